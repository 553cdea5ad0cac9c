import numpy as np
import pandas as pd

from alertloom.llm import embedding_dedup as ed
from alertloom.llm.queries import QUERIES


def brute(x):
    """links and component of each row."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    u = x / np.where(n > 0, n, 1)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[hit[i]]]) for i in range(len(x))])
        if (new == comp).all():
            return hit.sum(axis=1), comp
        comp = new


def test_query_against_brute_force(spark, small):
    got = QUERIES["op2_embeddings"](spark, small).toPandas().sort_values("vec_id")
    pdf = pd.read_parquet(f"{small}/embeddings.parquet").sort_values("vec_id")
    links, comp = brute(np.stack(pdf.embedding).astype(float))
    assert got.vec_id.tolist() == pdf.vec_id.tolist()
    assert got.n_links.tolist() == links.tolist()
    assert got.component_id.tolist() == pdf.vec_id.to_numpy()[comp].tolist()


def test_clusters_copies_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([c + rng.normal(scale=0.18, size=(rng.integers(1, 30), 32)) for c in centres] + [np.repeat(centres[:1], 40, axis=0)]).astype(np.float32)
    links, comp = brute(x.astype(float))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    n = len(rows)
    odd = [None, [0.0] * 32, [float("nan")] * 32, [1.0, None] * 16, [float("inf")] * 32, [], [1.0, 2.0]]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, VEC_ID int").repartition(4)
    got = ed.near_vectors(df).toPandas()
    one = got[got.vec_id.notna() & (got.vec_id < n)].sort_values("vec_id")
    extra = np.array([float(np.dot(x[0], v) / np.linalg.norm(x[0]) / np.linalg.norm(v)) >= 0.9 for v in x.astype(float)])
    found = one.n_links.to_numpy() - extra
    assert found.sum() >= 0.98 * links.sum() and (found <= links).all()
    assert (one.component_id.to_numpy() == comp).mean() > 0.98
    rest = got[got.vec_id >= n]
    assert (rest.n_links == 0).all() and rest.kept.all()
    assert len(got) == len(rows)
    assert ed.near_vectors(df.limit(0)).count() == 0


def test_blocks_count_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(1, 16)) + rng.normal(scale=0.25, size=(150, 16))).astype(np.float32)
    links, comp = brute(x.astype(float))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ed.near_vectors(df).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == links.tolist() and got.component_id.tolist() == comp.tolist()


def lone_pairs(rng, n, cosine, d=64):
    """n pairs of unit vectors with that cosine, each far from all others."""
    a, b = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_lone_pairs_beside_a_crowd(spark):
    rng = np.random.default_rng(3)
    crowd = rng.normal(size=(3000, 64))
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    c = np.zeros(64)
    c[0] = 1
    # all of the cone are at about 0.8 to each other, and 200 pairs in it at 0.9
    cone = np.sqrt(0.8) * c + np.sqrt(0.2) * np.concatenate([*lone_pairs(rng, 200, 0.5025), crowd])
    x = np.concatenate([*lone_pairs(rng, 200, 0.9005), cone, rng.normal(size=(4000, 64))])
    links, comp = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ed.near_vectors(df).toPandas().sort_values("vec_id")
    linked = links > 0
    assert linked.sum() >= 800
    assert (got.n_links.to_numpy() == links)[linked].mean() >= 0.97 and (got.n_links.to_numpy() <= links).all()
    assert (got.component_id.to_numpy() == comp).mean() >= 0.98


def test_plan_holds_recall_at_any_size():
    for n in (1, 512, 513, 50_000, 10**6, 10**8):
        passes, bits = ed.plan(n)
        assert n / 2**bits <= ed.BUCKET and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes >= ed.RECALL
