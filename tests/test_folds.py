"""k-means, hierarchies, threshold adaptation and greedy windows against plain Python."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from alertloom.operators import baselines as ba
from alertloom.operators import decisions as de
from alertloom.operators import sampling as sa
from alertloom.operators import temporal as te
from alertloom.plans.catalog import QUERIES


def vectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}


def test_kmeans_ends_where_no_row_is_nearer_another_mean(spark, small):
    x = vectors(spark, small)
    got = {r.vec_id: r.cluster for r in QUERIES["k2_kmeans"](spark, small).select("vec_id", "cluster").collect()}
    assert got.keys() == x.keys()
    names = sorted(set(got.values()))
    means = np.stack([np.mean([x[i] for i in got if got[i] == c], axis=0) for c in names])
    away = sum(names[int(np.argmin(((means - x[i]) ** 2).sum(axis=1)))] != c for i, c in got.items())
    assert away <= 0.02 * len(got)  # the last move of the means may leave a few behind


def test_hierarchy_joins_micro_clusters_of_near_means(spark, small):
    x = vectors(spark, small)
    got = ba.hierarchy(spark.read.parquet(f"{small}/embeddings.parquet"), "embedding", "vec_id", micro=20, merge=0.3).collect()
    assert len(got) == len(x)
    micro = {r.vec_id: r.micro for r in got}
    means = {m: np.mean([x[i] for i in x if micro[i] == m], axis=0) for m in set(micro.values())}
    root = {m: m for m in means}
    for _ in means:
        for a in means:
            for b in means:
                if means[a] @ means[b] / np.linalg.norm(means[a]) / np.linalg.norm(means[b]) >= 0.3:
                    root[a] = root[b] = min(root[a], root[b])
    assert all(r.macro == root[r.micro] for r in got) and 1 < len(set(root.values()))


def test_mean_similarity_against_all_pairs(spark):
    rnd = np.random.default_rng(5)
    heads = rnd.normal(size=(6, 5))
    rows = [(int(c), (heads[c // 4] + 0.4 * rnd.normal(size=5)).tolist()) for c in range(24) for _ in range(int(rnd.integers(1, 6)))] + [(24, None), (25, [0.0] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "c long, v array<double>")
    unit = {}
    for c, v in rows:
        if c is not None:
            n = np.linalg.norm(v) if v is not None else 0
            unit.setdefault(c, []).append(np.array(v) / n if n else np.zeros(5))
    root = {c: c for c in unit}
    for _ in unit:
        for a in unit:
            for b in unit:
                if a != b and np.mean(np.stack(unit[a]) @ np.stack(unit[b]).T) >= 0.6:
                    root[a] = root[b] = min(root[a], root[b])
    for block_rows in (3, 2048):
        got = {r.c: r.merged for r in ba.mean_similarity_clusters(df, "c", "v", 0.6, block_rows).collect()}
        assert got == root
    assert len(set(root.values())) < len(root)
    assert ba.mean_similarity_clusters(df.limit(0), "c", "v", 0.6).count() == 0


def test_thresholds_fold_in_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.uniform(0, 100), rnd.random() < 0.3, k) for k in range(600)] + [("a", None, True, 601), ("a", 99.0, None, 602)]
    rnd.shuffle(rows)
    want = {}
    for u, r, bad, _ in sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: x[3]):
        t = want.setdefault(u, [31.0, 69.0, 0, 0, 0, 0])
        said = r < t[0] or r > t[1]
        t[2 + [(True, True), (True, False), (False, False), (False, True)].index((said, bad))] += 1
        if said and not bad:
            t[0], t[1] = max(5.0, t[0] - 1), min(95.0, t[1] + 1)
        elif bad and not said:
            t[0], t[1] = min(50.0, t[0] + 1), max(50.0, t[1] - 1)
    df = spark.createDataFrame(rows, "u string, r double, bad boolean, k long")
    got = {x[0]: list(x[1:]) for x in de.adapt_thresholds(df, "u", "r", "bad", "k").collect()}
    assert got == want
    assert de.adapt_thresholds(df.limit(0), "u", "r", "bad", "k").count() == 0


def test_greedy_windows_against_pairs(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.choice(["x", "y", None, "NIL"]), rnd.choice(["p", "q", "hot", "hot"]), rnd.choice([0, 5, 7, rnd.randrange(4000)])) for k in range(300)] + [(300, "x", "p", None)]
    df = spark.createDataFrame(rows, "alert_idx long, a string, b string, s long").withColumn("EndDate", F.timestamp_seconds("s"))
    up = {}
    for k, a, b, s in rows:
        near = [(t, j) for j, c, d, t in rows if s is not None and t is not None and s - 100 <= t <= s and ((a == c and a not in (None, "NIL")) or b == d)]
        up[k] = min(near)[1] if near else k
    root = {}
    for k in up:
        r = k
        while up[r] != r:
            r = up[r]
        root[k] = r
    got = {r.alert_idx: r.cluster for r in ba.greedy_windows(df, ["a", "b"], 100.0).collect()}
    assert got == root


def test_anchored_windows_of_runs_over_many_blocks(spark):
    """Blocks of four windows: runs that go through blocks as a whole, ties, gaps, a null entity, times below zero."""
    rnd, rows = random.Random(11), []
    for u in ("hot", "calm", None, "tied"):
        t = -2000.0
        for _ in range({"hot": 700}.get(u, 120)):
            t += {"hot": rnd.choice([1, 2, 9, 10]), "tied": rnd.choice([0, 0, 10])}.get(u, rnd.choice([1, 5, 11, 40]))
            rows.append((u, len(rows), t))
    rows.append(("hot", len(rows), None))
    df = spark.createDataFrame(rows, "u string, alert_idx long, s double").withColumn("EndDate", F.expr("timestamp_micros(cast(s * 1000000 as long))"))
    want, anchor = {}, {}
    for u, i, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if u not in anchor or t - anchor[u][0] > 10:
            anchor[u] = (t, i)
        want[i] = anchor[u][1]
    for block_widths in (4, None):
        got = te.anchored_windows(df, ["u"], 10.0, block_widths=block_widths).collect()
        assert {r.id: r.window for r in got} == want and len(got) == len(want)
        assert all(rows[r.id][0] == r.u for r in got)
    assert te.anchored_windows(df.limit(0), ["u"], 10.0).count() == 0


def test_ranks_by_ranges_of_hashes(spark):
    rows = [(k if k % 50 else k // 100, None if k % 7 == 0 else "big" if k % 3 else "small") for k in range(3000)]
    df = spark.createDataFrame(rows, "alert_idx long, c string")
    md5 = lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()
    want = {}
    for c in (None, "big", "small"):
        own = sorted(md5(i) for i, x in rows if x == c)
        for h in own:
            want[c, h] = (own.index(h) + 1, len(own))
    got = sa.hash_ranked(df, ["c"]).collect()
    assert len(got) == len(rows) and all(want[r.c, md5(r.alert_idx)] == (r._tied, r._n) for r in got)
    for c in (None, "big", "small"):
        assert sorted(r._r for r in got if r.c == c) == list(range(1, 1 + sum(x == c for _, x in rows)))
    least = {(c, h) for c in (None, "big", "small") for h in sorted(md5(i) for i, x in rows if x == c)[:5]}
    assert {(r.c, md5(r.alert_idx)) for r in sa.reservoir(df, 5, ["c"]).collect()} == least
