"""Nearest-neighbour candidates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators.knn import alert_vector, nearest_candidates
from alertloom.schema import FieldRoles, alerts

PASSES, WINDOW, THROUGH, K = 36, 6, 5, 10


@pytest.mark.parametrize(("d", "least", "n"), [("sf0.01", 0, 10_000), ("sf0.1", 0, 20_000)])
def test_recall_with_few_comparisons(spark, d, least, n):
    a = alerts(spark, f"/root/testdata/{d}").where((F.col("alert_idx") >= least) & (F.col("alert_idx") < least + n))
    x = alert_vector(a, FieldRoles()).select("alert_idx", "vector").cache()
    rows = x.orderBy("alert_idx").collect()
    ids = np.array([r.alert_idx for r in rows])
    v = np.array([r.vector for r in rows], dtype=np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    worst = np.zeros(len(v))  # cosine of each row's k-th nearest
    for lo in range(0, len(v), 2000):
        s = v[lo : lo + 2000] @ v.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -1
        worst[lo : lo + 2000] = np.partition(s, -K, axis=1)[:, -K]
    got = nearest_candidates(x, "vector", "alert_idx", K, PASSES, WINDOW, through=THROUGH).toPandas()
    place = np.searchsorted(ids, got.id.to_numpy())
    hits = (got.cosine.to_numpy() >= worst[place] - 1e-5).sum()
    real = np.einsum("ij,ij->i", v[place], v[np.searchsorted(ids, got.other.to_numpy())])
    assert np.allclose(real, got.cosine, atol=1e-5) and (got.id != got.other).all()
    assert got.groupby("id").size().max() == K and not got.duplicated(["id", "other"]).any()
    share = (2 * WINDOW * PASSES + THROUGH**2) / len(v)
    print("recall", len(v), hits / (K * len(v)), share)
    assert share < 0.05 and hits >= 0.9 * K * len(v)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (None, [1.0, 0.0]), (4, None), (5, [0.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = {(r.id, r.other) for r in nearest_candidates(df, "v", "i", k=1, passes=3, window=2).collect()}
    assert got >= {(1, 2), (2, 1)} and {i for i, _ in got} == {1, 2, 5}
    assert nearest_candidates(df.limit(0), "v", "i").count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_passes_shuffle_few_bytes(spark):
    a = alerts(spark, "/root/testdata/sf0.01").where("alert_idx < 4000")
    x = alert_vector(a, FieldRoles()).select("alert_idx", "vector")
    before = shuffled(spark)
    assert nearest_candidates(x, "vector", "alert_idx").count() == 40_000
    assert shuffled(spark) - before < 4000 * 5000  # 10,000 to 12,000 bytes a row when each pass told the ten best of its windows


def test_alike_rows_are_told_once(spark):
    # 30 kinds of 40 rows: nearly all rows' ten nearest are of their kind, and other passes tell hardly anything
    df = spark.range(1200).selectExpr("id", "array(1D + id % 30, id % 30 % 7 + 0D, 3D, (id div 30) / 1000D) as v")
    before = shuffled(spark)
    got = nearest_candidates(df, "v", "id").toPandas()
    assert len(got) == 12_000 and shuffled(spark) - before < 1200 * 2600
    v = np.array([[1.0 + i % 30, i % 30 % 7, 3.0, i // 30 / 1000] for i in range(1200)], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(np.einsum("ij,ij->i", v[got.id], v[got.other]), got.cosine, atol=1e-5)
    assert (got.id % 30 == got.other % 30).mean() > 0.95


def test_any_values_and_places(spark):
    rng = np.random.default_rng(5)
    v = np.where(rng.random((60, 400)) < 0.03, rng.integers(1, 4, (60, 400)), 0).astype(float)
    v[:20, 300:] = 0  # rows of few places and counts,
    v[20:40, :] *= 0.37  # of fractions,
    v[40, 7], v[41, 9] = 256.0, -2.0  # and of values that a byte can't hold
    v[:, -1] = rng.random(60)
    df = spark.createDataFrame([(i * 10, [float(x) for x in r]) for i, r in enumerate(v)], "i long, v array<double>")
    got = {(r.id, r.other): r.cosine for r in nearest_candidates(df, "v", "i", k=5, passes=40, window=30).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    worst = np.sort(s, axis=1)[:, -5]
    assert len(got) == 300
    for (i, j), c in got.items():
        assert abs(c - s[i // 10, j // 10]) < 1e-6 and s[i // 10, j // 10] >= worst[i // 10] - 1e-6


def test_others_of_an_id_are_put_together_over_batches():
    import pyarrow as pa

    from alertloom.operators.knn import _PAIR, _best

    def row(i, *pairs):
        return i, 0.0, np.array(list(pairs), dtype=_PAIR).tobytes()

    rows = [row(1, (0.5, 7), (0.5, 3)), row(2, (0.1, 9)), row(2, (0.9, 4), (0.1, 8)), row(2, (0.9, 4)), row(5, (0.2, 1))]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]], pa.float32()), pa.array([r[2]], pa.binary())], ["id", "least", "found"]) for r in rows]
    got = [(i, least, np.frombuffer(f, dtype=_PAIR).tolist()) for b in _best(2)(iter(batches)) for i, least, f in zip(*[c.to_pylist() for c in b.columns])]
    f = lambda x: float(np.float32(x))
    assert got == [(1, 0.5, [(0.5, 3), (0.5, 7)]), (2, f(0.1), [(f(0.9), 4), (f(0.1), 8)]), (5, -np.inf, [(f(0.2), 1)])]
