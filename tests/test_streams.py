"""Stateful streams against folds in Python, over several micro-batches and restarts."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from alertloom.operators import behaviour as be
from alertloom.operators import decisions as de
from alertloom.plans.catalog import QUERIES
from alertloom.schema import alerts
from alertloom.streaming import stateful as st


def fold(rows, least, decay=0.99, age_ms=None, keep=5):
    """(id, cluster) of rows (ms, id, vector) in order."""
    held, number, out = {}, 0, {}
    for ms, i, v in sorted(rows, key=lambda r: r[:2]):
        if age_ms is not None:
            held = {k: c for k, c in held.items() if c[1] >= keep or c[2] + age_ms > ms}
        x = np.array(v, dtype=float)
        sims = {k: float(c[0] @ x / (np.linalg.norm(c[0]) * np.linalg.norm(x) + 1e-8)) for k, c in held.items()}
        best = max(sims, key=lambda k: (sims[k], -k)) if sims else None
        if best is None or sims[best] <= least:
            best, number = number, number + 1
            held[best] = [x, 1, ms]
        else:
            held[best][0] = decay * held[best][0] + (1 - decay) * x
            held[best][1] += 1
        out[i] = best
    return out


def test_centroids_of_a_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.label].append((r.vec_id, r.vec_id, r.embedding))
    want = {k: fold(v, 0.3) for k, v in by.items()}
    got = QUERIES["k11_online_centroids"](spark, small).collect()
    assert len(got) == len(rows) and all(want[r.label][r.id] == r.cluster for r in got)
    streamed = QUERIES["st7_stream_centroids"](spark, small).collect()
    expired = {k: fold([(10_000 * i, i, v) for _, i, v in x], 0.3, age_ms=3_600_000) for k, x in by.items()}
    assert len(streamed) == len(rows) and all(expired[r.label][r.id] == r.cluster for r in streamed)


def test_centroids_expire_over_restarts(spark, tmp_path):
    """Files come one by one, the query is started anew for each; small centroids are gone after ten minutes."""
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["a", "b"]), 10**12 + 20_000 * k, [rnd.gauss(0, 1) for _ in range(3)]) for k in range(240)]
    schema = "id long, label string, ts timestamp, v array<double>"
    want = {key: fold([(ms, i, v) for i, label, ms, v in rows if label == key], 0.9, age_ms=600_000, keep=3) for key in "ab"}
    for part in range(4):
        own = [(i, label, ms / 1000, v) for i, label, ms, v in rows[60 * part : 60 * part + 60]]
        spark.createDataFrame(own, "id long, label string, s double, v array<double>").select("id", "label", F.expr("timestamp_millis(cast(s * 1000 as long))").alias("ts"), "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        st.finished(st.run_stream(st.centroid_stream(stream, "label", "v", "id", "ts", 0.9, max_age_minutes=10, keep=3), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(rows)
    assert all(want[r.label][r.id] == r.cluster for r in got)
    assert max(max(w.values()) for w in want.values()) > 20  # many came and went


def test_intervals_close_once_over_restarts(spark, small, tmp_path):
    """Interval anomalies of a stream in three runs are those of the batch; open ones that pass the upper bound are told once, before."""
    a = alerts(spark, small).select("SourceUserName", F.col("EndDate").cast("timestamp").alias("EndDate"))
    first = a.agg(F.min("EndDate")).first()[0]
    cut = F.date_add(F.to_date(F.lit(first)), 20)
    base = be.baseline(be.activity(a.where(F.to_date("EndDate") < cut), "interval")).where("user <> 'user_3'").cache()
    now = a.where(F.to_date("EndDate") >= cut).cache()
    want = be.anomalies(be.activity(now, "interval"), base).select("user", "day", "key", "n", "is_new", F.round("risk", 6)).collect()
    edges = [r[0] for r in now.select(F.expr("percentile_approx(unix_millis(EndDate), array(0.3, 0.7))")).collect()][0]
    for low, high in zip([0, *edges], [*edges, 1 << 60], strict=True):
        part = now.where((F.unix_millis("EndDate") >= low) & (F.unix_millis("EndDate") < high))
        if high == 1 << 60:
            part = part.unionByName(now.agg(F.lit("").alias("SourceUserName"), (F.max("EndDate") + F.expr("interval 1 day")).alias("EndDate")))
        part.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        found = st.interval_watch(spark.readStream.schema(now.schema).parquet(f"{tmp_path}/in"), base)
        st.finished(st.run_stream(found, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out").where("user <> ''")
    closed = got.where("closed").select("user", "day", "key", "n", "is_new", F.round("risk", 6)).collect()
    assert sorted(map(tuple, closed)) == sorted(map(tuple, want)) and want
    early = got.where("not closed").select("user", "day", "key").collect()
    assert len(early) == len(set(early))
    assert {r for r in map(tuple, early)} == {(r.user, r.day, r.key) for r in got.where("closed and risk > 69").collect()}


def test_online_centroids_odd_rows(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, None), (1, 2, [2.0, 0.0]), (None, 3, [1.0, 0.0]), (1, None, [1.0, 1.0]), (2, 4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "label int, id long, v array<double>")
    got = {(r.label, r.id): r.cluster for r in de.online_centroids(df, ["label"], "v", "id").collect()}
    assert got == {(1, 0): 0, (1, 2): 0, (None, 3): 0, (2, 4): 0}
    assert de.online_centroids(df.limit(0), ["label"], "v", "id").count() == 0


