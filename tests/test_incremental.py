"""Batch-wise correlation against one correlation of all alerts."""

import time

import pytest
from pyspark.sql import functions as F

from alertloom.operators.correlation import correlate
from alertloom.schema import FieldRoles, alerts
from alertloom.streaming.incremental import IncrementalCorrelator
from alertloom.streaming.stateful import finished


def partition(rows, id_col="alert_idx", cluster="cluster"):
    by = {}
    for r in rows:
        by.setdefault(r[cluster], set()).add(r[id_col])
    return {frozenset(x) for x in by.values()}


@pytest.mark.parametrize("order", ["time", "hash"])
def test_any_split_gives_the_batch_s_clusters(spark, small, tmp_path, order):
    a = alerts(spark, small).where("alert_idx < 600").cache()
    key = {"time": F.col("alert_idx"), "hash": F.abs(F.xxhash64("alert_idx")) % 600}[order]
    roles = FieldRoles()
    loop = IncrementalCorrelator(f"{tmp_path}/state", roles, 0.5)
    schema, took = a.schema, []
    for low, high in ((0, 200), (200, 210), (210, 420), (420, 600)):
        a.where((key >= low) & (key < high)).write.mode("append").parquet(f"{tmp_path}/in")
        began = time.time()
        finished(loop.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", once=True))  # a restart each
        took.append(time.time() - began)
        seen = a.where(key < high)
        want = partition(correlate(seen, roles, 0.5).select("alert_idx", F.col("pred_cluster").alias("cluster")).collect())
        assert partition(loop.clusters(spark).collect()) == want
    found = loop.clusters(spark).collect()
    assert all(min(x.alert_idx for x in found if x.cluster == r.cluster) == r.cluster for r in found[:50])
    kinds = {r.kind for r in loop.changes(spark).collect()}
    assert kinds >= {"new", "grown"}


def test_merges_and_repeated_batches(spark, tmp_path):
    """Links as the index gives them; batch 2 joins clusters that batch 1 joined already, and runs twice."""
    loop = IncrementalCorrelator(f"{tmp_path}/state")
    batches = [[(5, 5), (6, 6), (8, 8), (9, 8)], [(7, 5), (7, 6)], [(1, 6), (1, 9), (2, 2)], [(3, 7), (4, 2)]]
    for k in (0, 1, 2, 2, 3):
        loop.batch(spark.createDataFrame(batches[k], "id long, head long"), k)
    assert partition(loop.clusters(spark).collect()) == {frozenset({1, 3, 5, 6, 7, 8, 9}), frozenset({2, 4})}
    got = {(r.batch, r.cluster): (r.added, r.joined, r.kind) for r in loop.changes(spark).collect()}
    assert got == {(0, 8): (2, 0, "new"), (1, 5): (1, 2, "merged"), (2, 1): (1, 2, "merged"), (3, 1): (1, 1, "grown"), (3, 2): (1, 1, "grown")}


def test_state_is_called_for_a_part_not_a_group():
    """A bucket of 3,000 groups costs a few calls a part, and heads are those that were seen first."""
    import pandas as pd

    from alertloom.streaming.incremental import PARTS, _Heads

    class State(dict):
        calls = 0

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    class Handle:
        def getMapState(self, name, key, value):
            return State()

    heads, at = _Heads(), [(i << 20) - 1 for i in range(3000)]
    heads.init(Handle())
    first = pd.DataFrame({"id": [*range(3000, 6000), *range(3000)], "h": at * 2, "g": at * 2})
    out = pd.concat(list(heads.handleInputRows((0,), iter([first]), None)))
    assert {(r.id, r.head) for r in out.itertuples()} == {(i, i % 3000) for i in range(6000)}
    assert heads.heads.calls <= 3 * PARTS
    again = pd.DataFrame({"id": [-5, -5, -4], "h": [at[7], 1 << 50, at[8]], "g": [at[7], 5, -8]})
    out = pd.concat(list(heads.handleInputRows((0,), iter([again]), None)))
    assert {(r.id, r.head) for r in out.itertuples()} == {(-5, 7), (-5, -5), (-4, -4)}
    assert sum(len(v[0]) for v in heads.heads.values()) == 3002 * 24
