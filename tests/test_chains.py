"""Chains by pointers over blocks against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.functions.scalars import RELATED, related_mask
from alertloom.operators.chains import chains

LABELS = ["Web", "SQL injection", "Recon-PortScan", "DoS-Syn", "Mirai dos", "Benign", "Odd", None]


def fold(rows, gap, masks):
    out, state = {}, {}
    for e, t, label, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[3])):
        m = masks[label]
        old = state.get(e)
        if old is None or (t is not None and old[3] is not None and t - old[3] > gap) or not (label == old[1] or m & old[2]):
            old = (i, label, m, t)
        state[e] = (*old[:3], t)
        out[i] = old[0]
    return out


@pytest.mark.parametrize("block_rows,labels,gap", [(40, LABELS, 30), (25, ["Benign", "Odd", None], 1000), (25, ["Mirai dos", "DoS-Syn", "Mirai", "Odd"], 1000), (100_000, LABELS, 30)])
def test_chains_over_blocks(spark, block_rows, labels, gap):
    rng, rows, t = random.Random(7 + block_rows + len(labels)), [], 0
    for i in range(900):
        t += rng.choice([0, 0, 1, 5, 20, 40])
        label = labels[0] if rng.random() < 0.6 else rng.choice(labels)
        rows.append((rng.choice(["hot"] * 6 + ["b", None]), None if i % 97 == 0 else t, label, i))
    df = spark.createDataFrame(rows, "entity string, t long, label string, alert_idx long").withColumn("EndDate", F.timestamp_seconds("t"))
    masks = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", related_mask(F.col("l"))).collect()}
    got = {r.id: r.chain for r in chains(df.repartition(3), ["entity"], "label", gap, block_rows=block_rows).collect()}
    assert got == fold(rows, gap, masks)
    assert len(RELATED) < 10  # windows see a row for each set of groups


def test_one_moment_and_one_label_fill_many_blocks(spark):
    df = spark.range(400).select(F.lit("x").alias("entity"), F.timestamp_seconds(F.lit(5)).alias("EndDate"), F.when(F.col("id") == 377, "Odd").otherwise("Benign").alias("label"), F.col("id").alias("alert_idx"))
    got = {r.id: r.chain for r in chains(df, ["entity"], "label", 10, block_rows=20).collect()}
    assert got == {i: 0 if i < 377 else (377 if i == 377 else 378) for i in range(400)}
    assert chains(df.limit(0), ["entity"], "label").count() == 0
