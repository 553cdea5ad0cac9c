"""Silhouettes by blocks of means against all pairs."""

import numpy as np
import pytest

from alertloom.operators.summaries import silhouette


@pytest.mark.parametrize("block", [24, 10**6])
def test_silhouette_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, f"c{i % 9}", rng.normal(i % 9, 2, 6).tolist()) for i in range(70)] + [(70, "alone", [0.5] * 6)]
    x, c = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {}
    for i in range(len(rows)):
        same = (c == c[i]).sum()
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        a = d[i, c == c[i]].sum() / (same - 1) if same > 1 else None
        want[i] = 0.0 if a is None else (b - a) / max(a, b)
    more = [(71, None, [1.0] * 6), (72, "c1", None)]
    df = spark.createDataFrame([*rows, *more], "id long, c string, x array<double>")
    got = {r.id: r.silhouette for r in silhouette(df.where("id < 71"), "id", "c", "x", block, 20).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    rest = {r.id: r.silhouette for r in silhouette(df, "id", "c", "x", block, 20).collect()}
    assert rest[71] == rest[72] == 0.0 and len(rest) == 73
    assert silhouette(df.limit(0), "id", "c", "x").count() == 0
