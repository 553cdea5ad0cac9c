"""Nearest rows, imputation, synthetic rows, Ward's agglomeration and the isolation forest against brute force."""

import math

import numpy as np
import pytest

from alertloom.operators import forest as fo
from alertloom.operators import neighbours as ne


def naive_ward(points, k):
    """Clusters by merging the cheapest pair, one at a time."""
    parts = [([i], np.array(p, dtype=float)) for i, p in points]
    while len(parts) > k:
        cost = lambda a, b: len(a[0]) * len(b[0]) / (len(a[0]) + len(b[0])) * ((a[1] - b[1]) ** 2).sum()
        i, j = min(((i, j) for i in range(len(parts)) for j in range(i + 1, len(parts))), key=lambda p: cost(parts[p[0]], parts[p[1]]))
        a, b = parts[i], parts.pop(j)
        parts[i] = (a[0] + b[0], (a[1] * len(a[0]) + b[1] * len(b[0])) / (len(a[0]) + len(b[0])))
    return {x: min(ids) for ids, _ in parts for x in ids}


@pytest.mark.parametrize("few, block, k", [(1000, 1024, 17), (1000, 1024, 3), (12, 16, 5)])
def test_ward_is_that_of_single_merges(spark, monkeypatch, few, block, k):
    monkeypatch.setattr(ne, "BLOCK_ROWS", block)
    rng = np.random.default_rng(k)
    points = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(48)]
    got = ne.agglomerate(spark.createDataFrame(points, "id long, v array<double>"), "v", "id", k, few)
    assert {r.id: r.cluster for r in got.collect()} == naive_ward(points, k)


def test_ward_of_odd_rows(spark):
    schema = "id long, v array<double>"
    rows = [(1, [0.0]), (2, [0.0]), (3, [9.0]), (4, None), (5, [None]), (6, [float("nan")]), (None, [1.0]), (7, [9.5])]
    got = ne.agglomerate(spark.createDataFrame(rows, schema), "v", "id", 2)
    assert {r.id: r.cluster for r in got.collect()} == {1: 1, 2: 1, 3: 3, 7: 3}
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)], schema)
    assert len({r.cluster for r in ne.agglomerate(same, "v", "id").collect()}) == 6  # ties: a fifth of the rows
    assert ne.agglomerate(spark.createDataFrame([], schema), "v", "id").count() == 0
    assert ne.agglomerate(spark.createDataFrame(rows[:1], schema), "v", "id").first().cluster == 1


def naive_impute(rows, k):
    out = []
    for i, *x in rows:
        new = list(x)
        for c, value in enumerate(x):
            if value is not None:
                continue
            near = []
            for j, *y in rows:
                both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
                if j != i and y[c] is not None and both:
                    near.append((math.sqrt(sum((a - b) ** 2 for a, b in both) * len(x) / len(both)), j, y[c]))
            values = [v for *_, v in sorted(near)[:k]] or [y[c] for _, *y in rows if y[c] is not None]
            new[c] = sum(values) / len(values) if values else None
        out.append((i, *new))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_imputed_values(spark, monkeypatch, block):
    monkeypatch.setattr(ne, "BLOCK_ROWS", block)
    rng = np.random.default_rng(block)
    cell = lambda: None if rng.random() < 0.3 else float(rng.integers(0, 50))
    rows = [(i, cell(), cell(), cell(), None) for i in range(40)] + [(100 + i, 1.0, 2.0, 3.0, None) for i in range(9)] + [(200, None, None, None, None), (201, 1.0, None, 3.0, None)]
    got = ne.impute(spark.createDataFrame(rows, "alert_idx long, a double, b double, c double, d double"), ["a", "b", "c", "d"])
    assert got.columns == ["alert_idx", "a", "b", "c", "d"]
    have = {r[0]: tuple(r[1:]) for r in got.collect()}
    for i, *want in naive_impute(rows, 2):
        assert have[i] == pytest.approx(tuple(want)), i


def test_imputed_empty(spark):
    none = spark.createDataFrame([], "alert_idx long, a double, name string")
    assert ne.impute(none, ["a"]).count() == 0


def test_synthetic_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "big", float(rng.normal()), float(rng.normal())) for i in range(60)] + [(100 + i, "small", 10.0 + float(rng.random()), float(rng.random())) for i in range(7)]
    rows += [(200, "lone", 5.0, 5.0), (300, None, 1.0, 1.0), (301, "big", None, 1.0)]
    got = ne.synthetic_minority(spark.createDataFrame(rows, "alert_idx long, kind string, x double, y double"), "kind", ["x", "y"], k=3).collect()
    count = {}
    for r in got:
        count[r.kind] = count.get(r.kind, 0) + 1
    assert count == {"big": 60, "small": 60, "lone": 60}
    small = {r[0]: np.array(r[2:]) for r in rows if r[1] == "small"}
    for r in got:
        if r.kind == "lone":
            assert (r.x, r.y) == (5.0, 5.0)
        if r.kind == "small" and r.copy:
            own, p = small[r.alert_idx], np.array([r.x, r.y])
            near = sorted((v for i, v in small.items() if i != r.alert_idx), key=lambda v: ((v - own) ** 2).sum())[:3]
            assert any(abs(np.linalg.norm(p - own) + np.linalg.norm(p - v) - np.linalg.norm(v - own)) < 1e-9 for v in near)
    assert len({(r.kind, r.alert_idx, r.copy) for r in got}) == len(got)


def test_forest_depths_and_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    tree = fo.grow(x[:256], rng, 8)

    def walk(row):
        at = 0
        while tree[0][at] >= 0:
            at = tree[2][at] + int(row[tree[0][at]] > tree[1][at])
        return tree[3][at]

    assert list(fo.depths(tree, x)) == [walk(r) for r in x]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(900, 30.0, -30.0, 30.0), (901, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: r.forest_score for r in fo.forest_score(df, ["a", "b", "c"], fo.fit_forest(df, ["a", "b", "c"], "id")).collect()}
    assert max(got, key=got.get) == 900 and got[901] == 0.0 and all(50 <= s <= 100 for i, s in got.items() if i != 901)
    none = fo.fit_forest(df.limit(5), ["a", "b", "c"], "id")
    assert none[0] == [] and fo.forest_score(df, ["a", "b", "c"], none).where("forest_score > 0").count() == 0


def test_ward_compares_new_clusters_only(spark, monkeypatch):
    monkeypatch.setattr(ne, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(8)
    points = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(160)]
    whole, searched, sent = [], ne._searched, []
    monkeypatch.setattr(ne, "_nearest_clusters", lambda now, count: whole.append(count))  # which every round did before
    monkeypatch.setattr(ne, "_searched", lambda now, count, fresh, wide: sent.append((count, fresh, wide)) or searched(now, count, fresh, wide))
    got = ne.agglomerate(spark.createDataFrame(points, "id long, v array<double>"), "v", "id", 9, 8)
    assert {r.id: r.cluster for r in got.collect()} == naive_ward(points, 9)
    assert not whole and len(sent) > 3 and sent[0][1] == 160 and not any(w for *_, w in sent)
    assert sum(f for _, f, _ in sent[1:]) < 1.3 * 160  # merges are 159


@pytest.mark.parametrize("once, wide", [(True, False), (False, False), (False, True)])
def test_nearest_clusters_are_told(once, wide):
    import pandas as pd

    rng = np.random.default_rng(9)

    def side(ids, fresh):
        k = len(ids)
        return pd.DataFrame({"p": 0, "q": 1, "id": ids, "n": rng.integers(1, 4, k).astype(float), "c": list(rng.normal(size=(k, 5))), "fresh": fresh, "beyond": 1.5})

    a = side(np.arange(700), True).assign(once=once, keep=3, wide=wide)
    b = side(np.arange(1000, 2500), True) if once else pd.concat([side(np.arange(1000, 2300), False), a[["p", "q", "id", "n", "c", "fresh", "beyond"]].iloc[::2]])
    got = ne._told(a, b)
    cost = lambda x, y: x.n * y.n / (x.n + y.n) * ((x.c - y.c) ** 2).sum()
    rows = {r.id: r for r in [*a.itertuples(), *b.itertuples()]}
    limit = {r.id: r.d for r in got.itertuples() if r.id == r.other}
    listed = {(r.id, r.other): r.d for r in got.itertuples() if r.id != r.other}
    for (i, j), d in listed.items():
        assert abs(d - cost(rows[i], rows[j])) < 1e-9
    for x in [*a.itertuples()][:40]:
        near = sorted((cost(x, y), y.id) for y in b.itertuples() if y.id != x.id)
        assert all((x.id, j) in listed for d, j in near if d < limit[x.id]) and limit[x.id] > near[1][0]
    for y in [*b.itertuples()][:40]:
        assert (y.id in limit) == once
        most = limit[y.id] if once else y.beyond
        assert all((y.id, x.id) in listed for x in a.itertuples() if cost(x, y) < most)


def test_ward_of_near_and_equally_far_rows(spark, monkeypatch):
    monkeypatch.setattr(ne, "BLOCK_ROWS", 16)
    schema, rng = "id long, v array<double>", np.random.default_rng(10)
    # far apart, and nearer to each other than single precision tells
    near = [(i, [1000.0 * (i % 3) + float(rng.normal()) * 1e-4, float(rng.normal()) * 1e-4]) for i in range(60)]
    assert {r.id: r.cluster for r in ne.agglomerate(spark.createDataFrame(near, schema), "v", "id", 7, 8).collect()} == naive_ward(near, 7)
    grid = [(i, [float(i % 6), float(i // 6 % 6), float(i // 36)]) for i in range(108)]  # costs are equal
    merges = ne.ward_merges(spark.createDataFrame(grid, schema), "v", "id", 8).collect()
    parent = list(range(108))
    for r in sorted(merges, key=lambda r: (r.d, r.a, r.b)):
        a, b = root(parent, r.a), root(parent, r.b)
        assert r.a < r.b and a != b
        parent[max(a, b)] = min(a, b)
    assert len(merges) == 107


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x
