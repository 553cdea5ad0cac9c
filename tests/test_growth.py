"""Plans whose work must not grow faster than their input."""

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tactics_are_scored_once_a_label(spark):
    from alertloom.functions.tactics import with_tactics

    df = spark.range(50).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("DDoS"), (F.col("id") % 3).cast("string"))).alias("label"))
    got = with_tactics(df, "label").where("tactic not in ('None')")
    scan = plan(got).split("Aggregate")[-1]  # what lies below the last aggregate works on rows
    assert "Reconnaissance" not in scan
    assert got.count() == 50


def test_exploded_rows_are_not_broadcast(spark, small):
    from alertloom.operators import correlation as co
    from alertloom.schema import FieldRoles, alerts

    a = alerts(spark, small)
    for df in (co.links(a, FieldRoles(), 0.5), co.links(a, FieldRoles(), 0.45, time_col="EndDate"), co.blocked_links(a, FieldRoles(), 0.5), co.max_scores(a, FieldRoles())):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_exploded_pairs_are_not_broadcast(spark, small):
    from alertloom.operators.reports import common_value_pairs
    from alertloom.schema import FieldRoles, alerts

    p = plan(common_value_pairs(alerts(spark, small), "user_id", FieldRoles()))
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def test_nearest_rows_meet_few_blocks(spark, monkeypatch):
    import numpy as np

    from alertloom.operators import neighbours as ne

    monkeypatch.setattr(ne, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [("a", i, [float(rng.integers(0, 9)) if i % 3 else None, float(rng.integers(0, 40)), float(rng.integers(0, 400))]) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    asked = df.where("v[0] is null and id < 600").selectExpr("g", "id", "0 as place", "v")
    sent, compared = [], ne._compared
    monkeypatch.setattr(ne, "_compared", lambda s, laid, k: sent.append(s) or compared(s, laid, k))
    got = {(r.id, r.rank): (r.other, round(r.d, 9)) for r in ne.nearest(asked, df, 2).collect()}
    for _, i, v in rows[:600:3]:
        far = sorted((round(float(np.sqrt(1.5 * ((v[1] - y[1]) ** 2 + (v[2] - y[2]) ** 2))), 9), j) for _, j, y in rows if y[0] is not None and j != i)
        assert [got[i, 1], got[i, 2]] == [(j, d) for d, j in far[:2]]
    assert sum(s.count() for s in sent) < 200 * 8  # of some 21 blocks that have the component


def test_few_signs_make_no_join(spark, small):
    from alertloom.operators.baselines import cosine_links

    p = plan(cosine_links(spark.read.parquet(f"{small}/embeddings.parquet"), "embedding", "vec_id", 0.35, bits=4, tables=20))
    assert "Join" not in p


def test_hashed_features_cost_their_columns_not_their_places(spark):
    from alertloom.functions.features import hashed_features

    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(f"x{i}", f"y{i % 7}", None if i % 3 else f"z{i}", "NIL") for i in range(300)], "a string, b string, c string, d string")
    for size in (1, 2, 5, 64):
        own = [F.expr(f"pmod(xxhash64(concat('{c}=', coalesce(nullif({c}, 'NIL'), ''))), {size}L)").alias(f"p{c}") for c in names]
        got = df.select(*own, hashed_features(names, size).alias("v"))
        assert "filter(" not in plan(got)  # which looked through all columns for each place
        for r in got.collect():
            assert r.v == [float(sum(r[f"p{c}"] == i for c in names)) for i in range(size)]


def test_ward_sends_clusters_to_a_fixed_number_of_blocks(spark, monkeypatch):
    import numpy as np

    from alertloom.operators import neighbours as ne

    monkeypatch.setattr(ne, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    c = rng.integers(0, 6, size=(400, 3)).astype(float)
    df = spark.createDataFrame([(i * 3, float(1 + i % 3), [float(x) for x in v]) for i, v in enumerate(c)], "id long, n double, c array<double>")
    found = ne._nearest_clusters(df, 400)
    assert ne._ward_blocks(400) == ne.WARD_BLOCKS and "CoGroup" in plan(found)  # 50 blocks of 8 rows before: each row was sent to all of them
    n = 1.0 + np.arange(400) % 3
    d = ((c[:, None] - c[None]) ** 2).sum(2) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(d, np.inf)
    rows = {r.id: r for r in found.collect()}
    assert len(rows) == 400
    for i in range(400):
        r, near = rows[i * 3], int(d[i].argmin())
        assert (r.a, r.b) == tuple(sorted((i * 3, near * 3))) and abs(r.d - d[i, near]) < 1e-9
