import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from alertloom.functions import scalars as s
from alertloom.operators import correlation as co
from alertloom.operators import evaluation as ev
from alertloom.operators import graph as gr
from alertloom.operators import intel
from alertloom.operators.components import connected_components
from alertloom.schema import FieldRoles, alerts
from alertloom.sources import connectors, files, sinks
from alertloom.streaming import live


def brute_components(rows, roles, threshold, temporal):
    cols = [*roles.addresses, *roles.usernames]
    full = co.scale(roles, temporal)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        w = sum((6 if c in roles.addresses else 3) for c in cols if rows[i][c] not in (None, "NIL") and rows[i][c] == rows[j][c])
        a, b = rows[i]["t"], rows[j]["t"]
        w += max(0.0, 1 - abs(a - b) / 3600) if temporal and a is not None and b is not None else 0
        if w >= threshold * full - 1e-9:
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("temporal,threshold", [(False, 0.4), (True, 0.45), (True, 0.3)])
def test_correlation_equals_all_pairs(spark, temporal, threshold):
    rnd = random.Random(int(100 * threshold) + temporal)
    roles = FieldRoles(["A", "B"], ["U"])
    rows = [{"alert_idx": i, "A": rnd.choice(["1", "2", "3", "NIL"]), "B": rnd.choice(["1", "2", "3", "4", None]), "U": rnd.choice("abcde"), "t": rnd.choice([rnd.randrange(20000), rnd.randrange(20000), None])} for i in range(60)]
    df = spark.createDataFrame([(r["alert_idx"], r["A"], r["B"], r["U"], r["t"]) for r in rows], "alert_idx long, A string, B string, U string, t long").withColumn("EndDate", F.timestamp_seconds("t"))
    got = {r.alert_idx: r.pred_cluster for r in co.correlate(df, roles, threshold, time_col="EndDate" if temporal else None).collect()}
    want = brute_components(rows, roles, threshold, temporal)
    number = {r: k for k, r in enumerate(sorted(set(want)))}
    assert got == {i: number[r] for i, r in enumerate(want)}


def test_missing_roles_are_refused(spark):
    with pytest.raises(ValueError):
        co.correlate(spark.range(3).withColumnRenamed("id", "alert_idx"))


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(edges).select("component").distinct().count() == 1
    assert connected_components(edges.limit(0)).count() == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(0.9,), (0.85,), (0.92,), (0.88,)], "c double")
    assert co.confidence_threshold(df, "c").first()[0] == pytest.approx(0.6875)
    assert co.confidence_threshold(df.limit(0), "c").first()[0] == pytest.approx(0.3)


def test_isolated_row_scores_zero(spark, small):
    roles = FieldRoles(["A"], ["U"])
    df = spark.createDataFrame([(0, "1", "x"), (1, "1", "x"), (2, "9", "y")], "alert_idx long, A string, U string")
    got = {r.alert_idx: r.max_correlation_score for r in co.max_scores(df, roles).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.0}


def test_scalars(spark):
    df = spark.createDataFrame([("a@b.org", "1.2.3.4", "dos flood")], "m string, ip string, l string")
    r = df.select(s.email_domain(F.col("m")), s.subnet24(F.col("ip")), s.tactic_by_rules(F.col("l")), s.related_mask(F.col("l"))).first()
    assert tuple(r) == ("b.org", "1.2.3", "Impact", 8)
    stage = lambda *t: spark.range(1).select(s.attack_stage(F.array(*map(F.lit, t)))).first()[0]
    assert stage("INITIAL ACCESS", "EXECUTION") == "Initial" and stage("IMPACT") == "Other"
    assert stage("PERSISTENCE", "CREDENTIAL ACCESS", "COLLECTION", "EXFILTRATION") == "Potential Hit"


def test_agreement_with_itself_is_perfect(spark):
    t = ev.contingency(spark.range(50).select((F.col("id") % 7).alias("true"), (F.col("id") % 7).alias("pred")))
    assert tuple(ev.pair_scores(t).first()) == (1.0, 1.0)
    assert [round(x, 9) for x in ev.information_scores(t).first()] == [1.0, 1.0, 1.0]
    assert ev.mapped_accuracy(t) == 1.0


def test_hungarian_against_all_permutations():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(1, 6)
        c = [[rnd.randint(0, 20) for _ in range(n)] for _ in range(n)]
        best = min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(c[i][j] for i, j in enumerate(ev.hungarian(c))) == best


def test_mapped_accuracy_of_uneven_tables(spark):
    rnd = random.Random(5)
    cells = {("a", p): rnd.randint(1, 9) for p in range(4)} | {("b", p): rnd.randint(1, 9) for p in range(2)} | {("c", 7): 5, ("d", 7): 6, ("e", 8): 2}
    t = spark.createDataFrame([(x, y, n) for (x, y), n in cells.items()], "true string, pred int, n long")
    best = max(sum(cells.get((x, y), 0) for x, y in zip("abcde", p)) for p in itertools.permutations([0, 1, 2, 3, 7, 8], 5))
    assert abs(ev.mapped_accuracy(t) - best / sum(cells.values())) < 1e-12
    assert ev.mapped_accuracy(t.limit(0)) == 0.0


def test_betweenness_of_a_star(spark):
    e = spark.createDataFrame([("hub", x) for x in "abcde"], "src string, dst string")
    got = {r.node: r.betweenness for r in gr.betweenness(e).collect()}
    assert got["hub"] == 1.0 and got["a"] == 0.0


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, None, "y")], "id long, a string, b string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", ("id", "a")).count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/csv", ("missing",))
    sinks.write_parquet(df, f"{tmp_path}/p", ["id"])
    assert files.read_cluster(spark, f"{tmp_path}/p", 2, "id").collect()[0].a is None
    for v in range(4):
        sinks.write_version(df, f"{tmp_path}/v", v, keep=2)
    assert spark.read.parquet(f"{tmp_path}/v").select("version").distinct().count() == 2
    (tmp_path / "f.jsonl").write_text('{"feedback_id": "1", "cluster_id": 3}\nnot json\n')
    assert files.read_feedback(spark, f"{tmp_path}/f.jsonl").count() == 1
    (tmp_path / "t.json").write_text(json.dumps({"techniques": [{"id": "T1", "name": "N", "tactics": ["impact", "discovery"]}]}))
    assert intel.technique_table(spark, f"{tmp_path}/t.json").first().severity == 0.9
    assert "| id | a | b |" in sinks.markdown(df, "t")
    ticks = files.ensure_timestamp(df, id_col="id").select("timestamp").distinct().count()
    assert ticks == 2
    seen = df.selectExpr("a AS path", "b AS digest")
    assert files.new_files(seen, seen.unionByName(spark.createDataFrame([("n", "d")], "path string, digest string")).na.fill("?")).count() >= 1


def test_connector(spark):
    asked = "asked"

    def transport(request):
        return [{"host": f"h{request['page']}", "what": asked if "earliest=5" in request["body"].replace("%3D", "=") else "all"}]

    connectors.register(spark, "splunk", "host string, what string", transport)
    got = spark.read.format("alerts_splunk").option("url", "https://x").option("since", "5").option("pages", "3").load()
    assert sorted((r.host, r.what) for r in got.collect()) == [("h0", "asked"), ("h1", "asked"), ("h2", "asked")]
    for name, build in connectors.CONNECTORS.items():
        assert "https://x" in build({"url": "https://x", "since": "2024-01-01"}).url, name


def test_live_loop_finds_what_a_batch_finds(spark, small, tmp_path):
    a = alerts(spark, small).where("alert_idx < 240")
    for k in range(3):
        a.where((F.col("alert_idx") >= 80 * k) & (F.col("alert_idx") < 80 * (k + 1))).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    loop = live.LiveCorrelator(f"{tmp_path}/out", threshold=0.5)
    loop.start(stream, f"{tmp_path}/cp", once=True).awaitTermination()
    emitted = {r.cluster_key for r in loop.emitted(spark).collect()}
    whole = {r.cluster_key for r in live.cluster_keys(co.correlate(a, FieldRoles(), 0.5)).where("size >= 2").collect()}
    assert whole <= emitted and loop.emitted(spark).count() == len(emitted)
    kept = sorted(int(p.name) for p in (tmp_path / "out" / "newest").iterdir())
    assert kept == [0, 1, 2] and spark.read.parquet(f"{tmp_path}/out/newest/2").count() == 240
    c = loop.counters(spark).first()
    assert (c.events, c.batches, c.correlations, c.clusters) == (240, 3, 3, len(emitted))
    loop.window = 100
    loop.batch(a.limit(0), 3)
    top = {r.alert_idx for r in live.newest(a, 100).collect()}
    assert {r.alert_idx for r in spark.read.parquet(f"{tmp_path}/out/newest/3").collect()} == top
    assert sorted(int(p.name) for p in (tmp_path / "out" / "newest").iterdir()) == [1, 2, 3]
    loop.batch(a.limit(0), 3)  # again, as after a failure
    assert {r.alert_idx for r in spark.read.parquet(f"{tmp_path}/out/newest/3").collect()} == top


def test_streaming_counts_equal_batch(spark, small, tmp_path):
    a = alerts(spark, small).select("SourceUserName", "EndDate")
    a.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(a.schema).parquet(f"{tmp_path}/in")
    q = live.interval_counts(stream).writeStream.outputMode("complete").format("memory").queryName("slots").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("slots").agg(F.sum("n")).first()[0] == a.count()


def test_tiers_correlate_like_their_threshold(spark, small):
    from alertloom.operators import correlation as co
    from alertloom.schema import FieldRoles, alerts

    a = alerts(spark, small)
    got = co.correlate_by_tier(a, override=0.5)
    want = {r.alert_idx: r.pred_cluster for r in co.correlate(a, FieldRoles(), 0.5).collect()}
    rows = got.select("alert_idx", "pred_cluster", "correlation_threshold_used", "threshold_source", "max_correlation_score").collect()
    assert {r.alert_idx: r.pred_cluster for r in rows} == want
    assert {(r.correlation_threshold_used, r.threshold_source) for r in rows} == {(0.5, "override")}
    assert co.tier(a, FieldRoles(), adaptive=False) == (0.3, "baseline")


def test_cluster_without_local_folder(spark, monkeypatch):
    import pytest

    from alertloom.plans import stage

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        stage.shared_dir(Elsewhere)
