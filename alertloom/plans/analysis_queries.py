"""Queries of the temporal, evaluation, graph, enrichment, sampling and behaviour operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import scalars as s
from alertloom.operators import behaviour as be
from alertloom.operators import enrichment as en
from alertloom.operators import evaluation as ev
from alertloom.operators import graph as gr
from alertloom.operators import sampling as sa
from alertloom.operators import temporal as te
from alertloom.operators.chains import chains
from alertloom.operators.intel import malware_table
from alertloom.plans.core_queries import _SCORES, _TACTIC, _scores, clustered
from alertloom.plans.registry import CLUSTERED, over_alerts, query
from alertloom.schema import alerts, table

BY = ["user_id"]
DAY = 86400.0


def _sec(c: str):
    return F.floor(F.unix_micros(c) / 1e6 + 0.5).cast("long")


_SEG = "g AS (SELECT *, CASE WHEN epoch(EndDate) - epoch(lag(EndDate) OVER (PARTITION BY user_id ORDER BY EndDate, alert_idx)) > 43200 THEN 1 ELSE 0 END AS nw FROM alerts)", "seg AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY EndDate, alert_idx) AS segment FROM g)"


@query(over_alerts("SELECT alert_idx, CAST(segment AS BIGINT) AS segment FROM seg", *_SEG))
def w3_gap_segments(spark, d):
    return te.segments(alerts(spark, d), BY, 43200.0).select("alert_idx", F.col("segment").cast("long").alias("segment"))


@query(over_alerts("SELECT user_id, alert_idx, round(epoch(EndDate) - epoch(p), 3) AS seconds FROM (SELECT *, lag(EndDate) OVER (PARTITION BY user_id ORDER BY EndDate, alert_idx) AS p FROM alerts) WHERE epoch(EndDate) - epoch(p) > 86400"))
def w5_dormant_periods(spark, d):
    return te.dormant_periods(alerts(spark, d), BY, DAY).select("user_id", "alert_idx", F.round("seconds", 3).alias("seconds"))


@query(over_alerts("SELECT user_id, string_agg(t, '>' ORDER BY ps, t) AS chain, count(*) AS length FROM (SELECT user_id, MalwareIntelAttackType AS t, min(alert_idx) AS ps FROM alerts GROUP BY 1, 2) GROUP BY 1"))
def w4_stage_chain(spark, d):
    return te.stage_chain(alerts(spark, d), BY, "MalwareIntelAttackType")


_LABEL = "CASE MalwareIntelAttackType WHEN 'Exploits' THEN 'Web' WHEN 'Reconnaissance' THEN 'Recon-PortScan' WHEN 'Shellcode' THEN 'SQL' WHEN 'Backdoors' THEN 'Mirai' ELSE 'DoS-Syn' END"
_MASK = "CASE WHEN regexp_matches(lower(l), 'scan|recon') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(l), 'sql|web') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(l), 'dos') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(l), 'mirai') THEN 16 ELSE 0 END"
_ROWS = f"o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY EndDate, alert_idx) AS rn, epoch(EndDate) AS e, {_LABEL} AS l FROM alerts)", f"om AS (SELECT *, {_MASK} AS m FROM o)"
_CHAINS = "ch(user_id, rn, e, alert_idx, head, hl, hm) AS (SELECT user_id, rn, e, alert_idx, alert_idx, l, m FROM om WHERE rn = 1 UNION ALL SELECT om.user_id, om.rn, om.e, om.alert_idx, CASE WHEN om.e - ch.e <= 28800 AND (om.l = ch.hl OR om.m & ch.hm <> 0) THEN ch.head ELSE om.alert_idx END, CASE WHEN om.e - ch.e <= 28800 AND (om.l = ch.hl OR om.m & ch.hm <> 0) THEN ch.hl ELSE om.l END, CASE WHEN om.e - ch.e <= 28800 AND (om.l = ch.hl OR om.m & ch.hm <> 0) THEN ch.hm ELSE om.m END FROM ch JOIN om ON om.user_id = ch.user_id AND om.rn = ch.rn + 1)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("MalwareIntelAttackType")
    return alerts(spark, d).withColumn("label", F.when(c == "Exploits", "Web").when(c == "Reconnaissance", "Recon-PortScan").when(c == "Shellcode", "SQL").when(c == "Backdoors", "Mirai").otherwise("DoS-Syn"))


@query(over_alerts("SELECT alert_idx AS id, head AS chain FROM ch", *_ROWS, _CHAINS, recursive=True))
def w1_chains(spark, d):
    return chains(_labelled(spark, d), BY, "label", 28800.0).select("id", "chain")


def _chain_rows(spark, d):
    c = chains(_labelled(spark, d), BY, "label", 28800.0).select(F.col("id").alias("alert_idx"), "chain")
    return te.chain_summary(alerts(spark, d).join(c, "alert_idx"))


@query(over_alerts("SELECT chain, n AS events, round(sec, 3) AS seconds, round(n / greatest(sec, 1), 9) AS rate FROM (SELECT head AS chain, count(*) AS n, max(e) - min(e) AS sec FROM ch GROUP BY 1)", *_ROWS, _CHAINS, recursive=True))
def a11_chain_summary(spark, d):
    return _chain_rows(spark, d).select("chain", "events", F.round("seconds", 3).alias("seconds"), F.round("rate", 9).alias("rate"))


@query(over_alerts("SELECT head AS chain, count(*) AS events FROM ch GROUP BY 1 HAVING count(*) >= 3 AND max(e) - min(e) >= 5", *_ROWS, _CHAINS, recursive=True))
def f7_significant_chains(spark, d):
    return te.significant_chains(_chain_rows(spark, d)).select("chain", "events")


_WINDOWS = "wd(user_id, rn, alert_idx, head, st) AS (SELECT user_id, rn, alert_idx, alert_idx, e FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, o.alert_idx, CASE WHEN o.e - wd.st > 36000 THEN o.alert_idx ELSE wd.head END, CASE WHEN o.e - wd.st > 36000 THEN o.e ELSE wd.st END FROM wd JOIN o ON o.user_id = wd.user_id AND o.rn = wd.rn + 1)"


@query(over_alerts("SELECT alert_idx AS id, head AS \"window\" FROM wd", _ROWS[0], _WINDOWS, recursive=True))
def w6_anchored_windows(spark, d):
    return te.anchored_windows(alerts(spark, d), BY, 36000.0).select("id", "window")


@query(over_alerts("SELECT head AS \"window\", string_agg(DISTINCT dm, ',' ORDER BY dm) AS domains, count(*) AS events, round(avg(severity), 9) AS severity, max_by(DestinationHostName, rn) AS last_host FROM (SELECT wd.head, wd.rn, alerts.*, CASE WHEN k % 3 = 0 THEN 'network' WHEN k % 3 = 1 THEN 'host' ELSE 'cloud' END AS dm FROM wd JOIN alerts USING (alert_idx)) GROUP BY 1 HAVING count(DISTINCT dm) > 1", _ROWS[0], _WINDOWS, recursive=True))
def a14_fused_alerts(spark, d):
    a = alerts(spark, d).withColumn("domain", F.when(F.col("k") % 3 == 0, "network").when(F.col("k") % 3 == 1, "host").otherwise("cloud"))
    return te.fuse(a, te.anchored_windows(a, BY, 36000.0)).select("window", "domains", "events", F.round("severity", 9).alias("severity"), "last_host")


@query(over_alerts("SELECT user_id, w AS \"window\", count(*) AS n FROM (SELECT user_id, rn - 1 AS r FROM o) JOIN (SELECT CAST(range AS BIGINT) AS w FROM range(0, 3000)) ON r >= w * 24 AND r < w * 24 + 32 GROUP BY 1, 2 HAVING count(*) >= 10", _ROWS[0]))
def w7_sliding_windows(spark, d):
    return te.sliding_windows(alerts(spark, d), BY, 32, 8, 10).groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT user_id, (rn - 1) // 30 AS chunk, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) >= 5", _ROWS[0]))
def w8_mini_campaigns(spark, d):
    return te.chunks(alerts(spark, d), BY).groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT x.alert_idx AS src, y.alert_idx AS dst FROM o x JOIN o y ON x.user_id = y.user_id AND y.rn BETWEEN x.rn + 1 AND x.rn + 99 AND y.e - x.e <= 3600", _ROWS[0]))
def j8_temporal_near_edges(spark, d):
    return te.near_edges(alerts(spark, d), BY)


@query(over_alerts("SELECT x.alert_idx AS src, y.alert_idx AS dst FROM o x JOIN o y ON x.user_id = y.user_id AND y.rn BETWEEN x.rn + 1 AND x.rn + 4", _ROWS[0]))
def j20_drill_edges(spark, d):
    return te.next_edges(alerts(spark, d), BY, 4)


@query(over_alerts("SELECT x.alert_idx AS src, y.alert_idx AS dst FROM o x JOIN o y ON x.user_id = y.user_id AND y.rn = x.rn + 1", _ROWS[0]))
def j9_next_edges(spark, d):
    return te.next_edges(alerts(spark, d), BY)


@query(over_alerts("SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, count(DISTINCT MalwareIntelAttackType) AS n_tactics, mode_t AS dominant FROM seg JOIN (SELECT user_id, segment, t AS mode_t FROM (SELECT user_id, segment, MalwareIntelAttackType AS t, row_number() OVER (PARTITION BY user_id, segment ORDER BY count(*) DESC, MalwareIntelAttackType) AS r FROM seg GROUP BY 1, 2, 3) WHERE r = 1) USING (user_id, segment) GROUP BY 1, 2, mode_t HAVING count(*) >= 2", *_SEG))
def a13_segment_summary(spark, d):
    out = te.segment_summary(te.segments(alerts(spark, d), BY, 43200.0), BY, "MalwareIntelAttackType")
    return out.select("user_id", F.col("segment").cast("long").alias("segment"), "n", "n_tactics", "dominant")


_TAC2 = "CASE MalwareIntelAttackType WHEN 'Exploits' THEN 'Initial Access' WHEN 'Reconnaissance' THEN 'Discovery' WHEN 'Shellcode' THEN 'Execution' WHEN 'Backdoors' THEN 'Persistence' ELSE 'Impact' END"


@query(over_alerts("SELECT a.user_id, segments, chain, round(least(1.0, least(segments * 0.1, 0.3) + least(len * 0.05, 0.3) + CASE WHEN chain LIKE '%Initial Access%' THEN 0.1 ELSE 0 END + CASE WHEN chain LIKE '%Persistence%' THEN 0.1 ELSE 0 END + CASE WHEN len >= 3 AND chain LIKE '%Initial Access%' AND (chain LIKE '%Execution%' OR chain LIKE '%Persistence%' OR chain LIKE '%Discovery%') AND chain LIKE '%Impact%' THEN 0.3 ELSE 0 END), 9)::DOUBLE AS confidence FROM apt a JOIN sg USING (user_id) JOIN cn USING (user_id) WHERE segments >= 3", *_SEG, "apt AS (SELECT user_id FROM alerts GROUP BY 1 HAVING epoch(max(EndDate)) - epoch(min(EndDate)) >= 86400 AND count(DISTINCT MalwareIntelAttackType) >= 3 AND count(DISTINCT CAST(EndDate AS DATE)) >= 2)", "sg AS (SELECT user_id, count(*) AS segments FROM (SELECT user_id, segment FROM seg GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)", f"cn AS (SELECT user_id, string_agg(t, '>' ORDER BY ps) AS chain, count(*) AS len FROM (SELECT user_id, {_TAC2} AS t, min(alert_idx) AS ps FROM alerts GROUP BY 1, 2) GROUP BY 1)"))
def m10_apt_campaigns(spark, d):
    c = F.col("MalwareIntelAttackType")
    a = alerts(spark, d).withColumn("tac", F.when(c == "Exploits", "Initial Access").when(c == "Reconnaissance", "Discovery").when(c == "Shellcode", "Execution").when(c == "Backdoors", "Persistence").otherwise("Impact"))
    return te.campaigns(a, BY, "tac", 43200.0, DAY).select("user_id", "segments", "chain", F.round("confidence", 9).alias("confidence"))


@query(over_alerts("SELECT round(count(DISTINCT SourceAddress) / count(*)::DOUBLE, 9) AS uniqueness FROM alerts"))
def f13_synthetic_guard(spark, d):
    return te.synthetic_guard(alerts(spark, d), "SourceAddress").select(F.round("uniqueness", 9).alias("uniqueness"))


@query(over_alerts("SELECT fragment, count(*) AS n, count(DeviceAddress) AS devices FROM (SELECT 'a' AS fragment, DeviceAddress FROM alerts WHERE k < 30 UNION ALL SELECT 'b', NULL FROM alerts WHERE k >= 70) GROUP BY 1"))
def u9_union_fragments(spark, d):
    a = alerts(spark, d)
    return te.unioned({"a": a.where("k < 30").select("alert_idx", "DeviceAddress"), "b": a.where("k >= 70").select("alert_idx")}).groupBy("fragment").agg(F.count(F.lit(1)).alias("n"), F.count("DeviceAddress").alias("devices"))


# --- evaluation
_LAB = "lb AS (SELECT user_id % 16 * 16 + k % 16 AS \"true\", (user_id + CASE WHEN k > 50 THEN 1 ELSE 0 END) % 16 AS pred FROM alerts)"
_CT = _LAB, 'ct AS (SELECT "true", pred, count(*) AS n FROM lb GROUP BY 1, 2)', 'ma AS (SELECT "true", sum(n) AS m FROM ct GROUP BY 1)', "mb AS (SELECT pred, sum(n) AS m FROM ct GROUP BY 1)", "nn AS (SELECT sum(n)::DOUBLE AS n FROM ct)"


def _ct(spark, d):
    return ev.contingency(alerts(spark, d).select((F.col("user_id") % 16 * 16 + F.col("k") % 16).alias("true"), ((F.col("user_id") + F.when(F.col("k") > 50, 1).otherwise(0)) % 16).alias("pred")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(over_alerts("SELECT * FROM ct", *_CT))
def e1_contingency(spark, d):
    return _ct(spark, d)


_S, _A, _B = "(SELECT sum(n * (n - 1) / 2.0) FROM ct)", "(SELECT sum(m * (m - 1) / 2.0) FROM ma)", "(SELECT sum(m * (m - 1) / 2.0) FROM mb)"


@query(over_alerts(f"SELECT round(({_S} - {_A} * {_B} / (n * (n - 1) / 2)) / (({_A} + {_B}) / 2 - {_A} * {_B} / (n * (n - 1) / 2)), 9)::DOUBLE AS ari, round({_S} / sqrt({_A} * {_B}), 9)::DOUBLE AS fmi FROM nn", *_CT))
def e2_ari_fmi(spark, d):
    return _rounded(ev.pair_scores(_ct(spark, d)))


_I = 'sum(c.n / nn.n * ln(c.n * nn.n / (ma.m * mb.m)))'


@query(over_alerts("SELECT round(i / ha, 9) AS homogeneity, round(i / hb, 9) AS completeness, round(2 * (i / ha) * (i / hb) / (i / ha + i / hb), 9) AS v_measure FROM (SELECT sum(c.n / nn.n * ln(c.n * nn.n / (ma.m * mb.m)))::DOUBLE AS i FROM ct c JOIN ma USING (\"true\") JOIN mb USING (pred), nn), (SELECT -sum(m / n * ln(m / n))::DOUBLE AS ha FROM ma, nn), (SELECT -sum(m / n * ln(m / n))::DOUBLE AS hb FROM mb, nn)", *_CT))
def e3_information(spark, d):
    return _rounded(ev.information_scores(_ct(spark, d)))


@query(over_alerts("SELECT round(sum(b) / sum(s)::DOUBLE, 9) AS purity, count(*) AS clusters FROM (SELECT pred, max(n) AS b, sum(n) AS s FROM ct GROUP BY 1)", *_CT))
def e5_purity(spark, d):
    return _rounded(ev.purity(_ct(spark, d)))


@query(over_alerts('SELECT pred, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n)::DOUBLE, 9) AS purity, min_by("true", -n * 1000000 + "true") AS dominant FROM ct GROUP BY 1', *_CT))
def e5_purity_by_cluster(spark, d):
    return _rounded(ev.purity_by_cluster(_ct(spark, d)))


@query(over_alerts('SELECT round(sum(c.n * c.n * nn.n / (ma.m * mb.m)) - max(nn.n), 4)::DOUBLE AS chi2, (SELECT (count(*) - 1) FROM ma) * (SELECT (count(*) - 1) FROM mb) AS dof FROM ct c JOIN ma USING ("true") JOIN mb USING (pred), nn', *_CT))
def e7_chi_square(spark, d):
    return ev.chi_square(_ct(spark, d)).select(F.round("chi2", 4).alias("chi2"), "dof")


_CL = "lb AS (SELECT k % 5 AS \"true\", CASE WHEN user_id % 4 = 0 THEN k % 3 ELSE k % 5 END AS pred FROM alerts)"


@query(over_alerts("SELECT round(sum(tp) / max(t), 9)::DOUBLE AS accuracy, round(sum(m / t * p), 9)::DOUBLE AS precision, round(sum(m / t * r), 9)::DOUBLE AS recall, round(sum(m / t * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9)::DOUBLE AS f1 FROM (SELECT ma.m::DOUBLE AS m, nn.n AS t, coalesce(c.n, 0)::DOUBLE AS tp, coalesce(c.n / mb.m::DOUBLE, 0) AS p, coalesce(c.n, 0) / ma.m::DOUBLE AS r FROM ma LEFT JOIN ct c ON c.\"true\" = ma.\"true\" AND c.pred = ma.\"true\" LEFT JOIN mb ON mb.pred = ma.\"true\", nn)", _CL, *_CT[1:]))
def e9_classification(spark, d):
    t = ev.contingency(alerts(spark, d).select((F.col("k") % 5).alias("true"), F.when(F.col("user_id") % 4 == 0, F.col("k") % 3).otherwise(F.col("k") % 5).alias("pred")))
    return _rounded(ev.classification(t))


@query(over_alerts("SELECT round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 9) AS t, round(avg(x) / stddev_samp(x), 9) AS effect, count(*) - 1 AS dof FROM (SELECT severity - k / 100.0::DOUBLE AS x FROM alerts)"))
def e10_paired_t(spark, d):
    return _rounded(ev.paired_t(alerts(spark, d).withColumn("b", F.col("k") / 100.0), "severity", "b"))


@query(over_alerts("SELECT user_id, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9)::DOUBLE AS f1 FROM (SELECT user_id, count(DISTINCT CASE WHEN k < 30 THEN t END) FILTER (hi) AS x, 1 AS y, i / nullif(np, 0)::DOUBLE AS p, i / nullif(nt, 0)::DOUBLE AS r FROM (SELECT *, k >= 0 AS hi FROM (SELECT user_id, k, MalwareIntelAttackType AS t FROM alerts)) JOIN (SELECT user_id, count(DISTINCT CASE WHEN k < 60 THEN MalwareIntelAttackType END) AS nt, count(DISTINCT CASE WHEN k >= 40 THEN MalwareIntelAttackType END) AS np FROM alerts GROUP BY 1) USING (user_id) JOIN (SELECT user_id, count(*) AS i FROM (SELECT user_id, MalwareIntelAttackType FROM alerts GROUP BY 1, 2 HAVING min(k) < 60 AND max(k) >= 40) GROUP BY 1) USING (user_id) GROUP BY ALL)"))
def e11_tactic_f1(spark, d):
    t = "MalwareIntelAttackType"
    g = alerts(spark, d).groupBy("user_id").agg(F.collect_set(F.when(F.col("k") < 60, F.col(t))).alias("a"), F.collect_set(F.when(F.col("k") >= 40, F.col(t))).alias("b"))
    return ev.tactic_f1(g, "a", "b").where("size(array_intersect(a, b)) > 0").select("user_id", F.round("f1", 9).alias("f1"))


_RES = "rs AS (SELECT MalwareIntelAttackType AS method, k AS data, round(avg(severity), 4) AS m1, count(*)::DOUBLE AS m2 FROM alerts GROUP BY 1, 2)"


def _results(spark, d):
    return alerts(spark, d).groupBy(F.col("MalwareIntelAttackType").alias("method"), F.col("k").alias("data")).agg(F.round(F.avg("severity"), 4).alias("m1"), F.count(F.lit(1)).cast("double").alias("m2"))


@query(over_alerts("SELECT method, round(avg((r1 + (c1 - 1) / 2.0 + r2 + (c2 - 1) / 2.0) / 2), 9)::DOUBLE AS avg_rank FROM (SELECT method, rank() OVER (PARTITION BY data ORDER BY m1 DESC) AS r1, count(*) OVER (PARTITION BY data, m1) AS c1, rank() OVER (PARTITION BY data ORDER BY m2 DESC) AS r2, count(*) OVER (PARTITION BY data, m2) AS c2 FROM rs) GROUP BY 1", _RES))
def e12_method_rank(spark, d):
    return _rounded(ev.rank_methods(_results(spark, d), ["m1", "m2"], "method", ["data"]))


@query(over_alerts("SELECT data, setting, best, round(best - base, 9) AS gain FROM (SELECT data, method AS setting, m1 AS best FROM (SELECT *, row_number() OVER (PARTITION BY data ORDER BY m1 DESC, length(method)) AS r FROM rs2) WHERE r = 1) LEFT JOIN (SELECT data, m1 AS base FROM rs2 WHERE method = 5) USING (data)".replace("length(method)", "method"), "rs2 AS (SELECT user_id % 10 AS data, k % 10 AS method, round(avg(severity), 4) AS m1 FROM alerts GROUP BY 1, 2)"))
def e15_optimal_setting(spark, d):
    r = alerts(spark, d).groupBy((F.col("user_id") % 10).alias("data"), (F.col("k") % 10).alias("setting")).agg(F.round(F.avg("severity"), 4).alias("m1"))
    return _rounded(ev.best_setting(r, "data", "setting", "m1", 5))


@query(over_alerts("SELECT g, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM (SELECT g, x, y, rank() OVER (PARTITION BY g ORDER BY x DESC) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y DESC) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM (SELECT k % 5 AS g, severity AS x, k::DOUBLE AS y FROM alerts)) GROUP BY 1"))
def e16_correlations(spark, d):
    return _rounded(ev.correlations(alerts(spark, d).select((F.col("k") % 5).alias("g"), F.col("severity").alias("x"), F.col("k").cast("double").alias("y")), "x", "y", "g"))


@query(over_alerts("SELECT AttackSeverity, round(avg(severity), 9) AS mean, round(stddev_pop(severity), 9) AS std, min(severity) AS min, max(severity) AS max, round(quantile_cont(severity, 0.5), 9) AS median, round(quantile_cont(severity, 0.95), 9) AS p95 FROM alerts GROUP BY 1"))
def a22_metric_spread(spark, d):
    return _rounded(ev.spread(alerts(spark, d), "AttackSeverity", "severity"))


@query(over_alerts("SELECT round(avg(severity), 9) AS mean, round(stddev_pop(severity), 9) AS std, round(quantile_cont(severity, 0.25), 9) AS p25, round(quantile_cont(severity, 0.75), 9) AS p75, round(avg(CASE WHEN severity < 0.6 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS below FROM alerts"))
def a24_confidence_diagnostics(spark, d):
    return _rounded(ev.confidence_diagnostics(alerts(spark, d), "severity", 0.6))


@query(over_alerts("SELECT round(avg(CASE WHEN t = 1 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS pure_share FROM (SELECT user_id * 1000 + k AS c, count(DISTINCT MalwareIntelAttackType) AS t FROM alerts GROUP BY 1)"))
def a27_pure_share(spark, d):
    return _rounded(ev.pure_share(alerts(spark, d).withColumn("c", F.col("user_id") * 1000 + F.col("k")), "c", "MalwareIntelAttackType"))


@query(over_alerts("SELECT 'DeviceHostName' AS \"column\", count(*) FILTER (DeviceHostName IS NULL) AS missing, count(DISTINCT DeviceHostName) AS distinct_values, min(DeviceHostName) AS least, max(DeviceHostName) AS largest FROM alerts UNION ALL SELECT 'CustomerName', 0, count(DISTINCT CustomerName), min(CustomerName), max(CustomerName) FROM alerts"))
def a25_column_profile(spark, d):
    return ev.column_profile(alerts(spark, d), ["DeviceHostName", "CustomerName"])


# --- graphs
_ENT = "en AS (SELECT alert_idx AS id, 'ip:' || SourceAddress AS entity FROM alerts UNION SELECT alert_idx, 'host:' || SourceHostName FROM alerts UNION SELECT alert_idx, 'host:' || DeviceHostName FROM alerts WHERE DeviceHostName IS NOT NULL)"
_COLS = {"SourceAddress": "ip", "SourceHostName": "host", "DeviceHostName": "host"}
_EDGES = "ed AS (SELECT least(x.entity, y.entity) AS src, greatest(x.entity, y.entity) AS dst, count(*) AS weight FROM en x JOIN en y ON x.id = y.id AND x.entity < y.entity GROUP BY 1, 2)"


@query(over_alerts("SELECT src, dst, weight FROM ed", _ENT, _EDGES))
def j12_cooccurrence_edges(spark, d):
    return gr.cooccurrence_edges(alerts(spark, d), _COLS)


def _pagerank_sql(rounds: int) -> str:
    ctes = ["bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)", "dg AS (SELECT src, count(*) AS d FROM bo GROUP BY 1)", "nn AS (SELECT count(*)::DOUBLE AS n FROM dg)", "r0 AS MATERIALIZED (SELECT src AS node, 1 / n AS r FROM dg, nn)"]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT bo.dst AS node, max(0.15::DOUBLE / n) + 0.85::DOUBLE * sum(r / d) AS r FROM bo JOIN r{k} ON bo.src = node JOIN dg ON dg.src = bo.src, nn GROUP BY 1)")
    return over_alerts(f"SELECT node, round(r / (SELECT max(r) FROM r{rounds}), 9) AS pagerank FROM r{rounds}", _ENT, _EDGES, *ctes)


@query(_pagerank_sql(20))
def g3_pagerank(spark, d):
    return _rounded(gr.pagerank(gr.cooccurrence_edges(alerts(spark, d), _COLS)))


@query()
def g4_betweenness(spark, d):
    return gr.betweenness(gr.cooccurrence_edges(alerts(spark, d), _COLS))


@query(over_alerts("SELECT host, tactic, count(*) AS weight FROM (SELECT SourceHostName AS host, MalwareIntelAttackType AS tactic FROM alerts UNION ALL SELECT DestinationHostName, MalwareIntelAttackType FROM alerts) GROUP BY 1, 2"))
def g5_campaign_graph(spark, d):
    return gr.campaign_graph(alerts(spark, d))


@query(over_alerts("SELECT SourceHostName AS focus, DestinationAddress AS neighbour, count(*) AS weight FROM alerts WHERE SourceHostName = (SELECT SourceHostName FROM alerts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1, 2"))
def g6_ego_net(spark, d):
    return gr.ego_net(alerts(spark, d))


@query(over_alerts("SELECT rel, count(*) AS n FROM (SELECT 'alert_SourceAddress' AS rel FROM alerts UNION ALL SELECT 'alert_DestinationAddress' FROM alerts UNION ALL SELECT 'alert_DeviceAddress' FROM alerts WHERE DeviceAddress <> 'NIL' UNION ALL SELECT 'alert_SourceHostName' FROM alerts UNION ALL SELECT 'alert_DeviceHostName' FROM alerts WHERE DeviceHostName IS NOT NULL UNION ALL SELECT 'alert_DestinationHostName' FROM alerts UNION ALL SELECT 'alert_SourceUserName' FROM alerts) GROUP BY 1"))
def g9_hetero_edges(spark, d):
    return gr.hetero_edges(alerts(spark, d)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT id AS src, f AS dst, entity FROM (SELECT *, min(id) OVER (PARTITION BY entity) AS f FROM (SELECT * FROM en UNION SELECT alert_idx, 'ip:' || DestinationAddress FROM alerts UNION SELECT alert_idx, 'ip:' || DeviceAddress FROM alerts WHERE DeviceAddress <> 'NIL' UNION SELECT alert_idx, 'host:' || DestinationHostName FROM alerts UNION SELECT alert_idx, 'user:' || SourceUserName FROM alerts)) WHERE id <> f", _ENT))
def j7_shared_entity_edges(spark, d):
    return gr.shared_entity_edges(alerts(spark, d))


@query(over_alerts("SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM ed) WHERE r <= 10", _ENT, _EDGES))
def t8_top_neighbours(spark, d):
    return gr.top_neighbours(gr.cooccurrence_edges(alerts(spark, d), _COLS))


# --- enrichment
_MAL = "mw(id, name, sev, tac, grp) AS (VALUES ('malware:Emotet', 'emotet', 0.8, ['initial access', 'execution', 'persistence'], 'TA542'), ('malware:TrickBot', 'trickbot', 0.85, ['execution', 'persistence', 'credential access'], 'WizardSpider'), ('malware:CobaltStrike', 'cobaltstrike', 0.75, ['execution', 'command and control', 'lateral movement'], 'APT29, WizardSpider'), ('malware:Ryuk', 'ryuk', 0.9, ['impact'], 'WizardSpider'), ('malware:QakBot', 'qakbot', 0.8, ['initial access', 'execution', 'persistence'], ''))"
_MATCH = f"ft AS (SELECT DISTINCT pred_cluster, lower({_TACTIC}) AS t FROM c)", "fm AS (SELECT DISTINCT pred_cluster, id FROM ft JOIN mw ON list_contains(tac, t))"


def _found(spark, d):
    intel = malware_table(spark).withColumn("tactics", F.transform("tactics", lambda x: F.replace(x, F.lit("_"), F.lit(" "))))
    c = clustered(spark, d).withColumn("tactic", s.tactic_exact(F.col("MalwareIntelAttackType")))
    return en.matches(c, intel), intel


_CE = CLUSTERED


@query(over_alerts("SELECT pred_cluster, id AS entity_id FROM fm", _CE, _MAL, *_MATCH))
def j13_intel_match(spark, d):
    return _found(spark, d)[0]


_ENR = "er AS (SELECT pred_cluster, count(*) AS entities, avg(sev)::DOUBLE AS severity, CASE WHEN count(*) = 1 THEN 'WizardSpider' ELSE 'APT29, TA542, WizardSpider' END AS linkage FROM fm JOIN mw USING (id) GROUP BY 1)"


@query(over_alerts("SELECT pred_cluster, entities, round(severity, 9) AS severity, linkage, round(0.4 * severity, 9)::DOUBLE AS threat_score FROM er", _CE, _MAL, *_MATCH, _ENR))
def a7_cluster_enrichment(spark, d):
    return _rounded(en.enrich(*_found(spark, d)))


@query(over_alerts("SELECT CAST(sum(entities) AS BIGINT) AS matches, count(*) AS linked, 0::BIGINT AS high, round(avg(0.4 * severity), 9)::DOUBLE AS avg_score, round(max(0.4 * severity), 9)::DOUBLE AS max_score FROM er", _CE, _MAL, *_MATCH, _ENR))
def a6_threat_summary(spark, d):
    return _rounded(en.threat_summary(en.enrich(*_found(spark, d))))


@query(over_alerts("SELECT alert_idx, round(coalesce(0.4 * severity, 0), 9)::DOUBLE AS threat_score FROM (SELECT alert_idx, user_id AS pred_cluster FROM alerts) LEFT JOIN (SELECT pred_cluster, severity FROM er) USING (pred_cluster)", _CE, _MAL, *_MATCH, _ENR))
def j15_map_back(spark, d):
    return en.map_back(clustered(spark, d), en.enrich(*_found(spark, d))).select("alert_idx", F.round("threat_score", 9).alias("threat_score"))


# --- sampling
_H = "md5('42:' || CAST(alert_idx AS VARCHAR))"
_RK = f"rk AS (SELECT *, row_number() OVER (PARTITION BY MalwareIntelAttackType ORDER BY {_H}) AS r, count(*) OVER (PARTITION BY MalwareIntelAttackType) AS n FROM im0)"
_IM0 = "im0 AS (SELECT * REPLACE (CASE WHEN MalwareIntelAttackType = 'DoS' AND k >= 20 THEN 'Exploits' ELSE MalwareIntelAttackType END AS MalwareIntelAttackType) FROM alerts)"


def _uneven(spark, d):
    kind = F.col("MalwareIntelAttackType")
    return alerts(spark, d).withColumn("MalwareIntelAttackType", F.when((kind == "DoS") & (F.col("k") >= 20), "Exploits").otherwise(kind))


@query(over_alerts("SELECT alert_idx FROM rk WHERE r <= 20", _IM0, _RK))
def u1_reservoir_stratified(spark, d):
    return sa.reservoir(_uneven(spark, d), 20, ["MalwareIntelAttackType"]).select("alert_idx")


@query(over_alerts(f"SELECT alert_idx FROM alerts ORDER BY {_H} LIMIT 50"))
def u2_reservoir(spark, d):
    return sa.reservoir(alerts(spark, d), 50).select("alert_idx")


@query(over_alerts("SELECT alert_idx FROM rk WHERE r <= (SELECT min(n) FROM rk)", _IM0, _RK))
def u3_undersample(spark, d):
    return sa.balance(_uneven(spark, d), "MalwareIntelAttackType", "under").select("alert_idx")


@query(over_alerts("SELECT alert_idx, CAST(c AS INT) AS copy FROM rk, (SELECT max(n) AS hi FROM rk), range(0, 60) t(c) WHERE c * n + r <= hi", _IM0, _RK))
def u3_oversample(spark, d):
    return sa.balance(_uneven(spark, d), "MalwareIntelAttackType", "over").select("alert_idx", "copy")


@query(over_alerts("SELECT MalwareIntelAttackType, count(*) AS n FROM rk, (SELECT floor(sqrt(max(n)::DOUBLE * min(n))) AS w FROM rk), range(0, 60) t(c) WHERE c * n + r <= w GROUP BY 1", _IM0, _RK))
def u3_hybrid(spark, d):
    return sa.balance(_uneven(spark, d), "MalwareIntelAttackType", "hybrid").groupBy("MalwareIntelAttackType").agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT alert_idx FROM rk WHERE r <= greatest(1, floor(n * 0.1))", _IM0, _RK))
def u8_stratified_share(spark, d):
    return sa.stratified(_uneven(spark, d), ["MalwareIntelAttackType"], 0.1).select("alert_idx")


@query(over_alerts("SELECT count(*) AS n, count(DISTINCT alert_idx) AS d FROM (SELECT alert_idx FROM rk LIMIT 300)", _IM0, _RK))
def u13_topped_up(spark, d):
    return sa.topped_up(_uneven(spark, d), ["MalwareIntelAttackType"], 0.1, 300).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("alert_idx").alias("d"))


@query(over_alerts("SELECT alert_idx, CASE WHEN CASE WHEN n = 1 THEN 0 ELSE (r - 1) / (n - 1)::DOUBLE END < 0.8 THEN 'train' ELSE 'test' END AS part FROM rk", _IM0, _RK))
def u7_split(spark, d):
    return sa.split(_uneven(spark, d), "MalwareIntelAttackType").select("alert_idx", "part")


@query(over_alerts("SELECT variant, count(*) AS n FROM (SELECT 'original' AS variant FROM rk UNION ALL SELECT 'under' FROM rk WHERE r <= (SELECT min(n) FROM rk) UNION ALL SELECT 'over' FROM rk, (SELECT max(n) AS hi FROM rk), range(0, 60) t(c) WHERE c * n + r <= hi UNION ALL SELECT 'hybrid' FROM rk, (SELECT floor(sqrt(max(n)::DOUBLE * min(n))) AS w FROM rk), range(0, 60) t(c) WHERE c * n + r <= w) GROUP BY 1", _IM0, _RK))
def u6_ensembles(spark, d):
    return sa.ensembles(_uneven(spark, d), "MalwareIntelAttackType").groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT MalwareIntelAttackType, count(*) AS n, round(count(*) / (SELECT count(*) FROM im0)::DOUBLE, 9) AS share, round((SELECT max(c) FROM (SELECT count(*) AS c FROM im0 GROUP BY MalwareIntelAttackType)) / count(*)::DOUBLE, 9) AS imbalance FROM im0 GROUP BY 1", _IM0))
def a16_class_distribution(spark, d):
    return _rounded(sa.class_distribution(_uneven(spark, d), "MalwareIntelAttackType"))


@query(over_alerts("SELECT round(sum(p * ln(p / q)), 9) AS kl, CASE WHEN sum(p * ln(p / q)) < 0.1 THEN 'low' WHEN sum(p * ln(p / q)) < 0.5 THEN 'medium' ELSE 'high' END AS degree FROM (SELECT greatest(coalesce(p, 0), 0.001) AS p, greatest(coalesce(q, 0), 0.001) AS q FROM (SELECT MalwareIntelAttackType AS t, count(*) / (SELECT count(*) FROM im0)::DOUBLE AS p FROM im0 GROUP BY 1) FULL JOIN (SELECT MalwareIntelAttackType AS t, count(*) / (SELECT count(*) FROM alerts)::DOUBLE AS q FROM alerts GROUP BY 1) USING (t))", _IM0))
def m9_kl_shift(spark, d):
    return _rounded(sa.kl_shift(_uneven(spark, d), alerts(spark, d), "MalwareIntelAttackType"))


# --- behaviour
_DT = "CASE WHEN isodow(EndDate) <= 5 THEN 'WD' WHEN isodow(EndDate) = 6 THEN 'Sat' ELSE 'Sun' END"


def _behaviour_sql(key: str, factor: float, new: bool) -> str:
    act = f"ac AS (SELECT SourceUserName AS u, {_DT} AS dt, CAST(EndDate AS DATE) AS dy, {key} AS ky, count(*) AS n, min(alert_idx) AS ai FROM alerts GROUP BY 1, 2, 3, 4)"
    half = "sp AS (SELECT min(dy) + 20 AS cut FROM ac)"
    base = "bs AS (SELECT u, dt, ky, sum(n) / max(days)::DOUBLE AS avg FROM (SELECT * FROM ac, sp WHERE dy < cut) JOIN (SELECT u, dt, count(DISTINCT dy) AS days FROM ac, sp WHERE dy < cut GROUP BY 1, 2) USING (u, dt) GROUP BY 1, 2, 3)"
    cur = f"cu AS (SELECT ac.*, coalesce(bs.avg, 0) AS a, bs.avg IS NULL AS nokey, coalesce(tt, 0) AS tt, kn.u IS NULL AS nouser FROM ac JOIN sp ON dy >= cut LEFT JOIN bs USING (u, dt, ky) LEFT JOIN (SELECT u, dt, sum(avg) AS tt FROM bs GROUP BY 1, 2) USING (u, dt) LEFT JOIN (SELECT DISTINCT u FROM bs) kn USING (u))"
    risk = f"ri AS (SELECT u, dt, dy, ky, n, nouser OR ({str(new).lower()} AND nokey) AS nw, CASE WHEN nouser OR ({str(new).lower()} AND nokey) THEN 100 ELSE 100 / (1 + exp(-(n - a) / greatest(tt, 1) * {factor})) END AS rk FROM cu)"
    return over_alerts('SELECT u AS "user", dt AS day_type, ky AS "key", n, nw AS is_new, round(rk, 4)::DOUBLE AS risk, count(*) AS days FROM ri WHERE rk > 69 OR rk < 31 GROUP BY ALL', act, half, base, cur, risk)


def _behaviour(spark, d, key, factor, new):
    act = be.activity(alerts(spark, d), key)
    cut = act.agg(F.date_add(F.min("day"), 20).alias("cut"))
    marked = act.crossJoin(F.broadcast(cut))  # one row
    out = be.anomalies(marked.where("day >= cut").drop("cut"), be.baseline(marked.where("day < cut").drop("cut")), factor, new)
    return out.select("user", "day_type", "key", "n", "is_new", F.round("risk", 4).alias("risk")).groupBy("user", "day_type", "key", "n", "is_new", "risk").agg(F.count(F.lit(1)).alias("days"))


@query(_behaviour_sql("CAST(hour(EndDate) // 3 AS VARCHAR)", 2.0, False))
def b1_time_anomaly(spark, d):
    return _behaviour(spark, d, "interval", 2.0, False)


@query(_behaviour_sql("DestinationHostName", 1.0, True))
def b2_entity_anomaly(spark, d):
    return _behaviour(spark, d, "DestinationHostName", 1.0, True)


_FB = "fb AS (SELECT event_id AS feedback_id, ts, user_id % 40 AS cluster_id, CASE WHEN k % 3 = 0 THEN 'false_positive' WHEN k % 3 = 1 THEN 'true_positive' ELSE 'uncertain' END AS feedback_type, k / 100.0::DOUBLE AS confidence, event_type AS tactic, (user_id * 7) % 60 AS cluster_size FROM e)"


def _fb(spark, d):
    a = alerts(spark, d)
    t = table(spark, d, "events").select(F.col("event_id").alias("alert_idx"), F.col("event_type").alias("tactic"))
    k = F.col("k")
    return a.join(t, "alert_idx").select(F.col("alert_idx").alias("feedback_id"), F.col("EndDate").alias("timestamp"), (F.col("user_id") % 40).alias("cluster_id"), F.when(k % 3 == 0, "false_positive").when(k % 3 == 1, "true_positive").otherwise("uncertain").alias("feedback_type"), (k / 100.0).alias("confidence"), "tactic", ((F.col("user_id") * 7) % 60).alias("cluster_size"))


@query(over_alerts("SELECT feedback_type, count(*) AS n, round(avg(confidence), 9) AS confidence FROM fb GROUP BY 1", _FB))
def a17_feedback_stats(spark, d):
    return _rounded(be.feedback_stats(_fb(spark, d)))


@query(over_alerts("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (feedback_type = 'false_positive') AS false_positives FROM fb GROUP BY 1", _FB))
def a17_feedback_trend(spark, d):
    return be.feedback_trend(_fb(spark, d)).select(F.col("day").cast("string").alias("day"), "n", "false_positives")


@query(over_alerts("SELECT tactic, CAST(floor(cluster_size / 10) AS BIGINT) AS bucket, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM (SELECT * FROM fb WHERE feedback_type = 'false_positive') GROUP BY GROUPING SETS ((tactic), (CAST(floor(cluster_size / 10) AS BIGINT)), (CAST(hour(ts) AS INT)))", _FB))
def a18_fp_patterns(spark, d):
    return be.fp_patterns(_fb(spark, d))


@query(over_alerts("SELECT cluster_id FROM fb GROUP BY 1 HAVING avg(confidence) < 0.5 OR count(DISTINCT feedback_type) > 1 OR max(cluster_size) > 50 ORDER BY 1 LIMIT 50", _FB))
def a19_uncertain_clusters(spark, d):
    return be.uncertain_clusters(_fb(spark, d))


@query(over_alerts("SELECT cluster_id, CASE WHEN r = '' THEN 'general_review' ELSE r END AS reason FROM (SELECT cluster_id, concat_ws(',', CASE WHEN round(avg(confidence), 9) < 0.5 THEN 'low_confidence' END, CASE WHEN max(cluster_size) > 50 THEN 'large_cluster' END, CASE WHEN count(*) >= 2 THEN 'conflicting_feedback' END) AS r FROM fb GROUP BY 1)", _FB))
def a30_review_reasons(spark, d):
    return be.review_reasons(_fb(spark, d))


@query(over_alerts("SELECT pred_cluster, round(p, 9)::DOUBLE AS priority FROM (SELECT pred_cluster, least(1.0, 0.5 + least(0.3, size / 100.0) + mean_severity / 20.0) AS p FROM im) ORDER BY round(p, 9) DESC, pred_cluster LIMIT 10", CLUSTERED, *_SCORES))
def t7_review_batch(spark, d):
    return be.review_batch(_scores(spark, d)).select("pred_cluster", F.round("priority", 9).alias("priority"))


@query(over_alerts("SELECT pred_cluster, round(greatest(0, importance - CASE WHEN tactics LIKE '%DoS%' THEN 0.2 ELSE 0 END - CASE WHEN size BETWEEN 10 AND 70 THEN 0.1 ELSE 0 END), 9)::DOUBLE AS score FROM im", CLUSTERED, *_SCORES))
def b7_fp_rule_adjust(spark, d):
    rules = spark.createDataFrame([("r1", "DoS", None, None, 0.2), ("r2", None, 10, 70, 0.1)], "rule_id string, tactic string, least_size long, most_size long, amount double")
    return be.adjust_scores(_scores(spark, d).withColumn("score", F.col("importance")), rules).select("pred_cluster", F.round("score", 9).alias("score"))


@query(over_alerts("SELECT \"user\", day_type, \"key\", round(CASE WHEN vd = 'normal' AND a IS NOT NULL THEN round_even((n + a * days) / (days + 1), 2) WHEN vd = 'normal' THEN n ELSE a END, 4)::DOUBLE AS avg FROM (SELECT * FROM (SELECT SourceUserName AS \"user\", 'WD' AS day_type, CAST(k % 8 AS VARCHAR) AS \"key\", count(*) / 4.0::DOUBLE AS a, 4 AS days FROM alerts WHERE k < 60 GROUP BY 1, 3) FULL JOIN (SELECT SourceUserName AS \"user\", 'WD' AS day_type, CAST(k % 8 AS VARCHAR) AS \"key\", count(*) AS n, CASE WHEN k % 8 < 4 THEN 'normal' ELSE 'positive' END AS vd FROM alerts WHERE k >= 60 GROUP BY 1, 3, 5) USING (\"user\", day_type, \"key\")) WHERE a IS NOT NULL OR vd = 'normal'"))
def b5_baseline_update(spark, d):
    a = alerts(spark, d).withColumn("key", (F.col("k") % 8).cast("string"))
    base = a.where("k < 60").groupBy(F.col("SourceUserName").alias("user"), F.lit("WD").alias("day_type"), "key").agg((F.count(F.lit(1)) / 4.0).alias("avg")).withColumn("days", F.lit(4))
    v = a.where("k >= 60").groupBy(F.col("SourceUserName").alias("user"), F.lit("WD").alias("day_type"), "key").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.when(F.col("key").cast("int") < 4, "normal").otherwise("positive"))
    return be.update_baseline(base, v).select("user", "day_type", "key", F.round("avg", 4).alias("avg"))


@query(over_alerts("SELECT user_id, DestinationHostName, n, round(n / t::DOUBLE, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, DestinationHostName) AS r, sum(n) OVER (PARTITION BY user_id) AS t FROM (SELECT user_id, DestinationHostName, count(*) AS n FROM alerts GROUP BY 1, 2)) WHERE r <= 3"))
def a21_key_entities(spark, d):
    return be.key_entities(alerts(spark, d), "DestinationHostName", "user_id").select("user_id", "DestinationHostName", "n", F.round("share", 9).alias("share"))
