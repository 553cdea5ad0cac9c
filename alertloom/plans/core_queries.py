"""Queries of the scalar, correlation and cluster operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import scalars as s
from alertloom.operators import clusters as cl
from alertloom.operators import correlation as co
from alertloom.operators.anchors import anchor_scores, best_chains
from alertloom.operators.components import connected_components
from alertloom.plans.registry import CLUSTERED, over_alerts, query
from alertloom.schema import FieldRoles, alerts, clean, table

ROLES = FieldRoles()
COLS = [*ROLES.addresses, *ROLES.usernames]


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """Alerts with a given cluster number, for operators that take one."""
    return alerts(spark, d).withColumn("pred_cluster", F.col("user_id"))


_TACTIC = "CASE MalwareIntelAttackType WHEN 'Exploits' THEN 'EXECUTION' WHEN 'Reconnaissance' THEN 'RECONNAISSANCE' WHEN 'Shellcode' THEN 'EXECUTION' WHEN 'Backdoors' THEN 'PERSISTENCE' WHEN 'DoS' THEN 'IMPACT' ELSE 'UNKNOWN' END"


@query(over_alerts("SELECT alert_idx, AlertId, SourceAddress, DestinationAddress, DeviceAddress, SourceUserName, DeviceHostName, MalwareIntelAttackType, AttackSeverity, CustomerName FROM alerts"))
def p1_normalize_alerts(spark, d):
    from alertloom.sources.files import normalise

    raw = alerts(spark, d).selectExpr("alert_idx", "AlertId", "SourceAddress AS src", "DestinationAddress AS DESTINATIONADDRESS", "DeviceAddress", "SourceUserName", "DeviceHostName", "MalwareIntelAttackType", "AttackSeverity", "CustomerName")
    out = normalise(raw, {"SourceAddress": "src"}, keep=["alert_idx"])
    return out.select("alert_idx", "AlertId", "SourceAddress", "DestinationAddress", "DeviceAddress", "SourceUserName", "DeviceHostName", "MalwareIntelAttackType", "AttackSeverity", "CustomerName")


@query(over_alerts("SELECT alert_idx, nullif(DeviceAddress, 'NIL') AS device, DeviceHostName AS host FROM alerts"))
def p4_clean_sentinels(spark, d):
    return alerts(spark, d).select("alert_idx", clean("DeviceAddress").alias("device"), clean("DeviceHostName").alias("host"))


@query(over_alerts("SELECT x.alert_idx, array_to_string([v FOR v IN [CASE WHEN x.SourceAddress = y.SourceAddress THEN x.SourceAddress END, CASE WHEN x.DestinationAddress = y.DestinationAddress THEN x.DestinationAddress END, CASE WHEN x.DeviceAddress = y.DeviceAddress AND x.DeviceAddress <> 'NIL' THEN x.DeviceAddress END] IF v IS NOT NULL], ',') AS shared FROM alerts x JOIN alerts y ON y.alert_idx = x.alert_idx + 1"))
def p5_common_values(spark, d):
    a = alerts(spark, d).select("alert_idx", *ROLES.addresses)
    b = a.select((F.col("alert_idx") - 1).alias("alert_idx"), *[F.col(c).alias(f"next_{c}") for c in ROLES.addresses])
    return a.join(b, "alert_idx").select("alert_idx", F.array_join(s.common_values(ROLES.addresses, [f"next_{c}" for c in ROLES.addresses]), ",").alias("shared"))


@query(over_alerts("SELECT alert_idx, 'h' || CAST(user_id AS VARCHAR) || '.org' AS domain, SourceUserName AS plain FROM alerts"))
def p6_email_domain(spark, d):
    mail = F.concat(F.col("SourceUserName"), F.lit("@h"), F.col("user_id").cast("string"), F.lit(".org"))
    return alerts(spark, d).select("alert_idx", s.email_domain(mail).alias("domain"), s.email_domain(F.col("SourceUserName")).alias("plain"))


@query(over_alerts("SELECT CAST(floor(epoch(EndDate) / 300) * 300 AS BIGINT) AS bucket, count(*) AS n FROM alerts GROUP BY 1"))
def p9_time_bucket(spark, d):
    return alerts(spark, d).groupBy(F.unix_timestamp(s.time_bucket(F.col("EndDate"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT alert_idx, CAST(least((hour(EndDate) * 60 + minute(EndDate)) // 5, 287) AS INT) AS bucket FROM alerts"))
def p11_tod_bucket(spark, d):
    return alerts(spark, d).select("alert_idx", s.tod_bucket(F.col("EndDate")).alias("bucket"))


@query(over_alerts("SELECT alert_idx, CASE WHEN DeviceHostName IS NULL THEN 0 ELSE CAST(('0x' || substr(md5('s:' || lower(DeviceHostName)), 1, 15))::BIGINT % 999 + 1 AS BIGINT) END AS h FROM alerts"))
def p12_entity_hash(spark, d):
    return alerts(spark, d).select("alert_idx", s.entity_hash(F.col("DeviceHostName"), 1000, "s").alias("h"))


@query(over_alerts("SELECT alert_idx, CAST(CASE lower(AttackSeverity) WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.5 END AS DOUBLE) AS score FROM alerts"))
def p13_severity_score(spark, d):
    return alerts(spark, d).select("alert_idx", s.severity_score(F.col("AttackSeverity")).alias("score"))


@query(over_alerts("SELECT alert_idx, '10.0.0.' || CAST((alert_idx * 37) % 256 AS VARCHAR) AS ip FROM alerts"))
def p14_byte_ip(spark, d):
    return alerts(spark, d).select("alert_idx", s.byte_ip(F.col("alert_idx") * 37).alias("ip"))


@query(over_alerts("SELECT DISTINCT regexp_extract(SourceAddress, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) AS net FROM alerts"))
def p26_subnet24(spark, d):
    return alerts(spark, d).select(s.subnet24(F.col("SourceAddress")).alias("net")).distinct()


@query(over_alerts("SELECT CASE WHEN isodow(EndDate) <= 5 THEN 'WD' WHEN isodow(EndDate) = 6 THEN 'Sat' ELSE 'Sun' END AS day_type, CAST(hour(EndDate) // 3 AS INT) AS slot, count(*) AS n FROM alerts GROUP BY 1, 2"))
def p28_day_type_interval(spark, d):
    return alerts(spark, d).groupBy(s.day_type(F.col("EndDate")).alias("day_type"), s.day_interval(F.col("EndDate")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT alert_idx, day(EndDate) + round((hour(EndDate) * 60 + minute(EndDate)) / 14.4::DOUBLE) / 100.0::DOUBLE AS d FROM alerts"))
def p30_decimal_day(spark, d):
    return alerts(spark, d).select("alert_idx", s.decimal_day(F.col("EndDate")).alias("d"))


@query(over_alerts(f"SELECT MalwareIntelAttackType AS label, {_TACTIC} AS tactic, count(*) AS n FROM alerts GROUP BY 1, 2"))
def s4_tactic_exact(spark, d):
    return alerts(spark, d).groupBy(F.col("MalwareIntelAttackType").alias("label"), s.tactic_exact(F.col("MalwareIntelAttackType")).alias("tactic")).agg(F.count(F.lit(1)).alias("n"))


@query(over_alerts("SELECT MalwareIntelAttackType AS label, CASE WHEN lower(MalwareIntelAttackType) LIKE '%recon%' THEN 'Discovery' WHEN lower(MalwareIntelAttackType) LIKE '%dos%' THEN 'Impact' ELSE 'Execution' END AS tactic FROM alerts GROUP BY 1, 2"))
def s1_tactic_rules(spark, d):
    return alerts(spark, d).select(F.col("MalwareIntelAttackType").alias("label"), s.tactic_by_rules(F.col("MalwareIntelAttackType")).alias("tactic")).distinct()


#: Tactics in turn; a user's alerts show the first few of them, as many as the user's number says.
_TACTIC_LIST = tuple(dict.fromkeys(t for _, own in s.STAGES for t in own)) + ("BENIGN",)
_STAGE = " ".join(f"WHEN list_has_all(t, [{', '.join(repr(x) for x in own)}]) THEN '{name}'" for name, own in s.STAGES)


@query(over_alerts(f"SELECT pred_cluster, CASE {_STAGE} ELSE 'Other' END AS stage FROM (SELECT pred_cluster, list([{', '.join(map(repr, _TACTIC_LIST))}][k % (user_id % {len(_TACTIC_LIST)} + 1) + 1]) AS t FROM c GROUP BY 1)", CLUSTERED))
def s9_attack_stage(spark, d):
    place = (F.col("k") % (F.col("user_id") % len(_TACTIC_LIST) + 1) + 1).cast("int")
    c = clustered(spark, d).withColumn("t", F.element_at(F.array(*map(F.lit, _TACTIC_LIST)), place))
    return c.groupBy("pred_cluster").agg(s.attack_stage(F.collect_set("t")).alias("stage"))


_NAMES = ("recon-x", "Scan 2", "SQL inject", "web-app", "bruteforce", "password", "ddos", "Flood", "mirai", "BotNet", "rootkit", "backdoor", "other", "scan web")
_NAMED = f"nm AS (SELECT DISTINCT [{', '.join(map(repr, _NAMES))}][k % {len(_NAMES)} + 1] AS l FROM alerts)"
_RELATED = " OR ".join(f"(regexp_matches(lower(x.l), '{'|'.join(w)}') AND regexp_matches(lower(y.l), '{'|'.join(w)}'))" for w in s.RELATED)


@query(over_alerts(f"SELECT x.l AS a, y.l AS b FROM nm x, nm y WHERE x.l < y.l AND ({_RELATED})", _NAMED))
def s10_related_attacks(spark, d):
    l = alerts(spark, d).select(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("k") % len(_NAMES) + 1).cast("int")).alias("l")).distinct().withColumn("m", F.explode(s.related_groups(F.col("l"))))
    pairs = l.alias("x").join(l.alias("y"), (F.col("x.m") == F.col("y.m")) & (F.col("x.l") < F.col("y.l")))  # labels of a common group
    return pairs.select(F.col("x.l").alias("a"), F.col("y.l").alias("b")).distinct()


@query(over_alerts("SELECT alert_idx, MalwareIntelAttackType AS name, AttackSeverity AS severity, SourceAddress AS src, DestinationAddress AS dst, SourceUserName AS suser FROM alerts"))
def s11_parse_cef(spark, d):
    line = F.concat_ws("|", F.lit("CEF:0"), F.lit("acme"), F.lit("fw"), F.lit("1"), F.lit("100"), "MalwareIntelAttackType", "AttackSeverity", F.concat(F.lit("src="), "SourceAddress", F.lit(" dst="), "DestinationAddress", F.lit(" suser="), "SourceUserName"))
    return alerts(spark, d).select("alert_idx", s.parse_cef(line).alias("p")).select("alert_idx", "p.name", "p.severity", "p.src", "p.dst", "p.suser")


@query(over_alerts("SELECT pred_cluster, CASE WHEN n >= 10 AND t >= 4 THEN 'CRITICAL' WHEN n >= 5 AND t >= 3 THEN 'HIGH' WHEN n >= 3 OR t >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT pred_cluster, count(*) AS n, count(DISTINCT MalwareIntelAttackType) AS t FROM c GROUP BY 1)", CLUSTERED))
def s12_alert_severity(spark, d):
    g = clustered(spark, d).groupBy("pred_cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("MalwareIntelAttackType").alias("t"))
    return g.select("pred_cluster", s.alert_severity(F.col("n"), F.col("t")).alias("level"))


@query(over_alerts("SELECT x.alert_idx, CAST(floor(greatest(0, 1 - abs(epoch_us(x.EndDate) - epoch_us(y.EndDate)) / 1e6::DOUBLE / 3600.0::DOUBLE) * 100000) AS BIGINT) AS proximity FROM alerts x JOIN alerts y ON y.alert_idx = x.alert_idx + 1"))
def m2_temporal_proximity(spark, d):
    a = alerts(spark, d).select("alert_idx", "EndDate")
    b = a.select((F.col("alert_idx") - 1).alias("alert_idx"), F.col("EndDate").alias("next"))
    return a.join(b, "alert_idx").select("alert_idx", F.floor(s.temporal_proximity(F.col("EndDate"), F.col("next")) * 100000).alias("proximity"))


@query(over_alerts("SELECT round(greatest(0.1, least(0.9, 0.3 + avg(severity) - 0.5)), 9)::DOUBLE AS threshold FROM alerts"))
def m3_confidence_threshold(spark, d):
    return co.confidence_threshold(alerts(spark, d), "severity").select(F.round("threshold", 9).alias("threshold"))


_DIV = " + ".join(f"count(DISTINCT nullif({c}, 'NIL'))" for c in COLS)


@query(over_alerts(f"SELECT round(greatest(0.1, least(0.8, 0.3 + least(0.1, log10(count(*)) / 10) + (({_DIV}) / count(*)::DOUBLE / 6 - 0.5) * 0.2 - least(0.1, (epoch(max(EndDate)) - epoch(min(EndDate))) / 3600.0 / 1000))), 9)::DOUBLE AS threshold FROM alerts"))
def m4_adaptive_threshold(spark, d):
    return co.adaptive_threshold(alerts(spark, d), ROLES).select(F.round("threshold", 9).alias("threshold"))


@query("SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id + 1 = y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.2")
def m8_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").where(s.cosine(F.col("embedding"), F.col("other")) >= 0.2).select(F.col("vec_id").alias("a"), "b")


_PAIRS = """p AS (SELECT x.alert_idx AS i, y.alert_idx AS j, 6 * (coalesce(x.SourceAddress = y.SourceAddress, false)::INT + coalesce(x.DestinationAddress = y.DestinationAddress, false)::INT
  + coalesce(nullif(x.DeviceAddress, 'NIL') = nullif(y.DeviceAddress, 'NIL'), false)::INT) + 3 * (coalesce(x.SourceHostName = y.SourceHostName, false)::INT
  + coalesce(x.DeviceHostName = y.DeviceHostName, false)::INT + coalesce(x.DestinationHostName = y.DestinationHostName, false)::INT) AS w,
  greatest(0, 1 - abs(epoch(x.EndDate) - epoch(y.EndDate)) / 3600.0) AS t FROM {a} x JOIN {a} y ON x.alert_idx <> y.alert_idx)"""
_COMPONENTS = """r(id, root) AS (SELECT alert_idx, alert_idx FROM {a} UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.id),
k AS (SELECT id AS alert_idx, min(root) AS root FROM r GROUP BY id)"""
_NUMBERED = "SELECT alert_idx, dense_rank() OVER (ORDER BY root) - 1 AS pred_cluster FROM k"


@query(over_alerts(_NUMBERED, _PAIRS.format(a="alerts"), "l AS (SELECT i, j FROM p WHERE w >= 13.5)", _COMPONENTS.format(a="alerts"), recursive=True))
def c1_correlate(spark, d):
    return co.correlate(alerts(spark, d), ROLES, 0.5).select("alert_idx", "pred_cluster")


@query(over_alerts(_NUMBERED, _PAIRS.format(a="alerts"), "l AS (SELECT i, j FROM p WHERE w + t >= 0.45 * 28)", _COMPONENTS.format(a="alerts"), recursive=True))
def c1_correlate_temporal(spark, d):
    return co.correlate(alerts(spark, d), ROLES, 0.45, time_col="EndDate").select("alert_idx", "pred_cluster")


@query(over_alerts("SELECT alert_idx, round(coalesce(m, 0) / 27.0, 9)::DOUBLE AS max_correlation_score FROM alerts LEFT JOIN (SELECT i, max(w) AS m FROM p GROUP BY i) ON i = alert_idx", _PAIRS.format(a="alerts")))
def w10_max_score(spark, d):
    return co.max_scores(alerts(spark, d), ROLES).withColumn("max_correlation_score", F.round("max_correlation_score", 9))


@query(over_alerts("SELECT x.alert_idx AS src, y.alert_idx AS dst, round(w / 27.0, 9)::DOUBLE AS score FROM p JOIN alerts x ON x.alert_idx = i JOIN alerts y ON y.alert_idx = j WHERE j = i + 1 AND w >= 0.2 * 27", _PAIRS.format(a="alerts")))
def j4_candidate_links(spark, d):
    a = alerts(spark, d)
    pairs = a.select(F.col("alert_idx").alias("src"), (F.col("alert_idx") + 1).alias("dst"))
    return co.candidate_links(a, pairs, ROLES, 0.2).withColumn("score", F.round("score", 9))


@query(over_alerts("SELECT alert_idx, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT alert_idx, min(alert_idx) OVER (PARTITION BY SourceAddress, DestinationAddress, DeviceAddress) AS f FROM alerts)"))
def k5_signature_groups(spark, d):
    return co.signature_groups(alerts(spark, d), ROLES.addresses)


@query(over_alerts("SELECT alert_idx, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT alert_idx, min(alert_idx) OVER (PARTITION BY split_part(SourceAddress, '.', 3), split_part(DestinationAddress, '.', 3), DeviceAddress = 'NIL') AS f FROM alerts)"))
def k6_subnet_groups(spark, d):
    return co.signature_groups(alerts(spark, d), ROLES.addresses, subnets=True)


@query(over_alerts("SELECT alert_idx, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM k", "s0 AS (SELECT alert_idx, 'u' || CAST(alert_idx // 5 AS VARCHAR) AS v FROM alerts UNION ALL SELECT alert_idx, 't' || CAST((alert_idx + 2) // 3 AS VARCHAR) FROM alerts WHERE k > 40)", "l AS (SELECT x.alert_idx AS i, y.alert_idx AS j FROM s0 x JOIN s0 y USING (v))", "b AS (SELECT DISTINCT alert_idx FROM s0)", _COMPONENTS.format(a="b"), recursive=True))
def j5_shared_labels(spark, d):
    i = F.col("alert_idx")
    a = alerts(spark, d).select(i, F.floor(i / 5).cast("string").alias("u"), F.when(F.col("k") > 40, F.floor((i + 2) / 3).cast("string")).alias("t"))
    return co.shared_label_components(a, ["u", "t"]).select("alert_idx", "cluster")


@query(over_alerts("SELECT alert_idx, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT alert_idx, min(alert_idx) OVER (PARTITION BY user_id, k) AS f FROM alerts)"))
def j18_consensus(spark, d):
    return co.consensus(alerts(spark, d), "user_id", "k", (0.5, 0.5)).select("alert_idx", "cluster")


@query(over_alerts("SELECT c.alert_idx, CASE WHEN severity < 0.5 THEN q.n + (SELECT max(pred_cluster) FROM c) + 1 ELSE pred_cluster END AS pred_cluster FROM c LEFT JOIN (SELECT alert_idx, dense_rank() OVER (ORDER BY root) - 1 AS n FROM k) q USING (alert_idx)", CLUSTERED, "lo AS (SELECT * FROM alerts WHERE severity < 0.5)", _PAIRS.format(a="lo"), "l AS (SELECT i, j FROM p WHERE w >= 13.5)", _COMPONENTS.format(a="lo"), recursive=True))
def j28_confidence_refine(spark, d):
    return co.refine(clustered(spark, d), "severity", 0.5, ROLES, 0.5).select("alert_idx", "pred_cluster")


@query(over_alerts("SELECT id AS node, min(root) AS component FROM r GROUP BY id", "l AS (SELECT user_id AS i, user_id + 7 AS j FROM (SELECT DISTINCT user_id FROM alerts) UNION SELECT user_id + 7, user_id FROM (SELECT DISTINCT user_id FROM alerts))", "r(id, root) AS (SELECT i, i FROM l UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.id)", recursive=True))
def g1_components(spark, d):
    u = alerts(spark, d).select("user_id").distinct()
    return connected_components(u.select(F.col("user_id").alias("src"), (F.col("user_id") + 7).alias("dst")))


# the tactics of CRITICAL_TACTICS and weights 0.3, 0.5, 0.2
_SCORES = "sc AS (SELECT pred_cluster, count(*) AS size, avg(severity) AS mean_severity, max(severity) AS max_severity, string_agg(DISTINCT MalwareIntelAttackType, ',' ORDER BY MalwareIntelAttackType) AS tactics, count(DISTINCT MalwareIntelAttackType) AS n_tactics, max(CASE WHEN MalwareIntelAttackType IN ('Exploits', 'Backdoors') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS critical_flag FROM c GROUP BY 1)", "im AS (SELECT *, 0.3::DOUBLE * ln(1 + size) + 0.5::DOUBLE * mean_severity + 0.2::DOUBLE * critical_flag AS importance FROM sc)"


def _scores(spark, d):
    return cl.score_clusters(clustered(spark, d))


_SEVERE = "c AS (SELECT * REPLACE (CASE WHEN user_id % 5 = 0 THEN 0.75 + severity / 4 ELSE severity END AS severity), user_id * 40 + alert_idx % 40 // 2 AS pred_cluster FROM alerts)"


@query(over_alerts("SELECT pred_cluster, size, round(mean_severity, 9) AS mean_severity, round(max_severity, 9) AS max_severity, tactics, n_tactics, critical_flag, round(importance, 9) AS importance, CASE WHEN size < 10 AND mean_severity < 0.7 AND critical_flag = 0 THEN 'Standard cluster' ELSE concat_ws('; ', CASE WHEN size >= 10 THEN 'Large cluster (' || CAST(size AS VARCHAR) || ' alerts)' END, CASE WHEN mean_severity >= 0.7 THEN 'High severity' END, CASE WHEN critical_flag > 0 THEN 'Critical tactic detected' END) END AS reason FROM im", _SEVERE, *_SCORES))
def a1_cluster_scores(spark, d):
    i, u = F.col("alert_idx"), F.col("user_id")
    a = alerts(spark, d).withColumn("severity", F.when(u % 5 == 0, 0.75 + F.col("severity") / 4).otherwise(F.col("severity"))).withColumn("pred_cluster", u * 40 + F.floor(i % 40 / 2))
    return cl.score_clusters(a).select("pred_cluster", "size", F.round("mean_severity", 9).alias("mean_severity"), F.round("max_severity", 9).alias("max_severity"), "tactics", "n_tactics", "critical_flag", F.round("importance", 9).alias("importance"), "reason")


def _top(by: str, cols: str = "pred_cluster, size") -> str:
    return over_alerts(f"SELECT {cols} FROM im ORDER BY {by} DESC, pred_cluster LIMIT 20", CLUSTERED, *_SCORES)


@query(_top("size"))
def t1_topk_size(spark, d):
    return cl.top_clusters(_scores(spark, d), "size").select("pred_cluster", "size")


@query(_top("round(mean_severity, 9)", "pred_cluster, round(mean_severity, 9) AS mean_severity"))
def t2_topk_severity(spark, d):
    return cl.top_clusters(_scores(spark, d).withColumn("r", F.round("mean_severity", 9)), "r").select("pred_cluster", F.round("mean_severity", 9).alias("mean_severity"))


@query(_top("round(importance, 9)", "pred_cluster, round(importance, 9) AS importance"))
def t3_topk_importance(spark, d):
    return cl.top_clusters(_scores(spark, d).withColumn("r", F.round("importance", 9)), "r").select("pred_cluster", F.round("importance", 9).alias("importance"))


@query(over_alerts("SELECT pred_cluster FROM im WHERE size >= 40 AND mean_severity >= 0.3 AND importance >= 1", CLUSTERED, *_SCORES))
def f2_cluster_thresholds(spark, d):
    return cl.clusters_at_least(_scores(spark, d), 40, 0.3, 1.0).select("pred_cluster")


@query(over_alerts("SELECT DISTINCT pred_cluster FROM c WHERE MalwareIntelAttackType = 'DoS'", CLUSTERED))
def f3_semantic(spark, d):
    return cl.semantic_clusters(clustered(spark, d), ("d_o-s",))


@query(over_alerts("SELECT pred_cluster, count(*) AS hits FROM c WHERE regexp_matches(lower(SourceAddress), '10.0.3.') OR regexp_matches(lower(DestinationAddress), '10.0.3.') OR regexp_matches(DeviceAddress, '10.0.3.') OR regexp_matches(DestinationHostName, 'srv-1$') OR regexp_matches(SourceHostName, 'srv-1$') OR regexp_matches(SourceHostName, '10.0.3.') OR regexp_matches(DestinationHostName, '10.0.3.') GROUP BY 1", CLUSTERED))
def f4_critical_assets(spark, d):
    return cl.asset_clusters(clustered(spark, d), ("10.0.3.", "SRV-1$"))


@query(over_alerts("SELECT alert_idx FROM c WHERE pred_cluster IN (SELECT pred_cluster FROM im ORDER BY size DESC, pred_cluster LIMIT 20)", CLUSTERED, *_SCORES))
def f5_membership(spark, d):
    return cl.keep_selected(clustered(spark, d), cl.top_clusters(_scores(spark, d), "size")).select("alert_idx")


@query(over_alerts("SELECT pred_cluster FROM top UNION SELECT pred_cluster FROM q WHERE r <= 5", CLUSTERED, *_SCORES, "c2 AS (SELECT pred_cluster, CASE WHEN pred_cluster % 4 = 0 THEN MalwareIntelAttackType ELSE 'DoS' END AS t FROM c)", "top AS (SELECT pred_cluster FROM im ORDER BY size DESC, pred_cluster LIMIT 3)", "rare AS (SELECT t FROM (SELECT DISTINCT pred_cluster, t FROM c2) LEFT JOIN top USING (pred_cluster) GROUP BY t HAVING count(top.pred_cluster) < 2)", "q AS (SELECT pred_cluster, t, row_number() OVER (PARTITION BY t ORDER BY round(importance, 9) DESC, pred_cluster) AS r FROM (SELECT DISTINCT pred_cluster, t FROM c2) JOIN rare USING (t) JOIN im USING (pred_cluster))".replace("FROM top", "FROM top")))
def t4_backfill(spark, d):
    c = clustered(spark, d).withColumn("MalwareIntelAttackType", F.when(F.col("pred_cluster") % 4 == 0, F.col("MalwareIntelAttackType")).otherwise("DoS"))
    sc = _scores(spark, d).withColumn("importance", F.round("importance", 9))
    return cl.backfill_rare(c, sc, cl.top_clusters(sc, "size", 3), reservoir=5)


@query(over_alerts(f"SELECT pred_cluster, count(*) AS events, CAST(epoch(min(EndDate)) AS BIGINT) AS first_seen, CAST(epoch(max(EndDate)) AS BIGINT) AS last_seen, string_agg(DISTINCT MalwareIntelAttackType, ',' ORDER BY MalwareIntelAttackType) AS types, string_agg(DISTINCT {_TACTIC}, ',' ORDER BY {_TACTIC}) AS tactics, min(SourceAddress) AS addresses, round(avg(severity), 9) AS avg_severity FROM c GROUP BY 1", CLUSTERED))
def a2_cluster_summary(spark, d):
    return cl.summarise(clustered(spark, d)).select("pred_cluster", "events", F.floor(F.unix_micros("first_seen") / 1e6 + 0.5).alias("first_seen"), F.floor(F.unix_micros("last_seen") / 1e6 + 0.5).alias("last_seen"), "types", "tactics", "addresses", "avg_severity")


@query(over_alerts(f"SELECT CAST(sum(n) AS BIGINT) AS events, count(*) AS clusters, round(avg(n), 9) AS avg_size, max(n) AS max_size, min(n) AS min_size, (SELECT count(DISTINCT MalwareIntelAttackType) FROM c) AS types, (SELECT count(DISTINCT {_TACTIC}) FROM c) AS tactics FROM (SELECT count(*) AS n FROM c GROUP BY pred_cluster)", CLUSTERED))
def a3_global_stats(spark, d):
    return cl.global_stats(clustered(spark, d))


@query(over_alerts("SELECT pred_cluster, count(*) AS size, least(count(*), 100) AS sampled, round(avg(severity), 9) AS mean_severity FROM c GROUP BY 1", CLUSTERED))
def a4_metadata(spark, d):
    return cl.metadata(clustered(spark, d))


@query(over_alerts("SELECT count(*) AS total, count(t.pred_cluster) AS shown, count(*) - count(t.pred_cluster) AS filtered, round(avg(CASE WHEN t.pred_cluster IS NOT NULL THEN size END), 9) AS avg_size, max(CASE WHEN t.pred_cluster IS NOT NULL THEN size END) AS max_size, round(avg(CASE WHEN t.pred_cluster IS NOT NULL THEN mean_severity END), 9) AS avg_severity FROM im LEFT JOIN (SELECT pred_cluster FROM im ORDER BY size DESC, pred_cluster LIMIT 20) t USING (pred_cluster)", CLUSTERED, *_SCORES))
def a5_filter_summary(spark, d):
    sc = _scores(spark, d)
    return cl.filter_summary(sc, cl.top_clusters(sc, "size"))


@query(over_alerts("SELECT alert_idx FROM q WHERE k IN (SELECT k FROM q GROUP BY k HAVING count(*) > 3 AND count(DISTINCT MalwareIntelAttackType) > 1)", "q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY severity DESC, k, alert_idx) AS r FROM alerts) WHERE r = 1)"))
def f6_clean_clusters(spark, d):
    a = alerts(spark, d).withColumn("pair", F.concat_ws(":", "user_id", "k")).withColumn("order", F.struct("severity", -F.col("alert_idx")))
    return cl.clean_clusters(a, "pair", "order", 3, "k").select("alert_idx")


@query(over_alerts(f"SELECT pred_cluster, strftime(min(EndDate), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(EndDate), '%Y-%m-%d %H:%M:%S') AS \"end\", min(CustomerName) AS customer, string_agg(DISTINCT MalwareIntelAttackType, ',' ORDER BY MalwareIntelAttackType) AS types, string_agg(DISTINCT DeviceAddress, ',' ORDER BY DeviceAddress) AS devices, string_agg(DISTINCT {_TACTIC}, ',' ORDER BY {_TACTIC}) AS tactics, 'Other' AS scenario FROM c GROUP BY 1", CLUSTERED))
def a8_cluster_report(spark, d):
    return cl.report(clustered(spark, d))


@query(over_alerts("SELECT min(alert_idx) AS alert_idx FROM alerts GROUP BY SourceAddress, DestinationAddress, DeviceAddress"))
def f1_first_of_addresses(spark, d):
    return cl.first_of_addresses(alerts(spark, d), ROLES.addresses, ROLES.usernames).select("alert_idx")


@query(over_alerts("SELECT pred_cluster, anchor, round(sum(CASE WHEN k = 1 THEN n / 2.0 ELSE n + 0.8 * k END), 9)::DOUBLE AS score, count(*) AS matches FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY id) AS k FROM m) GROUP BY 1, 2", "q AS (SELECT alert_idx, user_id // 4 * 100 + k % 20 AS pred_cluster, SourceAddress AS a, DestinationAddress AS b, nullif(DeviceAddress, 'NIL') AS c0 FROM alerts)", "v AS (SELECT pred_cluster, alert_idx AS id, a AS x FROM q UNION SELECT pred_cluster, alert_idx, b FROM q UNION SELECT pred_cluster, alert_idx, c0 FROM q WHERE c0 IS NOT NULL)", "m AS (SELECT x.pred_cluster, x.id AS anchor, y.id, count(*) AS n FROM v x JOIN v y ON x.pred_cluster = y.pred_cluster AND x.x = y.x AND x.id < y.id GROUP BY 1, 2, 3)"))
def a9_anchor_chains(spark, d):
    return anchor_scores(_pair_clusters(spark, d), ROLES.addresses)


def _pair_clusters(spark: SparkSession, d: str) -> DataFrame:
    return alerts(spark, d).withColumn("pred_cluster", F.floor(F.col("user_id") / 4) * 100 + F.col("k") % 20)


_BOTH = (
    "q AS (SELECT alert_idx, user_id // 4 * 100 + k % 20 AS pred_cluster, SourceAddress AS a, DestinationAddress AS b, nullif(DeviceAddress, 'NIL') AS c0, SourceUserName AS u FROM alerts)",
    "v AS (SELECT pred_cluster, alert_idx AS id, a AS x, 0 AS role FROM q UNION SELECT pred_cluster, alert_idx, b, 0 FROM q UNION SELECT pred_cluster, alert_idx, c0, 0 FROM q WHERE c0 IS NOT NULL UNION SELECT pred_cluster, alert_idx, u, 1 FROM q)",
    "m AS (SELECT x.pred_cluster, x.id AS anchor, y.id, count(*) AS n FROM v x JOIN v y ON x.pred_cluster = y.pred_cluster AND x.x = y.x AND x.role = y.role AND x.id < y.id GROUP BY 1, 2, 3 HAVING count(DISTINCT x.role) = 2)",
    "sc AS (SELECT pred_cluster, anchor, round(sum(CASE WHEN k = 1 THEN n / 2.0 ELSE n + 0.8 * k END), 9)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY id) AS k FROM m) GROUP BY 1, 2)",
    "best AS (SELECT pred_cluster, score, anchor FROM sc QUALIFY row_number() OVER (PARTITION BY pred_cluster ORDER BY score DESC, anchor) = 1)",
)


@query(over_alerts("SELECT pred_cluster, anchor, score, anchor AS id FROM best UNION ALL SELECT pred_cluster, anchor, score, id FROM best JOIN m USING (pred_cluster, anchor)", *_BOTH))
def j6_best_chains(spark, d):
    return best_chains(_pair_clusters(spark, d), ROLES.addresses, ("SourceUserName",), require_both=True)


@query(over_alerts("SELECT pred_cluster, string_agg(DISTINCT n, ',' ORDER BY n) AS columns FROM v JOIN (SELECT pred_cluster, x FROM v GROUP BY 1, 2 HAVING count(DISTINCT id) > 1) USING (pred_cluster, x) GROUP BY 1", CLUSTERED, "v AS (SELECT pred_cluster, alert_idx AS id, 'SourceAddress' AS n, SourceAddress AS x FROM c UNION ALL SELECT pred_cluster, alert_idx, 'DeviceAddress', DeviceAddress FROM c WHERE DeviceAddress <> 'NIL' UNION ALL SELECT pred_cluster, alert_idx, 'DeviceHostName', DeviceHostName FROM c WHERE DeviceHostName IS NOT NULL)"))
def a10_feature_chains(spark, d):
    return cl.feature_chains(clustered(spark, d), ["SourceAddress", "DeviceAddress", "DeviceHostName"])
