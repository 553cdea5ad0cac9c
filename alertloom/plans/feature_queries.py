"""Queries of the feature projections, decision rules and remaining joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import features as fe
from alertloom.functions import scalars as s
from alertloom.operators import decisions as de
from alertloom.operators import temporal as te
from alertloom.plans.core_queries import ROLES, _scores, clustered
from alertloom.plans.registry import CLUSTERED, over_alerts, query
from alertloom.schema import alerts, table


@query(over_alerts("SELECT alert_idx, 'host-' || replace(SourceAddress, '.', '-') AS SourceHostName, 'target-' || replace(DestinationAddress, '.', '-') AS DestinationHostName, strftime(EndDate, '%Y-%m-%dT%H:%M:%S') AS EndDate, CASE WHEN k % 5 = 0 THEN 'normal' ELSE 'attack' END AS alert_type, CASE WHEN k % 5 = 0 THEN 'None' ELSE 'Command and Control' END AS tactic FROM alerts"))
def p7_flow_projection(spark, d):
    raw = alerts(spark, d).select("alert_idx", F.col("SourceAddress").alias("src"), F.col("DestinationAddress").alias("dst"), F.date_format("EndDate", "dd/MM/yyyy HH:mm:ss").alias("time"), F.when(F.col("k") % 5 == 0, "Benign").otherwise("Mirai-x").alias("label"))
    return fe.flow_alerts(raw, "src", "dst", "label", "time").select("alert_idx", "SourceHostName", "DestinationHostName", "EndDate", "alert_type", F.col("MalwareIntelAttackType").alias("tactic"))


@query(over_alerts("SELECT alert_idx, coalesce(dense_rank() OVER (ORDER BY DeviceHostName NULLS LAST) - 1, -1) * CASE WHEN DeviceHostName IS NULL THEN 0 ELSE 1 END - CASE WHEN DeviceHostName IS NULL THEN 1 ELSE 0 END AS DeviceHostName_code, dense_rank() OVER (ORDER BY AttackSeverity) - 1 AS AttackSeverity_code FROM alerts"))
def p22_feature_codes(spark, d):
    return fe.coded(alerts(spark, d).select("alert_idx", "DeviceHostName", "AttackSeverity"), ["DeviceHostName", "AttackSeverity"]).select("alert_idx", "DeviceHostName_code", "AttackSeverity_code")


@query(over_alerts("SELECT coalesce(DeviceHostName, 'UNKNOWN') AS host, dense_rank() OVER (ORDER BY coalesce(DeviceHostName, 'UNKNOWN')) - 1 AS code FROM (SELECT DISTINCT DeviceHostName FROM alerts)"))
def p34_filled_codes(spark, d):
    return fe.coded(alerts(spark, d).select("DeviceHostName").distinct(), ["DeviceHostName"], "UNKNOWN").select(F.coalesce("DeviceHostName", F.lit("UNKNOWN")).alias("host"), F.col("DeviceHostName_code").alias("code"))


@query(over_alerts("SELECT alert_idx, round(hour(EndDate) / 23.0, 9)::DOUBLE AS hour, round((isodow(EndDate) - 1) / 6.0, 9)::DOUBLE AS day_of_week, round(day(EndDate) / 31.0, 9)::DOUBLE AS day FROM alerts"))
def p23_calendar_features(spark, d):
    return alerts(spark, d).select("alert_idx", *[F.round(c, 9).alias(n) for c, n in zip(fe.calendar(F.col("EndDate")), ("hour", "day_of_week", "day"), strict=True)])


@query(over_alerts("SELECT alert_idx, SourceAddress AS source, DestinationAddress AS target FROM alerts"))
def p24_entity_map(spark, d):
    a = alerts(spark, d)
    return a.select("alert_idx", fe.entity_map(a, "network").alias("m")).select("alert_idx", F.col("m")["source"].alias("source"), F.col("m")["target"].alias("target"))


@query(over_alerts("SELECT alert_idx, 20 AS width, round(hour(EndDate) / 24.0 + (isodow(EndDate) - 1) / 7.0 + day(EndDate) / 31.0 + k, 9)::DOUBLE AS total FROM alerts"))
def p25_feature_vector(spark, d):
    v = fe.feature_vector(F.col("EndDate"), [F.col("k")])
    return alerts(spark, d).select("alert_idx", F.size(v).alias("width"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query(over_alerts("SELECT alert_idx, SourceAddress AS src, CASE WHEN DeviceAddress = 'NIL' THEN '' ELSE DeviceAddress END AS device, CAST(least((hour(EndDate) * 60 + minute(EndDate)) // 5, 287) AS INT) AS bucket, CAST(CASE lower(AttackSeverity) WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END AS DOUBLE) AS severity FROM alerts"))
def p15_alert_tokens(spark, d):
    return fe.alert_tokens(alerts(spark, d))


@query(over_alerts("SELECT alert_idx, round((severity - (SELECT avg(severity) FROM alerts)) / (SELECT stddev_pop(severity) FROM alerts), 5) AS z FROM alerts"))
def p21_standard_scale(spark, d):
    return fe.scaled(alerts(spark, d).select("alert_idx", "severity"), ["severity"]).select("alert_idx", F.round("severity_scaled", 5).alias("z"))


@query(over_alerts("SELECT alert_idx, round(CASE WHEN x = y THEN 0 ELSE (e - x) / (y - x) END, 5)::DOUBLE AS t FROM (SELECT alert_idx, epoch(EndDate) AS e, min(epoch(EndDate)) OVER (PARTITION BY user_id) AS x, max(epoch(EndDate)) OVER (PARTITION BY user_id) AS y FROM alerts)"))
def p27_min_max_time(spark, d):
    return alerts(spark, d).select("alert_idx", F.round(fe.min_max_time(["user_id"], "EndDate"), 5).alias("t"))


@query(over_alerts("SELECT alert_idx, 3.0::DOUBLE AS total FROM alerts"))
def p32_hashed_features(spark, d):
    v = fe.hashed_features(["SourceAddress", "DestinationAddress", "DeviceAddress"])
    return alerts(spark, d).select("alert_idx", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(over_alerts("SELECT alert_idx, SourceAddress AS src_ip, DestinationAddress AS dst_ip FROM alerts"))
def p33_aliases(spark, d):
    return fe.with_aliases(alerts(spark, d), {"SourceAddress": "src_ip", "DestinationAddress": "dst_ip", "k": "user_id"}).select("alert_idx", "src_ip", "dst_ip")


@query(over_alerts("SELECT alert_idx, round(100 / (1 + exp(-(severity - 0.5) * 4)), 9) AS risk FROM alerts"))
def m7_risk_score(spark, d):
    return alerts(spark, d).select("alert_idx", F.round(s.risk_score((F.col("severity") - 0.5) * 4), 9).alias("risk"))


@query(over_alerts("SELECT alert_idx, round(0.4 * severity + 0.4 * (k / 100.0) + 0.2 * 0.5, 9)::DOUBLE AS threat FROM alerts"))
def m6_threat_score(spark, d):
    return alerts(spark, d).select("alert_idx", F.round(s.threat_score(F.col("severity"), F.col("k") / 100.0, F.lit(0.5)), 9).alias("threat"))


@query(over_alerts("SELECT pred_cluster, round(least(1.0, 0.3 * ln(1 + count(*)) / 5 + 0.4 * 0.5 + 0.3 * avg(severity) / 10), 9)::DOUBLE AS importance FROM c GROUP BY 1", CLUSTERED))
def m12_explanation_importance(spark, d):
    return _scores(spark, d).select("pred_cluster", F.round(s.explanation_importance(F.col("size"), F.lit(None).cast("double"), F.col("mean_severity")), 9).alias("importance"))


@query(over_alerts("SELECT k, count(DISTINCT MalwareIntelAttackType) AS mapped, round(count(DISTINCT MalwareIntelAttackType) / 14.0 * 100, 4)::DOUBLE AS pct FROM alerts GROUP BY 1"))
def s8_tactic_coverage(spark, d):
    n = F.countDistinct("MalwareIntelAttackType")
    return alerts(spark, d).groupBy("k").agg(n.alias("mapped"), F.round(n / 14.0 * 100, 4).alias("pct"))


@query(over_alerts("SELECT x.alert_idx AS src, y.alert_idx AS dst FROM (SELECT *, min(alert_idx) OVER (PARTITION BY MalwareIntelAttackType) AS f FROM alerts) x JOIN alerts y ON y.alert_idx = x.f WHERE x.alert_idx <> x.f"))
def j10_same_tactic_edges(spark, d):
    a = alerts(spark, d).select("alert_idx", "MalwareIntelAttackType")
    first = a.groupBy("MalwareIntelAttackType").agg(F.min("alert_idx").alias("dst"))
    return a.join(first, "MalwareIntelAttackType").where("alert_idx <> dst").select(F.col("alert_idx").alias("src"), "dst")


@query(over_alerts("SELECT DISTINCT pred_cluster, CASE k % 50 WHEN 7 THEN 'malware:Ryuk' WHEN 9 THEN 'malware:Emotet' ELSE 'malware:QakBot' END AS entity_id FROM c WHERE k % 50 IN (7, 9, 11)", CLUSTERED))
def j14_intel_text_match(spark, d):
    from alertloom.operators.enrichment import matches
    from alertloom.operators.intel import malware_table

    c = clustered(spark, d).withColumn("tactic", F.lit("none")).withColumn("process", F.when(F.col("k") % 50 == 7, F.concat(F.lit("C:/x/ryuk_"), "SourceHostName")).when(F.col("k") % 50 == 9, "EMOTET.dll").when(F.col("k") % 50 == 11, "x-QakBot-2").otherwise("svc.exe"))
    return matches(c, malware_table(spark), text="process")


_CUT = "iv AS (SELECT user_id, (alert_idx // 50) AS ch, epoch(min(EndDate)) AS a, epoch(max(EndDate)) AS z FROM alerts GROUP BY 1, 2)"


@query(over_alerts("SELECT x.user_id, x.ch AS first, y.ch AS second FROM iv x JOIN iv y ON x.user_id = y.user_id AND x.ch < y.ch AND abs(y.a - x.z) < 86400", _CUT))
def j21_chain_proximity(spark, d):
    iv = alerts(spark, d).groupBy("user_id", F.floor(F.col("alert_idx") / 50).alias("ch")).agg(F.min("EndDate").alias("a"), F.max("EndDate").alias("z"))
    x, y = iv.alias("x"), iv.alias("y")
    near = F.abs(F.unix_micros("y.a") - F.unix_micros("x.z")) < 86400 * 1_000_000
    return x.join(y, (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.ch") < F.col("y.ch")) & near).select("x.user_id", F.col("x.ch").alias("first"), F.col("y.ch").alias("second"))


@query(over_alerts("SELECT x.alert_idx, (x.SourceAddress = y.SourceAddress)::INT + (x.DestinationAddress = y.DestinationAddress)::INT + (x.MalwareIntelAttackType = y.MalwareIntelAttackType)::INT AS shared FROM alerts x JOIN alerts y ON y.alert_idx = x.alert_idx + 1"))
def j26_shared_attributes(spark, d):
    cols = ["SourceAddress", "DestinationAddress", "MalwareIntelAttackType"]
    a = alerts(spark, d).select("alert_idx", *cols)
    b = a.select((F.col("alert_idx") - 1).alias("alert_idx"), *[F.col(c).alias(f"n_{c}") for c in cols])
    return a.join(b, "alert_idx").select("alert_idx", sum(((F.col(c) == F.col(f"n_{c}")).cast("int") for c in cols), F.lit(0)).alias("shared"))


@query(over_alerts("SELECT round(avg(n), 9) AS avg_size, min(n) AS min_size, max(n) AS max_size, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, (rn - 1) // 30 AS ch, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY EndDate, alert_idx) AS rn FROM alerts) GROUP BY 1, 2 HAVING count(*) >= 5)"))
def a26_window_stats(spark, d):
    n = te.chunks(alerts(spark, d), ["user_id"]).groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.round(F.avg("n"), 9).alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.sum("n").alias("total"))


@query(over_alerts("SELECT alert_idx, dense_rank() OVER (ORDER BY f) - 1 AS truth FROM (SELECT alert_idx, min(alert_idx) OVER (PARTITION BY regexp_extract(SourceAddress, '^(.*)\\.', 1)) AS f FROM alerts)"))
def e14_subnet_labels(spark, d):
    from alertloom.operators.correlation import signature_groups

    return signature_groups(alerts(spark, d), ["SourceAddress"], subnets=True).withColumnRenamed("cluster", "truth")


@query(over_alerts("SELECT alert_idx, round(ab / a::DOUBLE, 9) AS agreement, round(CASE WHEN ab = a THEN 1.0 ELSE 0.7 * severity + 0.24 END, 9)::DOUBLE AS joint_confidence FROM (SELECT alert_idx, severity, count(*) OVER (PARTITION BY user_id, k % 2) AS ab, count(*) OVER (PARTITION BY user_id) AS a FROM alerts)"))
def k9_agreement(spark, d):
    a = alerts(spark, d).withColumn("second", F.col("k") % 2)
    return de.agreement(a, "user_id", "second", "severity").select("alert_idx", F.round("agreement", 9).alias("agreement"), F.round("joint_confidence", 9).alias("joint_confidence"))


@query()
def k1_auto_correlation(spark, d):
    return de.correlate_auto(alerts(spark, d), ROLES, 0.5, lambda df: df.select("alert_idx", F.col("user_id").alias("cluster"))).select("alert_idx", "pred_cluster", "correlation_method")


@query()
def b6_threshold_adaptation(spark, d):
    a = alerts(spark, d).withColumn("risk", F.col("k").cast("double")).withColumn("bad", F.col("severity") > 0.8)
    return de.adapt_thresholds(a, "SourceUserName", "risk", "bad", "alert_idx")


@query()
def k11_online_centroids(spark, d):
    return de.online_centroids(table(spark, d, "embeddings"), ["label"], "embedding", "vec_id", 0.3)
