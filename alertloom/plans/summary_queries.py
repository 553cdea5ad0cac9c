"""Queries of the filters, summaries, scores and samples over results."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import sampling as sa
from alertloom.operators import summaries as su
from alertloom.plans.core_queries import k5_signature_groups, k6_subnet_groups
from alertloom.plans.label_queries import _FUZ, _LABELLED, _MAPPED, _PAT, labelled
from alertloom.plans.registry import ORACLE, over_alerts, query
from alertloom.schema import alerts, table


@query(over_alerts("SELECT alert_idx FROM alerts WHERE k % 5 <> 0"))
def f11_attack_rows(spark, d):
    a = alerts(spark, d).withColumn("kind", F.when(F.col("k") % 5 == 0, "normal").otherwise("attack"))
    return su.attack_rows(a, "kind").select("alert_idx")


@query(over_alerts("SELECT alert_idx FROM alerts"))
def f11_without_attacks(spark, d):
    return su.attack_rows(alerts(spark, d).withColumn("kind", F.lit("normal")), "kind").select("alert_idx")


@query(over_alerts("SELECT alert_idx FROM alerts WHERE k % 3 = 0 AND user_id % 12 IN (2, 3, 7, 9, 10)"))
def f12_logons(spark, d):
    a = alerts(spark, d).select("alert_idx", F.when(F.col("k") % 3 == 0, "An account was successfully Logged On").otherwise("off").alias("event"), (F.col("user_id") % 12).alias("kind"))
    return su.logons(a, "event", "kind").select("alert_idx")


@query(over_alerts("SELECT alert_idx, CAST(k % 7 - 1 AS INT) AS gt FROM alerts WHERE k % 7 - 1 >= 0"))
def f16_without_noise(spark, d):
    return su.without_noise(alerts(spark, d).select("alert_idx", (F.col("k") % 7 - 1).cast("int").alias("gt")), "gt")


_AGED = "ag AS (SELECT user_id * 1000 + k AS cluster, count(*) AS count, min(EndDate) AS created_at FROM alerts GROUP BY 1), nw AS (SELECT max(EndDate) AS now FROM alerts)"


@query(over_alerts("SELECT cluster, count >= 2 AS active FROM ag, nw WHERE NOT ((epoch(now) - epoch(created_at)) / 60 > 60 * 24 * 7 AND count < 2)", _AGED))
def f19_active_clusters(spark, d):
    a = alerts(spark, d)
    c = a.groupBy((F.col("user_id") * 1000 + F.col("k")).alias("cluster")).agg(F.count(F.lit(1)).alias("count"), F.min("EndDate").alias("created_at"))
    now = a.agg(F.max("EndDate").alias("now"))
    kept = su.pruned_clusters(c.crossJoin(F.broadcast(now)), F.col("now"), 60 * 24 * 7, 2)  # one row
    active = su.active_clusters(kept, 2).select("cluster", F.lit(True).alias("active"))
    return kept.join(active, "cluster", "left").select("cluster", F.coalesce("active", F.lit(False)).alias("active"))


@query(over_alerts("SELECT alert_idx FROM alerts WHERE user_id = 3 ORDER BY alert_idx LIMIT 200"))
def f20_cluster_page(spark, d):
    return su.of_cluster(alerts(spark, d), "user_id", 3, most=200).select("alert_idx")


@query(over_alerts("SELECT r.CustomerName, n, rank FROM (SELECT CustomerName, count(*) AS n FROM alerts GROUP BY 1) r JOIN (VALUES ('CUST-0', 1), ('CUST-2', 2), ('CUST-9', 3)) s(CustomerName, rank) USING (CustomerName)"))
def j27_by_dataset(spark, d):
    settings = spark.createDataFrame([("CUST-0", 1), ("CUST-2", 2), ("CUST-9", 3)], "CustomerName string, rank int")
    return su.by_dataset(alerts(spark, d).groupBy("CustomerName").agg(F.count(F.lit(1)).alias("n")), settings, "CustomerName")


@query(over_alerts("SELECT CustomerName, count(*) AS samples, count(DISTINCT CASE WHEN tactic NOT IN ('None', 'Unknown') THEN tactic END) AS covered, count(DISTINCT label) AS attack_types, 14 - count(DISTINCT CASE WHEN tactic NOT IN ('None', 'Unknown') THEN tactic END) AS missing, round(count(DISTINCT CASE WHEN tactic NOT IN ('None', 'Unknown') THEN tactic END) * 100.0 / 14, 6)::DOUBLE AS coverage FROM lab JOIN mapped USING (label) GROUP BY 1", _LABELLED, _PAT, _FUZ, _MAPPED))
def a20_dataset_comparison(spark, d):
    return su.compare_datasets(labelled(spark, d), "CustomerName", "label").withColumn("coverage", F.round("coverage", 6))


@query(over_alerts("SELECT MalwareIntelAttackType AS method, round(quantile_cont(severity * 1000 + 1, 0.5), 6)::DOUBLE AS latency_ms, round(quantile_cont(severity * 1000 + 1, 0.95), 6)::DOUBLE AS latency_p95_ms, round(max(k) / (quantile_cont(severity * 1000 + 1, 0.5) / 1000), 4)::DOUBLE AS throughput FROM alerts GROUP BY 1"))
def a23_latency(spark, d):
    a = alerts(spark, d).select(F.col("MalwareIntelAttackType").alias("method"), (F.col("severity") * 1000 + 1).alias("ms"), "k")
    return su.latency(a, "method", "ms", "k").select("method", F.round("latency_ms", 6).alias("latency_ms"), F.round("latency_p95_ms", 6).alias("latency_p95_ms"), F.round("throughput", 4).alias("throughput"))


@query(over_alerts("SELECT MalwareIntelAttackType, printf('%.3f \\pm %.3f', avg(k), stddev_pop(k)) AS text FROM alerts GROUP BY 1"))
def a28_mean_and_spread(spark, d):
    return su.mean_and_spread(alerts(spark, d), "MalwareIntelAttackType", "k")


@query(over_alerts("SELECT count(*) AS runs, CAST(sum(events) AS BIGINT) AS events, CAST(sum(clusters) AS BIGINT) AS clusters, round(sum(events) / sum(clusters), 6)::DOUBLE AS mean_cluster_size, round(avg(ok::INT), 6)::DOUBLE AS success_rate, CAST(sum(seconds) AS BIGINT) AS seconds, round(avg(seconds), 6)::DOUBLE AS mean_seconds FROM (SELECT user_id, count(*) AS events, count(DISTINCT k) AS clusters, min(k) < 5 AS ok, max(k) AS seconds FROM alerts GROUP BY 1)"))
def a29_roll_up(spark, d):
    r = alerts(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("k").alias("clusters"), (F.min("k") < 5).alias("ok"), F.max("k").alias("seconds"))
    out = su.roll_up(r)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_QUALITY = """q AS (SELECT greatest(0, 1 - var_pop(n) / avg(n) / 2) AS size, least(1, 2 * avg(dd / (2.0 * n))) AS diversity FROM (SELECT user_id, count(*) AS n FROM alerts GROUP BY 1) JOIN
  (SELECT user_id, count(DISTINCT a) AS dd FROM (SELECT user_id, SourceAddress AS a FROM alerts UNION ALL SELECT user_id, DestinationAddress FROM alerts) GROUP BY 1) USING (user_id)),
sp AS (SELECT least(1, (epoch(max(EndDate)) - epoch(min(EndDate))) / (7 * 24 * 3600)) AS span FROM alerts)"""


@query(over_alerts("SELECT round(size, 6)::DOUBLE AS size, round(diversity, 6)::DOUBLE AS diversity, round(span, 6)::DOUBLE AS span, round((size + diversity + span) / 3, 6)::DOUBLE AS quality FROM q, sp", _QUALITY))
def e13_dataset_quality(spark, d):
    q = su.dataset_quality(alerts(spark, d), "user_id")
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query(over_alerts("SELECT count(DISTINCT user_id) AS n_clusters, count(DISTINCT CASE WHEN k % 3 <> 0 THEN user_id END) AS n_plain_clusters, count(DISTINCT CASE WHEN k % 3 = 0 THEN user_id END) AS n_refined_clusters, round(avg((k % 3 = 0)::INT), 6)::DOUBLE AS refined_share, round(avg(severity), 6) AS avg_confidence, round(quantile_cont(severity, 0.25), 6) AS p25_confidence, round(avg(CASE WHEN k % 3 = 0 THEN k / 100.0 END), 6)::DOUBLE AS threshold_used FROM alerts"))
def e17_sweep_row(spark, d):
    a = alerts(spark, d).withColumn("m", F.when(F.col("k") % 3 == 0, "refined").otherwise("plain")).withColumn("t", F.col("k") / 100)
    out = su.sweep_row(a, "m", "refined", "user_id", "severity", "t")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_DOMINANT = "cl AS (SELECT *, (k + user_id) % 13 AS c, 'camp-' || CAST(user_id % 11 AS VARCHAR) AS camp FROM alerts), dom AS (SELECT camp, arg_max(c, (n, -c)) AS dominant FROM (SELECT camp, c, count(*) AS n FROM cl GROUP BY 1, 2) GROUP BY 1)"


@query(
    over_alerts(
        "SELECT camp, dominant, round(CASE WHEN b = 0 THEN 0 ELSE 2.0 * b / (o + h) END, 9)::DOUBLE AS f1 FROM (SELECT camp, dominant, (SELECT count(DISTINCT t) FROM x WHERE x.camp = dom.camp) AS o, (SELECT count(DISTINCT t) FROM x WHERE c = dominant) AS h, (SELECT count(DISTINCT t) FROM x WHERE x.camp = dom.camp AND t IN (SELECT t FROM x y WHERE y.c = dominant)) AS b FROM dom)",
        _DOMINANT, "x AS (SELECT camp, c, MalwareIntelAttackType || CAST(user_id % 4 AS VARCHAR) AS t FROM cl)",
    )
)
def e18_campaign_f1(spark, d):
    a = alerts(spark, d).select(((F.col("k") + F.col("user_id")) % 13).alias("c"), F.concat(F.lit("camp-"), (F.col("user_id") % 11).cast("string")).alias("camp"), F.concat("MalwareIntelAttackType", (F.col("user_id") % 4).cast("string")).alias("t"))
    return su.campaign_f1(a, "camp", "c", "t").select("camp", "dominant", F.round("f1", 9).alias("f1"))


@query(
    """WITH v AS (SELECT vec_id, label AS c, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT c, count(*) AS n FROM v GROUP BY 1),
    p AS (SELECT a.vec_id, a.c, b.c AS o, sum(pow(list_distance(a.x, b.x), 2)) AS s FROM v a JOIN v b ON true GROUP BY 1, 2, 3),
    d AS (SELECT vec_id, max(CASE WHEN p.c = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN p.c <> o THEN s / n END) AS b FROM p JOIN n ON n.c = p.o GROUP BY 1)
    SELECT vec_id, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS silhouette FROM d"""
)
def e8_silhouette(spark, d):
    return su.silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 6))


@query(over_alerts("SELECT alert_idx, row_number() OVER (ORDER BY EndDate NULLS LAST, e2 NULLS LAST, alert_idx) AS place FROM (SELECT *, nullif(k, 5) AS e2 FROM alerts)"))
def t5_time_order(spark, d):
    a = alerts(spark, d).withColumn("e2", F.nullif("k", F.lit(5)))
    from alertloom.operators.correlation import dense

    ordered = su.in_time_order(a, ["EndDate", "missing", "e2", "alert_idx"]).select("alert_idx", F.struct(F.col("EndDate").isNull(), "EndDate", F.col("e2").isNull(), "e2", "alert_idx").alias("key"))
    return dense(ordered, "key", "place").select("alert_idx", (F.col("place") + 1).alias("place"))


_FP = "fp(kind, value, n) AS (SELECT 'tactic', MalwareIntelAttackType, count(*) FROM alerts GROUP BY ALL UNION ALL SELECT 'hour', CAST(hour(EndDate) AS VARCHAR), count(*) FROM alerts GROUP BY ALL UNION ALL SELECT 'size', CAST(k // 10 * 10 AS VARCHAR), count(*) FROM alerts GROUP BY ALL)"


@query(
    over_alerts(
        "SELECT CASE kind WHEN 'tactic' THEN 'tactic_threshold_' WHEN 'size' THEN 'size_penalty_' ELSE 'time_adjustment_' END || value AS rule_id, CASE kind WHEN 'size' THEN 'apply_penalty' ELSE 'increase_threshold' END AS action, CASE kind WHEN 'tactic' THEN 0.1 ELSE 0.05 END::DOUBLE AS amount, least(1.0, n / 10.0)::DOUBLE AS confidence, n AS fp_count FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS r FROM fp) WHERE (kind = 'size' AND n >= 5) OR (kind <> 'size' AND r <= 3 AND n >= 3)",
        _FP,
    )
)
def t9_adjustment_rules(spark, d):
    a = alerts(spark, d)
    count = lambda kind, c: a.groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    p = count("tactic", F.col("MalwareIntelAttackType")).unionByName(count("hour", F.hour("EndDate"))).unionByName(count("size", F.floor(F.col("k") / 10) * 10))
    return su.adjustment_rules(p)


_U4 = "cls AS (SELECT *, CASE WHEN k < 55 THEN 'normal' WHEN k < 90 THEN 'dos' WHEN k < 98 THEN 'probe' ELSE 'r2l' END AS label FROM alerts), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(alert_idx AS VARCHAR))) AS r, count(*) OVER (PARTITION BY label) AS n FROM cls)"


@query(
    over_alerts(
        "SELECT alert_idx, CAST(c AS INT) AS copy FROM rk, (SELECT greatest(min(n) FILTER (label <> 'normal'), 30) AS t, count(*) FILTER (label <> 'normal') AS a FROM rk), range(0, 60) x(c) WHERE c * n + r <= CASE WHEN label = 'normal' THEN least(n, 2 * a) WHEN n < t THEN t ELSE least(2 * t, n) END",
        _U4,
    )
)
def u4_balance_normal(spark, d):
    k = F.col("k")
    a = alerts(spark, d).withColumn("label", F.when(k < 55, "normal").when(k < 90, "dos").when(k < 98, "probe").otherwise("r2l"))
    return sa.balance_normal(a, "label", least=30).select("alert_idx", "copy")


@query(over_alerts("SELECT alert_idx, CAST(c AS INT) AS copy FROM rk, (SELECT floor(quantile_cont(n, 0.5)) AS t FROM (SELECT DISTINCT label, n FROM rk)), range(0, 200) x(c) WHERE c * n + r <= t", _U4))
def u4_balance_median(spark, d):
    k = F.col("k")
    a = alerts(spark, d).withColumn("label", F.when(k < 55, "normal").when(k < 90, "dos").when(k < 98, "probe").otherwise("r2l"))
    return sa.balance(a, "label", "median").select("alert_idx", "copy")


@query(over_alerts("SELECT alert_idx, array_to_string(list_sort(list_distinct([v FOR v IN x IF list_contains(y, v)])), ',') AS common, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS everything, array_to_string(list_sort(list_distinct([v FOR v IN x IF NOT list_contains(y, v)])), ',') AS first_only FROM (SELECT alert_idx, [v FOR v IN [SourceHostName, DeviceHostName, DeviceAddress] IF v IS NOT NULL AND v <> 'NIL'] AS x, [v FOR v IN ['host-' || CAST(k AS VARCHAR), DeviceHostName] IF v IS NOT NULL] AS y FROM alerts)"))
def u10_value_sets(spark, d):
    a = alerts(spark, d).withColumn("other", F.concat(F.lit("host-"), F.col("k").cast("string")))
    sets = su.value_sets(["SourceHostName", "DeviceHostName", "DeviceAddress"], ["other", "DeviceHostName"])
    return a.select("alert_idx", *[F.array_join(c, ",").alias(n) for c, n in zip(sets, ("common", "everything", "first_only"), strict=True)])


@query(over_alerts("SELECT src, dst FROM (SELECT DISTINCT user_id AS src, k + 1000 AS dst FROM alerts) ORDER BY md5('42:' || CAST(src AS VARCHAR) || '-' || CAST(dst AS VARCHAR)), src, dst LIMIT 100"))
def u12_edge_sample(spark, d):
    return su.edge_sample(alerts(spark, d).select(F.col("user_id").alias("src"), (F.col("k") + 1000).alias("dst")).distinct(), 100)


@query(over_alerts("SELECT alert_idx AS src, user_id AS dst, 'near' AS kind FROM alerts WHERE k % 2 = 0 UNION ALL SELECT alert_idx, alert_idx, 'none' FROM alerts"))
def g11_alert_edges(spark, d):
    a = alerts(spark, d)
    e = a.select(F.col("alert_idx").alias("src"), F.col("user_id").alias("dst"), F.when(F.col("k") % 2 == 0, "near").otherwise("user").alias("relation"))
    return su.alert_edges(e, a, ["near"]).withColumn("kind", F.lit("near")).unionByName(su.alert_edges(e, a, ["absent"]).withColumn("kind", F.lit("none")))


@query(f"SELECT 'signature' AS method, * FROM ({ORACLE['k5_signature_groups']}) UNION ALL SELECT 'subnet', * FROM ({ORACLE['k6_subnet_groups']})")
def k7_all_baselines(spark, d):
    return su.merged_clusterings(signature=k5_signature_groups(spark, d), subnet=k6_subnet_groups(spark, d))
