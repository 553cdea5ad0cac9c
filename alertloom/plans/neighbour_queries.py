"""Queries of imputation, synthetic rows, Ward's agglomeration and the isolation forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import behaviour as be
from alertloom.operators import forest as fo
from alertloom.operators import neighbours as ne
from alertloom.plans.registry import over_alerts, query
from alertloom.schema import alerts, table


@query()
def k4_ward(spark, d):
    return ne.agglomerate(table(spark, d, "embeddings"), "embedding", "vec_id")


@query()
def k12_forest_risk(spark, d):
    act = be.activity(alerts(spark, d), "interval")
    marked = act.crossJoin(F.broadcast(act.agg(F.date_add(F.min("day"), 20).alias("cut"))))  # one row
    now, base = marked.where("day >= cut").drop("cut"), be.baseline(marked.where("day < cut").drop("cut"))
    return fo.combined_risk(now, base, be.anomalies(now, base)).withColumn("day", F.col("day").cast("string"))


_HOLES = "x AS (SELECT alert_idx, CASE WHEN k % 50 = 0 THEN NULL ELSE severity::DOUBLE END AS severity, k::DOUBLE AS k, user_id::DOUBLE AS u FROM alerts)"


@query(
    over_alerts(
        "SELECT alert_idx, k, u, round(coalesce(severity, (SELECT avg(n.severity) FROM (SELECT y.severity FROM x y WHERE y.severity IS NOT NULL ORDER BY (y.k - x.k) * (y.k - x.k) + (y.u - x.u) * (y.u - x.u), y.alert_idx LIMIT 2) n)), 6) AS severity FROM x",
        _HOLES,
    )
)
def p20_imputed(spark, d):
    x = alerts(spark, d).select("alert_idx", F.when(F.col("k") % 50 != 0, F.col("severity").cast("double")).alias("severity"), F.col("k").cast("double").alias("k"), F.col("user_id").cast("double").alias("u"))
    return ne.impute(x, ["severity", "k", "u"]).withColumn("severity", F.round("severity", 6))


@query(over_alerts("SELECT MalwareIntelAttackType AS kind, max(count(*)) OVER () AS n, max(count(*)) OVER () - count(*) AS made FROM alerts GROUP BY 1"))
def u5_synthetic_minority(spark, d):
    out = ne.synthetic_minority(alerts(spark, d), "MalwareIntelAttackType", ["severity", "k"])
    return out.groupBy(F.col("MalwareIntelAttackType").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("copy") > 0, 1)).alias("made"))
