"""Row-level threshold tiers, clusters of a stream, nearest candidates, merges by mean similarity, file manifests and formats."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from alertloom.operators import baselines as ba
from alertloom.operators import correlation as co
from alertloom.operators.knn import alert_vector, nearest_candidates
from alertloom.plans.core_queries import _COMPONENTS, _NUMBERED, _PAIRS, COLS, ROLES
from alertloom.plans.registry import ORACLE, over_alerts, query
from alertloom.plans.stage import shared_dir
from alertloom.schema import alerts, table
from alertloom.sources import manifest as mf
from alertloom.streaming.incremental import IncrementalCorrelator
from alertloom.streaming.stateful import finished

#: Rounds of label passing in the SQL below; alerts' columns have few values, so labels settle in two or three.
_ROUNDS = 8


def _labels_sql(name: str, tenths: int) -> str:
    """CTEs in which each alert takes the least label of the groups that it shares ``tenths`` of weight with, again and again."""
    weight = [6, 6, 6, 3, 3, 3]
    sets = [s for k in range(1, 7) for s in combinations(range(6), k) if sum(weight[i] for i in s) >= tenths]
    least = [s for s in sets if not any(set(t) < set(s) for t in sets)]
    shared = ", ".join(f"CASE WHEN {' AND '.join(f'v{i} IS NOT NULL' for i in s)} THEN min(l) OVER (PARTITION BY {', '.join(f'v{i}' for i in s)}) END" for s in least)
    rounds = ", ".join(f"{name}{k + 1} AS (SELECT * REPLACE (least(l, {shared}) AS l) FROM {name}{k})" for k in range(_ROUNDS))
    return f"{name}0 AS (SELECT alert_idx, {', '.join(f'nullif({c}, ' + chr(39) + 'NIL' + chr(39) + f') AS v{i}' for i, c in enumerate(COLS))}, alert_idx AS l FROM alerts), {rounds}"


def _tier_sql(name: str, source: str, threshold: str) -> str:
    return f"SELECT '{source}' AS threshold_source, {threshold} AS correlation_threshold_used, alert_idx, dense_rank() OVER (ORDER BY l) - 1 AS pred_cluster FROM {name}{_ROUNDS}"


# at a scale of 27 tenths, thresholds above 1/9 and up to 2/9 need a weight of 6 (as do confidence and statistics here), 0.3 one of 9, 0.55 one of 15
@query(
    over_alerts(
        " UNION ALL ".join([_tier_sql("o", "override", "0.55::DOUBLE"), _tier_sql("s", "confidence_guided", f"(SELECT threshold FROM ({ORACLE['m3_confidence_threshold']}))"), _tier_sql("s", "adaptive_stats", f"(SELECT threshold FROM ({ORACLE['m4_adaptive_threshold']}))"), _tier_sql("b", "baseline", "0.3::DOUBLE")]),
        _labels_sql("o", 15), _labels_sql("s", 6), _labels_sql("b", 9),
    )
)
def c1_by_tier(spark, d):
    """Every alert's cluster at the threshold of each tier, with the threshold and where it is from."""
    a, out = alerts(spark, d), None
    for how in ({"override": 0.55, "confidence": "severity"}, {"confidence": "severity"}, {}, {"adaptive": False}):
        one = co.correlate_by_tier(a, ROLES, scores=False, **how).select("threshold_source", F.round("correlation_threshold_used", 9).alias("correlation_threshold_used"), "alert_idx", "pred_cluster")
        out = one if out is None else out.unionByName(one)
    return out


@query(over_alerts(_NUMBERED, _PAIRS.format(a="alerts"), "l AS (SELECT i, j FROM p WHERE w >= 13.5)", _COMPONENTS.format(a="alerts"), recursive=True))
def st4_incremental_clusters(spark, d):
    """The clusters of ``c1_correlate``, from a stream of all alerts in three arrivals that have nothing to do with time."""
    base, a = shared_dir(spark), alerts(spark, d)
    loop = IncrementalCorrelator(f"{base}/state", ROLES, 0.5)
    for part in range(3):
        a.where(F.pmod(F.xxhash64("alert_idx"), F.lit(3)) == part).write.mode("append").parquet(f"{base}/in")
        finished(loop.start(spark.readStream.schema(a.schema).parquet(f"{base}/in"), f"{base}/checkpoint", once=True))
    found = a.select("alert_idx").join(loop.clusters(spark), "alert_idx", "left").select("alert_idx", F.coalesce("cluster", "alert_idx").alias("_root"))
    return co.dense(found, "_root", "pred_cluster").select("alert_idx", "pred_cluster")


@query("WITH RECURSIVE e AS (SELECT vec_id, label * 10 + vec_id % 10 AS cluster, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.cluster AS i, y.cluster AS j FROM e x JOIN e y ON x.cluster <> y.cluster GROUP BY 1, 2 HAVING avg(list_cosine_similarity(x.v, y.v)) >= 0.05), r(id, root) AS (SELECT DISTINCT cluster, cluster FROM e UNION SELECT p.j, r.root FROM r JOIN p ON p.i = r.id) SELECT id AS cluster, min(root) AS merged FROM r GROUP BY 1")
def j19_mean_similarity(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label").cast("long") * 10 + F.col("vec_id") % 10).alias("cluster"), "embedding")
    return ba.mean_similarity_clusters(e, "cluster", "embedding", 0.05)


_LINES = "SELECT p, sha256(string_agg(t, '' ORDER BY alert_idx)) AS digest FROM ({}) GROUP BY 1"
_OLD = "SELECT alert_idx, user_id % 8 AS p, AlertId || ',' || CAST(k AS VARCHAR) || chr(10) AS t FROM alerts WHERE user_id % 8 < 6"
_NEW = "SELECT alert_idx, user_id % 8 AS p, CASE WHEN user_id % 8 = 3 THEN SourceUserName ELSE AlertId END || ',' || CAST(k AS VARCHAR) || chr(10) AS t FROM alerts WHERE user_id % 8 > 0"


@query(over_alerts(f"SELECT p AS part, CASE WHEN o.digest IS NULL THEN 'new' WHEN n.digest IS NULL THEN 'gone' WHEN o.digest = n.digest THEN 'same' ELSE 'modified' END AS status, o.digest AS old_digest, n.digest AS new_digest FROM ({_LINES.format(_OLD)}) o FULL JOIN ({_LINES.format(_NEW)}) n USING (p)"))
def src9_manifest(spark, d):
    """Alerts written as text files, one for each of eight groups of users: some new, gone, changed or as before in the second listing."""
    base, a = shared_dir(spark), alerts(spark, d).withColumn("part", F.col("user_id") % 8)
    for name, rows, first in (("old", a.where("part < 6"), F.col("AlertId")), ("new", a.where("part > 0"), F.when(F.col("part") == 3, F.col("SourceUserName")).otherwise(F.col("AlertId")))):
        lines = rows.select("part", "alert_idx", F.concat(first, F.lit(","), F.col("k").cast("string")).alias("value"))
        lines.repartition("part").sortWithinPartitions("part", "alert_idx").select("part", "value").write.partitionBy("part").text(f"{base}/{name}")
    listing = lambda name: mf.listed(spark, f"{base}/{name}", "*.txt").select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "digest")
    return mf.compared(listing("old"), listing("new"), "part")


@query(over_alerts("SELECT alert_idx, CASE WHEN alert_idx % 16 // 4 = 2 THEN 'Zoë € ' ELSE 'Zoë ' END || SourceUserName AS who, MalwareIntelAttackType || CASE WHEN k % 2 = 0 THEN ', ; x' ELSE '' END AS what FROM alerts"))
def src3_mixed_formats(spark, d):
    """Alerts written as delimited files in 16 formats (UTF-8, UTF-16, Windows-1252 and ISO-8859-1 by four separators), told apart and read back as one table."""
    base, a = shared_dir(spark), alerts(spark, d)
    for k in range(16):
        windows = k // 4 == 2
        who = F.concat(F.lit("Zoë \x80 " if windows else "Zoë "), "SourceUserName")  # 0x80 is the euro sign of Windows-1252
        rows = a.where(F.col("alert_idx") % 16 == k).select("alert_idx", who.alias("who"), F.concat("MalwareIntelAttackType", F.when(F.col("k") % 2 == 0, ", ; x").otherwise("")).alias("what"))
        rows.write.mode("append").option("header", True).option("sep", mf.SEPARATORS[k % 4]).option("encoding", ("UTF-8", "UTF-16", "ISO-8859-1", "ISO-8859-1")[k // 4]).option("quoteAll", k % 2 == 1).csv(f"{base}/files")
    return mf.read_delimited(spark, f"{base}/files", "*.csv").select(F.col("alert_idx").cast("long").alias("alert_idx"), "who", "what")


@query()
def j3_nearest_candidates(spark, d):
    """The ten nearest alerts of each alert by hashed values and time (recall 0.90 of the ten nearest of all pairs), scored as links."""
    a = alerts(spark, d)
    near = nearest_candidates(alert_vector(a, ROLES), "vector", "alert_idx").withColumnRenamed("id", "src").withColumnRenamed("other", "dst")
    return co.candidate_links(a, near, ROLES, 0.0).select("src", "dst", F.round("cosine", 5).alias("cosine"), F.round("score", 9).alias("score"))
