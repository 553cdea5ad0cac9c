"""Queries of the baseline clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import baselines as ba
from alertloom.plans.registry import over_alerts, query
from alertloom.schema import alerts, table


@query("SELECT label, CAST(i AS INT) AS place, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def m_centroids(spark, d):
    c = ba.centroids(table(spark, d, "embeddings"), "embedding", "label")
    return c.select("label", F.posexplode("centroid").alias("place", "mean")).withColumn("mean", F.round("mean", 5))


@query("WITH RECURSIVE p AS (SELECT x.vec_id AS i, y.vec_id AS j FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35), r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.j, r.root FROM r JOIN p ON p.i = r.id) SELECT id AS node, min(root) AS component FROM r WHERE id IN (SELECT i FROM p) GROUP BY 1")
def j17_cosine_components(spark, d):
    from alertloom.operators.components import connected_components

    return connected_components(ba.cosine_links(table(spark, d, "embeddings"), "embedding", "vec_id", 0.35))


@query("WITH RECURSIVE p AS (SELECT x.vec_id AS i, y.vec_id AS j FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35), core AS (SELECT i FROM p GROUP BY 1 HAVING count(*) >= 2), r(id, root) AS (SELECT i, i FROM core UNION SELECT p.j, r.root FROM r JOIN p ON p.i = r.id JOIN core ON core.i = p.j), cc AS (SELECT id, min(root) AS c FROM r GROUP BY 1), bo AS (SELECT p.i AS id, min(c) AS c FROM p JOIN cc ON cc.id = p.j WHERE p.i NOT IN (SELECT i FROM core) GROUP BY 1) SELECT vec_id, coalesce(cc.c, bo.c, vec_id) AS cluster FROM embeddings LEFT JOIN cc ON cc.id = vec_id LEFT JOIN bo ON bo.id = vec_id")
def k3_dbscan(spark, d):
    e = table(spark, d, "embeddings")
    return ba.density_clusters(ba.cosine_links(e, "embedding", "vec_id", 0.35), e, "vec_id", 3)


@query()
def k2_kmeans(spark, d):
    return ba.kmeans(table(spark, d, "embeddings"), "embedding", 8).select("vec_id", "cluster")


@query()
def g12_hierarchy(spark, d):
    return ba.hierarchy(table(spark, d, "embeddings"), "embedding", "vec_id")


@query()
def j3_lsh_candidates(spark, d):
    return ba.cosine_links(table(spark, d, "embeddings"), "embedding", "vec_id", 0.35, bits=4, tables=20)  # 0.95 of the pairs at the threshold, more above


@query(over_alerts("SELECT alert_idx, min(root) AS cluster FROM rr WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.id = rr.root AND pa.up <> pa.id) GROUP BY 1", "pa AS (SELECT x.alert_idx AS id, arg_min(y.alert_idx, (y.EndDate, y.alert_idx)) AS up FROM alerts x JOIN alerts y ON y.EndDate <= x.EndDate AND epoch_us(x.EndDate) - epoch_us(y.EndDate) <= 21600000000 AND (x.SourceAddress = y.SourceAddress OR x.DestinationHostName = y.DestinationHostName) GROUP BY 1)", "rr(alert_idx, root) AS (SELECT id, up FROM pa UNION SELECT rr.alert_idx, pa.up FROM rr JOIN pa ON pa.id = rr.root)", recursive=True))
def j16_greedy_windows(spark, d):
    return ba.greedy_windows(alerts(spark, d), ["SourceAddress", "DestinationHostName"], 21600.0)


@query(over_alerts("SELECT c, t AS label FROM (SELECT k // 10 AS c, MalwareIntelAttackType AS t, row_number() OVER (PARTITION BY k // 10 ORDER BY count(*) DESC, MalwareIntelAttackType) AS r FROM alerts GROUP BY 1, 2) WHERE r = 1"))
def a31_label_majority(spark, d):
    return ba.label_majority(alerts(spark, d).withColumn("c", F.floor(F.col("k") / 10).cast("int")), "c", "MalwareIntelAttackType")


@query(over_alerts("SELECT alert_idx FROM alerts WHERE user_id = 3"))
def src8_cluster_read(spark, d):
    from alertloom.plans.stage import shared_dir
    from alertloom.sources.files import read_cluster
    from alertloom.sources.sinks import write_parquet

    path = shared_dir(spark)
    write_parquet(alerts(spark, d).withColumn("pred_cluster", F.col("user_id")), path, ["pred_cluster"])
    return read_cluster(spark, path, 3).select("alert_idx")


@query(over_alerts("SELECT DISTINCT min(alert_idx) OVER (PARTITION BY user_id) AS k FROM alerts"))
def st6_batch_correlation(spark, d):
    from alertloom.plans.stage import shared_dir
    from alertloom.schema import FieldRoles
    from alertloom.streaming.live import correlate_in_batches

    a = alerts(spark, d).select("alert_idx", "user_id", "SourceHostName", "SourceAddress")
    out = correlate_in_batches(a, 3, shared_dir(spark), FieldRoles(["SourceAddress"], ["SourceHostName"]), 1.0)
    return out.groupBy("pred_cluster").agg(F.min("user_id").alias("user_id"), F.min("alert_idx").alias("k")).groupBy("user_id").agg(F.min("k").alias("k")).select("k")
