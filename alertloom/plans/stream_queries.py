"""Queries that run as streams over whole tables: they read what there is, batch by batch, and return the table that they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import behaviour as be
from alertloom.plans.analysis_queries import _behaviour_sql
from alertloom.plans.registry import query
from alertloom.plans.stage import shared_dir, written
from alertloom.schema import alerts, table
from alertloom.streaming import stateful as st


@query()
def st7_stream_centroids(spark, d):
    """Centroids of each label over a stream of ``embeddings``, a vector every ten seconds; small ones expire after an hour."""
    base = shared_dir(spark)
    rows = table(spark, d, "embeddings").select("label", "embedding", "vec_id", F.timestamp_seconds(1_704_067_200 + F.col("vec_id") * 10).alias("ts"))
    cuts = rows.select(F.expr("percentile_approx(vec_id, array(0.25, 0.5, 0.75))")).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):  # four arrivals, each read by a run of its own
        part = rows if low is None else rows.where(F.col("vec_id") > low)
        (part if high is None else part.where(F.col("vec_id") <= high)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        st.finished(st.run_stream(st.centroid_stream(stream, "label", "embedding", "vec_id", "ts", 0.3), f"{base}/out", f"{base}/checkpoint"))
    return st.read_or_empty(spark, f"{base}/out", "label int, id long, cluster int")


@query(_behaviour_sql("CAST(hour(EndDate) // 3 AS VARCHAR)", 2.0, False))
def st8_stream_intervals(spark, d):
    """The anomalies of ``b1_time_anomaly``, each told when its interval closes in a stream of alerts. The last row of the stream only moves its time on."""
    base, a = shared_dir(spark), alerts(spark, d)
    cut = a.agg(F.date_add(F.min(F.to_date("EndDate")), 20).alias("cut"))
    marked = a.select("SourceUserName", F.col("EndDate").cast("timestamp").alias("EndDate")).join(F.broadcast(cut))  # one row
    expected = be.baseline(be.activity(marked.where("to_date(EndDate) < cut"), "interval"))
    now = marked.where("to_date(EndDate) >= cut").drop("cut")
    now.repartitionByRange(6, "EndDate").sortWithinPartitions("EndDate").write.parquet(f"{base}/in")
    marked.agg(F.lit("").alias("SourceUserName"), (F.max("EndDate") + F.expr("interval 1 day")).alias("EndDate")).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(now.schema).parquet(f"{base}/in")
    found = st.interval_watch(stream, written(expected, "expected", base))
    st.finished(st.run_stream(found, f"{base}/out", f"{base}/checkpoint"))
    out = st.read_or_empty(spark, f"{base}/out", "user string, day_type string, day date, key string, n long, is_new boolean, risk double, closed boolean").where("closed and user <> ''")
    return out.select("user", "day_type", "key", "n", "is_new", F.round("risk", 4).alias("risk")).groupBy("user", "day_type", "key", "n", "is_new", "risk").agg(F.count(F.lit(1)).alias("days"))
