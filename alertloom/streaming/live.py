"""The live loop: events stream in, are normalised and kept, correlated in micro-batches, and new clusters become alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.functions.scalars import alert_severity
from alertloom.operators.correlation import correlate
from alertloom.plans.stage import removed
from alertloom.schema import FieldRoles


def read_alerts(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cluster_keys(correlated: DataFrame, id_col: str = "alert_idx") -> DataFrame:
    """Clusters by a key that later batches keep: the smallest id of their alerts."""
    keys = correlated.groupBy("pred_cluster").agg(
        F.min(id_col).alias("cluster_key"), F.count(F.lit(1)).alias("size"), F.countDistinct("MalwareIntelAttackType").alias("types"), F.max("EndDate").alias("last_seen")
    )
    return keys.select("cluster_key", "size", "types", "last_seen", alert_severity(F.col("size"), F.col("types")).alias("level"))


def newest(df: DataFrame, n: int, id_col: str = "alert_idx") -> DataFrame:
    """The n newest rows: a bounded buffer from which the oldest go."""
    return df.orderBy(F.col("EndDate").desc(), F.col(id_col).desc()).limit(n)


def _numbered(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished tables in a folder, ascending."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath() for f in fs.listStatus(at)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(done(p, "_SUCCESS")))


class LiveCorrelator:
    """Keeps alerts and emitted clusters as tables in ``folder``; each micro-batch appends, correlates the ``window`` newest alerts
    (None: all) and appends those clusters of two or more alerts whose key no batch has emitted. The newest alerts are a table of
    their own, made from the last one and the batch, so a batch costs the window and not the history. A batch that runs again
    after a failure overwrites what it wrote."""

    def __init__(self, folder: str, roles: FieldRoles | None = None, threshold: float = 0.5, window: int | None = 5000, least: int = 2, every: int = 1):
        self.folder, self.roles, self.threshold, self.window, self.least, self.every = folder.rstrip("/"), roles or FieldRoles(), threshold, window, least, every

    def _buffer(self, df: DataFrame, number: int) -> DataFrame:
        """The newest alerts up to this batch. The tables of the two batches before stay, for one that runs again."""
        spark, path = df.sparkSession, f"{self.folder}/newest"
        own = spark.read.schema(df.schema).parquet(f"{self.folder}/alerts/batch={number}")
        last = _numbered(spark, path)
        before = [n for n in last if n < number]
        both = own.unionByName(spark.read.schema(df.schema).parquet(f"{path}/{before[-1]}")) if before else own
        newest(both, self.window).write.mode("overwrite").parquet(f"{path}/{number}")
        for n in before[:-2]:
            removed(spark, f"{path}/{n}")
        return spark.read.schema(df.schema).parquet(f"{path}/{number}")

    def batch(self, df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.withColumn("_ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.folder}/alerts/batch={number}")
        recent = self._buffer(df, number) if self.window else spark.read.parquet(f"{self.folder}/alerts").where(F.col("batch") <= number)
        if (number + 1) % self.every:
            return
        found = cluster_keys(correlate(recent, self.roles, self.threshold)).where(F.col("size") >= self.least)
        try:
            known = spark.read.parquet(f"{self.folder}/emitted").where(F.col("batch") < number).select("cluster_key")
        except Exception as e:  # noqa: BLE001  no batch has emitted yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = found.select("cluster_key").limit(0)
        found.join(known, "cluster_key", "left_anti").write.mode("overwrite").parquet(f"{self.folder}/emitted/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()

    def counters(self, spark: SparkSession) -> DataFrame:
        """One row from the tables, so a restart loses none: events and batches kept, correlations run, clusters emitted, the last event's arrival."""
        kept = spark.read.parquet(f"{self.folder}/alerts").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("batch").alias("batches"), (F.countDistinct(F.when((F.col("batch") + 1) % self.every == 0, F.col("batch")))).alias("correlations"), F.max("_ingested_at").alias("last_ingested"))
        found = self.emitted(spark).agg(F.count(F.lit(1)).alias("clusters"))
        return kept.crossJoin(F.broadcast(found))  # one row each

    def emitted(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/emitted")


def interval_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts per user and three-hour slot of event time; rows more than ``delay`` late are dropped with their state."""
    return stream.withWatermark("EndDate", delay).groupBy(F.window("EndDate", "3 hours").alias("slot"), "SourceUserName").agg(F.count(F.lit(1)).alias("n")).select(F.col("slot.start").alias("slot"), "SourceUserName", "n")


def sessions(stream: DataFrame, gap: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: rows at most ``gap`` apart."""
    w = F.session_window("EndDate", gap)
    return stream.withWatermark("EndDate", delay).groupBy(w.alias("session"), "SourceUserName").agg(F.count(F.lit(1)).alias("n")).select(F.col("session.start").alias("start"), "SourceUserName", "n")


def correlate_in_batches(df: DataFrame, batches: int, path: str, roles: FieldRoles | None = None, threshold: float = 0.5, id_col: str = "alert_idx") -> DataFrame:
    """Batch-wise correlation with cluster numbers that no two batches share, written by batch and read as one table.

    The batch is a part of each group's digest, so all batches are correlated in one pass over the input.
    """
    spark = df.sparkSession
    marked = df.withColumn("batch", F.pmod(F.xxhash64(id_col), F.lit(batches)).cast("int"))
    out = correlate(marked, roles, threshold, id_col, within="batch")
    out.write.mode("overwrite").option("compression", "snappy").partitionBy("batch").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*df.columns, "pred_cluster")
