"""Lineage cuts through the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has made and not removed.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. A session without one is given a local folder only where all tasks run in
    the driver's process (tests); on a cluster that is an error, as executors don't see each other's disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'alertloom-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/alertloom-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{under or shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def made() -> int:
    """How many folders there are, for ``cleared``."""
    return len(_made)


def cleared(spark: SparkSession, since: int) -> None:
    """Delete the folders made after ``since``. Frames that still read them can't be used any more."""
    for path in _made[since:]:
        removed(spark, path)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver's JVM collects them."""
    for _ in range(3):
        gc.collect()
        time.sleep(0.3)  # until the JVM has heard that Python let go
        spark.sparkContext._jvm.System.gc()
