"""File sources and the normalisation of raw events to the alert schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.schema import ALERT_COLUMNS, TIME_COLUMNS, first_present


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), schema: str | None = None, sep: str = ",", encoding: str = "UTF-8", drop_bad: bool = False) -> DataFrame:
    """A CSV file with a header (or with ``schema``); ``ValueError`` if required columns are missing."""
    reader = spark.read.option("header", schema is None).option("sep", sep).option("encoding", encoding).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path}: missing columns {missing}")
    return df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines or CSV, by the path's ending."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return read_csv(spark, path)


def read_cluster(spark: SparkSession, path: str, cluster: int, column: str = "pred_cluster") -> DataFrame:
    """The rows of one cluster; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col(column) == cluster)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of analyst feedback; lines that don't parse are dropped."""
    schema = "feedback_id string, timestamp timestamp, analyst_id string, cluster_id long, feedback_type string, confidence double, tactic string, cluster_size long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_provenance(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("_source", F.lit(source)).withColumn("_file", F.input_file_name())


def normalise(df: DataFrame, mapping: dict[str, str] | None = None, customer: str = "Unknown", keep: list[str] | None = None) -> DataFrame:
    """The alert columns of raw events: by ``mapping``, else by exact name, else by name in any case, else null (customer: a
    default)."""
    mapping, lower = mapping or {}, {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name in ALERT_COLUMNS:
        found = mapping.get(name) if mapping.get(name) in df.columns else name if name in df.columns else lower.get(name.lower())
        c = F.col(found).cast("string" if name != "EndDate" else "timestamp") if found else F.lit(None).cast("string" if name != "EndDate" else "timestamp")
        out.append((F.coalesce(c, F.lit(customer)) if name == "CustomerName" else c).alias(name))
    return df.select(*(keep or []), *out)


def ensure_timestamp(df: DataFrame, base: str = "2024-01-01 00:00:00", id_col: str | None = None) -> DataFrame:
    """``timestamp`` from the first present time column; without one, ticks of a second a row in order of ``id_col`` (unique)."""
    found = first_present(df, TIME_COLUMNS)
    if found:
        return df.withColumn("timestamp", F.col(found).try_cast("timestamp")).where("timestamp is not null")
    from alertloom.operators.correlation import dense

    placed = dense(df, id_col or df.columns[0], "_place")
    return placed.withColumn("timestamp", F.timestamp_seconds(F.unix_timestamp(F.lit(base).cast("timestamp")) + F.col("_place"))).select(*df.columns, "timestamp")


def new_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files (path, digest) that the manifest lacks or has with another digest."""
    return listing.join(manifest.select("path", "digest"), ["path", "digest"], "left_anti")
