"""Sinks: Parquet with nulls kept, CSV, JSON reports and logs, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Snappy Parquet; ``by`` columns order the rows within files, so a filter on them skips row groups."""
    out = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def json_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON lines with their part."""
    rows = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    return rows(nodes, "node").unionByName(rows(edges, "edge"))


def write_version(df: DataFrame, path: str, version: int, keep: int = 5) -> None:
    """A new version in a folder of its own, of which the newest ``keep`` stay."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((int(f.getPath().getName().split("=")[1]), f.getPath()) for f in fs.listStatus(at) if f.getPath().getName().startswith("version="))
    for _, old in found[:-keep]:
        fs.delete(old, True)


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """A table of the first ``most`` rows, for people."""
    rows = df.limit(most).collect()
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows)
