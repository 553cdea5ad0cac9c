"""Connected components of an edge table: minimum labels with pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.plans.stage import removed, shared_dir, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it is connected with) for each node of ``edges``.

    Edges have no direction; loops, repeats and rows with a null end count for nothing but the ends they name. Neighbours'
    labels are combined before they are shuffled, so a node of any degree is no hot spot; every round's labels are
    written, so lost executors cost one round at most, and the round before is deleted. Labels halve their distance to the root each round.
    No side is broadcast: labels of a large component pack so well that the size of their file says nothing of their number.
    """
    spark, base = edges.sparkSession, shared_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", base)
    first = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = written(first, "labels", base)
    for k in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "v").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("m"))
        least = labels.join(near.withColumnRenamed("u", "node").hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = written(least.join(ahead.hint("merge"), "label").select("node", "old", F.least("label", "next").alias("label")), f"round{k}", base)
        labels = moved.select("node", "label")
        removed(spark, f"{base}/round{k - 1}" if k else f"{base}/labels")
        if moved.where("label <> old").limit(1).count() == 0:
            removed(spark, f"{base}/edges")
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels still change after {rounds} rounds")
