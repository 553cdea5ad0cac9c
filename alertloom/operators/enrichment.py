"""Threat-intelligence matches and the enrichment of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.scalars import threat_score
from alertloom.operators.intel import names_in_texts


def matches(df: DataFrame, intel: DataFrame, cluster: str = "pred_cluster", tactic: str = "tactic", text: str | None = None, most: int = 100_000) -> DataFrame:
    """Distinct (cluster, entity) matches: tactic equal to an entity's name or one of its tactics, or ``text`` holding its name.

    Values are made distinct before they meet the intelligence table, which is broadcast if it has at most ``most`` rows; texts are
    read once for all names. An empty name is in no text.
    """
    small = intel.limit(most + 1).count() <= most
    hint = F.broadcast if small else (lambda x: x)  # the size is checked
    values = df.select(cluster, F.lower(tactic).alias("v")).distinct()
    names = intel.select("entity_id", F.explode(F.array_union(F.array(F.lower("name")), F.transform("tactics", lambda x: F.lower(x)))).alias("v")).distinct()
    found = values.join(hint(names), "v").select(cluster, "entity_id")
    if text:
        words, named = df.select(cluster, F.lower(text).alias("t")).distinct(), intel.select("entity_id", F.lower("name").alias("n"))
        hits = names_in_texts(words, named).join(hint(named), "n").select("t", "entity_id")
        found = found.unionByName(words.join(hits, "t").select(cluster, "entity_id"))
    return found.distinct()


def enrich(found: DataFrame, intel: DataFrame, centrality: DataFrame | None = None, cluster: str = "pred_cluster") -> DataFrame:
    """Per cluster: number of entities, groups, mean severity, and the threat score with its largest centralities."""
    e = found.join(intel.select("entity_id", "severity", "groups"), "entity_id")
    out = e.groupBy(cluster).agg(F.count(F.lit(1)).alias("entities"), F.avg("severity").alias("severity"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("groups")))), ", ").alias("linkage"))
    if centrality is not None:
        out = out.join(centrality, cluster, "left")
    pr = F.coalesce("pagerank", F.lit(0.0)) if centrality is not None else F.lit(0.0)
    bc = F.coalesce("betweenness", F.lit(0.0)) if centrality is not None else F.lit(0.0)
    return out.withColumn("threat_score", threat_score(F.col("severity"), pr, bc))


def map_back(df: DataFrame, enriched: DataFrame, cluster: str = "pred_cluster") -> DataFrame:
    cols = enriched.select(cluster, "threat_score", "linkage")
    return df.join(cols, cluster, "left").withColumn("threat_score", F.coalesce("threat_score", F.lit(0.0))).withColumn("linkage", F.coalesce("linkage", F.lit("")))


def threat_summary(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.sum("entities").alias("matches"), F.count(F.when(F.col("linkage") != "", 1)).alias("linked"), F.count(F.when(F.col("threat_score") > 0.7, 1)).alias("high"), F.avg("threat_score").alias("avg_score"), F.max("threat_score").alias("max_score")
    )
