"""Per-cluster scores, selection strategies, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.scalars import attack_stage, importance, tactic_exact

#: Names of tactics and columns.
CRITICAL_TACTICS = ("Exploits", "Backdoors")
ASSET_COLUMNS = ("SourceAddress", "DestinationAddress", "DeviceAddress", "SourceHostName", "DestinationHostName")


def joined_set(c: Column | str) -> Column:
    """Distinct values in order, joined by commas."""
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def score_clusters(df: DataFrame, critical: tuple[str, ...] = CRITICAL_TACTICS, assets: tuple[str, ...] = (), cluster: str = "pred_cluster", severity: str = "severity", tactic: str = "MalwareIntelAttackType") -> DataFrame:
    """Size, severity, tactics, critical flag, critical assets, importance and the reason in words, per cluster."""
    hits = [F.when(F.col(c).rlike(f"(?i){p}"), F.col(c)) for c in ASSET_COLUMNS if c in df.columns for p in assets]
    flag = F.max(F.when(F.lower(tactic).isin(*[t.lower() for t in critical]), F.lit(1.0)).otherwise(F.lit(0.0)))
    g = df.withColumn("_s", F.coalesce(F.expr(f"try_cast({severity} AS DOUBLE)"), F.lit(0.0))).withColumn("_hits", F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>"))
    out = g.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), F.avg("_s").alias("mean_severity"), F.max("_s").alias("max_severity"), joined_set(tactic).alias("tactics"), F.countDistinct(tactic).alias("n_tactics"),
        flag.alias("critical_flag"), F.size(F.array_distinct(F.flatten(F.collect_set("_hits")))).cast("long").alias("critical_assets"),
    )
    reason = F.concat_ws(
        "; ",
        F.when(F.col("size") >= 10, F.concat(F.lit("Large cluster ("), F.col("size").cast("string"), F.lit(" alerts)"))),
        F.when(F.col("mean_severity") >= 0.7, F.lit("High severity")),
        F.when(F.col("critical_flag") > 0, F.lit("Critical tactic detected")),
        F.when(F.col("critical_assets") > 0, F.concat(F.lit("Critical assets: "), F.col("critical_assets").cast("string"))),
    )
    return out.withColumn("importance", importance(F.col("size"), F.col("mean_severity"), F.col("critical_flag"))).withColumn("reason", F.when(reason == "", "Standard cluster").otherwise(reason))


def top_clusters(scores: DataFrame, by: str, k: int = 20, cluster: str = "pred_cluster") -> DataFrame:
    """The k clusters of the largest ``by``; ties go to the smaller cluster number."""
    return scores.orderBy(F.col(by).desc(), F.col(cluster)).limit(k)


def clusters_at_least(scores: DataFrame, size: int = 1, severity: float = 0.0, score: float = 0.0) -> DataFrame:
    return scores.where((F.col("size") >= size) & (F.col("mean_severity") >= severity) & (F.col("importance") >= score))


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_-]", "")


def semantic_clusters(df: DataFrame, wanted: tuple[str, ...], cluster: str = "pred_cluster", tactic: str = "MalwareIntelAttackType") -> DataFrame:
    """Clusters with any of the wanted tactics, however written."""
    names = [w.lower().replace("_", "").replace("-", "").replace(" ", "") for w in wanted]
    return df.where(normal_name(F.col(tactic)).isin(*names)).select(cluster).distinct()


def asset_clusters(df: DataFrame, patterns: tuple[str, ...], cluster: str = "pred_cluster") -> DataFrame:
    """Clusters where an asset column matches any pattern (regular expressions, letters in either case)."""
    hit = F.lit(False)
    for c in ASSET_COLUMNS:
        for p in patterns:
            if c in df.columns:
                hit = hit | F.coalesce(F.col(c).rlike(f"(?i){p}"), F.lit(False))
    return df.where(hit).groupBy(cluster).agg(F.count(F.lit(1)).alias("hits"))


def keep_selected(df: DataFrame, selected: DataFrame, cluster: str = "pred_cluster") -> DataFrame:
    return df.join(selected.select(cluster), cluster, "left_semi")


def backfill_rare(df: DataFrame, scores: DataFrame, selected: DataFrame, least: int = 2, reservoir: int = 100, cluster: str = "pred_cluster", tactic: str = "MalwareIntelAttackType") -> DataFrame:
    """``selected`` and, for each tactic with fewer than ``least`` selected clusters, its best others, at most ``reservoir`` a tactic."""
    pairs = df.select(cluster, tactic).distinct()
    have = pairs.join(selected.select(cluster), cluster, "left_semi").groupBy(tactic).agg(F.count(F.lit(1)).alias("n"))
    rare = pairs.select(tactic).distinct().join(have, tactic, "left").where(F.coalesce("n", F.lit(0)) < least).select(tactic)
    ranked = pairs.join(rare, tactic).join(scores.select(cluster, "importance"), cluster).withColumn("r", F.row_number().over(Window.partitionBy(tactic).orderBy(F.col("importance").desc(), cluster)))
    return selected.select(cluster).unionByName(ranked.where(F.col("r") <= reservoir).select(cluster)).distinct()


def summarise(df: DataFrame, cluster: str = "pred_cluster") -> DataFrame:
    """Dates, types, tactics, stage and mean severity of each cluster."""
    tactics = F.collect_set(tactic_exact(F.col("MalwareIntelAttackType")))
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("events"), F.min("EndDate").alias("first_seen"), F.max("EndDate").alias("last_seen"), joined_set("MalwareIntelAttackType").alias("types"),
        F.array_join(F.sort_array(tactics), ",").alias("tactics"), attack_stage(tactics).alias("stage"), F.array_join(F.slice(F.sort_array(F.collect_set("SourceAddress")), 1, 10), ",").alias("addresses"), F.round(F.avg("severity"), 9).alias("avg_severity"),
    )


def global_stats(df: DataFrame, cluster: str = "pred_cluster") -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("clusters"), F.round(F.avg("n"), 9).alias("avg_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"))
    kinds = df.agg(F.countDistinct("MalwareIntelAttackType").alias("types"), F.countDistinct(tactic_exact(F.col("MalwareIntelAttackType"))).alias("tactics"))
    return one.crossJoin(kinds)  # one row each


def metadata(df: DataFrame, reservoir: int = 100, cluster: str = "pred_cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.least(F.count(F.lit(1)), F.lit(reservoir)).cast("long").alias("sampled"), F.round(F.avg("severity"), 9).alias("mean_severity"))


def filter_summary(scores: DataFrame, selected: DataFrame, cluster: str = "pred_cluster") -> DataFrame:
    flag = scores.join(selected.select(cluster).withColumn("_in", F.lit(1)), cluster, "left")
    return flag.agg(
        F.count(F.lit(1)).alias("total"), F.count("_in").alias("shown"), (F.count(F.lit(1)) - F.count("_in")).alias("filtered"),
        F.round(F.avg(F.when(F.col("_in") == 1, F.col("size"))), 9).alias("avg_size"), F.max(F.when(F.col("_in") == 1, F.col("size"))).alias("max_size"), F.round(F.avg(F.when(F.col("_in") == 1, F.col("mean_severity"))), 9).alias("avg_severity"),
    )


def clean_clusters(df: DataFrame, index: str, score: str, k: int, cluster: str = "pred_cluster", kind: str = "MalwareIntelAttackType") -> DataFrame:
    """The best row of each ``index``; then without clusters of at most k rows or of a single attack type."""
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(index).orderBy(F.col(score).desc(), cluster))).where("_r = 1").drop("_r")
    good = best.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kind).alias("t")).where((F.col("n") > k) & (F.col("t") > 1))
    return best.join(good, cluster, "left_semi")


def report(df: DataFrame, cluster: str = "pred_cluster") -> DataFrame:
    """One JSON document per cluster: start, end, types, devices, tactics, scenario."""
    tactics = F.collect_set(tactic_exact(F.col("MalwareIntelAttackType")))
    rows = df.groupBy(cluster).agg(
        F.date_format(F.min("EndDate"), "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format(F.max("EndDate"), "yyyy-MM-dd HH:mm:ss").alias("end"), F.min("CustomerName").alias("customer"),
        joined_set("MalwareIntelAttackType").alias("types"), joined_set("DeviceAddress").alias("devices"), F.array_join(F.sort_array(tactics), ",").alias("tactics"), attack_stage(tactics).alias("scenario"),
    )
    return rows


def first_of_addresses(df: DataFrame, addresses: list[str], users: list[str], id_col: str = "alert_idx") -> DataFrame:
    """Rows with some address and some user, one of each combination of addresses (the first)."""
    some = df.where(F.coalesce(*map(F.col, addresses)).isNotNull() & F.coalesce(*map(F.col, users)).isNotNull())
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*addresses).orderBy(id_col))).where("_r = 1").drop("_r")


def feature_chains(df: DataFrame, columns: list[str], cluster: str = "pred_cluster") -> DataFrame:
    """Columns of a cluster that hold a value which two or more of its rows hold, in any column."""
    v = df.select(cluster, F.col("alert_idx").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("x")).where("x.v is not null and x.v <> 'NIL'").select(cluster, "id", "x.c", "x.v")
    shared = v.groupBy(cluster, "v").agg(F.countDistinct("id").alias("n")).where("n > 1").select(cluster, "v")
    return v.join(shared, [cluster, "v"], "left_semi").groupBy(cluster).agg(joined_set("c").alias("columns"))
