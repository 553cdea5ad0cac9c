"""Filters, joins, summaries and scores over results: what reports and experiments are made of."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.tactics import TACTIC_PATTERNS, with_tactics
from alertloom.operators.evaluation import tactic_f1
from alertloom.operators.sampling import hash_order
from alertloom.schema import SENTINELS

#: Logon types that count.
LOGON_TYPES = (2, 3, 7, 9, 10)
WEEK = 7 * 24 * 3600.0


def attack_rows(df: DataFrame, kind: str, attack: str = "attack") -> DataFrame:
    """Rows of attacks, or all rows where there are none."""
    any_ = df.agg(F.coalesce(F.max((F.col(kind) == attack).cast("int")), F.lit(0)).alias("_any"))
    return df.crossJoin(F.broadcast(any_)).where((F.col("_any") == 0) | (F.col(kind) == attack)).drop("_any")  # one row


def logons(df: DataFrame, event: str, logon_type: str, text: str = "logged on", types: tuple[int, ...] = LOGON_TYPES) -> DataFrame:
    return df.where(F.contains(F.lower(event), F.lit(text)) & F.col(logon_type).isin(*types))


def without_noise(df: DataFrame, truth: str) -> DataFrame:
    return df.where(F.col(truth) >= 0)


def active_clusters(clusters: DataFrame, least: int = 5, count: str = "count") -> DataFrame:
    return clusters.where(F.col(count) >= least)


def pruned_clusters(clusters: DataFrame, now: Column, minutes: float = 60, least: int = 5, count: str = "count", created: str = "created_at") -> DataFrame:
    """Clusters but for those that are older than ``minutes`` and have fewer than ``least`` alerts."""
    age = (F.unix_micros(now) - F.unix_micros(created)) / 6e7
    return clusters.where(~((age > minutes) & (F.col(count) < least)))


def of_cluster(df: DataFrame, cluster: str, number: int, id_col: str = "alert_idx", most: int | None = None) -> DataFrame:
    """Rows of one cluster in order of their ids, the first ``most`` if given (a page)."""
    rows = df.where(F.col(cluster) == number).orderBy(id_col)
    return rows if most is None else rows.limit(most)


def by_dataset(results: DataFrame, settings: DataFrame, key: str = "dataset") -> DataFrame:
    return results.join(settings, key, "inner")


def compare_datasets(df: DataFrame, dataset: str, label: str) -> DataFrame:
    """Per dataset: rows, tactics that its labels cover and miss, their share in percent, and its distinct labels."""
    rows = with_tactics(df.select(dataset, label), label)
    known = F.col("tactic").isin(*TACTIC_PATTERNS)
    n = len(TACTIC_PATTERNS)
    out = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct(F.when(known, F.col("tactic"))).alias("covered"), F.countDistinct(label).alias("attack_types"))
    return out.withColumn("missing", F.lit(n) - F.col("covered")).withColumn("coverage", F.col("covered") * 100.0 / n)


def latency(df: DataFrame, method: str, millis: str, alerts: str) -> DataFrame:
    """Per method: exact median and 95th percentile, and alerts a second at the median."""
    mid = F.percentile(millis, F.lit(0.5))
    return df.groupBy(method).agg(mid.alias("latency_ms"), F.percentile(millis, F.lit(0.95)).alias("latency_p95_ms"), (F.max(alerts) / (mid / 1000)).alias("throughput"))


def mean_and_spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group the mean and population deviation as text with three digits."""
    return df.groupBy(by).agg(F.format_string("%.3f \\pm %.3f", F.avg(value), F.stddev_pop(value)).alias("text"))


def roll_up(results: DataFrame) -> DataFrame:
    """One row over runs (events, clusters, ok, seconds): totals, mean cluster size, share of successes, run time."""
    return results.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("events").alias("events"), F.sum("clusters").alias("clusters"), (F.sum("events") / F.sum("clusters")).alias("mean_cluster_size"),
        F.avg(F.col("ok").cast("double")).alias("success_rate"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"),
    )


def dataset_quality(df: DataFrame, truth: str, addresses: tuple[str, str] = ("SourceAddress", "DestinationAddress"), time: str = "EndDate") -> DataFrame:
    """One row with ``quality``: the mean of even cluster sizes, diversity of addresses in clusters, and time span in weeks."""
    rows = df.where(F.col(truth) >= 0)
    sizes = rows.groupBy(truth).agg(F.count(F.lit(1)).alias("n"))
    cells = rows.select(truth, F.explode(F.array(*[F.col(c).cast("string") for c in addresses])).alias("a")).groupBy(truth).agg(F.countDistinct("a").alias("d"))
    per = sizes.join(cells, truth, "left").withColumn("d", F.coalesce("d", F.lit(0)))
    one = per.agg(F.greatest(F.lit(0.0), 1 - F.var_pop("n") / F.avg("n") / 2).alias("size"), F.least(F.lit(1.0), 2 * F.avg(F.col("d") / (2 * F.col("n")))).alias("diversity"))
    span = df.agg(F.least(F.lit(1.0), F.coalesce((F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6 / WEEK, F.lit(0.0))).alias("span"))
    both = one.crossJoin(F.broadcast(span))  # one row each
    return both.select("size", "diversity", "span", F.when(F.col("size").isNull(), F.col("span")).otherwise((F.col("size") + F.col("diversity") + F.col("span")) / 3).alias("quality"))


def sweep_row(df: DataFrame, method: str, refined: str, cluster: str, confidence: str, threshold: str) -> DataFrame:
    """One row over a run: clusters in all and by method, the share of refined rows, confidence, and the refined rows' mean threshold."""
    own = F.col(method) == refined
    return df.agg(
        F.countDistinct(cluster).alias("n_clusters"), F.countDistinct(F.when(~own, F.col(cluster))).alias("n_plain_clusters"), F.countDistinct(F.when(own, F.col(cluster))).alias("n_refined_clusters"),
        F.avg(own.cast("double")).alias("refined_share"), F.avg(confidence).alias("avg_confidence"), F.percentile(confidence, F.lit(0.25)).alias("p25_confidence"), F.avg(F.when(own, F.col(threshold))).alias("threshold_used"),
    )


def dominant_clusters(df: DataFrame, campaign: str, cluster: str) -> DataFrame:
    """Per campaign the cluster that holds most of it, the smallest of equals."""
    n = df.groupBy(campaign, cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(campaign).agg(F.max_by(cluster, F.struct(F.col("n"), -F.col(cluster))).alias("dominant"))


def campaign_f1(df: DataFrame, campaign: str, cluster: str, tactic: str) -> DataFrame:
    """Per campaign the F1 of the tactics of its dominant cluster against its own."""
    own = df.groupBy(campaign).agg(F.collect_set(tactic).alias("own"))
    held = df.groupBy(cluster).agg(F.collect_set(tactic).alias("held"))
    best = dominant_clusters(df, campaign, cluster)
    return tactic_f1(best.join(own, campaign).join(held, F.col("dominant") == F.col(cluster)).drop(cluster), "own", "held")


def silhouette(df: DataFrame, id_col: str, cluster: str, vector: str, block: int = 4_000_000, block_rows: int = 20_000) -> DataFrame:
    """Per row its silhouette by squared Euclidean distance, from sums of each cluster and so without pairs: for a cluster of n rows the mean
    squared distance of x is x.x - 2 x.mean + mean(y.y). A row alone in its cluster has 0, as has one without a cluster or a whole vector.

    Clusters whose means have at most ``block`` numbers together go to every task; more are dealt out to blocks, and each meets each block
    of rows in a task as a matrix product, whose least distance alone goes on.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(id_col, F.col(cluster).alias("c"), v.alias("x"))
    places = rows.where("c is not null").select("c", F.posexplode("x").alias("i", "e")).groupBy("c", "i").agg(F.avg("e").alias("m"))
    means = places.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)
    stats = means.join(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("yy")), "c").withColumnRenamed("c", "o")
    one = stats.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("mean")).alias("w")).first()
    width, blocks = one["w"] or 0, max(1, -(-one["k"] * (one["w"] or 0) // block))

    def matrix(lists: pd.Series) -> np.ndarray:
        gap = np.full(width, np.nan)
        return np.stack([gap if x is None or len(x) != width else np.asarray(x, dtype=float) for x in lists]) if len(lists) else np.zeros((0, width))

    def near(pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        mean, n, yy, names = matrix(st["mean"]), st["n"].to_numpy(dtype=float), st["yy"].to_numpy(dtype=float), pd.Index(st["o"])
        own, other = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo : lo + 500]
            x, at = matrix(part["x"]), names.get_indexer(part["c"])
            far = (x * x).sum(axis=1)[:, None] - 2 * x @ mean.T + yy
            mine = np.flatnonzero(at >= 0)
            k = at[mine]
            more = n[k] > 1
            own[lo + mine[more]] = far[mine[more], k[more]] * n[k[more]] / (n[k[more]] - 1)
            far[mine, k] = np.nan
            other[lo : lo + len(part)] = np.fmin.reduce(far, axis=1, initial=np.inf)
        other[np.isinf(other) | pdf["c"].isna().to_numpy()] = np.nan
        return pd.DataFrame({id_col: pdf[id_col], "a": own, "b": other})

    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, a double, b double"
    if blocks == 1:
        held = stats.toPandas()  # its size is checked
        found = rows.mapInPandas(lambda batches: (near(pdf, held) for pdf in batches), schema)
    else:
        groups = max(1, -(-rows.count() // block_rows))
        each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        left = rows.withColumn("_g", F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int")).withColumn("_b", each(blocks))
        right = stats.withColumn("_b", F.pmod(F.xxhash64("o"), F.lit(blocks)).cast("int")).withColumn("_g", each(groups))
        found = left.groupBy("_b", "_g").cogroup(right.groupBy("_b", "_g")).applyInPandas(near, schema)
    out = found.groupBy(id_col).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return out.select(id_col, F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def in_time_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ordered by those time columns that there are, nulls last."""
    present = [F.col(c).asc_nulls_last() for c in columns if c in df.columns]
    return df.orderBy(*present) if present else df


def adjustment_rules(patterns: DataFrame) -> DataFrame:
    """Rules from counts of false positives (kind: tactic, size or hour; value; n): the three most frequent tactics and hours with 3 or
    more, and sizes with 5 or more."""
    from pyspark.sql import Window

    ranked = patterns.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value")))
    kept = ranked.where("(kind = 'size' and n >= 5) or (kind <> 'size' and r <= 3 and n >= 3)")
    word = F.when(F.col("kind") == "tactic", "tactic_threshold_").when(F.col("kind") == "size", "size_penalty_").otherwise("time_adjustment_")
    action = F.when(F.col("kind") == "size", "apply_penalty").otherwise("increase_threshold")
    return kept.select(F.concat(word, "value").alias("rule_id"), action.alias("action"), F.when(F.col("kind") == "tactic", 0.1).otherwise(0.05).alias("amount"), F.least(F.lit(1.0), F.col("n") / 10).alias("confidence"), F.col("n").alias("fp_count"))


def value_sets(a: list[str], b: list[str]) -> tuple[Column, Column, Column]:
    """Common values, all values and those of the first alone, of two lists of columns without sentinels."""
    def held(columns: list[str]) -> Column:
        return F.array_distinct(F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNotNull() & ~x.isin(*SENTINELS)))

    x, y = held(a), held(b)
    return F.array_sort(F.array_intersect(x, y)), F.array_sort(F.array_union(x, y)), F.array_sort(F.array_except(x, y))


def edge_sample(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n edges (src, dst) by the order of a hash."""
    return edges.withColumn("_k", F.concat_ws("-", "src", "dst")).orderBy(hash_order("_k", seed), "src", "dst").limit(n).drop("_k")


def alert_edges(edges: DataFrame, alerts: DataFrame, relations: list[str], id_col: str = "alert_idx") -> DataFrame:
    """Edges (src, dst) of the given relations; where there are none a loop at each alert."""
    kept = edges.where(F.col("relation").isin(*relations)).select("src", "dst")
    any_ = kept.agg((F.count(F.lit(1)) > 0).alias("_any"))
    loops = alerts.crossJoin(F.broadcast(any_)).where("not _any").select(F.col(id_col).alias("src"), F.col(id_col).alias("dst"))  # one row
    return kept.unionByName(loops)


def merged_clusterings(**by_method: DataFrame) -> DataFrame:
    """The clusterings of several methods (id, cluster) under each other, with ``method``."""
    out = None
    for name, df in by_method.items():
        own = df.withColumn("method", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
