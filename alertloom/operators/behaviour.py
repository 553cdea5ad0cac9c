"""Anomalies against learned baselines, baseline updates, and analyst feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.scalars import day_interval, day_type, review_priority, risk_score, running_average

LOW, HIGH = 31.0, 69.0


def activity(df: DataFrame, key: str, user: str = "SourceUserName", time: str = "EndDate") -> DataFrame:
    """Counts per user, day type, day and key (an entity column, or ``interval`` for three-hour slots)."""
    k = day_interval(F.col(time)).cast("string") if key == "interval" else F.col(key)
    return df.groupBy(F.col(user).alias("user"), day_type(F.col(time)).alias("day_type"), F.to_date(time).alias("day"), k.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def baseline(act: DataFrame) -> DataFrame:
    """Mean daily count of each key, over the days that the user was active on that type of day."""
    days = act.groupBy("user", "day_type").agg(F.countDistinct("day").alias("days"))
    return act.groupBy("user", "day_type", "key").agg(F.sum("n").alias("total")).join(days, ["user", "day_type"]).select("user", "day_type", "key", (F.col("total") / F.col("days")).alias("avg"), "days")


def with_baseline(current: DataFrame, base: DataFrame) -> DataFrame:
    """Rows with what is expected of them: ``avg`` of their key, ``total`` of the user's type of day, ``known`` (the user has a baseline)."""
    sums = base.groupBy("user", "day_type").agg(F.sum("avg").alias("total"))
    known = base.select("user").distinct().withColumn("known", F.lit(True))
    return current.join(base.select("user", "day_type", "key", "avg"), ["user", "day_type", "key"], "left").join(sums, ["user", "day_type"], "left").join(known, "user", "left")


def judged(rows: DataFrame, factor: float = 2.0, new_keys: bool = False, low: float = LOW, high: float = HIGH, keep: list[str] | None = None) -> DataFrame:
    """Of counts with their expectation, those whose risk leaves [low, high]."""
    x = (F.col("n") - F.coalesce("avg", F.lit(0.0))) / F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(1.0)) * factor
    is_new = F.col("known").isNull() | (F.col("avg").isNull() if new_keys else F.lit(False))
    out = rows.select("user", "day_type", "day", "key", "n", is_new.alias("is_new"), F.when(is_new, 100.0).otherwise(risk_score(x)).alias("risk"), *(keep or []))
    return out.where((F.col("risk") > high) | (F.col("risk") < low))


def anomalies(current: DataFrame, base: DataFrame, factor: float = 2.0, new_keys: bool = False, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Counts whose risk leaves [low, high]; users without a baseline, and with ``new_keys`` keys without one, have risk 100."""
    return judged(with_baseline(current, base), factor, new_keys, low, high)


def update_baseline(base: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New means after judged counts (user, day_type, key, n, verdict): ``normal`` counts enter the mean, ``positive`` ones leave
    it as it is, keys without a baseline start with their count unless they are positive."""
    v = verdicts.groupBy("user", "day_type", "key").agg(F.sum("n").alias("n"), F.max("verdict").alias("verdict"))
    j = base.join(v, ["user", "day_type", "key"], "full")
    good = F.col("verdict") == "normal"
    avg = F.when(F.col("avg").isNull() & good, F.col("n").cast("double")).when(good, running_average(F.col("avg"), F.col("days"), F.col("n"))).otherwise(F.col("avg"))
    return j.select("user", "day_type", "key", avg.alias("avg"), (F.coalesce("days", F.lit(0)) + F.when(good, 1).otherwise(0)).alias("days")).where("avg is not null")


def feedback_stats(fb: DataFrame) -> DataFrame:
    return fb.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def feedback_trend(fb: DataFrame) -> DataFrame:
    fp = F.col("feedback_type") == "false_positive"
    return fb.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(fp, 1)).alias("false_positives"))


def false_positives(fb: DataFrame, confidence: float = 0.0, since: str | None = None, kind: str = "false_positive") -> DataFrame:
    """Feedback of one type with at least this confidence and, if given, from ``since`` (a time) on."""
    out = fb.where((F.col("feedback_type") == kind) & (F.col("confidence") >= confidence))
    return out.where(F.col("timestamp") >= F.lit(since).cast("timestamp")) if since else out


def fp_patterns(fb: DataFrame) -> DataFrame:
    """False positives by tactic, by tens of cluster size and by hour, in one pass."""
    rows = false_positives(fb).select("tactic", F.floor(F.col("cluster_size") / 10).alias("bucket"), F.hour("timestamp").alias("hour"))
    return rows.groupingSets([("tactic",), ("bucket",), ("hour",)], "tactic", "bucket", "hour").agg(F.count(F.lit(1)).alias("n"))


def uncertain_clusters(fb: DataFrame, confidence: float = 0.5, size: int = 50, most: int = 50) -> DataFrame:
    """The ``most`` first clusters with low mean confidence, feedback of different types, or a large size."""
    g = fb.groupBy("cluster_id").agg(F.avg("confidence").alias("c"), F.countDistinct("feedback_type").alias("k"), F.max("cluster_size").alias("s"))
    return g.where((F.col("c") < confidence) | (F.col("k") > 1) | (F.col("s") > size)).orderBy("cluster_id").limit(most).select("cluster_id")


def review_reasons(fb: DataFrame, confidence: float = 0.5, size: int = 50) -> DataFrame:
    g = fb.groupBy("cluster_id").agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("k"), F.max("cluster_size").alias("s"))
    why = F.concat_ws(",", F.when(F.col("c") < confidence, "low_confidence"), F.when(F.col("s") > size, "large_cluster"), F.when(F.col("k") >= 2, "conflicting_feedback"))
    return g.select("cluster_id", F.when(why == "", "general_review").otherwise(why).alias("reason"))


def review_batch(clusters: DataFrame, k: int = 10, cluster: str = "pred_cluster") -> DataFrame:
    """The k clusters of the highest review priority."""
    return clusters.withColumn("priority", review_priority(F.col("size"), F.col("mean_severity"))).orderBy(F.round("priority", 9).desc(), cluster).limit(k)


def adjust_scores(scores: DataFrame, rules: DataFrame, cluster: str = "pred_cluster") -> DataFrame:
    """Scores less the amounts of all rules (rule_id, tactic, least_size, most_size, amount; null: any) that fit, at least 0.

    Rules are a handful of analyst decisions; more than 10,000 are refused, as they go to every task.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 rules")
    fits = (F.col("r.tactic").isNull() | F.col("s.tactics").contains(F.col("r.tactic"))) & (F.col("s.size") >= F.coalesce(F.col("r.least_size"), F.lit(0))) & (F.col("s.size") <= F.coalesce(F.col("r.most_size"), F.lit(1 << 60)))
    j = scores.alias("s").join(F.broadcast(rules.alias("r")), fits, "left")
    g = j.groupBy(F.col(f"s.{cluster}").alias(cluster)).agg(F.max("s.score").alias("score"), F.coalesce(F.sum("r.amount"), F.lit(0.0)).alias("cut"), F.array_join(F.sort_array(F.collect_set("r.rule_id")), ",").alias("rules"))
    return g.select(cluster, F.greatest(F.lit(0.0), F.col("score") - F.col("cut")).alias("score"), "rules")


def key_entities(df: DataFrame, column: str, by: str, k: int = 3) -> DataFrame:
    """The k most frequent values of a column per group, with their share."""
    n = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    return n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), column))).where(F.col("rank") <= k)
