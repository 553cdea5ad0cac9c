"""Agreement of clusterings with ground truth, from one contingency table, and statistics of result tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.components import connected_components


def contingency(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: str) -> Column:
    c = F.col(n).cast("double")
    return F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0.0))


def _margins(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = lambda c: t.groupBy(c).agg(F.sum("n").alias("m"))
    return rows("true"), rows("pred"), t.agg(F.sum("n").cast("double").alias("n"))


def pair_scores(t: DataFrame) -> DataFrame:
    """One row: adjusted Rand index and Fowlkes-Mallows index."""
    a, b, n = _margins(t)
    one = t.agg(_pairs("n").alias("s")).crossJoin(a.agg(_pairs("m").alias("a"))).crossJoin(b.agg(_pairs("m").alias("b"))).crossJoin(n)  # one row each
    all_ = F.col("n") * (F.col("n") - 1) / 2
    chance = F.col("a") * F.col("b") / all_
    top = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(top == chance, F.lit(1.0)).otherwise((F.col("s") - chance) / (top - chance)).alias("ari"), F.when((F.col("a") == 0) | (F.col("b") == 0), F.lit(0.0)).otherwise(F.col("s") / F.sqrt(F.col("a") * F.col("b"))).alias("fmi"))


def information_scores(t: DataFrame) -> DataFrame:
    """One row: homogeneity, completeness, V-measure (equal to NMI with arithmetic mean)."""
    a, b, n = _margins(t)
    n = F.broadcast(n)  # one row
    entropy = lambda m, name: m.crossJoin(n).agg(F.coalesce(-F.sum(F.col("m") / F.col("n") * F.log(F.col("m") / F.col("n"))), F.lit(0.0)).alias(name))
    joint = t.withColumnRenamed("n", "c").join(a.withColumnRenamed("m", "ma"), "true").join(b.withColumnRenamed("m", "mb"), "pred").crossJoin(n)
    mutual = joint.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ma") * F.col("mb")))).alias("i"))
    one = mutual.crossJoin(entropy(a, "ha")).crossJoin(entropy(b, "hb"))
    h = F.when(F.col("ha") == 0, 1.0).otherwise(F.col("i") / F.col("ha"))
    c = F.when(F.col("hb") == 0, 1.0).otherwise(F.col("i") / F.col("hb"))
    return one.select(h.alias("homogeneity"), c.alias("completeness"), F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)).alias("v_measure"))


def purity(t: DataFrame) -> DataFrame:
    best = t.groupBy("pred").agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return best.agg((F.sum("best") / F.sum("size")).alias("purity"), F.count(F.lit(1)).alias("clusters"))


def purity_by_cluster(t: DataFrame) -> DataFrame:
    return t.groupBy("pred").agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("purity"), F.min_by("true", F.struct(-F.col("n"), F.col("true"))).alias("dominant"))


def chi_square(t: DataFrame) -> DataFrame:
    """One row: the statistic and degrees of freedom; empty cells are counted through the total."""
    a, b, n = _margins(t)
    joint = t.withColumnRenamed("n", "c").join(a.withColumnRenamed("m", "ma"), "true").join(b.withColumnRenamed("m", "mb"), "pred").crossJoin(F.broadcast(n))
    one = joint.agg(F.sum(F.col("c") * F.col("c") * F.col("n") / (F.col("ma") * F.col("mb"))).alias("s"), F.max("n").alias("n"))
    k = a.agg((F.count(F.lit(1)) - 1).alias("ra")).crossJoin(b.agg((F.count(F.lit(1)) - 1).alias("rb")))
    return one.crossJoin(k).select((F.col("s") - F.col("n")).alias("chi2"), (F.col("ra") * F.col("rb")).alias("dof"))


def classification(t: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1, for predictions that name true classes."""
    a, b, n = _margins(t)
    hit = t.where(F.col("true") == F.col("pred")).select("true", F.col("n").alias("tp"))
    per = a.join(hit, "true", "left").join(b.select(F.col("pred").alias("true"), F.col("m").alias("mp")), "true", "left").crossJoin(F.broadcast(n))
    tp = F.coalesce("tp", F.lit(0))
    p, r = F.coalesce(tp / F.col("mp"), F.lit(0.0)), tp / F.col("m")
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    w = F.col("m") / F.col("n")
    return per.agg((F.sum(tp) / F.max("n")).alias("accuracy"), F.sum(w * p).alias("precision"), F.sum(w * r).alias("recall"), F.sum(w * f1).alias("f1"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"), (F.avg(d) / F.stddev_samp(d)).alias("effect"), (F.count(d) - 1).alias("dof"))


def tactic_f1(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of tactic sets (arrays); two empty sets agree fully, one empty set not at all."""
    both = F.size(F.array_intersect(true, pred))
    nt, np_ = F.size(F.array_distinct(true)), F.size(F.array_distinct(pred))
    p = F.when((nt == 0) & (np_ == 0), 1.0).when(np_ == 0, 0.0).otherwise(both / np_)
    r = F.when((nt == 0) & (np_ == 0), 1.0).when(nt == 0, 0.0).otherwise(both / nt)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from the largest, ties sharing their mean."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc())
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def rank_methods(df: DataFrame, metrics: list[str], method: str, by: list[str]) -> DataFrame:
    """Mean rank of each method over all metrics and groups."""
    ranks = df.select(method, *[average_rank(m, by).alias(m) for m in metrics])
    return ranks.groupBy(method).agg(F.avg(sum((F.col(m) for m in metrics), F.lit(0.0)) / len(metrics)).alias("avg_rank"))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"))


def confidence_diagnostics(df: DataFrame, value: str, gate: float) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.75)).alias("p75"), F.avg((F.col(value) < gate).cast("int")).alias("below"))


def best_setting(df: DataFrame, by: str, setting: str, score: str, baseline: float) -> DataFrame:
    """Per group the setting of the highest score (smallest on ties), and its gain over the baseline setting."""
    best = df.groupBy(by).agg(F.max_by(F.struct(setting, score), F.struct(F.col(score), -F.col(setting))).alias("b"))
    base = df.where(F.col(setting) == baseline).select(by, F.col(score).alias("base"))
    return best.join(base, by, "left").select(by, f"b.{setting}", F.col(f"b.{score}").alias("best"), (F.col(f"b.{score}") - F.col("base")).alias("gain"))


def correlations(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Pearson and Spearman correlation per group."""
    r = df.select(by, x, y, average_rank(x, [by]).alias("_rx"), average_rank(y, [by]).alias("_ry"))
    return r.groupBy(by).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def pure_share(df: DataFrame, cluster: str, kind: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.countDistinct(kind).alias("k")).agg(F.avg((F.col("k") == 1).cast("int")).alias("pure_share"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing, distinct, least and largest value (as text) of each column."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"), F.countDistinct(c).alias("distinct_values"), F.min(F.col(c).cast("string")).alias("least"), F.max(F.col(c).cast("string")).alias("largest")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def hungarian(cost: list[list[float]]) -> list[int]:
    """Assignment of rows to columns of least total cost (rows at most columns), by shortest augmenting paths."""
    c = np.asarray(cost, dtype=float).reshape(len(cost), -1)
    n, m = c.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        least, way, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, col = i, -1
        while True:
            cur = c[row] - u[row] - v
            better = ~used & (cur < least)
            least[better], way[better] = cur[better], col
            nxt = int(np.where(used, np.inf, least).argmin())
            delta = least[nxt]
            u[i] += delta
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            col, used[nxt] = nxt, True
            if match[col] < 0:
                break
            row = match[col]
        while col >= 0:
            before = way[col]
            match[col] = match[before] if before >= 0 else i
            col = before
    out = np.full(n, -1)
    out[match[match >= 0]] = np.flatnonzero(match >= 0)
    return out.tolist()


def mapped_accuracy(t: DataFrame) -> float:
    """Accuracy under the best one-to-one mapping of clusters to classes.

    Classes and clusters that share no row gain nothing from one another, so each component of the contingency table is solved by
    itself, in a task that holds its classes x clusters; only the sum comes to the driver. 0 for an empty table.
    """
    named = t.select(F.concat(F.lit("t"), F.col("true").cast("string")).alias("true"), F.concat(F.lit("p"), F.col("pred").cast("string")).alias("pred"), "n")
    comp = connected_components(named, "true", "pred").withColumnRenamed("node", "true")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pd.factorize(pdf["true"])[0], pd.factorize(pdf["pred"])[0]
        cost = np.zeros((x.max() + 1, y.max() + 1))
        np.subtract.at(cost, (x, y), pdf["n"].to_numpy(dtype=float))
        cost = cost if cost.shape[0] <= cost.shape[1] else cost.T
        return pd.DataFrame({"hits": [-cost[np.arange(len(cost)), hungarian(cost)].sum()]})

    hits = named.join(comp, "true").groupBy("component").applyInPandas(solve, "hits double").agg(F.sum("hits")).first()[0]
    total = t.agg(F.sum("n")).first()[0]
    return hits / total if total else 0.0
