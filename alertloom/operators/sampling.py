"""Samples and class balance. Rows are chosen by the order of a hash, so every run and engine chooses the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_ranked(df: DataFrame, by: list[str], id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """``df`` with each row's place (``_r`` from 1, ``_tied`` the same for equal ids) in its group's hash order, and the group's size ``_n``. Null is a group.

    Hashes are even, so a group is cut into 4,096 ranges of them; ranges are counted first, and each is ranked by itself: a group
    with any share of the rows is the work of many tasks.
    """
    rows = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", F.coalesce(F.substring("_h", 1, 3), F.lit("")))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb"), before.alias("_before"), F.sum("_c").over(group).alias("_n"))
    same = F.col("_b") == F.col("_kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_b").orderBy("_h")
    out = rows.join(sizes, same).withColumn("_r", F.col("_before") + F.row_number().over(inside)).withColumn("_tied", F.col("_before") + F.rank().over(inside))
    return out.drop("_h", "_b", "_kb", "_before", *[f"_k{i}" for i in range(len(by))])


def reservoir(df: DataFrame, k: int, strata: list[str] | None = None, id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """At most k rows, of each stratum if given (null is one)."""
    if not strata:
        return df.orderBy(hash_order(id_col, seed)).limit(k)
    order = hash_order(id_col, seed)
    part = F.pmod(F.xxhash64(id_col), F.lit(256))  # at most 256 k rows of a stratum meet in the end
    some = df.withColumn("_s", part).withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_s").orderBy(order))).where(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).where(F.col("_r") <= k).drop("_r", "_s")


def stratified(df: DataFrame, strata: list[str], share: float, id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """The same share of each stratum, one row at least."""
    return hash_ranked(df, strata, id_col, seed).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_r", "_tied")


def topped_up(df: DataFrame, strata: list[str], share: float, total: int, id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """A stratified sample filled up from the other rows to ``total``."""
    first = stratified(df, strata, share, id_col, seed).withColumn("_p", F.lit(0))
    rest = df.join(first.select(id_col), id_col, "left_anti").withColumn("_p", F.lit(1))
    return first.unionByName(rest).orderBy("_p", hash_order(id_col, seed)).limit(total).drop("_p")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    one = n.agg(F.sum("n").alias("_t"), F.max("n").alias("_m"))
    return n.crossJoin(F.broadcast(one)).select(label, "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("_m") / F.col("n")).alias("imbalance"))  # one row


def _target(df: DataFrame, label: str, how: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    one = n.agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"), F.percentile("_n", F.lit(0.5)).alias("mid"))
    want = {"under": F.col("lo"), "over": F.col("hi"), "hybrid": F.floor(F.sqrt(F.col("hi").cast("double") * F.col("lo"))), "median": F.floor("mid")}[how]
    return n.crossJoin(F.broadcast(one)).select(label, "_n", want.cast("long").alias("_want"))  # one row


def balance(df: DataFrame, label: str, how: str = "hybrid", id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """Every class at one size: the smallest (``under``), the largest (``over``), their geometric mean (``hybrid``) or the median.

    Rows of larger classes are left out by hash order; those of smaller ones repeat (``copy`` counts from 0), the first in
    hash order once more than the others.
    """
    return _resized(df, label, _target(df, label, how), id_col, seed)


def _resized(df: DataFrame, label: str, want: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Each class at its wanted size (label, _n, _want), as ``balance`` does it."""
    r = hash_ranked(df.where(F.col(label).isNotNull()), [label], id_col, seed).drop("_n", "_tied").join(want, label)
    copies = F.floor((F.col("_want") - F.col("_r")) / F.col("_n")) + 1
    return r.where(F.col("_r") <= F.col("_want")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), copies).cast("int") - 1))).drop("_n", "_want", "_r")


def balance_normal(df: DataFrame, label: str, normal: str = "normal", least: int = 500, id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """Normal rows down to twice the attacks; each attack up to the size of the rarest (``least`` at least), or down to twice that."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    attack = F.col(label) != normal
    one = n.agg(F.greatest(F.min(F.when(attack, F.col("_n"))), F.lit(least)).alias("_t"), F.sum(F.when(attack, F.col("_n"))).alias("_a"))
    size = F.when(~attack, F.least(F.col("_n"), 2 * F.col("_a"))).when(F.col("_n") < F.col("_t"), F.col("_t")).otherwise(F.least(2 * F.col("_t"), F.col("_n")))
    want = n.crossJoin(F.broadcast(one)).select(label, "_n", size.cast("long").alias("_want"))  # one row
    return _resized(df, label, want, id_col, seed)


def balance_auto(df: DataFrame, label: str, id_col: str = "alert_idx") -> DataFrame:
    """``over`` up to an imbalance of 3, ``hybrid`` up to 10, else ``under``."""
    ratio = class_distribution(df, label).agg(F.max("imbalance")).first()[0] or 1.0
    return balance(df, label, "over" if ratio <= 3 else "hybrid" if ratio <= 10 else "under", id_col)


def ensembles(df: DataFrame, label: str, id_col: str = "alert_idx") -> DataFrame:
    out = df.withColumn("copy", F.lit(0)).withColumn("variant", F.lit("original"))
    for how in ("under", "over", "hybrid"):
        out = out.unionByName(balance(df, label, how, id_col).withColumn("variant", F.lit(how)))
    return out


def split(df: DataFrame, label: str, train: float = 0.8, id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """``part``: train or test, with the same share of each class."""
    share = F.when(F.col("_n") > 1, (F.col("_tied") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return hash_ranked(df, [label], id_col, seed).withColumn("part", F.when(share < train, "train").otherwise("test")).drop("_n", "_r", "_tied")


def kl_shift(a: DataFrame, b: DataFrame, label: str, floor: float = 0.001) -> DataFrame:
    """One row: divergence of the label distribution of ``a`` from that of ``b``, and its degree in words."""
    p = lambda df, name: df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_t")))).select(label, (F.col("_n") / F.col("_t")).alias(name))  # noqa: E731  one row
    both = p(a, "p").join(p(b, "q"), label, "full")
    both = both.select(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(floor)).alias("p"), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(floor)).alias("q"))
    return both.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl")).withColumn("degree", F.when(F.col("kl") < 0.1, "low").when(F.col("kl") < 0.5, "medium").otherwise("high"))
