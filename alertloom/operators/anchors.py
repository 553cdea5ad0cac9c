"""Rows of a cluster as anchors of the later rows that share addresses or users with them, scored without making pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.plans.stage import shared_dir, written

#: Rows of a range of values that one task ranks, about.
BLOCK_ROWS = 500_000


def _values(columns: Sequence[str]) -> Column:
    if not columns:
        return F.array().cast("array<string>")
    some = F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNotNull() & (x != "NIL"))
    return F.array_sort(F.array_distinct(some))


def _subsets(n: int) -> list[tuple[int, ...]]:
    return [s for k in range(n + 1) for s in combinations(range(n), k)]


def _later(rows: DataFrame, n: int, base: str) -> DataFrame:
    """``rows`` (h1, h2, id) with the number of later ids of the same key and the next one.

    Rows are cut into ranges of key and id, so a key with any share of the rows is the work of many tasks. Only the first and last
    key of a range go on in others; these, at most two a range, are counted by range.
    """
    ranged = rows.repartitionByRange(n, "h1", "h2", "id").withColumn("_block", F.spark_partition_id())
    ranged = written(ranged, "values", base)
    w = Window.partitionBy("_block", "h1", "h2").orderBy(F.desc("id"))
    inside = ranged.withColumn("later", F.row_number().over(w) - 1).withColumn("next", F.lag("id").over(w))
    if n == 1:
        return inside
    key = F.struct("h1", "h2")
    ends = ranged.groupBy("_block").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("k")).select(F.explode("k").alias("k")).select("k.*").distinct()
    hint = F.broadcast if n <= 100_000 else (lambda x: x)  # at most two small rows a range
    pieces = ranged.join(hint(ends), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    behind = Window.partitionBy("h1", "h2").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    more = pieces.select("h1", "h2", "_block", F.sum("n").over(behind).alias("_more"), F.last("first").over(behind).alias("_first")).where("_more is not null")
    out = inside.join(hint(written(more, "more", base)), ["h1", "h2", "_block"], "left")
    return out.withColumn("later", F.col("later") + F.coalesce("_more", F.lit(0))).withColumn("next", F.coalesce("next", "_first")).drop("_more", "_first")


def anchor_scores(
    df: DataFrame, addresses: Sequence[str], usernames: Sequence[str] = (), require_both: bool = False, cluster: str = "pred_cluster", id_col: str = "alert_idx", least: float = 0.3, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``cluster``, ``anchor``, ``score`` and ``matches`` of each row that scores above ``least``.

    A later row of the cluster matches if it shares an address or a user with the anchor, in any column; with ``require_both`` an
    address and a user. Its count is the number of shared values; the first match scores half of its count, the k-th its count and 0.8 k.
    Nulls and ``NIL`` are no values; rows of no cluster are left out; ids are unique.

    Matches are counted by inclusion and exclusion over the sets of a row's values (at most 2 to the number of columns), each by the
    later rows that hold the whole set, so a value that m rows share costs m rows, not m squared. Sets are keyed by 128 bits.
    """
    base = shared_dir(df.sparkSession)
    return _scored(_rows(df, addresses, usernames, cluster, id_col, base), len(addresses), len(usernames), require_both, cluster, least, block_rows, base)


def _rows(df: DataFrame, addresses: Sequence[str], usernames: Sequence[str], cluster: str, id_col: str, base: str) -> DataFrame:
    """Rows of clusters with their values. They are read several times, so they are written once."""
    return written(df.where(F.col(cluster).isNotNull()).select(cluster, F.col(id_col).cast("long").alias("id"), _values(addresses).alias("_a"), _values(usernames).alias("_u")), "rows", base)


def _scored(rows: DataFrame, n_addresses: int, n_usernames: int, require_both: bool, cluster: str, least: float, block_rows: int, base: str) -> DataFrame:
    """``anchor_scores`` of ``_rows``."""
    sets = []
    for s in _subsets(n_addresses):
        for t in _subsets(n_usernames):
            if (not s or not t) if require_both else not (s or t):
                continue
            sign = (-1) ** (len(s) + len(t))
            matched = sign if require_both else -sign
            shared = ((len(s) == 1) * (-1) ** (len(t) + 1) + (len(t) == 1) * (-1) ** (len(s) + 1)) if require_both else int(len(s) + len(t) == 1)
            least_set = (len(s), len(t)) == (1, 1) if require_both else len(s) + len(t) == 1
            parts = [F.col(cluster), F.lit(len(s)), *[F.get("_a", F.lit(i)) for i in s], *[F.get("_u", F.lit(i)) for i in t]]
            there = (F.size("_a") > (s[-1] if s else -1)) & (F.size("_u") > (t[-1] if t else -1))
            fields = {"h1": F.xxhash64(*parts), "h2": F.xxhash64(F.lit(71), *parts), "m": F.lit(matched), "c": F.lit(shared), "least_set": F.lit(least_set), "a": F.lit(s[0] if s else -1), "u": F.lit(t[0] if t else -1)}
            sets.append(F.when(there, F.struct(*[v.alias(k) for k, v in fields.items()])))
    keyed = rows.select(cluster, "id", F.explode(F.array_compact(F.array(*sets))).alias("x")).select(cluster, "id", "x.*") if sets else None
    if keyed is None:
        return rows.select(cluster, F.col("id").alias("anchor"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matches")).where(F.lit(False))
    n = max(1, -(-rows.count() * len(sets) // block_rows))
    found = _later(keyed, n, base).where("later > 0")
    nexts = F.collect_list(F.when(F.col("least_set"), F.struct("next", "a", "u")))
    g = found.groupBy(cluster, "id").agg(F.sum(F.col("m") * F.col("later")).alias("matches"), F.sum(F.col("c") * F.col("later")).alias("shared"), nexts.alias("nexts"))
    first = F.filter("nexts", lambda x: x["next"] == F.array_min("nexts")["next"])
    held = lambda k: F.size(F.array_distinct(F.filter(F.transform(first, lambda x: x[k]), lambda i: i >= 0)))
    g = g.where("matches > 0").withColumn("c1", held("a") + held("u"))
    score = F.col("c1") / 2 + (F.col("shared") - F.col("c1")) + 0.8 * (F.col("matches") * (F.col("matches") + 1) / 2 - 1)
    return g.select(cluster, F.col("id").alias("anchor"), F.round(score, 9).alias("score"), "matches").where(F.col("score") > least)


def best_chains(
    df: DataFrame, addresses: Sequence[str], usernames: Sequence[str] = (), require_both: bool = False, cluster: str = "pred_cluster", id_col: str = "alert_idx", least: float = 0.3, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows of each cluster's best chain: the anchor of the highest score (smallest id on ties) and its matches, with anchor and score."""
    base = shared_dir(df.sparkSession)
    rows = _rows(df, addresses, usernames, cluster, id_col, base)
    scores = _scored(rows, len(addresses), len(usernames), require_both, cluster, least, block_rows, base)
    best = written(scores.groupBy(cluster).agg(F.max_by(F.struct("anchor", "score"), F.struct("score", -F.col("anchor"))).alias("b")), "best", base)
    heads = best.join(rows, (best[cluster] == rows[cluster]) & (F.col("b.anchor") == F.col("id"))).select(best[cluster], "b.*", F.col("_a").alias("_ha"), F.col("_u").alias("_hu"))
    both = rows.join(heads, cluster)
    a, u = F.arrays_overlap("_a", "_ha"), F.arrays_overlap("_u", "_hu")
    return both.where((F.col("id") == F.col("anchor")) | ((F.col("id") > F.col("anchor")) & ((a & u) if require_both else (a | u)))).select(cluster, "anchor", "score", "id")
