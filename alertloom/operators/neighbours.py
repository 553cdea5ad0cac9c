"""Exact nearest rows in blocks, and what rests on them: imputation, synthetic minority rows, Ward's agglomeration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.components import connected_components
from alertloom.operators.sampling import hash_order
from alertloom.plans.stage import removed, shared_dir, written

#: Rows of a block that are compared with another block's at once.
BLOCK_ROWS = 1024
#: Blocks of clusters in a round of Ward's agglomeration, and the rows that one may have before there are more.
WARD_BLOCKS, LARGEST_BLOCK = 16, 65_536
#: Rows of these that are compared at once, so that costs stay in a processor's cache.
TILE_ROWS = 256
#: New clusters are dealt out to so many blocks as are compared with all blocks (more where one would pass ``LARGEST_BLOCK``).
NEW_BLOCKS = 2
#: Others that a cluster keeps in its list.
LISTED = 8
#: Clusters with so many values in all (but ``BLOCK_ROWS`` at least) are finished in one task.
FINISHED_VALUES = 1 << 20

_FOUND = "g string, id long, place int, d double, other long, x double"


def _vector(columns: list[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])


def _pattern(width: int) -> Column:
    """Bits of the components that a vector has."""
    return sum((F.when(F.get("v", F.lit(i)).isNotNull() & ~F.isnan(F.get("v", F.lit(i))), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(width)), F.lit(0)).cast("long")


def _laid(queries: DataFrame, donors: DataFrame, order: list[int], base: str) -> tuple[DataFrame, dict]:
    """Donors in blocks of ``BLOCK_ROWS`` by group, components that they have, and values in ``order``; and the box of each block."""
    near = donors.join(F.broadcast(queries.select("g").distinct()), "g", "left_semi")  # groups
    sort = ["g", "has", *[F.get("v", F.lit(i)) for i in order], "id"]
    laid = near.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS))
    laid = written(laid, "laid", base)
    ends = [f(F.get("v", F.lit(i))).alias(f"{n}{i}") for i in sorted(order) for n, f in (("a", F.min), ("b", F.max))]
    boxes = laid.groupBy("g", "has", "block").agg(F.count(F.lit(1)).alias("n"), *ends).toPandas()  # a row a block
    by_group = {}
    for g, part in boxes.groupby("g"):
        low, high = (np.nan_to_num(part[[f"{n}{i}" for i in sorted(order)]].to_numpy(dtype=float)) for n in "ab")
        by_group[g] = (part["block"].to_numpy(), part["has"].to_numpy(), part["n"].to_numpy(), low, high)
    return laid, by_group


def _reached(width: int, boxes: dict, k: int):
    """Blocks that a query has to meet: without ``bound`` the nearest ones that hold k donors and itself, then all others within its bound."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, (g, place, v, has, bound) in enumerate(zip(pdf["g"], pdf["place"], pdf["v"], pdf["has"], pdf["bound"])):
                if g not in boxes:
                    continue
                block, own, rows, low, high = boxes[g]
                x = np.nan_to_num(np.array(v, dtype=float))
                both = ((own & has)[:, None] >> np.arange(width)[None, :]) & 1 == 1
                shared = both.sum(1)
                gap = np.maximum(np.maximum(low - x, x - high), 0.0)
                least = np.nan_to_num(np.sqrt((gap * gap * both).sum(1) * (width / np.maximum(shared, 1))), nan=0.0)
                usable = (shared > 0) & ((own >> max(place, 0)) & 1 == 1 if place >= 0 else True)
                at = np.flatnonzero(usable)
                at = at[np.argsort(least[at], kind="stable")]
                first = at[: int(np.searchsorted(np.cumsum(rows[at]), k + 1)) + 1]
                if not np.isnan(bound):
                    first = np.setdiff1d(at[least[at] <= bound * (1 + 1e-9) + 1e-12], first)
                out += [(n, j, h) for j, h in zip(block[first], own[first])]
            if out:
                at, block, own = zip(*out)
                yield pdf.iloc[list(at)][["g", "id", "place", "v"]].assign(block=list(block), own=list(own))

    return blocks


def nearest(queries: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """For each query (g, id, place, v) the k nearest donors (g, id, v) of its group, itself left out: g, id, place, d, other, x, rank.

    Distances are Euclidean over the components that both rows have, scaled up by the share of those missing; rows that share none
    aren't comparable. ``place`` asks for donors that have that component and returns it as ``x`` (-1: any donor). Ties go to the
    smallest donor. Donors are laid in blocks of ``BLOCK_ROWS`` along the components that queries have; a query meets the nearest block, and then
    those whose box is no farther than the k-th donor found there, so the result is exact and in few dimensions most blocks are never met. Of
    equal donors k+1 are enough. A row a block, its box, goes to all tasks.
    """
    spark, base = queries.sparkSession, shared_dir(queries.sparkSession)
    one = donors.select(F.size("v").alias("n")).first()
    width = one.n if one else 0
    copies = F.row_number().over(Window.partitionBy("g", "v").orderBy("id"))
    given = donors.select(*[F.col(c).alias(c) for c in ("g", "id", "v")]).withColumn("c", copies).where(F.col("c") <= k + 1).drop("c").withColumn("has", _pattern(width)).where("has <> 0")
    given = written(given, "given", base)
    asked = written(queries.select("g", "id", "place", "v").withColumn("has", _pattern(width)).where("has <> 0"), "asked", base)
    spread = given.agg(*[F.approx_count_distinct(F.get("v", F.lit(i))).alias(f"n{i}") for i in range(width)]).first() if width else []
    order = sorted(range(width), key=lambda i: -spread[i])
    lead = F.coalesce(*[F.when(F.col("has").bitwiseAND(F.lit(1 << i)) != 0, F.lit(i)) for i in order], F.lit(-1)) if width else F.lit(-1)
    asked = asked.withColumn("lead", lead)
    counts = [F.count(F.when(F.col("has").bitwiseAND(F.lit(1 << i)) != 0, 1)).alias(f"q{i}") for i in range(width)]
    out = None
    for r in asked.groupBy("lead").agg(*counts, F.count(F.lit(1)).alias("n")).orderBy("lead").collect():  # a row a component at most
        own = asked.where(F.col("lead") == r["lead"]).drop("lead")
        # along the component that all of these have, then along those that most have
        axes = [r["lead"], *sorted((i for i in order if i != r["lead"]), key=lambda i: -r[f"q{i}"])]
        laid, boxes = _laid(own, given, axes, f"{base}/lead{r['lead']}")
        where = "g string, id long, place int, v array<double>, block long, own long"
        met = None
        for step in range(2):
            if step:
                far = met.groupBy("g", "id", "place").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("m"))
                bound = F.when(F.col("n") >= k, F.col("m")).otherwise(F.lit(float("inf")))
                from_ = own.join(far.hint("merge"), ["g", "id", "place"], "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf")))).drop("n", "m")
            else:
                from_ = own.withColumn("bound", F.lit(float("nan")))
            sent = written(from_.repartition("id").mapInPandas(_reached(width, boxes, k), where), f"sent{r['lead']}_{step}", base)
            found = written(_top(_compared(sent, laid, k), k), f"met{r['lead']}_{step}", base)
            met = found if met is None else met.unionByName(found)
        out = met if out is None else out.unionByName(met)
    if out is None:
        return spark.createDataFrame([], _FOUND + ", rank int")
    w = Window.partitionBy("g", "id", "place").orderBy("d", "other")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("g", "id", "place").orderBy("d", "other")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _compared(sent: DataFrame, laid: DataFrame, k: int) -> DataFrame:
    """Each query with the k nearest donors of each block that it was sent to. A block that many queries meet is compared in parts of these."""
    parts = sent.groupBy("g", "block", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    keys = ["g", "block", "own"]
    a = sent.join(parts.hint("merge"), keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    b = laid.withColumnRenamed("has", "own").join(parts.hint("merge"), keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "part", "id", "v")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("g", "id", "place", "d", "other", "x")}
        if len(a) and len(b):
            y, ids = np.array([list(v) for v in b["v"]], dtype=float), b["id"].to_numpy()
            has, at = ~np.isnan(y), np.argsort(ids, kind="stable")
            y, ids, has = np.nan_to_num(y)[at], ids[at], has[at]
            for i, place, v in zip(a["id"], a["place"], a["v"]):
                x = np.array(v, dtype=float)
                both = has & ~np.isnan(x)
                n = both.sum(1)
                d = (((y - np.nan_to_num(x)) ** 2) * both).sum(1) * (len(x) / np.maximum(n, 1))
                d[(n == 0) | (ids == i) | (~has[:, place] if place >= 0 else False)] = np.inf
                few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))  # with all that tie
                for j in few[np.argsort(d[few], kind="stable")[:k]]:
                    if d[j] < np.inf:
                        for c, value in zip(out, (a["g"].iloc[0], i, place, float(np.sqrt(d[j])), ids[j], float(y[j, max(place, 0)]))):
                            out[c].append(value)
        return pd.DataFrame(out).astype({"g": object})

    at = [*keys, "part"]
    return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInPandas(compare, _FOUND)


def impute(df: DataFrame, columns: list[str], id_col: str = "alert_idx", k: int = 2) -> DataFrame:
    """Missing values of ``columns`` as the mean of the k nearest rows that have them; the column's mean where no row is comparable.

    Only rows with a missing value are compared, each with all others that aren't a k+1st copy of one: further copies would change
    no mean but for ties, which go to the smallest id. A column without any value stays null. ``id_col`` must be unique, a long.
    """
    rows = df.select(F.lit("").alias("g"), F.col(id_col).cast("long").alias("id"), _vector(columns).alias("v"))
    missing = rows.select("*", F.posexplode("v").alias("place", "x")).where("x is null")
    found = nearest(missing.drop("x"), rows, k).groupBy("id", "place").agg(F.avg("x").alias("x"))
    wide = found.groupBy("id").agg(*[F.max(F.when(F.col("place") == i, F.col("x"))).alias(f"_new{i}") for i in range(len(columns))])
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_mean{i}") for i, c in enumerate(columns)])
    joined = df.join(wide.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left").crossJoin(F.broadcast(means))  # one row
    new = {c: F.coalesce(F.col(c).cast("double"), f"_new{i}", f"_mean{i}") for i, c in enumerate(columns)}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def synthetic_minority(df: DataFrame, label: str, columns: list[str], id_col: str = "alert_idx", k: int = 5, seed: int = 42) -> DataFrame:
    """Every class at the size of the largest: its rows, and new ones (``copy`` 1, 2, ...) on the line from a row to one of its k
    nearest of the class. Rows serve in hash order, as ``balance`` repeats them; which neighbour and how far follow from a hash. A
    row alone in its class is repeated. Columns other than these, the label and the id are left out; rows with a missing value too.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("g"), _vector(columns).alias("v")).where(F.col("g").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    n = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    want = n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most"))))  # one row
    order = F.row_number().over(Window.partitionBy("g").orderBy(hash_order("id", seed), "id"))
    times = F.floor((F.col("most") - F.col("n") - F.col("r")) / F.col("n")) + 1
    chosen = base.join(want.where("n < most"), "g").withColumn("r", order).withColumn("times", times.cast("int")).where("times > 0")
    near = nearest(chosen.select("g", "id", F.lit(-1).alias("place"), "v"), base.join(want.where("n < most").select("g"), "g", "left_semi"), k)
    beside = near.select("g", "id", "rank", "other").join(base.select("g", F.col("id").alias("other"), F.col("v").alias("to")), ["g", "other"])
    known = chosen.join(near.groupBy("g", "id").agg(F.max("rank").alias("found")), ["g", "id"], "left")
    # in thousands, so that a lone row of a rare class makes no huge array
    many = known.withColumn("m", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 1000)))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("times") - 1000 * F.col("m"))))).withColumn("copy", (F.col("copy") + 1000 * F.col("m")).cast("int"))
    pick = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.coalesce("found", F.lit(1))).cast("int") + 1
    share = F.pmod(F.xxhash64("copy", "id", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = many.withColumn("rank", pick).withColumn("u", share).join(beside, ["g", "id", "rank"], "left")
    made = drawn.select("id", "g", "copy", F.when(F.col("to").isNull(), F.col("v")).otherwise(F.zip_with("v", "to", lambda a, b: a + F.col("u") * (b - a))).alias("v"))
    all_ = base.select("id", "g", F.lit(0).alias("copy"), "v").unionByName(made)
    return all_.select(F.col("id").alias(id_col), F.col("g").alias(label), "copy", *[F.col("v")[i].alias(c) for i, c in enumerate(columns)])


def _cost(n: np.ndarray, c: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Growth of the sum of squares when clusters of n rows around c join such of m around e."""
    out = np.add.outer((c * c).sum(1), (e * e).sum(1))
    out -= (2 * c) @ e.T
    np.maximum(out, 0, out=out)
    (u, p), (v, q) = np.unique(n, return_inverse=True), np.unique(m, return_inverse=True)  # sizes are few
    out *= np.take((np.multiply.outer(u, v) / np.add.outer(u, v))[p], q, axis=1)
    return out


def _exact(n: np.ndarray, c: np.ndarray, m: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Costs of the pairs (i, j), the same bits whichever end comes first and whatever else is compared."""
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 14):
        x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
        z = c[x] - e[y]
        out[s : s + len(x)] = np.einsum("ij,ij->i", z, z) * (n[x] * m[y] / (n[x] + m[y]))
    return out


def _slack(n: np.ndarray, c: np.ndarray, e: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """How far costs by matrix products in numbers of this kind may be from the exact ones."""
    return 2 * np.finfo(kind).eps * (c.shape[1] + 8) * n * ((c * c).sum(1) + (e * e).sum(1).max())


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """All merges among a few clusters, by rounds of mutual nearest neighbours. A cluster is compared with all others when it is new or its nearest joined another."""
    pdf = pdf.sort_values("id")
    ids, n = pdf["id"].to_numpy(), pdf["n"].to_numpy(dtype=float)
    c = np.array([list(v) for v in pdf["c"]], dtype=float).reshape(len(ids), -1)
    out, need = [], np.ones(len(ids), dtype=bool)
    near, low = np.zeros(len(ids), dtype="int64"), np.zeros(len(ids))
    while len(ids) > 1:
        at, mid = np.arange(len(ids)), c.mean(0)
        rows, around = np.flatnonzero(need), c - mid
        for s in range(0, len(rows), TILE_ROWS):
            r = rows[s : s + TILE_ROWS]
            d = _cost(n[r], around[r], n, around)
            d[np.arange(len(r)), r] = np.inf
            i, j = np.nonzero(d <= (d.min(1) + 2 * _slack(n[r], around[r], around))[:, None])
            cost = _exact(n, c, n, c, r[i], j)
            # ids ascend: of equal costs that of the smallest pair
            order = np.lexsort((np.maximum(r[i], j), np.minimum(r[i], j), cost, i))
            first = order[np.searchsorted(i[order], np.arange(len(r)))]
            near[r], low[r] = j[first], cost[first]
        a = at[(near[near] == at) & (at < near)]
        if not len(a):  # costs of several rounds may differ in their last bits; of one round they have a least pair
            need[:] = True
            continue
        b = near[a]
        out += zip(ids[a], ids[b], low[a])
        c[a] = (c[a] * n[a, None] + c[b] * n[b, None]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        gone = np.zeros(len(ids), dtype=bool)
        gone[a] = gone[b] = True
        need = gone[near] | gone
        keep = np.setdiff1d(at, b)
        near = np.searchsorted(keep, near)  # of those whose nearest is still there
        ids, n, c, need, near, low = (x[keep] for x in (ids, n, c, need, near, low))
    return pd.DataFrame(out, columns=["a", "b", "d"]).astype({"a": "int64", "b": "int64", "d": "float64"})


def _ward_blocks(count: int) -> int:
    return max(min(WARD_BLOCKS, -(-count // BLOCK_ROWS)), -(-count // LARGEST_BLOCK))


def _nearest_clusters(now: DataFrame, count: int) -> DataFrame:
    """The cluster that each one would join at the least cost: id, d, other.

    Each cluster is sent to each of the blocks once. These are ``WARD_BLOCKS`` as long as none is larger than ``LARGEST_BLOCK``, so what is
    shuffled grows with the number of clusters; a task compares its two blocks in tiles of ``TILE_ROWS``.
    """
    blocks = _ward_blocks(count)
    own = now.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = own.withColumn("q", F.explode(F.sequence("p", F.lit(blocks - 1))))
    given = own.withColumnRenamed("p", "q").withColumn("p", F.explode(F.sequence(F.lit(0), "q")))
    step = min(BLOCK_ROWS, TILE_ROWS)

    def better(best: tuple[np.ndarray, np.ndarray], at: int, d: np.ndarray, others: np.ndarray, axis: int) -> None:
        least = d.min(axis)
        rows = np.flatnonzero(least < best[0][at : at + len(least)])
        # ids ascend, and so do tiles: the smallest of equal ones, which also makes the smallest pair
        near = (d[rows] if axis else d[:, rows]).argmin(axis)
        best[0][at + rows], best[1][at + rows] = least[rows], others[near]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "d": [], "other": []}).astype({"id": "int64", "d": "float64", "other": "int64"})
        same = a["p"].iloc[0] == a["q"].iloc[0]
        a, b = a.sort_values("id"), b.sort_values("id")
        (i, n, c), (j, m, e) = ((x["id"].to_numpy(), x["n"].to_numpy(dtype=float), np.stack(x["c"].to_numpy())) for x in (a, b))
        of_a = (np.full(len(i), np.inf), np.zeros(len(i), dtype="int64"))
        of_b = of_a if same else (np.full(len(j), np.inf), np.zeros(len(j), dtype="int64"))
        for s in range(0, len(i), step):
            for t in range(s if same else 0, len(j), step):
                # each pair's cost is computed once, so that both ends see the same
                d = _cost(n[s : s + step], c[s : s + step], m[t : t + step], e[t : t + step])
                if same and s == t:
                    d = np.minimum(d, d.T)
                    np.fill_diagonal(d, np.inf)
                else:
                    better(of_b, t, d, i[s : s + step], 0)
                better(of_a, s, d, j[t : t + step], 1)
        found = [pd.DataFrame({"id": k, "d": d, "other": o})[np.isfinite(d)] for k, (d, o) in ([(i, of_a)] if same else [(i, of_a), (j, of_b)])]
        return pd.concat(found)

    met = asked.groupBy("p", "q").cogroup(given.groupBy("p", "q")).applyInPandas(compare, "id long, d double, other long")
    return met.groupBy("id").agg(F.min(F.struct("d", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).alias("m")).select("id", "m.*")


class _Least:
    """Others at the least costs of each row: those up to its ``bound``, which falls to the ``keep``-th least cost where ``keep`` is given."""

    def __init__(self, bound: np.ndarray, keep: int | None, limit: int):
        self.bound, self.keep, self.limit = bound, keep, limit
        self.held, self.rows, self.others, self.costs = 0, [], [], []

    def add(self, at: int, other: int, d: np.ndarray, factor: float, axis: int) -> None:
        """Costs ``d`` times ``factor`` of the rows from ``at`` on (``axis`` 1: down the tile) with the others from ``other`` on."""
        bound = self.bound[at : at + d.shape[1 - axis]]
        if self.keep and d.shape[axis] > self.keep and np.isinf(bound).any():
            kth = np.partition(d, self.keep - 1, axis=axis).take(self.keep - 1, axis=axis)
            np.minimum(bound, kth * factor * (1 + 1e-14), out=bound)
        most = (bound / factor).astype(d.dtype)
        found = np.flatnonzero(d <= (most[:, None] if axis else most))
        if len(found):
            row, col = np.divmod(found, d.shape[1])
            self.costs.append(d.ravel()[found] * factor)
            self.rows.append((row if axis else col) + at)
            self.others.append((col if axis else row) + other)
            self.held += len(found)
            if self.keep and self.held > self.limit:
                self.settled()
                self.limit = max(self.limit, 2 * self.held)

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        row, other, cost = (np.concatenate(x) if x else np.zeros(0, dtype="int64") for x in (self.rows, self.others, self.costs))
        if self.keep:
            order = np.lexsort((cost, row))
            row, other, cost = row[order], other[order], cost[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == self.keep - 1
            self.bound[row[last]] = np.minimum(self.bound[row[last]], cost[last] * (1 + 1e-14))
            row, other, cost = (x[rank < self.keep] for x in (row, other, cost))
        self.held, self.rows, self.others, self.costs = len(row), [row], [other], [cost]
        return row, other


def _told(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Costs between new clusters ``a`` and clusters ``b``: id, other, d.

    A new cluster is told its ``keep`` nearest of the others, and, as its own other, the cost below which there is none but these. Others are told
    the same if both sides are new and meet here only (``once``), else the new ones that aren't dearer than their ``beyond``. Costs of those that
    are told are exact; others are ruled out by products in single precision, or double if ``wide``, with their error allowed for.
    """
    if not len(a) or not len(b):
        return pd.DataFrame({"id": [], "other": [], "d": []}).astype({"id": "int64", "other": "int64", "d": "float64"})
    once, keep = bool(a["once"].iloc[0]), int(a["keep"].iloc[0])
    once = once and a["p"].iloc[0] != a["q"].iloc[0]
    a, b = a.sort_values(["n", "id"]), b.sort_values(["n", "id"])
    (i, n, c), (j, m, e) = ((x["id"].to_numpy(), x["n"].to_numpy(dtype=float), np.stack(x["c"].to_numpy())) for x in (a, b))
    mid = e.mean(0)
    x, y = c - mid, e - mid
    most = max((x * x).sum(1).max(), (y * y).sum(1).max())
    kind = np.float64 if a["wide"].iloc[0] or not 1e-20 < most < 1e30 else np.float32
    over, under = _slack(n, x, y, kind), _slack(m, y, x, kind)
    left = np.column_stack([-2 * x, (x * x).sum(1), np.ones(len(x))]).astype(kind)
    right = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), (y * y).sum(1)]).T.astype(kind))
    own = pd.Series(np.arange(len(j)), index=j).reindex(i).to_numpy()  # where a new cluster is itself among the others
    step, wide = min(BLOCK_ROWS, TILE_ROWS), BLOCK_ROWS
    of_b = _Least(np.full(len(j), np.inf), keep, 8 * keep * len(j)) if once else _Least(np.where(b["fresh"], -np.inf, b["beyond"] + under), None, 0)
    found, bound = [], np.full(len(i), np.inf)
    for s in range(0, len(i), step):
        k = n[s : s + step]
        of_a = _Least(bound[s : s + step], keep, 3 * keep * step)
        for t in range(0, len(j), wide):
            d, o, factor = left[s : s + step] @ right[:, t : t + wide], m[t : t + wide], 1.0
            if k[0] == k[-1] and o[0] == o[-1]:  # they are in order of size
                factor = k[0] * o[0] / (k[0] + o[0])
            else:
                d *= (np.multiply.outer(k, o) / np.add.outer(k, o)).astype(kind)
            if not once:
                same = np.flatnonzero((own[s : s + step] >= t) & (own[s : s + step] < t + wide))
                d[same, (own[s + same] - t).astype("int64")] = np.nan
            of_a.add(0, t, d, factor, 1)
            of_b.add(t, s, d, factor, 0)
        row, other = of_a.settled()
        found.append((row + s, other))
    row, other = (np.concatenate(z) for z in zip(*found))
    out = [(i[row], j[other], _exact(n, c, m, e, row, other)), (i, i, bound - over)]
    row, other = of_b.settled()
    out.append((j[row], i[other], _exact(m, e, n, c, row, other)))
    if once:
        out.append((j, j, of_b.bound - under))
    return pd.DataFrame(dict(zip(("id", "other", "d"), (np.concatenate(z) for z in zip(*out)))))


def _searched(now: DataFrame, count: int, fresh: int, wide: bool = False) -> DataFrame:
    """What new clusters of ``now`` (``fresh``), and others about these, are told by ``_told``. Each cluster is sent to a fixed number of blocks."""
    if fresh == count:  # each pair is compared once
        blocks = _ward_blocks(count)
        own = now.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("once", F.lit(True))
        a, b = own.withColumn("q", F.explode(F.sequence("p", F.lit(blocks - 1)))), own.withColumnRenamed("p", "q").withColumn("p", F.explode(F.sequence(F.lit(0), "q")))
        tasks = blocks * (blocks + 1) // 2
    else:
        blocks, few = _ward_blocks(count), max(min(NEW_BLOCKS, -(-fresh // BLOCK_ROWS)), -(-fresh // LARGEST_BLOCK))
        new = now.where("fresh").withColumn("p", F.pmod(F.xxhash64("id"), F.lit(few)).cast("int")).withColumn("once", F.lit(False))
        a = new.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        b = now.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(few - 1))))
        tasks = blocks * few
    a = a.withColumn("wide", F.lit(wide)).withColumn("keep", F.lit(-(-LISTED // blocks) + 2))  # of each block, so that the nearest of all blocks are some more than these
    a, b = (x.repartition(2 * tasks, "p", "q") for x in (a.select("p", "q", "id", "n", "c", "once", "keep", "wide"), b.select("p", "q", "id", "n", "c", "fresh", "beyond")))
    return a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInPandas(_told, "id long, other long, d double")


def _listed(told: DataFrame) -> DataFrame:
    """The nearest clusters of each one as far as they are known: ``l``, in order of cost, ``beyond``, which no other one is below, and
    whether the first of these is the nearest of all for ``certain``."""
    pair = pa.struct([("d", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])

    def listed(one: np.ndarray, other: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(one, return_inverse=True)
        beyond, limit = np.full(len(ids), np.inf), one == other
        np.minimum.at(beyond, at[limit], d[limit])
        at, one, other, d = (x[~limit] for x in (at, one, other, d))
        a, b = np.minimum(one, other), np.maximum(one, other)
        order = np.lexsort((b, a, d, at))
        at, a, b, d = (x[order] for x in (at, a, b, d))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at, a, b, d = (x[new] for x in (at, a, b, d))
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        np.minimum.at(beyond, at[rank == LISTED], d[rank == LISTED])
        keep = (rank < LISTED) & (d < beyond[at])
        size = np.bincount(at[keep], minlength=len(ids))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype("int32"))
        items = pa.StructArray.from_arrays([pa.array(d[keep]), pa.array(a[keep]), pa.array(b[keep])], fields=list(pair))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, items), pa.array(beyond), pa.array(size > 0)], ["id", "l", "beyond", "certain"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, dtype=x) for x in ("int64", "int64", "float64"))
        for batch in batches:
            held = tuple(np.concatenate([x, y.to_numpy()]) for x, y in zip(held, batch.columns, strict=True))
            cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last id may go on
            if cut:
                yield listed(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if len(held[0]):
            yield listed(*held)

    return told.repartition("id").sortWithinPartitions("id").mapInArrow(lists, "id long, l array<struct<d:double,a:long,b:long>>, beyond double, certain boolean")


def ward_merges(df: DataFrame, vector: str, id_col: str, few: int | None = None) -> DataFrame:
    """The n-1 merges of Ward's agglomeration: a < b (smallest ids of both clusters), d (growth of the sum of squares).

    Ward's cost is reducible, so clusters that are each other's nearest join in the end whatever else does: each round joins all such
    pairs. For the same reason a cluster's nearest stays what it is until it joins another, and no cluster made since is nearer than the nearer of its halves
    was. So each cluster keeps a list of its nearest, all pairs are compared once in the first round, and later rounds compare only the new clusters, and the few whose
    list is used up, with all. Where most lists don't tell the nearest (many equal costs), or no pair is found, costs are computed in double precision from there on; if that doesn't
    help, a round compares all pairs. Blocks are
    of a fixed number, no pairs are emitted but those in lists, and a round writes its clusters. Equal vectors join
    first, at no cost; ``few`` clusters (by default as many as have ``FINISHED_VALUES``) are finished in one task, with the same merges. Costs are those of exact arithmetic up to
    rounding; ties go to the pair of smallest ids. Work grows with the square of the number of different vectors.
    """
    spark, base = df.sparkSession, shared_dir(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("c")).where("id is not null and c is not null").where(~F.exists("c", lambda x: x.isNull() | F.isnan(x)))
    copies = rows.join(rows.groupBy("c").agg(F.min("id").alias("a")), "c").where("a <> id").select("a", F.col("id").alias("b"), F.lit(0.0).alias("d"))
    merges = written(copies, "merges0", base)
    start = rows.groupBy("c").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n"))
    now = written(start.select("id", "n", "c", F.lit(True).alias("fresh"), F.lit(0.0).alias("beyond")), "round0", base)
    if few is None:
        one = now.select(F.size("c").alias("n")).first()
        few = max(BLOCK_ROWS, FINISHED_VALUES // max(one.n, 1)) if one else 1
    k, kept, wide = 0, None, False
    count = fresh = now.count()
    before = ["round0"]  # tables that are not needed once the next round is written
    while count > max(few, 1):
        k += 1
        told = _searched(now, count, fresh, wide)
        lists = written(_listed(told if kept is None else told.unionByName(kept)), f"lists{k}", base)
        near = lists.where("certain").select("id", F.col("l")[0].alias("m")).select("id", "m.*")
        pairs = written(_mutual(near), f"merges{k}", base)
        joins = pairs.count()
        few_known = not joins or 20 * joins < count and 2 * near.count() < count
        if few_known and not wide:  # costs differ by less than single precision tells
            wide, fresh, kept, now = True, count, None, now.withColumn("fresh", F.lit(True))
            before.append(f"lists{k}")
            continue
        if few_known:
            near = written(_nearest_clusters(now, count), f"near{k}", base)
            pairs = written(_mutual(near), f"merges{k}all", base)
        merges = merges.unionByName(pairs)
        to = now.join(pairs.select(F.col("b").alias("id"), "a"), "id", "left").select(F.coalesce("a", "id").alias("id"), "n", "c")
        one, two = F.col("x")[0], F.get("x", F.lit(1))  # a cluster that stays is alone
        mean = F.zip_with(one["c"], two["c"], lambda x, y: (one["n"] * x + two["n"] * y) / (one["n"] + two["n"]))
        joined = to.groupBy("id").agg(F.collect_list(F.struct("n", "c")).alias("x"))
        joined = joined.select("id", F.when(two.isNull(), one["n"]).otherwise(one["n"] + two["n"]).alias("n"), F.when(two.isNull(), one["c"]).otherwise(mean).alias("c"), two.isNotNull().alias("new"))
        joined = joined.join(lists.select("id", "certain", "beyond"), "id").select("id", "n", "c", (F.col("new") | ~F.col("certain")).alias("fresh"), "beyond")
        now = written(joined, f"round{k}", base)
        for name in before:
            removed(spark, f"{base}/{name}")
        before = [f"round{k}", f"lists{k}", f"near{k}"]
        r = now.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fresh"), 1)).alias("fresh")).first()
        count, fresh = r["n"], r["fresh"]
        if 2 * fresh > count:  # comparing all pairs once costs no more
            fresh, kept, now = count, None, now.withColumn("fresh", F.lit(True))
            continue
        old = now.where("not fresh")
        gone = pairs.select(F.explode(F.array("a", "b")).alias("other"))
        entries = lists.join(old.select("id"), "id").select("id", F.explode("l").alias("x"), F.col("x.d").alias("d"))
        entries = entries.select("id", F.when(F.col("x.a") == F.col("id"), F.col("x.b")).otherwise(F.col("x.a")).alias("other"), "d").join(gone, "other", "left_anti")
        kept = entries.select("id", "other", "d").unionByName(old.select("id", F.col("id").alias("other"), F.col("beyond").alias("d")))
    rest = written(now.select("id", "n", "c").groupBy().applyInPandas(_finish, "a long, b long, d double"), "rest", base)  # at most `few` rows
    return merges.unionByName(rest)


def _mutual(near: DataFrame) -> DataFrame:
    """Pairs of clusters that are each other's nearest."""
    return near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d")).where("n = 2").select("a", "b", "d")


def agglomerate(df: DataFrame, vector: str, id_col: str, clusters: int | None = None, few: int | None = None) -> DataFrame:
    """Ward clusters: ``id_col`` and ``cluster`` (its smallest id); ``clusters`` of them, a fifth of the rows but two at least if not given.

    The cheapest n - ``clusters`` merges are taken; of equally dear ones those of the smallest ids. Rows without a vector, or with a
    component missing, are left out.
    """
    whole = ~F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x))
    nodes = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & whole).select(F.col(id_col).cast("long").alias("node"))
    n = nodes.count()
    take = n - min(n, clusters or max(2, n // 5))
    # ranks over sorted ranges: no task holds all merges
    spread = written(ward_merges(df, vector, id_col, few).repartitionByRange("d", "a", "b").withColumn("part", F.spark_partition_id()), "merges")
    before = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("d", "a", "b")) + F.col("before")
    chosen = spread.join(F.broadcast(before), "part").withColumn("rank", rank).where(F.col("rank") <= take)
    comp = connected_components(chosen, "a", "b")
    return nodes.join(comp, "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("cluster"))
