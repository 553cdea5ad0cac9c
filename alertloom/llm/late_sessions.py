"""Session versions of events that arrive late, batch by batch, from the final sessions backwards.

Method: reverse deletion. Final sessions are runs of a doubly linked list of events in time; batches are removed in descending
order, a removed event unlinks itself, and where the gap around it has become too wide its session splits. Read forwards, each
split is a creation, an extension or a merge, and sums run from the parts of a split up to the whole.

Lists are cut into pieces of one user and ``piece_s`` seconds, each with the neighbours' events within a gap of its borders, so a user
with a third of all events is the work of many tasks. What happens inside a piece is final. A version that runs over a border is
known from parts, one for each piece that it changed; what lies further left and right of a part is looked up in rounds,
through pieces and through blocks of 2, 4, 8... pieces that a session runs through as a whole. Rounds grow with the logarithm of
the longest session.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import lean, pick, shared_dir, sorted_groups, written

GAP = 420
PIECE_S = 3600
#: Rows of a block of pieces at most; others are walked through in halves.
BLOCK_CHANGES = 4096

_VERSION, _PART, _END = 0, 1, 2
_FIELDS = ("kind", "user", "piece", "batch", "start_s", "open_left", "end_s", "open_right", "n", "h", "n_new", "n_before", "next_batch", "next_start_s", "next_open", "until_left", "until_right")
_OUT = ", ".join(f"{c} {'boolean' if 'open' in c else 'int' if c == 'kind' else 'long'}" for c in _FIELDS)


def piece_versions(t: list[int], batch: list[int], n: list[int], h: list[int], lo: int, hi: int, gap: int) -> list[tuple]:
    """Rows of ``_FIELDS`` from ``batch`` on, with their kind in front, of one piece: events [lo, hi) of a list in order of time, whose other events are
    the neighbours'.

    A version inside the piece is a row of its own, with the batch and start of the one that retracts it (``next_open``: that one starts
    left of the piece). A version over a border is a part: what of it is inside, and until when that stays. The last part that begins
    at a start tells (as a row ``_END``) when this start goes.
    """
    size = len(t)
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    first, last, made_by = {}, {}, {}  # of the standing sessions, by head: an event at or before their first
    heads: list[int] = []
    for i in range(size):
        if i == 0 or t[i] - t[i - 1] > gap:
            heads.append(i)
            first[i], made_by[i] = i, -1
        last[heads[-1]] = i
    inner_first, inner_last = lo, hi - 1  # of the events left inside
    by_batch: dict[int, list[int]] = {}
    for i in range(size):
        by_batch.setdefault(batch[i], []).append(i)
    versions: list[list] = []  # of the versions, latest first: batch, retracted by, start, open left, end, open right, n, h, new, children
    for b in sorted(by_batch, reverse=True):
        touched: dict[int, list[int]] = {}
        for i in by_batch[b]:
            touched.setdefault(heads[bisect.bisect_right(heads, i) - 1], []).append(i)
        for head, gone in touched.items():
            a, z = first[head], last[head]
            start, stop = (inner_first, True) if a < lo else (a, False), (inner_last, True) if z >= hi else (z, False)
            inside = start[0] <= min(stop[0], hi - 1) and stop[0] >= lo
            mine = [i for i in gone if lo <= i < hi]
            me = len(versions)
            new_n, new_h = sum(n[i] for i in mine), sum(h[i] for i in mine)
            versions.append([b, made_by[head], t[start[0]] if inside else None, start[1], t[stop[0]] if inside else None, stop[1], new_n, new_h, new_n, 0])
            parts, at = [head], head
            for i in gone:
                p, q = before[i], after[i]
                if p >= 0:
                    after[p] = q
                if q < size:
                    before[q] = p
                if i == inner_first:
                    inner_first = q
                if i == inner_last:
                    inner_last = p
                at = parts[-1]
                if first[at] == i and last[at] == i:
                    first[at] = size  # nothing left
                elif first[at] == i:
                    first[at] = q
                elif last[at] == i:
                    last[at] = p
                elif t[q] - t[p] > gap:
                    first[q], last[q] = q, last[at]
                    last[at] = p
                    parts.append(q)
            keep = [x for x in parts if first[x] < size]
            k = bisect.bisect_left(heads, head)
            heads[k : k + 1] = keep
            for x in keep:
                made_by[x] = me
                if lo <= first[x] < hi:
                    versions[me][9] += 1
    for v in reversed(versions):
        if v[1] >= 0:
            versions[v[1]][6] += v[6]
            versions[v[1]][7] += v[7]
    rows = []
    until = {3: None, 5: None}
    for b, up, start, left, end, right, count, total, new, children in versions:
        if start is None:
            continue
        over = versions[up] if up >= 0 else None
        nxt = (over[0], None if over[3] else over[2], over[3]) if over else (None, None, False)
        if not left and not right:
            rows.append((_VERSION, b, start, False, end, False, count, total, new, children, *nxt, None, None))
            continue
        rows.append((_PART, b, start, left, end, right, count, total, new, children, None, None, False, until[3] if left else None, until[5] if right else None))
        if left:
            until[3] = b
        if right:
            until[5] = b
        if not left and over and (over[3] or over[2] != start):
            rows.append((_END, b, start, False, end, True, 0, 0, 0, 0, *nxt, None, None))
    return rows


def _pieces(nodes: DataFrame, gap: int, piece_s: int) -> DataFrame:
    """What reverse deletion finds in each piece (``_FIELDS``)."""
    own, at = F.floor(F.col("time") / piece_s), F.pmod("time", F.lit(piece_s))
    where = F.array_compact(F.array(own, F.when(at <= gap, own - 1), F.when(at >= piece_s - gap, own + 1)))
    dealt = nodes.select("user", F.explode(where).alias("piece"), own.alias("own"), "time", "batch", "n", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in sorted_groups(batches, 2):
            own = group.column(2).to_numpy()
            user, piece = group.column(0)[0].as_py(), group.column(1)[0].as_py()
            lo, hi = np.searchsorted(own, piece), np.searchsorted(own, piece, side="right")
            if lo < hi:
                t, b, n, h = (group.column(i).to_pylist() for i in range(3, 7))
                out += [(r[0], user, piece, *r[1:]) for r in piece_versions(t, b, n, h, int(lo), int(hi), gap)]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return dealt.repartition("user", "piece").sortWithinPartitions("user", "piece", "own", "time", "batch").mapInArrow(lean(run), _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.bool_() if "open" in c else pa.int32() if c == "kind" else pa.int64() for c in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(_FIELDS))


def _levels(parts: DataFrame, under: str) -> tuple[DataFrame, int]:
    """Blocks of 2**level pieces, level 1 and up, with what a session that runs through all of them has there from batch ``settled`` until batch
    ``until``. Once a session runs through a piece it always does, so a block's rows are merged from those of its halves in order of
    batch; blocks that change more than ``BLOCK_CHANGES`` times are left to their halves."""
    level = written(parts.where("open_left and open_right").select("user", F.col("piece").alias("block"), F.col("batch").alias("settled"), F.least("until_left", "until_right").alias("until"), "n", "h"), "level0", under)
    found, k = level.where("false").withColumn("level", F.lit(0)), 0
    while not level.isEmpty():
        k += 1
        pair = Window.partitionBy("user", "block").orderBy("settled")
        half = level.select("user", F.expr("shiftright(block, 1)").alias("block"), F.pmod("block", F.lit(2)).alias("half"), "settled", "n", "h")
        half = half.withColumn("size", F.count("*").over(Window.partitionBy("user", "block"))).where(F.col("size") <= BLOCK_CHANGES)
        both = half.select("user", "block", "settled", *[F.last(F.when(F.col("half") == i, F.col(c)), True).over(pair).alias(f"{c}{i}") for i in (0, 1) for c in ("n", "h")])
        both = both.where("n0 is not null and n1 is not null").groupBy("user", "block", "settled").agg(F.max(F.expr("n0 + n1")).alias("n"), F.max(F.expr("h0 + h1")).alias("h"))
        level = written(both.withColumn("until", F.lead("settled").over(pair)).select("user", "block", "settled", "until", "n", "h"), f"level{k}", under)
        found = found.unionAll(level.withColumn("level", F.lit(k)))
    return found, max(0, k - 1)


def _walk(asked: DataFrame, parts: DataFrame, under: str) -> DataFrame:
    """For each (right, user, piece, batch): where the session that goes on over the piece's left (right) border ends at that batch, and
    its counts beyond. A round goes one block further, the largest that starts there and that the session runs through."""
    blocks, top = _levels(parts, under)
    steps = None
    for right, side, on, until, bound in ((False, "open_right", "open_left", "until_right", "start_s"), (True, "open_left", "open_right", "until_left", "end_s")):
        own = parts.where(side).select(F.lit(right).alias("right"), "user", F.lit(0).alias("level"), F.col("piece").alias("block"), F.col("batch").alias("settled"), F.col(until).alias("until"), F.col(on).alias("on"), F.col(bound).alias("bound"), "n", "h")
        own = own.unionAll(blocks.select(F.lit(right), "user", "level", "block", "settled", "until", F.lit(True), F.lit(None).cast("long"), "n", "h"))
        steps = own if steps is None else steps.unionAll(own)
    zero = F.lit(0).cast("long")
    todo = asked.select("right", "user", "piece", "batch", (F.col("piece") + F.col("right").cast("long")).alias("at"), zero.alias("n"), zero.alias("h"))
    done, k, left = todo.where("false").select("right", "user", "piece", "batch", zero.alias("bound"), "n", "h"), 0, todo.count()
    while left:
        tried = todo.withColumn("level", F.explode(F.expr(f"filter(sequence(0, {top}), x -> pmod(at, shiftleft(1L, x)) = 0)"))).withColumn("block", F.expr("shiftright(at, level) - if(right, 0, 1)"))
        met = tried.alias("a").join(steps.alias("s"), ["right", "user", "level", "block"]).where("a.batch >= s.settled and (s.until is null or a.batch < s.until)")
        best = met.groupBy("right", "user", "piece", "batch", "at", F.col("a.n").alias("n"), F.col("a.h").alias("h")).agg(F.max(F.struct("level", "s.on", "s.bound", F.col("s.n").alias("n"), F.col("s.h").alias("h"))).alias("s"))
        went = best.select("right", "user", "piece", "batch", F.expr("at + if(right, 1, -1) * shiftleft(1L, s.level)").alias("at"), (F.col("n") + F.col("s.n")).alias("n"), (F.col("h") + F.col("s.h")).alias("h"), F.col("s.on").alias("on"), F.col("s.bound").alias("bound"))
        table = written(went, f"round{k}", under)
        met_all, still = table.agg(F.count("*"), F.count_if("on")).first()
        if met_all != left:
            raise RuntimeError("a session goes on over a border where no piece continues it")
        done = done.unionAll(table.where("not on").select("right", "user", "piece", "batch", "bound", "n", "h"))
        todo, left, k = table.where("on").select("right", "user", "piece", "batch", "at", "n", "h"), still, k + 1
    return done


def _next_batch(rows: DataFrame) -> DataFrame:
    """``after``: the next batch of the same (user, start_s). Batches are looked through in blocks of 4,096, these in blocks of 4,096
    and so on, so a session with ever so many versions is no single window."""
    def lead(df: DataFrame, col: str, bits: int) -> Column:
        return F.lead(col).over(Window.partitionBy("user", "start_s", F.expr(f"shiftright(batch, {bits})")).orderBy("batch"))

    def upper(df: DataFrame, bits: int) -> DataFrame:
        return df.groupBy("user", "start_s", F.expr(f"shiftright(batch, {bits})").alias(f"b{bits}")).agg(F.min("batch").alias("batch"))

    b12 = upper(rows, 12)
    b24 = upper(b12, 24)
    b24 = b24.withColumn("n24", F.lead("batch").over(Window.partitionBy("user", "start_s").orderBy("batch"))).drop("batch")
    b12 = b12.withColumn("n12", lead(b12, "batch", 24)).withColumn("b24", F.expr("shiftright(batch, 24)")).drop("batch").join(b24, ["user", "start_s", "b24"])
    out = rows.withColumn("n0", lead(rows, "batch", 12)).withColumn("b12", F.expr("shiftright(batch, 12)"))
    return out.join(b12.select("user", "start_s", "b12", F.coalesce("n12", "n24").alias("_up")), ["user", "start_s", "b12"]).withColumn("after", F.coalesce("n0", "_up")).drop("n0", "b12", "_up")


def session_versions(events: DataFrame, gap: int = GAP, piece_s: int = PIECE_S) -> DataFrame:
    """Every version of every session of ``events`` (user, time in seconds, batch, h: a number to sum), one row each: user, batch, start_s,
    end_s, n_events, n_new, n_retracted (0 creation, 1 extension, more merge), h_sum, retracted_batch, retracted_start_s.

    After each batch, ascending, a user's events so far form sessions, neighbours at most ``gap`` seconds apart in one. Events with a null
    user, time or batch are in no session, a null h counts 0; events at the same time and repeated rows count each; an empty table
    gives none; other columns are ignored. ``piece_s`` (more than ``gap``) only says how the work is cut.
    """
    if piece_s <= gap:
        raise ValueError("piece_s must be more than gap")
    src = pick(events, user="user", time="time", batch="batch", h="h").where("user is not null and time is not null and batch is not null")
    nodes = src.select(*[F.col(c).cast("long").alias(c) for c in ("user", "time", "batch", "h")]).groupBy("user", "time", "batch").agg(F.count("*").alias("n"), F.sum(F.coalesce("h", F.lit(0))).alias("h"))
    spark, under = events.sparkSession, shared_dir(events.sparkSession)
    found = written(_pieces(nodes, gap, piece_s), "pieces", under)
    inside, parts, ends = (found.where(F.col("kind") == k) for k in (_VERSION, _PART, _END))
    asked = parts.where("open_left").select(F.lit(False).alias("right"), "user", "piece", "batch").unionAll(found.where("next_open").select(F.lit(False), "user", "piece", "next_batch")).distinct()
    beyond = _walk(asked.unionAll(parts.where("open_right").select(F.lit(True), "user", "piece", "batch")), parts, under)
    lefts, rights = (beyond.where(F.col("right") == r).select("user", "piece", "batch", F.col("bound").alias(name), F.col("n").alias(f"{x}_n"), F.col("h").alias(f"{x}_h")) for r, x, name in ((False, "l", "l_start"), (True, "r", "r_end")))
    key = ["user", "piece", "batch"]
    seen = parts.join(lefts, key, "left").join(rights, key, "left").select(
        "user", "batch", F.when(F.col("open_left"), F.col("l_start")).otherwise(F.col("start_s")).alias("start_s"), F.when(F.col("open_right"), F.col("r_end")).otherwise(F.col("end_s")).alias("end_s"), "open_left", "n_new", "n_before",
        *[(F.col(c) + F.when(F.col("open_left"), F.col(f"l_{c}")).otherwise(0) + F.when(F.col("open_right"), F.col(f"r_{c}")).otherwise(0)).alias(c) for c in ("n", "h")],
    )
    over = seen.groupBy("user", "batch", "start_s").agg(
        F.max("end_s").alias("end_s"), F.max("n").alias("n"), F.sum("n_new").alias("n_new"), (F.sum("n_before") + F.bool_and("open_left").cast("int")).alias("n_retracted"), F.max("h").alias("h")
    )  # where all changed parts go on leftwards, the session that begins there stood before
    over = written(over, "over", under)
    gone = ends.join(lefts.withColumnRenamed("batch", "next_batch"), ["user", "piece", "next_batch"], "left").select("user", "start_s", F.col("next_batch").alias("gone_batch"), F.when(F.col("next_open"), F.col("l_start")).otherwise(F.col("next_start_s")).alias("gone_start"))
    over = _next_batch(over).join(gone, ["user", "start_s"], "left")
    after = F.col("after").isNotNull()
    names = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]
    outer = over.select("user", "batch", "start_s", "end_s", "n", "n_new", F.col("n_retracted").cast("long"), "h", F.coalesce("after", "gone_batch"), F.when(after, F.col("start_s")).otherwise(F.col("gone_start")))
    near = inside.join(lefts.withColumnRenamed("batch", "next_batch"), ["user", "piece", "next_batch"], "left")
    inner = near.select("user", "batch", "start_s", "end_s", "n", "n_new", "n_before", "h", "next_batch", F.when(F.col("next_open"), F.col("l_start")).otherwise(F.col("next_start_s")))
    return outer.toDF(*names).unionAll(inner.toDF(*names))


def turn_events(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with a turn as events (user, time, batch, h): user, time and lateness are drawn from hashes of conv_id and
    turn. A null conv_id has no user, so its rows are in no session."""
    src = pick(conversations, conv_id="conv_id", turn="turn").where("turn is not null")
    c, h = F.crc32(F.col("conv_id").cast("string")), F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    e = src.select("conv_id", "turn", c.alias("c"), h.alias("h")).withColumn("g", F.expr("h div 600"))
    e = e.select((2 * F.floor(F.col("conv_id") / 8) + F.col("c") % 2).alias("user"), F.expr("(c div 2) % 7200 + 300 * turn + h % 600").alias("time"), "g", "h")
    return e.select("user", "time", (F.floor(F.col("time") / 3600) + F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)).alias("batch"), "h")
