"""Chains, segments, sessions, dormant gaps, windows and campaigns over time-ordered alerts, per entity.

All of these are partitioned by an entity. A rule that looks back at the head of its own chain or window, which no fixed frame
expresses, is folded in blocks, whose heads are found by pointers from block to block (``chains.chains``, ``anchored_windows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.plans.stage import written

#: Names of stages.
CRITICAL_STAGES = ("Initial Access", "Persistence", "Lateral Movement", "Exfiltration")
EARLY, MIDDLE, LATE = ("Reconnaissance", "Initial Access"), ("Execution", "Persistence", "Discovery"), ("Lateral Movement", "Exfiltration", "Impact")

#: Rows of a block of an entity's time that one task holds, about.
BLOCK_ROWS = 50_000


def _order(by: list[str], time: str, id_col: str):
    return Window.partitionBy(*by).orderBy(time, id_col)


def _gap(time: str, w) -> Column:
    return (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6


def segments(df: DataFrame, by: list[str], gap_s: float, time: str = "EndDate", id_col: str = "alert_idx", name: str = "segment") -> DataFrame:
    """``df`` with a number from 0 for each run of rows of an entity without a gap of more than ``gap_s`` seconds."""
    w = _order(by, time, id_col)
    return df.withColumn("_new", F.when(_gap(time, w) > gap_s, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w)).drop("_new")


def dormant_periods(df: DataFrame, by: list[str], gap_s: float, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """(previous, next) times of an entity more than ``gap_s`` apart."""
    w = _order(by, time, id_col)
    return df.select(*by, id_col, F.lag(time).over(w).alias("quiet_from"), F.col(time).alias("quiet_to"), _gap(time, w).alias("seconds")).where(F.col("seconds") > gap_s)


def stage_chain(df: DataFrame, by: list[str], tactic: str, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Distinct tactics of each entity in order of first appearance."""
    firsts = df.where(F.col(tactic).isNotNull()).groupBy(*by, tactic).agg(F.min(F.struct(time, id_col)).alias("at"))
    chain = F.transform(F.array_sort(F.collect_list(F.struct("at", tactic))), lambda x: x[tactic])
    return firsts.groupBy(*by).agg(F.array_join(chain, ">").alias("chain"), F.count(F.lit(1)).alias("length"))


def chain_summary(df: DataFrame, chain: str = "chain", time: str = "EndDate") -> DataFrame:
    seconds = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6
    out = df.groupBy(chain).agg(F.count(F.lit(1)).alias("events"), seconds.alias("seconds"), F.min(time).alias("chain_start"), F.max(time).alias("chain_end"))
    return out.withColumn("rate", F.col("events") / F.greatest("seconds", F.lit(1.0)))


def significant_chains(summary: DataFrame, events: int = 3, seconds: float = 5.0) -> DataFrame:
    return summary.where((F.col("events") >= events) & (F.col("seconds") >= seconds))


def anchored_windows(df: DataFrame, by: list[str], width_s: float = 300.0, time: str = "EndDate", id_col: str = "alert_idx", block_widths: int | None = None) -> DataFrame:
    """``by``, ``id`` and the first row of its window: a window opens at a row and holds all up to ``width_s`` seconds after it; the next opens at the
    first row behind it. Rows without a time are left out; a null entity is one.

    An entity is cut into blocks of ``block_widths`` windows of time (by default so that the densest holds about ``BLOCK_ROWS`` rows), each with its
    neighbours' nearest rows. A gap of more than a width opens a window
    whatever came before, so most blocks know their windows by themselves. Where a run goes through a whole block, the block tells for each row that its first
    window may open at where the next block's does, and these pointers double until every block of the run knows its own; so the rounds
    grow with the logarithm of the longest run, and an entity with any share of the rows is the work of many tasks.
    """
    width = int(width_s * 1e6)
    rows = df.select(*by, F.col(id_col).cast("long").alias("id"), F.unix_micros(time).alias("us")).where("us is not null")
    dense = rows.groupBy(*by, F.floor(F.col("us") / (256 * width))).agg(F.count("*").alias("n"), F.min("us").alias("low"), F.max("us").alias("high"))
    most, low, high = dense.agg(F.max("n"), F.min("low"), F.max("high")).first()
    low, high = low or 0, high or 0
    span = width * (block_widths or max(4, min(1 << 16, 256 * BLOCK_ROWS // (most or 1))))
    own, at = F.floor((F.col("us") - low) / span), F.pmod(F.col("us") - low, F.lit(span))
    blocks = F.array_compact(F.array(own, F.when(at <= 2 * width, own - 1), F.when(at >= span - width, own + 1)))
    dealt = rows.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    keys, names = [*by, "_block"], ["_block", "entry", "next_entry", "head"]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def parts(table: pa.Table) -> tuple:
        """Rows in order of time: times, ids, where the block's own begin and end, which of them open a run, and each row's next window."""
        block = table.column("_block")[0].as_py()
        table = table.take(pa.array(np.lexsort((table.column("id").to_numpy(), table.column("us").to_numpy()))))
        us, ids, mine = (table.column(c).to_numpy() for c in ("us", "id", "_own"))
        lo, hi = int(np.searchsorted(mine, block)), int(np.searchsorted(mine, block, side="right"))
        start = np.concatenate([[True], us[1:] - us[:-1] > width])
        return table, us, ids, lo, hi, start, np.searchsorted(us, us + width, side="right")

    def orbit(first: np.ndarray, after: np.ndarray, hi: int) -> np.ndarray:
        """All places that pointers reach from the marked ones, by doubling."""
        seen, jump = np.append(first, False), np.append(np.minimum(after, len(after)), len(after))
        while True:
            new = seen.copy()
            new[jump[np.flatnonzero(seen)]] = True
            new[len(after)] = False
            jump = jump[jump]
            if (new == seen).all() and (jump >= hi).all():
                return seen[:-1]
            seen = new

    def borders(table: pa.Table) -> pa.Table:
        table, us, ids, lo, hi, start, after = parts(table)
        found = []
        if lo < hi:
            reach = np.arange(len(us))  # of each row the last window of the block if one opens there
            reach[lo:hi] = np.where(after[lo:hi] >= hi, reach[lo:hi], after[lo:hi])
            while (reach[reach] != reach).any():
                reach = reach[reach]
            opened = np.flatnonzero(start[lo:hi]) + lo
            entries = [(None, int(opened[-1]))] if len(opened) else [(int(ids[i]), i) for i in range(lo, hi) if us[i] < us[lo] + 2 * width]
            for name, i in entries:
                last = int(reach[i])
                k = int(after[last])
                goes_on = k < len(us) and not start[k]
                if goes_on or (hi < len(us) and us[hi] <= us[last] + width):
                    found.append((name, int(ids[k]) if goes_on else None, int(ids[last])))
        key = [pa.array([table.column(c)[0].as_py()] * len(found), table.schema.field(c).type) for c in by]
        block = pa.array([table.column("_block")[0].as_py()] * len(found), pa.int64())
        return pa.Table.from_arrays([*key, block, *[pa.array([f[j] for f in found], pa.int64()) for j in range(3)]], [*by, *names])

    key = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"_{i}") for i, c in enumerate(by)]  # compared with nulls
    same = [f"_{i}" for i in range(len(by))]
    if (high - low) // span == 0:  # one block holds all
        edges = df.select(*by, *[F.lit(None).cast("long").alias(c) for c in names]).where(F.lit(False))
    else:
        edges = written(dealt.groupBy(*keys).applyInArrow(borders, f"{kinds}, _block long, entry long, next_entry long, head long"), "borders")
    step = edges.select(*key, *by, (F.col("_block") + 1).alias("_block"), F.col("_block").alias("_from"), "entry", "next_entry", "head")
    reached = step.where("entry is null").select(*same, *by, "_block", F.col("next_entry").alias("entry"), "head")
    jump = step.where("entry is not null").select(*same, "_from", "entry", F.col("_block").alias("_to"), "next_entry", "head")
    while (high - low) // span > 1 and not jump.isEmpty():
        more = reached.alias("r").where("entry is not null").join(jump.alias("j"), [*same, "entry"]).where("r._block = j._from")
        reached = written(reached.unionByName(more.select(*same, *[f"r.{c}" for c in by], F.col("j._to").alias("_block"), F.col("j.next_entry").alias("entry"), F.col("j.head").alias("head"))), "reached")
        ahead = jump.select(*same, F.col("_from").alias("_to"), F.col("entry").alias("next_entry"), F.col("_to").alias("_to2"), F.col("next_entry").alias("next2"), F.col("head").alias("head2"))
        jump = written(jump.drop("head").join(ahead, [*same, "_to", "next_entry"]).select(*same, "_from", "entry", F.col("_to2").alias("_to"), F.col("next2").alias("next_entry"), F.col("head2").alias("head")), "jump")

    def windows(table: pa.Table) -> pa.Table:
        note = table.filter(pc.is_null(table.column("us")))
        table, us, ids, lo, hi, start, after = parts(table.filter(pc.is_valid(table.column("us"))))
        first, before = start.copy(), None
        first[:lo] = first[hi:] = False
        if note.num_rows:
            before = note.column("head")[0].as_py()
            if (entry := note.column("entry")[0].as_py()) is not None:
                first[lo + int(np.flatnonzero(ids[lo:hi] == entry)[0])] = True
        opens = orbit(first, after, hi)
        opens[hi:] = False
        place = np.maximum.accumulate(np.where(opens, np.arange(len(us)), -1))[lo:hi]
        head = np.where(place >= 0, ids[np.maximum(place, 0)], before if before is not None else -1)
        return pa.Table.from_arrays([*[table.column(c).slice(lo, hi - lo) for c in by], pa.array(ids[lo:hi]), pa.array(head.astype(np.int64))], [*by, "id", "window"])

    long = F.lit(None).cast("long")
    known = reached.select(*by, long.alias("id"), long.alias("us"), long.alias("_own"), "_block", "entry", "head")
    both = dealt.withColumn("entry", long).withColumn("head", long).unionByName(known)
    return both.groupBy(*keys).applyInArrow(lambda t: windows(t) if pc.any(pc.equal(t.column("_own"), t.column("_block"))).as_py() else _none(t, by), f"{kinds}, id long, window long")


def _none(table: pa.Table, by: list[str]) -> pa.Table:
    """No rows, of a block that has but its neighbours' ones."""
    none = table.slice(0, 0)
    return pa.Table.from_arrays([*[none.column(c) for c in by], none.column("id"), none.column("id")], [*by, "id", "window"])


def sliding_windows(df: DataFrame, by: list[str], size: int = 256, overlap: int = 32, least: int = 10, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Rows of each window of ``size`` rows, a new one every ``size - overlap`` rows; windows of fewer than ``least`` rows go."""
    step = size - overlap
    r = df.select(*by, id_col, (F.row_number().over(_order(by, time, id_col)) - 1).alias("_r"))
    last, first = F.floor(F.col("_r") / step), F.greatest(F.lit(0), F.floor((F.col("_r") - size) / step) + 1)
    rows = r.select(*by, id_col, F.explode(F.sequence(first, last)).alias("window"))
    n = rows.groupBy(*by, "window").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*by, "window")
    return rows.join(n, [*by, "window"], "left_semi")


def chunks(df: DataFrame, by: list[str], size: int = 30, least: int = 5, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Rows with the number of their chunk of ``size`` consecutive rows; smaller rests of fewer than ``least`` rows go."""
    r = df.select(*by, id_col, F.floor((F.row_number().over(_order(by, time, id_col)) - 1) / size).alias("chunk"))
    return r.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "chunk"))).where(F.col("_n") >= least).drop("_n")


def near_edges(df: DataFrame, by: list[str], width_s: float = 3600.0, most: int = 99, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Each row to the next ``most`` rows of its entity that lie within ``width_s`` seconds."""
    w = _order(by, time, id_col)
    ahead = F.collect_list(F.struct(F.col(id_col).alias("dst"), F.unix_micros(time).alias("us"))).over(w.rowsBetween(1, most))
    rows = df.select(F.col(id_col).alias("src"), F.unix_micros(time).alias("us0"), ahead.alias("ahead"))
    rows = rows.select("src", "us0", F.explode("ahead").alias("x"))
    return rows.where(F.col("x.us") - F.col("us0") <= width_s * 1e6).select("src", F.col("x.dst").alias("dst"))


def next_edges(df: DataFrame, by: list[str], hops: int = 1, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Each row to the next 1 to ``hops`` rows of its entity."""
    w = _order(by, time, id_col)
    ahead = F.array(*[F.lead(id_col, k).over(w) for k in range(1, hops + 1)])
    rows = df.select(F.col(id_col).alias("src"), ahead.alias("ahead"))
    return rows.select("src", F.explode("ahead").alias("dst")).where("dst is not null")


def segment_summary(df: DataFrame, by: list[str], tactic: str, least: int = 2, segment: str = "segment", time: str = "EndDate") -> DataFrame:
    """Rows, times, distinct and dominant tactic (smallest on ties) of segments of at least ``least`` rows."""
    return df.groupBy(*by, segment).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.countDistinct(tactic).alias("n_tactics"), F.expr(f"mode() WITHIN GROUP (ORDER BY {tactic})").alias("dominant")
    ).where(F.col("n") >= least)


def campaign_confidence(n_segments: Column, chain: Column) -> Column:
    """From the number of segments, the chain's length, its critical stages, and whether it has early, middle and late ones."""
    has = lambda names: F.arrays_overlap(chain, F.array(*map(F.lit, names)))
    critical = sum((F.when(F.array_contains(chain, s), 0.1).otherwise(0.0) for s in CRITICAL_STAGES), F.lit(0.0))
    whole = F.when((F.size(chain) >= 3) & has(EARLY) & has(MIDDLE) & has(LATE), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), F.least(n_segments * 0.1, F.lit(0.3)) + F.least(F.size(chain) * 0.05, F.lit(0.3)) + critical + whole)


def campaigns(df: DataFrame, by: list[str], tactic: str, gap_s: float, span_s: float, tactics: int = 3, days: int = 2, least_segments: int = 3, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Entities that persist (``span_s``), show enough tactics on enough days, and have ``least_segments`` segments or more."""
    span = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6
    apt = df.groupBy(*by).agg(span.alias("span"), F.countDistinct(tactic).alias("n_tactics"), F.countDistinct(F.to_date(time)).alias("days")).where((F.col("span") >= span_s) & (F.col("n_tactics") >= tactics) & (F.col("days") >= days))
    seg = segment_summary(segments(df, by, gap_s, time, id_col), by, tactic, time=time).groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("events"))
    found = apt.join(seg, by).where(F.col("segments") >= least_segments).join(stage_chain(df, by, tactic, time, id_col), by)
    return found.withColumn("confidence", campaign_confidence(F.col("segments"), F.split("chain", ">")))


def synthetic_guard(df: DataFrame, address: str, time: str = "EndDate", id_col: str = "alert_idx", buckets: int = 64) -> DataFrame:
    """One row: share of distinct addresses, and the variation of time gaps (within hash buckets of the address)."""
    w = Window.partitionBy(F.pmod(F.xxhash64(address), F.lit(buckets))).orderBy(time, id_col)
    g = df.withColumn("_g", _gap(time, w))
    return g.agg((F.countDistinct(address) / F.count(F.lit(1))).alias("uniqueness"), (F.stddev_samp("_g") / (F.avg("_g") + 1e-8)).alias("gap_variation"))


def fuse(df: DataFrame, windows: DataFrame, id_col: str = "alert_idx", domain: str = "domain", tactic: str = "MalwareIntelAttackType", time: str = "EndDate") -> DataFrame:
    """One row per window that more than one domain reached: time, domains, tactics, last value per entity."""
    rows = df.join(windows.select(F.col("id").alias(id_col), "window"), id_col)
    return rows.groupBy("window").agg(
        F.min(time).alias("first_seen"), F.array_join(F.sort_array(F.collect_set(domain)), ",").alias("domains"), F.countDistinct(domain).alias("n_domains"), F.array_join(F.sort_array(F.collect_set(tactic)), ",").alias("tactics"),
        F.max_by("DestinationHostName", F.struct(time, id_col)).alias("last_host"), F.avg("severity").alias("severity"), F.count(F.lit(1)).alias("events"),
    ).where("n_domains > 1")


def unioned(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of several fragments, each with its tag; missing columns are null."""
    out = None
    for tag, df in parts.items():
        df = df.withColumn("fragment", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

