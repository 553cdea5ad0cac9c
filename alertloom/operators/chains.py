"""Chains of related alerts per entity: whether a row goes on with a chain hangs on the chain's first row, not on the row before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.scalars import related_mask
from alertloom.plans.stage import removed, shared_dir, written

#: Rows of a block that one task holds, about.
BLOCK_ROWS = 50_000

#: Kinds of rows that end chains: one after a gap ends all, one of another label those without related ones; each mask m above has its
#: own, a row that is related to none of m's groups.
_GAP, _OTHER = -1, 0
_EXITS = "_key string, _block int, place int, kind int, head long"
_FIRSTS = "_key string, _block int, kind int, place int"


class _Block:
    """The rows of a block in order of entity, time and id. Each entity's rows are a piece; ``place`` numbers them from 0."""

    def __init__(self, table: pa.Table, gap: int):
        keys = table.column("_key").combine_chunks().dictionary_encode()
        labels = table.column("_label").combine_chunks().dictionary_encode(null_encoding="encode")
        us = table.column("_us")
        timed = pc.is_valid(us).to_numpy()
        at = np.where(timed, pc.fill_null(us, 0).to_numpy(), np.iinfo(np.int64).min)
        key, label, ids = keys.indices.to_numpy(), labels.indices.to_numpy(), table.column("id").to_numpy()
        copy, mask = ~table.column("_own").to_numpy(zero_copy_only=False), table.column("_mask").to_numpy()
        by_name = np.argsort(np.argsort(labels.dictionary.to_numpy(zero_copy_only=False).astype(str)))  # ties in time and id
        order = np.lexsort((by_name[label], ~copy, ids, at, key))
        key, label, at, timed, copy = key[order], label[order], at[order], timed[order], copy[order]
        fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
        start, other = fresh.copy(), fresh.copy()
        start[1:] |= timed[1:] & timed[:-1] & (at[1:] - np.where(timed[:-1], at[:-1], at[1:]) > gap)
        other[1:] |= label[1:] != label[:-1]
        own = ~copy
        self.order, self.start, self.other = order[own], start[own], other[own]
        self.ids, self.mask, self.key = ids[order][own], mask[order][own], key[own]
        self.names = keys.dictionary
        n = len(self.ids)
        self.bounds = np.append(np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])[:n]), n)
        self.ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        self.first = np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def kind_rows(self, kind: int) -> np.ndarray:
        if kind == _GAP:
            return np.flatnonzero(self.start)
        return np.flatnonzero(self.other if kind == _OTHER else (self.mask & kind) == 0)

    def after(self) -> np.ndarray:
        """For each row, the first row of its piece that can't be in a chain with it at the head, or the piece's end."""
        n, out = len(self.ids), self.ends.copy()
        ahead = np.append(self.kind_rows(_GAP), n)
        rows = np.arange(n)
        out = np.minimum(out, ahead[np.searchsorted(ahead, rows, side="right").clip(max=len(ahead) - 1)])
        for kind in np.unique(self.mask):
            mine = np.flatnonzero(self.mask == kind)
            stops = np.append(self.kind_rows(int(kind)), n)
            out[mine] = np.minimum(out[mine], stops[np.searchsorted(stops, mine, side="right").clip(max=len(stops) - 1)])
        return out

    def last_heads(self, after: np.ndarray) -> np.ndarray:
        """For each row, the last head of its piece if it is one itself."""
        reach = np.where(after < self.ends, after, np.arange(len(after)))
        while (reach[reach] != reach).any():
            reach = reach[reach]
        return reach

    def heads(self, opened: np.ndarray, after: np.ndarray) -> np.ndarray:
        """For each row the place of its head, -1 before the first; ``opened`` marks the heads that are known."""
        n = len(after)
        seen, jump = np.append(opened, False), np.append(np.where(after < self.ends, after, n), n)
        while (jump[:-1] < n).any():
            seen[jump[np.flatnonzero(seen[:-1])]] = True
            seen[n] = False
            jump = jump[jump]
        place = np.maximum.accumulate(np.where(seen[:-1], np.arange(n), -1))
        return np.where(place >= self.first, place, -1)


def chains(df: DataFrame, by: list[str], label: str, gap_s: float = 300.0, time: str = "EndDate", id_col: str = "alert_idx", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``by``, ``id`` and the first row of the chain that each row belongs to. A chain goes on while the gap to the row before is at most
    ``gap_s`` seconds and the label equals, or is related to, that of the chain's first row.

    Rows without a time come first in their entity and make no gap; a null label equals null alone; ids aren't null; a null entity is one; an empty table
    gives no rows. Rows of one entity, time and id count in order of the label.

    Rows are cut into ranges of entity, time and id of about ``block_rows`` rows, so an entity (or a moment) with any share of the rows is the
    work of many tasks. Which row ends a chain hangs on the groups of related labels that the head has only, and on equal labels where it
    has none: a block tells for each such kind its first row, and where chains that enter at those rows leave it. These pointers from block to
    block double until every block knows the head that it begins with, in rounds that grow with the logarithm of an entity's blocks. Windows
    over an entity see a row a block and kind.
    """
    spark, base = df.sparkSession, shared_dir(df.sparkSession)
    gap = int(gap_s * 1e6)
    rows = df.select(*by, F.coalesce(F.to_json(F.struct(*by)), F.lit("")).alias("_key"), F.col(id_col).cast("long").alias("id"), F.unix_micros(time).alias("_us"), F.col(label).cast("string").alias("_label"), related_mask(F.col(label)).alias("_mask"))
    n = max(1, -(-df.count() // block_rows))
    ranged = rows.repartitionByRange(n, "_key", "_us", "id", "_label").withColumn("_block", F.spark_partition_id()).withColumn("_own", F.lit(True))
    rows = written(ranged, "rows", base)
    of = Window.partitionBy("_key").orderBy("_block")
    last = F.max(F.struct("_us", "id", "_label")).alias("last")
    pieces = written(rows.groupBy("_key", "_block").agg(last).withColumn("then", F.lead("_block").over(of)), "pieces", base)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    masks = [int(r[0]) for r in rows.select("_mask").distinct().collect()]  # as many as there are sets of related groups, a fixed number

    # A piece begins with a copy of the row before it, which tells gaps and changes of the label.
    ends = pieces.where("then is not null").select("_key", F.col("then").alias("_block"), "last._us", "last.id", "last._label", F.lit(False).alias("_own"))
    dealt = rows.unionByName(ends, allowMissingColumns=True).withColumn("_mask", F.coalesce("_mask", F.lit(0)))  # notes to blocks have a null in _own

    def piece_key(b: _Block, at: np.ndarray) -> pa.Array:
        return b.names.take(pa.array(b.key[at], pa.int32()))

    def firsts(table: pa.Table) -> pa.Table:
        """The first row of each kind in each piece; null where there is none."""
        block, b, out = table.column("_block")[0].as_py(), _Block(table, gap), []
        at = b.bounds[:-1]
        for kind in {_GAP, _OTHER, *masks}:
            stops = np.append(b.kind_rows(kind), len(b.ids))
            found = stops[np.searchsorted(stops, at)]
            place = pa.array(found - at, pa.int32(), mask=found >= b.bounds[1:])
            m = len(at)
            out.append(pa.table({"_key": piece_key(b, at), "_block": pa.array([block] * m, pa.int32()), "kind": pa.array([kind] * m, pa.int32()), "place": place}))
        return pa.concat_tables(out)

    def exits(table: pa.Table) -> pa.Table:
        """Per piece the head that it leaves: known where it has a start, else one for each row at which a chain may enter."""
        notes = table.filter(pc.is_null(table.column("_own")))
        block, b = table.column("_block")[0].as_py(), _Block(table.filter(pc.is_valid(table.column("_own"))), gap)
        reach, begin = b.last_heads(b.after()), dict(zip(piece_key(b, b.bounds[:-1]).to_pylist(), zip(b.bounds[:-1], b.bounds[1:], strict=True), strict=True))
        found = []
        entries: dict[str, list[int]] = {}
        for key, place in zip(notes.column("_key").to_pylist(), notes.column("entry").to_pylist(), strict=True):
            entries.setdefault(key, []).append(place)
        for key, (lo, hi) in begin.items():
            starts = np.flatnonzero(b.start[lo:hi])
            for place, i in [(None, lo + int(starts[-1]))] if len(starts) else [(p, lo + p) for p in entries.get(key, [])]:
                found.append((key, block, place, int(b.mask[reach[i]]), int(b.ids[reach[i]])))
        return pa.Table.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["_key", "_block", "place", "kind", "head"])

    def found(table: pa.Table) -> pa.Table:
        kept, notes = table.filter(pc.is_valid(table.column("_own"))), table.filter(pc.is_null(table.column("_own")))
        b = _Block(kept, gap)
        begin = dict(zip(piece_key(b, b.bounds[:-1]).to_pylist(), b.bounds[:-1], strict=True))
        opened, before = b.start.copy(), np.full(len(b.ids), -1, dtype=np.int64)
        sizes = dict(zip(b.bounds[:-1], b.bounds[1:], strict=True))
        for key, entry, head in zip(*[notes.column(c).to_pylist() for c in ("_key", "entry", "head")], strict=True):
            lo = begin[key]
            if entry is not None:
                opened[lo + entry] = True
            if head is not None:
                before[lo : sizes[lo]] = head
        place = b.heads(opened, b.after())
        mine = kept.take(pa.array(b.order))
        return pa.Table.from_arrays([*[mine.column(c) for c in by], pa.array(b.ids), pa.array(np.where(place >= 0, b.ids[np.maximum(place, 0)], before))], [*by, "id", "chain"])

    none = lambda t: F.lit(None).cast(t)
    if n == 1:
        return dealt.withColumn("entry", none("int")).withColumn("head", none("long")).groupBy("_block").applyInArrow(found, f"{kinds}, id long, chain long")

    # The next row of each kind behind each piece, where no gap comes before it.
    back = Window.partitionBy("_key", "kind").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    spot = F.when(F.col("place").isNotNull(), F.struct("_block", "place"))
    ahead = dealt.groupBy("_block").applyInArrow(firsts, _FIRSTS).withColumn("next", F.last(spot, ignorenulls=True).over(back))
    stop = F.min(F.when(F.col("kind") == _GAP, F.col("next"))).over(Window.partitionBy("_key", "_block"))
    targets = ahead.withColumn("_stop", stop).where((F.col("kind") != _GAP) & F.col("next").isNotNull() & (F.col("_stop").isNull() | (F.col("next") < F.col("_stop"))))
    targets = written(targets.select("_key", F.col("_block").alias("_from"), "kind", F.col("next._block").alias("_to"), F.col("next.place").alias("_at")), "targets", base)

    entries = targets.select("_key", F.col("_to").alias("_block"), F.col("_at").alias("entry")).distinct()
    asked = dealt.withColumn("entry", none("int")).unionByName(entries, allowMissingColumns=True)
    left = written(asked.groupBy("_block").applyInArrow(exits, _EXITS), "exits", base)
    links = left.withColumnRenamed("_block", "_from").join(targets, ["_key", "_from", "kind"]).select("_key", "_from", "place", "_to", "_at")
    links = written(links, "links", base)
    reached = links.where("place is null").select("_key", F.col("_to").alias("_block"), F.col("_at").alias("place"))
    jump = links.where("place is not null")
    k = 0
    while not jump.isEmpty():
        more = reached.withColumnRenamed("_block", "_from").join(jump, ["_key", "_from", "place"]).select("_key", F.col("_to").alias("_block"), F.col("_at").alias("place"))
        reached = written(reached.unionByName(more).distinct(), f"reached{k}", base)
        far = jump.select("_key", F.col("_from").alias("_to"), F.col("place").alias("_at"), F.col("_to").alias("_to2"), F.col("_at").alias("_at2"))
        jump = written(jump.join(far, ["_key", "_to", "_at"]).select("_key", "_from", "place", F.col("_to2").alias("_to"), F.col("_at2").alias("_at")), f"jump{k}", base)
        if k:
            removed(spark, f"{base}/reached{k - 1}")
            removed(spark, f"{base}/jump{k - 1}")
        k += 1

    met = reached.withColumnRenamed("place", "entry")
    known = left.where("place is null").select("_key", "_block", "head").unionByName(left.join(reached, ["_key", "_block", "place"]).select("_key", "_block", "head"))
    earlier = of.rowsBetween(Window.unboundedPreceding, -1)
    notes = pieces.select("_key", "_block").join(known, ["_key", "_block"], "left").join(met, ["_key", "_block"], "left")
    notes = notes.withColumn("head", F.last("head", ignorenulls=True).over(earlier)).where("head is not null or entry is not null")
    both = dealt.withColumn("entry", none("int")).withColumn("head", none("long")).unionByName(notes, allowMissingColumns=True)
    return both.groupBy("_block").applyInArrow(found, f"{kinds}, id long, chain long")
