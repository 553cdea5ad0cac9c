"""Exact removal of byte strings that occur earlier in the corpus, by suffix sorting of candidate regions.

A window of ``LENGTH`` bytes picks the k-gram of least hash that it holds as its anchor (leftmost of equals), so equal windows have equal
anchors at equal places. Only anchors that occur twice or more can carry a repeat; the bytes around those (a context: all
windows of one anchor) meet by anchor hash. There a two-stage suffix sort puts windows in order: suffixes that are smaller
than their successors are sorted directly, all others are induced from these by one scan over the first-byte buckets. Windows
whose common prefix with their neighbour reaches ``LENGTH`` are equal, and all but the earliest are removed.

Scale: anchors are about 1 byte in 39; a task keeps one of each anchor and of each context, so a passage that a third of all
documents share reaches its group once per task. Nothing is capped, sampled or sent to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_place, counted, lean, pick, released, written
from .textops import U64, Block, blocks, mix, powers, ragged, strings

LENGTH, GRAM = 100, 24
#: Anchors, and bytes of contexts, that a task holds before it drops its own repeats; bytes of contexts sorted at once.
HOLD_ANCHORS, HOLD_BYTES, SORT_BYTES = 1 << 20, 8 << 20, 2 << 20
#: Contexts of an anchor above which they are dealt out by further bytes, and the places of the anchor in a window that part them.
HOT = 2048
PLACES = tuple((p, min(p + 11, LENGTH - GRAM + 1)) for p in range(0, LENGTH - GRAM + 1, 11))


def window_anchors(block: Block) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first and last window start, anchor place (all within the text), anchor hash."""
    n, off = len(block.data), block.offsets
    size = np.diff(off)
    if not (size >= LENGTH).any():
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    sums = block.prefix_sums()
    with np.errstate(over="ignore"):
        h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1, inverse=True)[: n + 1 - GRAM])
    bits = U64(max(20, int(n).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=U64)  # ties go to the left
    width, have = LENGTH - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    windows = np.maximum(size - LENGTH + 1, 0)
    at = ragged(off[:-1], windows)
    row = np.repeat(np.arange(block.rows), windows)
    place = (low[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    row, place = row[first], place[first]
    return row, at[first] - off[row], at[last] - off[row], place - off[row], h[place]


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether it is the first of its key, and how often its key occurs."""
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    flags = np.zeros(len(keys), dtype=bool)
    flags[first] = True
    return flags, count[inverse]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each anchor: ``key`` (its hash, or where its task has met it before, a key of its own), ``known`` (to be repeated), uid, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            h, uid, at = (np.concatenate(x) for x in zip(*held, strict=True))
            first, count = _first_of(h)
            with np.errstate(over="ignore"):
                own = mix(h + mix(uid.astype(U64) * U64(3) + U64(7)) + at.astype(U64))
            held.clear()
            n = 0
            return pa.RecordBatch.from_arrays([pa.array(np.where(first, h, own).view(np.int64)), pa.array(count > 1), pa.array(uid), pa.array(at.astype(np.int32))], ["key", "known", "uid", "at"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for b in blocks(batch.column(1)):
                row, _, _, place, h = window_anchors(b)
                held.append((h, ids[b.first_row : b.first_row + b.rows][row], place))
                n += len(h)
                if n >= HOLD_ANCHORS:
                    yield flush()
        if n:
            yield flush()

    return docs.select("uid", "text").mapInArrow(lean(run), "key long, known boolean, uid long, at int")


_PARTS = "uid long, key long, lo int, hi int, at int, body binary"


def _contexts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The bytes of all windows of each repeated anchor. Without bytes: windows whose context its task has met before, so that an
    earlier copy exists.

    Texts come in order of uid, so the first of equal contexts is the earliest of its task.
    """
    joined = docs.select("uid", "text").join(repeated, "uid").sortWithinPartitions("uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            uid, key, lo, hi, place, digest, size = (np.concatenate([x[i] for x in held]) for i in range(7))
            data = np.concatenate([x[7] for x in held])
            with np.errstate(over="ignore"):
                first, _ = _first_of(mix(key + U64(1)) ^ digest)
            off = np.cumsum(size) - size
            kept = np.where(first, size, 0)
            body = data[ragged(off, kept)]
            ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            valid = pa.array(first).buffers()[1]
            held.clear()
            n = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.array(key.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (lo, hi, place - lo)), pa.Array.from_buffers(pa.binary(), len(first), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])],
                ["uid", "key", "lo", "hi", "at", "body"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1)):
                own = ids[b.first_row : b.first_row + b.rows]
                row, lo, hi, place, h = window_anchors(b)
                marked = np.zeros(len(b.data) + 1, dtype=bool)
                marks = at[b.first_row : b.first_row + b.rows + 1]
                marked[flat[marks[0] : marks[-1]] + np.repeat(b.offsets[:-1], np.diff(marks))] = True
                hit = marked[place + b.offsets[row]]
                row, lo, hi, place, h = row[hit], lo[hit], hi[hit], place[hit], h[hit]
                start = b.offsets[row] + lo
                length = hi - lo + LENGTH
                held.append((own[row], h, lo, hi, place, b.hashes(start, start + length), length, b.data[ragged(start, length)]))
                n += int(length.sum())
                if n >= HOLD_BYTES:
                    yield flush()
        if held:
            yield flush()

    return joined.mapInArrow(lean(run), _PARTS)


def suffix_order(data: np.ndarray, need: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of ``need`` in order of the suffixes that start there, right to ``depth`` bytes at least.

    Two-stage: a suffix is small if it is smaller than its successor. Small ones are sorted directly by 8 bytes at a time. A large
    one's order follows from its first byte and its successor, so scanning the buckets of first bytes upwards, with each
    bucket's large suffixes in front of its small ones, finds every large suffix in order. Suffixes that no needed one is
    induced from are left out.
    """
    n = len(data)
    c = np.zeros(n + 1, dtype=np.uint16)  # with an end that is smaller than all bytes
    c[:-1] = data.astype(np.uint16) + 1
    turn = np.where(c[:-1] != c[1:], np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # where the run of equal bytes ends
    small = np.ones(n + 1, dtype=bool)
    small[:-1] = c[turn] < c[np.minimum(turn + 1, n)]
    used = np.zeros(n + 1, dtype=bool)
    used[:-1] = need
    chain = np.flatnonzero(used & ~small)
    while len(chain):
        chain = chain[~used[chain + 1]] + 1
        used[chain] = True
        chain = chain[~small[chain]]
    padded = np.concatenate([data, np.zeros(depth + 16, dtype=np.uint8)])
    word = np.zeros(n + depth + 8, dtype=U64)
    for k in range(8):
        word = word << U64(8) | padded[k : k + len(word)].astype(U64)
    order = _sorted_directly(np.flatnonzero(used & small), word, depth)
    large = used & ~small
    bounds = np.searchsorted(c[order], np.arange(258))
    front: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for b in range(257):
        own = order[bounds[b] : bounds[b + 1]]
        if not front[b] and not len(own):
            continue
        waves = front[b]
        wave = np.concatenate(waves) if waves else own[:0]
        waves = [wave]
        while len(wave):  # predecessors with the same first byte stand further back in the same bucket
            wave = wave[wave > 0] - 1
            wave = wave[large[wave]]
            wave = wave[c[wave] == b]
            waves.append(wave)
        bucket = np.concatenate([*waves, own])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before]]
        kind = c[before]
        before, kind = before[kind > b], kind[kind > b]
        if len(before):
            by = np.argsort(kind, kind="stable")
            before, kind = before[by], kind[by]
            cuts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(before)], strict=True):
                front[kind[a]].append(before[a:z])
    found = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    found = found[found < n]
    return found[need[found]]


def _sorted_directly(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    if not len(at):
        return at
    first = word[at]
    by = np.argsort(first, kind="stable")
    at, first = at[by], first[by]
    group = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]]))
    open_ = np.arange(len(at))
    for d in range(8, depth, 8):
        g = group[open_]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        size = np.diff(np.append(np.flatnonzero(head), len(g)))
        keep = np.repeat(size > 1, size)
        open_, g = open_[keep], g[keep]
        if not len(open_):
            break
        if d in (16, 32, 56):  # groups that are equal to the full depth need no more sorting
            head = np.concatenate([[True], g[1:] != g[:-1]])
            start = np.flatnonzero(head)
            size = np.diff(np.append(start, len(g)))
            lead = np.repeat(at[open_[start]], size)
            same = np.ones(len(open_), dtype=bool)
            for e in (*range(d, depth - 8, 8), depth - 8):
                same &= word[at[open_] + e] == word[lead + e]
            keep = np.repeat(~np.logical_and.reduceat(same, start), size)
            open_, g = open_[keep], g[keep]
            if not len(open_):
                break
        key = word[at[open_] + d]
        by = np.lexsort((key, g))
        at[open_], key = at[open_][by], key[by]
        split = np.concatenate([[False], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        names = open_[np.maximum.accumulate(np.where(np.concatenate([[True], split[1:]]), np.arange(len(open_)), 0))]
        group[open_] = names + len(group)  # named by their first member's place
    return at


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each place's common prefix with the one before it in order reaches ``length`` bytes."""
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    word = np.zeros(len(data) + 8, dtype=U64)
    for k in range(8):
        word = word << U64(8) | padded[k : k + len(word)].astype(U64)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for e in (*range(0, length - 8, 8), length - 8):
        alive = alive[word[a[alive] + e] == word[b[alive] + e]]
    out = np.zeros(len(order), dtype=bool)
    out[alive + 1] = True
    return out


def later_windows(data: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Flags the needed windows whose bytes also start at an earlier needed place."""
    order = suffix_order(data, need)
    flags = np.zeros(len(data), dtype=bool)
    if len(order):
        same = equal_neighbours(data, order)
        start = np.flatnonzero(~same)
        earliest = np.repeat(np.minimum.reduceat(order, start), np.diff(np.append(start, len(order))))
        flags[order[order != earliest]] = True
    return flags


def _dealt(contexts: DataFrame) -> DataFrame:
    """uid, key, lo, body of all contexts; those of an anchor that has more than ``HOT`` get keys of their own by further bytes.

    Equal windows have their anchor at the same place, so windows part by that place into ``PLACES``; within one of these all
    windows hold the same bytes around the anchor (90 of their 100), and these join the key. So an ordinary phrase in ever new
    surroundings is no hot key.
    """
    hot = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot")), "hot")
    if not hot.limit(1).count():
        return contexts.select("uid", "key", "lo", "body")
    rows = contexts.join(hot, "key", "left")  # a table of known size; one too large to broadcast is joined by shuffling

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, key, lo, hi, at = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            raw, off = strings(batch.column(5))
            data, start = raw[off[0] : off[-1]], off[:-1] - off[0]
            b = Block(data, off - off[0], 0)
            for r, (p, q) in enumerate(PLACES):
                first, last = np.maximum(lo, lo + at - q + 1), np.minimum(hi, lo + at - p)
                own = np.flatnonzero(first <= last)
                if not len(own):
                    continue
                anchor = start[own] + at[own]
                with np.errstate(over="ignore"):
                    sub = mix(key[own].view(U64) + U64(r + 1)) ^ b.hashes(anchor - p, anchor + LENGTH + 1 - q)
                size = (last - first)[own] + LENGTH
                body = data[ragged(start[own] + (first - lo)[own], size)]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[own]), pa.array(sub.view(np.int64)), pa.array(first[own].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])],
                    ["uid", "key", "lo", "body"],
                )

    split = rows.where("hot").select("uid", "key", "lo", "hi", "at", "body").mapInArrow(lean(run), "uid long, key long, lo int, body binary")
    return rows.where("hot is null").select("uid", "key", "lo", "body").unionByName(split)


def _later(contexts: DataFrame) -> DataFrame:
    """Ranges (uid, lo, hi: first and last window) of windows that have an earlier copy in another context of their anchor."""

    def ranges(uid: np.ndarray, key: np.ndarray, lo: np.ndarray, bodies: list[np.ndarray]) -> pa.RecordBatch | None:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        keep = np.flatnonzero(np.repeat(size > 1, size))  # windows of one context differ from each other
        if not len(keep):
            return None
        parts = [bodies[i] for i in keep.tolist()]
        length = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        off = np.cumsum(length) - length
        data = np.concatenate(parts)
        need = np.zeros(len(data), dtype=bool)
        need[ragged(off, length - LENGTH + 1)] = True
        flags = later_windows(data, need)
        at = np.flatnonzero(flags)
        if not len(at):
            return None
        own = np.searchsorted(off, at, side="right") - 1
        cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(at)) - 1
        ctx = own[first]
        base = lo[keep][ctx] - off[ctx]
        return pa.RecordBatch.from_arrays([pa.array(uid[keep][ctx]), pa.array((base + at[first]).astype(np.int32)), pa.array((base + at[last]).astype(np.int32))], ["uid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, key, lo, bodies, n = [], [], [], [], 0
        for batch in batches:
            u, k, x = (batch.column(i).to_numpy() for i in range(3))
            raw, off = strings(batch.column(3))
            a = 0
            while a < len(k):
                z = min(len(k), max(a + 1, int(np.searchsorted(off, off[a] + SORT_BYTES))))
                if n >= SORT_BYTES and bodies:  # cut where the key changes
                    stop = a
                    while stop < z and k[stop] == key[-1][-1]:
                        stop += 1
                    if stop < z:
                        if stop > a:
                            uid.append(u[a:stop]), key.append(k[a:stop]), lo.append(x[a:stop])
                            bodies += [raw[off[i] : off[i + 1]] for i in range(a, stop)]
                        if (got := ranges(np.concatenate(uid), np.concatenate(key), np.concatenate(lo).astype(np.int64), bodies)) is not None:
                            yield got
                        uid, key, lo, bodies, n = [], [], [], [], 0
                        a = stop
                uid.append(u[a:z]), key.append(k[a:z]), lo.append(x[a:z])
                bodies += [raw[off[i] : off[i + 1]].copy() for i in range(a, z)]
                n += int(off[z] - off[a])
                a = z
        if bodies and (got := ranges(np.concatenate(uid), np.concatenate(key), np.concatenate(lo).astype(np.int64), bodies)) is not None:
            yield got

    sorted_ = _dealt(contexts).repartition("key").sortWithinPartitions("key", "uid", "lo")
    return sorted_.mapInArrow(lean(run), "uid long, lo int, hi int")


def _keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with ``uid``, a unique number in order of doc_id: the id itself, or where ids repeat, are null or aren't
    integers, a new one (nulls first, equal ids by text). The flag tells which."""
    whole = docs.schema[doc_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and not docs.groupBy(doc_id).count().where(F.col("count").__gt__(1) | F.col(doc_id).isNull()).limit(1).count():
        return docs.withColumn("uid", F.col(doc_id).cast("long")), True
    fixed = written(docs.repartitionByRange(doc_id, text).sortWithinPartitions(doc_id, text).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    return fixed, False


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal runs."""
    by = np.argsort(starts, kind="stable")
    s, e = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def _ranges(keyed: DataFrame) -> DataFrame:
    """All ranges of windows with an earlier copy, by uid. Each half is written, so that the shuffles of one are gone before the next."""
    parts = _written_contexts(keyed)
    released(keyed.sparkSession)
    out = _written_ranges(parts)
    released(keyed.sparkSession)
    return out


def _written_ranges(parts: DataFrame) -> DataFrame:
    both = parts.where("body is null").select("uid", "lo", "hi").unionByName(_later(parts.where("body is not null")))
    return written(both.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")


def _written_contexts(keyed: DataFrame) -> DataFrame:
    found = _anchor_rows(keyed).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    repeated = found.where("known or n > 1").groupBy("uid").agg(F.collect_list("at").alias("at"))
    return written(_contexts(keyed, repeated), "contexts")


def _cut(joined: DataFrame) -> DataFrame:
    """Apply ranges to texts (columns: uid, text, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = strings(batch.column(1))
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            valid = np.array(lists.is_valid())
            gone, spans, shas = [], [], []
            for i in range(batch.num_rows):
                text = raw[off[i] : off[i + 1]]
                n, k = len(text), 0
                if valid[i] and at[i + 1] > at[i]:
                    s, e = _spans(lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]] + LENGTH)
                    k = len(s)
                    text = text[_outside(n, s, e)]
                spans.append(k)
                gone.append(n - len(text))
                shas.append(hashlib.sha256(text.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(lean(run), "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _outside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    keep = np.ones(n, dtype=bool)
    keep[ragged(starts, ends - starts)] = False
    return keep


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the SHA-256 of what is left after removing every byte that a string of
    ``LENGTH`` bytes covers which also starts earlier (smaller doc_id, or earlier in the same document).

    Null text counts as empty. Rows with a null or repeated doc_id are documents of their own: nulls come first, equal ids in
    order of text. Texts shorter than ``LENGTH`` stay whole; an empty table gives none; other columns are ignored.
    """
    keyed, plain = _keyed(pick(docs, doc_id="doc_id", text="text"))
    out = _cut(keyed.select("uid", "text").join(_ranges(keyed), "uid", "left"))
    if plain:
        return out.withColumnRenamed("uid", "doc_id")
    return out.join(keyed.select("uid", "doc_id"), "uid").drop("uid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with ``text`` cut as in ``remove_repeats`` and ``n_chars`` counted again.

    A character that a removed range cuts in two goes as a whole. Null texts stay null; rows with a null or repeated doc_id are
    documents of their own (nulls first, equal ids by text, of equal rows one keeps its text); texts of any length are
    cut as wholes; other columns, whatever their names, are carried through; an empty table gives none.
    """
    plain, (doc_id, text) = by_place(docs, "doc_id", "text")
    keyed, _ = _keyed(plain, doc_id, text)
    ranges = _ranges(keyed.select("uid", F.col(text).alias("text")))

    at, gaps = plain.columns.index(text), len(plain.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(gaps)
            rows = np.flatnonzero(np.array(lists.is_valid()) & np.array(batch.column(at).is_valid()))
            if len(rows):
                raw, off = strings(batch.column(at))
                ends, flat = lists.offsets.to_numpy(), lists.values
                lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                new = batch.column(at).to_pylist()
                for i in rows.tolist():
                    data = raw[off[i] : off[i + 1]]
                    s, e = _spans(lo[ends[i] : ends[i + 1]], hi[ends[i] : ends[i + 1]] + LENGTH)
                    new[i] = data[_outside(len(data), s, e)].tobytes().decode("utf-8", "ignore")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch.select(range(gaps))

    joined = keyed.join(ranges, "uid", "left").select(*plain.columns, "ranges").mapInArrow(lean(cut), plain.schema)
    return counted(joined, text, docs.columns).toDF(*docs.columns)
