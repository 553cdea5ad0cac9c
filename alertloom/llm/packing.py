"""Cost-balanced packing of token streams into fixed-length training sequences.

Method: a piece of n tokens costs ``LINEAR * n + QUADRATIC * n**2`` (feed-forward and attention). Pieces are taken in descending
length and each goes to the sequence of lowest cost that still has room; a piece that fits nowhere is cut at the largest room, that of
the sequence of lowest cost among equals. Groups of about ``GROUP_TOKENS`` tokens are packed by the task that read them, so there is no
shuffle; capacities of a group add up to exactly its tokens (full sequences, then powers of two for the rest), so nothing is
padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .frames import lean, pick
from .textops import blocks
from .wordpiece import crc32, default_path, encoder

SEQUENCE = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together: 256 full sequences or more.
GROUP_TOKENS = 256 * SEQUENCE


def capacities(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Full sequences and, for the rest, one sequence of each power of two that its binary form holds."""
    rest = total % sequence
    return [sequence] * (total // sequence) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(lengths: list[int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (text, start, length, sequence, offset) that together fill all capacities; every token is in one piece."""
    room = np.array(capacities(sum(lengths), sequence), dtype=np.int64)
    used = np.zeros(len(room), dtype=np.int64)
    cost = np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []
    todo = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    while todo:
        n, i, start = heapq.heappop(todo)
        n = -n
        open_ = np.where(room >= n, cost, np.inf)
        k = int(open_.argmin())
        if open_[k] == np.inf:  # fits nowhere: cut at the largest room, of lowest cost among equals
            k = int(np.lexsort((cost, -room))[0])
        take = min(n, int(room[k]))
        out.append((i, start, take, k, int(used[k])))
        room[k] -= take
        used[k] += take
        cost[k] += LINEAR * take + QUADRATIC * take * take
        if take < n:
            heapq.heappush(todo, (take - n, i, start + take))
    return out


_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, group_tokens: int = GROUP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece of every document of ``docs``: where it comes from, where it goes, and its ids (``with_ids``).

    Null and empty texts are one piece, the end id. Null ids are carried through and repeated rows are packed each on its own.
    Texts of any length are cut; an empty table gives no pieces; other columns are ignored. ``sequence_id`` is unique over the
    table; a sequence's pieces have gapless offsets from 0, and it holds ``sequence_length`` tokens: ``sequence`` or a power of
    two.
    """
    path = tokenizer or default_path()
    src = pick(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        enc = encoder(path)
        names: list[pa.Array] = []
        streams: list[np.ndarray] = []
        held, sequences = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, sequences
            docs_, pieces = pa.concat_arrays(names), pack([len(x) for x in streams], sequence)
            doc, start, length, seq, offset = np.array(pieces, dtype=np.int64).T
            sizes = np.array(capacities(held, sequence), dtype=np.int64)
            parts = [streams[i][s : s + n] for i, s, n, _, _ in pieces]
            cols = [docs_.take(pa.array(doc)), *map(pa.array, (start, length, np.fromiter(map(crc32, parts), dtype=np.int64, count=len(parts)), np.array([len(x) for x in streams])[doc], base + sequences + seq, offset, sizes[seq]))]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(parts), pa.int32())))
            sequences += len(sizes)
            held = 0
            names.clear(), streams.clear()
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *_NAMES, *["ids"] * with_ids])

        for batch in batches:
            for b in blocks(batch.column(1)):
                ids, at = enc.encode_with_end(b, end_id)
                ids_of_docs = batch.column(0).slice(b.first_row, b.rows)
                lo = 0
                while lo < b.rows:
                    hi = min(b.rows, max(lo + 1, int(np.searchsorted(at, at[lo] + group_tokens - held, side="left"))))
                    names.append(ids_of_docs.slice(lo, hi - lo))
                    streams += [ids[at[i] : at[i + 1]] for i in range(lo, hi)]
                    held += int(at[hi] - at[lo])
                    lo = hi
                    if held >= group_tokens:
                        yield flush()
        if streams:
            yield flush()

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}" + ", ids array<int>" * with_ids)
