"""Vectorised text primitives: Arrow strings as flat byte arrays, words, lines and their 64-bit hashes.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D). Hashes are polynomials modulo 2**64 over
prefix sums, finished by a mixer, so any substring of a block costs two look-ups. Texts can be made whose hashes are equal; where
a result must be exact, ``exact_groups`` compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .frames import BLOCK_BYTES

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for the first byte of each code point.
LEAD = np.ones(256, dtype=bool)
LEAD[0x80:0xC0] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.ones(size, dtype=U64)
        with np.errstate(over="ignore"):
            out[1:] = np.multiply.accumulate(np.full(size - 1, _BASE_INVERSE if inverse else _BASE, dtype=U64))
        if size > 1 << 22:  # of an unusually long text: not kept
            return out[:n]
        _powers[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Block:
    """Some consecutive rows of a string column: ``data`` (all their bytes) and ``offsets`` (one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row = data, offsets, first_row
        self.rows = len(offsets) - 1
        self._sums: np.ndarray | None = None

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def prefix_sums(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            out = np.zeros(n + 1, dtype=U64)
            with np.errstate(over="ignore"):
                np.cumsum((self.data.astype(U64) + U64(1)) * powers(n), out=out[1:])
            self._sums = out
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each substring [start, end)."""
        sums = self.prefix_sums()
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * powers(len(self.data) + 1, inverse=True)[start])

    def count(self, flags: np.ndarray) -> np.ndarray:
        """The number of true bytes in each row."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each row (plus one) the number of words before it."""
        inside = ~SPACE[self.data]
        start, after = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        after[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        start[edges] = inside[edges]
        after[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(start)
        return starts, np.flatnonzero(after) + 1, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines that ``\\n`` separates, and the row of each."""
        cuts = np.flatnonzero(self.data == 0x0A)
        rows = np.searchsorted(self.offsets, cuts, side="right") - 1
        starts = np.concatenate([self.offsets[:-1], cuts + 1])
        ends = np.concatenate([cuts, self.offsets[1:]])
        row_s = np.concatenate([np.arange(self.rows), rows])
        row_e = np.concatenate([rows, np.arange(self.rows)])
        a, b = np.lexsort((starts, row_s)), np.lexsort((ends, row_e))
        return starts[a], ends[b], row_s[a]


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without copying its text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, off


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column into blocks of whole rows of about ``size`` bytes, so that temporary arrays stay small."""
    raw, off = strings(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        hi = min(n, hi, lo + 65_536)
        yield Block(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo)
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
#: Bytes that are compared eight at a time; what lies beyond is compared as a whole.
_STRIDES = 64


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of ranges, from ``a`` and ``b`` on and of ``size`` bytes each, hold the same bytes."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    same, todo = np.ones(len(a), dtype=bool), np.flatnonzero(size > 0)
    for k in range(0, 8 * _STRIDES, 8):
        if not len(todo):
            return same
        x, y, left = a[todo] + k, b[todo] + k, size[todo] - k
        ok = ((eight[x] ^ eight[y]) & _MASKS[np.minimum(left, 8)]) == 0
        same[todo] = ok
        todo = todo[ok & (left > 8)]
    for i in todo.tolist():
        k, n = 8 * _STRIDES, int(size[i])
        same[i] = np.array_equal(data[a[i] + k : a[i] + n], data[b[i] + k : b[i] + n])
    return same


def exact_groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal strings [start, end), from 0 on in order of their first place, and these places. Hashes only suggest what may be equal: bytes are
    compared, and strings that differ from the first with their hash are numbered by themselves."""
    codes, _ = pd.factorize(hashes)
    n = int(codes.max()) + 1 if len(codes) else 0
    first = np.zeros(n, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    lead = first[codes]
    size = ends - starts
    same = size == size[lead]
    other = np.flatnonzero(same & (lead != np.arange(len(codes))))
    same[other] = equal_ranges(data, starts[other], starts[lead[other]], size[other])
    if not same.all():
        known: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(~same).tolist():
            own = data[starts[i] : ends[i]].tobytes()
            if own not in known:
                known[own] = n + len(extra)
                extra.append(i)
            codes[i] = known[own]
        first = np.concatenate([first, np.array(extra, dtype=np.int64)])
    return codes, first


def shingles(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words (a shorter text: one run of all its words), and counts before each row."""
    starts, ends, at = block.words()
    h = block.hashes(starts, ends)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    first = ragged(at[:-1], count)
    out = np.zeros(len(first), dtype=U64)
    limit = np.repeat(at[1:], count)
    padded = np.concatenate([h, np.zeros(words, dtype=U64)])
    short = bool((n < words).any())
    with np.errstate(over="ignore"):
        for k in range(words):
            part = padded[first + k]
            if short:
                part = np.where(first + k < limit, part, U64(0))
            out = mix(out * U64(_BASE) + part + U64(1)) if k == words - 1 else out * U64(_BASE) + part + U64(1)
    return out, np.concatenate([[0], np.cumsum(count)])
