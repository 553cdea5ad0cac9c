"""Token ids of whole texts with a ``tokenizers`` BPE file whose pre-tokens never cross white space.

Pre-tokens are found, lower-cased, hashed and compared in bulk; each distinct one reaches the library once per worker and cache
life.
Words with anything but ASCII and Latin-1 letters, and words with an apostrophe or ``<|``, are units as a whole and go through
the library's whole chain. Ids of a text are the concatenated ids of its units, which holds for this family of files: white
space separates pre-tokens and is dropped, and special-token strings hold no white space.
"""

from __future__ import annotations

import zlib

import numpy as np

from .textops import SPACE, Block, exact_groups, ragged

#: Units that a worker remembers at most; beyond that it starts over.
CACHE_UNITS = 900_000

_OTHER, _LETTER, _DIGIT, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _ODD, dtype=np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _ODD
_CLASS[SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE uses for each byte."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in keep else chr(spare))
        spare += b not in keep
    return out


def _units(block: Block) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block with plain words lower-cased; starts and ends of units; whether each is a whole odd word; units before rows."""
    data = block.data
    kind = _CLASS[data]
    second = np.flatnonzero(data == 0xC3) + 1  # Latin-1 letters are C3 80 to C3 BF, but for the signs at 97 and B7
    second = second[second < len(data)]
    second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
    kind[second] = kind[second - 1] = _LETTER
    low = _LOWER[data]
    capital = second[data[second] < 0x9F]
    low[capital] += 32
    odd = kind == _ODD
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    starts, ends, _ = block.words()
    sums = np.concatenate([[0], np.cumsum(odd)])
    odd_word = sums[ends] > sums[starts]
    if odd_word.any():
        at = ragged(starts[odd_word], (ends - starts)[odd_word])
        kind[at] = _ODD
        low[at] = data[at]
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin[starts] = True
    begin[:-1] &= kind > 0
    u = np.flatnonzero(begin)
    close = np.empty(len(u), dtype=np.int64)
    close[:-1] = u[1:]
    if len(u):
        close[-1] = len(data)
        last = np.searchsorted(u, ends) - 1  # the last unit of each word
        close[last] = ends
    return Block(low, block.offsets, 0), u, close, kind[u] == _ODD, np.searchsorted(u, block.offsets)


class WordEncoder:
    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.cache_units = cache_units
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _ids(self, raw: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        s = raw.decode()
        if not s.isascii():
            s = "".join([self.alphabet[b] for b in raw])
        return [t.id for t in self.model.tokenize(s)]

    def _learn(self, keys: list[bytes], ids: list[list[int]]) -> None:
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for part in ids for x in part), dtype=np.int32, count=int(n.sum()))
        first = len(self.row)
        while first + len(ids) > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.begin[first : first + len(ids)] = self.used + np.cumsum(n) - n
        self.length[first : first + len(ids)] = n
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.row.update(zip(keys, range(first, first + len(ids)), strict=True))

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and where each text's ids start (plus the end)."""
        if not len(block.data):
            return np.zeros(0, dtype=np.int32), np.zeros(block.rows + 1, dtype=np.int64)
        low, starts, ends, whole, at = _units(block)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(block.rows + 1, dtype=np.int64)
        codes, first = exact_groups(low.data, starts, ends, low.hashes(starts, ends))
        if len(self.row) + len(first) > self.cache_units:
            self.clear()
        raw, get = low.data.tobytes(), self.row.get
        keys = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = [get(k, -1) for k in keys]
        new = [i for i, r in enumerate(known) if r < 0]
        if new:
            self._learn([keys[i] for i in new], [self._ids(keys[i], w) for i, w in zip(new, whole[first[new]].tolist(), strict=True)])
            known = [self.row[k] for k in keys]
        rows = np.array(known, dtype=np.int64)[codes]
        n = self.length[rows]
        before = np.concatenate([[0], np.cumsum(n)])
        return self.flat[ragged(self.begin[rows], n)], before[at]

    def encode_with_end(self, block: Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, at = self.encode(block)
        out = np.full(len(ids) + block.rows, end_id, dtype=np.int32)
        out[ragged(at[:-1] + np.arange(block.rows), np.diff(at))] = ids
        return out, at + np.arange(block.rows + 1)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False))
