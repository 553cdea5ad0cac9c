"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Method: the symbols of all new words of a block lie in one flat numpy array. Each round looks up the rank of every adjacent pair,
takes the minimum per word, merges all its occurrences at once (leftmost first where they overlap) and compacts the array,
until no word has a pair left. That equals the library's one-at-a-time order where a merge can't make a pair that ranks above
it; of the few pieces that can (``Model.alone``), only the leftmost of a word is merged in a round. Runs of blanks, whose
pieces all rank last and equal, are cut by the rule that this order gives them. Words are encoded once per worker and cache
life; texts are put together from them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import lean, pick
from .textops import Block, blocks, exact_groups, ragged

BLANK = "▁"
_BLANK_BYTES = BLANK.encode()
#: Words that a worker remembers at most; beyond that it starts over.
CACHE_WORDS = 700_000
#: Words of more characters are merged on their own, rank by rank.
LONG_WORD = 400
_FAR = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces, their ranks, and what each pair of pieces merges to."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        score = {self.pieces[i]: sp.get_score(i) for i in range(n) if i not in skip}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("pieces cross words")
        self.blanks = {len(p): i for p, i in self.ids.items() if not p.strip(BLANK)}
        self.longest = max(self.blanks)
        extra = sorted({c for p in self.ids for c in p if c not in self.ids})
        self.symbol = self.ids | {c: n + i for i, c in enumerate(extra)}
        self.foreign = n + len(extra)  # a character that no piece has
        keys, ranks, merged = [], [], []
        self.alone = alone = np.zeros(n, dtype=bool)  # pieces that one ranking above them is made of
        for p, i in self.ids.items():
            if not p.strip(BLANK):
                continue
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is None or b is None:
                    continue
                for x in (p[:k], p[k:]):
                    if len(x) > 1 and score[x] <= score[p]:
                        alone[self.ids[x]] = True
                keys.append(a << 20 | b), ranks.append(score[p]), merged.append(i)
        order = np.argsort(np.array(keys))
        self.keys = np.array(keys, dtype=np.int64)[order]
        _, rank = np.unique(-np.array(ranks), return_inverse=True)
        self.rank, self.merged = rank.astype(np.int64)[order], np.array(merged, dtype=np.int64)[order]
        self.text = [None] * n
        for p, i in self.ids.items():
            self.text[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _FAR), np.where(hit, self.merged[at], 0)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Piece ids of words that have no blanks but at most one in front."""
        long = {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG_WORD}
        if long:
            short = iter(self.merge([w for i, w in enumerate(words) if i not in long]))
            return [long[i] if i in long else next(short) for i in range(len(words))]
        text = "".join(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars, inverse = np.unique(points, return_inverse=True)
        table = np.array([self.symbol.get(chr(c), self.foreign) for c in chars], dtype=np.int64) if len(chars) else np.zeros(0, dtype=np.int64)
        sym, char = table[inverse], points.astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        rank, made = np.full(len(sym), _FAR), np.zeros(len(sym), dtype=np.int64)
        fresh = np.arange(max(0, len(sym) - 1))
        done: list[tuple[np.ndarray, ...]] = []
        while len(sym):
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh], made[fresh] = self.look_up(sym[fresh], sym[fresh + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            best = np.repeat(least, count)
            over = best == _FAR
            take = (rank == best) & ~over
            at = np.flatnonzero(take)
            if len(at):  # of overlapping ones every other, from the left
                run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
                head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
                again = np.concatenate([[False], word[at[1:]] == word[at[:-1]]])
                at = at[~(again & self.alone[made[at]])]
            if over.any():
                done.append((word[over], sym[over], char[over]))
            sym[at] = made[at]
            keep = ~over
            keep[at + 1] = False
            changed = np.zeros(len(sym) + 1, dtype=bool)
            changed[at] = True
            rank[at] = _FAR
            ahead = at[at > 0] - 1
            changed[ahead] = True
            gone = np.zeros(len(sym), dtype=bool)
            gone[at + 1] = True
            back = ahead[gone[ahead]]  # the symbol in front is itself part of a merge: its head stands one further left
            changed[back - 1] = True
            rank[ahead] = _FAR
            rank[back - 1] = _FAR
            sym, char, word, rank, made, changed = sym[keep], char[keep], word[keep], rank[keep], made[keep], changed[:-1][keep]
            fresh = np.flatnonzero(changed[:-1]) if len(sym) else np.zeros(0, dtype=np.int64)
            if len(sym):
                rank[-1] = _FAR
                rank[np.flatnonzero(word[1:] != word[:-1])] = _FAR
        if not done:
            return [[] for _ in words]
        w, s, c = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(w, kind="stable")
        w, s, c = w[order], s[order], c[order]
        bounds = np.searchsorted(w, np.arange(len(words) + 1)).tolist()
        s, c, limit = s.tolist(), c.tolist(), len(self.pieces)
        out = []
        for i in range(len(words)):
            own: list[int] = []
            for k in range(bounds[i], bounds[i + 1]):
                if s[k] < limit:
                    own.append(s[k])
                else:
                    own += [self.bytes[b] for b in chr(c[k]).encode("utf-8", "replace")]
            out.append(own)
        return out

    def merge_long(self, word: str) -> list[int]:
        """Piece ids of one long word. Its pairs wait by rank; a round takes those of the least rank, merges them from the left and looks
        up only the pairs that are new, so a word costs its length and not its length for each rank."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars, inverse = np.unique(points, return_inverse=True)
        n = len(points)
        sym = np.append(np.array([self.symbol.get(chr(c), self.foreign) for c in chars], dtype=np.int64)[inverse], self.foreign)
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        rank, made = np.full(n + 1, _FAR), np.zeros(n + 1, dtype=np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at these places, which then wait for their turn."""
            rank[at], made[at] = self.look_up(sym[at], sym[after[at]])
            at = at[rank[at] != _FAR]
            by = at[np.lexsort((at, rank[at]))]
            r = rank[by]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for own in np.split(by, cuts) if len(by) else []:
                k = int(rank[own[0]])
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(ranks, k)
                waiting[k].append(own)

        look(np.arange(max(0, n - 1)))
        while ranks:
            k = heapq.heappop(ranks)
            parts = waiting.pop(k)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank[at] == k]
            if not len(at):
                continue
            every, nxt = at, after[at]
            if (nxt[:-1] == at[1:]).any():  # of overlapping ones every other, from the left
                run = np.concatenate([[True], nxt[:-1] != at[1:]])
                place = np.arange(len(at))
                skip = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 1
                at = at[~skip]
            if self.alone[made[at]].any():  # what one makes may rank above the others, which then wait
                front, behind = before[at], after[after[at]]
                left = np.where(front >= 0, sym[front], self.foreign)
                met = np.concatenate([[False], after[at[:-1]] == front[1:]])
                left[met] = made[at[np.flatnonzero(met) - 1]]
                above = np.minimum(self.look_up(left, made[at])[0], self.look_up(made[at], np.where(behind < n, sym[np.minimum(behind, n)], self.foreign))[0]) < k
                if above.any():
                    last = int(np.argmax(above)) + 1
                    if last < len(at):
                        waiting[k] = [every[every >= at[last]]]
                        heapq.heappush(ranks, k)
                    at = at[:last]
            gone = after[at]
            far = after[gone]
            sym[at] = made[at]
            sym[gone] = -1
            rank[gone] = _FAR
            after[at] = far
            before[far] = at
            front = before[at]
            fresh = np.unique(np.concatenate([at[far < n], front[front >= 0]]))
            rank[at] = _FAR
            look(fresh[after[fresh] < n])
        left = np.flatnonzero(sym[:n] >= 0)
        limit, out = len(self.pieces), []
        for s, c in zip(sym[left].tolist(), points[left].tolist(), strict=True):
            if s < limit:
                out.append(s)
            else:
                out += [self.bytes[b] for b in chr(c).encode("utf-8", "replace")]
        return out

    def run(self, n: int) -> list[int]:
        """Ids of n blanks that no letter follows: again and again the leftmost two neighbours that make a piece become it."""
        whole = max(0, n // self.longest - 2)  # these end as longest pieces, which merge with nothing
        left = [1] * (n - whole * self.longest)
        k = 0
        while k + 1 < len(left):
            if left[k] + left[k + 1] in self.blanks:
                left[k : k + 2] = [left[k] + left[k + 1]]
                k = max(0, k - 1)
            else:
                k += 1
        return [self.blanks[self.longest]] * whole + [self.blanks[x] for x in left]


class Codec:
    """A model with the words that it has met: their ids, those as text, and what they decode to."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.model, self.cache_words = Model(path), cache_words
        self.clear()

    def clear(self) -> None:
        self.row: dict[object, int] = {}
        self.flat = {x: np.zeros(1 << 16, dtype=t) for x, t in (("ids", np.int32), ("digits", np.uint8), ("text", np.uint8))}
        self.begin = {x: np.zeros(1 << 14, dtype=np.int64) for x in self.flat}
        self.length = {x: np.zeros(1 << 14, dtype=np.int64) for x in self.flat}
        self.used = dict.fromkeys(self.flat, 0)
        self.lone = np.zeros(1 << 14, dtype=np.int64)

    def _learn(self, keys: list, ids: list[list[int]]) -> None:
        m = self.model
        lone = [bool(x) and k[1] and x[0] == m.blanks[1] if isinstance(k, tuple) else False for k, x in zip(keys, ids, strict=True)]
        ids = [x[1:] if z else x for x, z in zip(ids, lone, strict=True)]
        parts = {
            "ids": [np.array(x, dtype=np.int32).tobytes() for x in ids],
            "digits": [b"".join([b"%d," % i for i in x]) for x in ids],
            "text": [b"".join([m.text[i] for i in x]) for x in ids],
        }
        first = len(self.row)
        while first + len(ids) > len(self.lone):
            self.lone = np.resize(self.lone, 2 * len(self.lone))
            for d in (self.begin, self.length):
                for x in d:
                    d[x] = np.resize(d[x], 2 * len(d[x]))
        self.lone[first : first + len(ids)] = lone
        for x, own in parts.items():
            flat = np.frombuffer(b"".join(own), dtype=self.flat[x].dtype)
            n = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // self.flat[x].itemsize
            while self.used[x] + len(flat) > len(self.flat[x]):
                self.flat[x] = np.resize(self.flat[x], 2 * len(self.flat[x]))
            self.begin[x][first : first + len(ids)] = self.used[x] + np.cumsum(n) - n
            self.length[x][first : first + len(ids)] = n
            self.flat[x][self.used[x] : self.used[x] + len(flat)] = flat
            self.used[x] += len(flat)
        self.row.update(zip([k[0] if isinstance(k, tuple) else k for k in keys], range(first, first + len(ids)), strict=True))

    def _rows(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the tables that make up the block's texts, in order, and where each text's rows start."""
        data, off = block.data, block.offsets
        split = (data == 0x20) | (data == 0x0A)
        inside = ~split
        starts = inside.copy()
        starts[1:] &= split[:-1]
        edges = off[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        starts[edges] = inside[edges]
        stops = inside.copy()
        stops[:-1] &= split[1:]
        stops[edges - 1] = inside[edges - 1]
        word, end, line = np.flatnonzero(starts), np.flatnonzero(stops) + 1, np.flatnonzero(data == 0x0A)
        full = np.flatnonzero(np.diff(off) > 0)  # a text's end is a place too: blanks may stand in front of it
        place = np.concatenate([word, line, off[full + 1]])
        kind = np.concatenate([np.zeros(len(word), np.int8), np.ones(len(line), np.int8), np.full(len(full), 2, np.int8)])
        doc = np.concatenate([np.searchsorted(off, word, side="right") - 1, np.searchsorted(off, line, side="right") - 1, full])
        last = np.maximum.accumulate(np.where(data != 0x20, np.arange(len(data)), -1)) if len(data) else np.zeros(0, dtype=np.int64)
        since = np.where(place > 0, last[np.maximum(place - 1, 0)] + 1, 0)
        blanks = place - np.maximum(since, off[doc])
        blanks += place - blanks == off[doc]  # the blank that is put in front of a text
        if len(word):
            prefixed = blanks[: len(word)] > 0
            codes, first = exact_groups(data, word, end, block.hashes(word, end))
            codes, pairs = pd.factorize(2 * codes + prefixed)
            raw, pre = data.tobytes(), (pairs % 2 == 1).tolist()
            at = first[pairs // 2]
            keys = [(b"\x01" if p else b"\x00") + raw[a:b] for a, b, p in zip(word[at].tolist(), end[at].tolist(), pre, strict=True)]
            if len(self.row) + len(keys) > self.cache_words:
                self.clear()
            known = [self.row.get(k, -1) for k in keys]
            new = [i for i, r in enumerate(known) if r < 0]
            if new:
                words = [(BLANK if pre[i] else "") + keys[i][1:].decode("utf-8", "replace") for i in new]
                self._learn([(keys[i], pre[i]) for i in new], self.model.merge(words))
                known = [self.row[k] for k in keys]
            own = np.array(known, dtype=np.int64)[codes]
            blanks[: len(word)] += np.where(prefixed, self.lone[own] - 1, 0)
        else:
            own = np.zeros(0, dtype=np.int64)
        needed = [f"run {n}" for n in np.unique(blanks[blanks > 0]).tolist()]
        if missing := [k for k in ["line", *needed] if k not in self.row]:
            self._learn(missing, [[self.model.bytes[10]] if k == "line" else self.model.run(int(k[4:])) for k in missing])
        element = np.concatenate([own, np.full(len(line), self.row["line"]), np.full(len(full), -1)])
        runs = np.full(len(place), -1)
        for n in np.unique(blanks[blanks > 0]).tolist():
            runs[blanks == n] = self.row[f"run {n}"]
        order = np.lexsort((kind != 2, place, doc))
        rows = np.stack([runs[order], element[order]], axis=1).ravel()
        docs = np.repeat(doc[order], 2)[rows >= 0]
        return rows[rows >= 0], np.searchsorted(docs, np.arange(block.rows + 1))

    def encode(self, block: Block, *, whole: bool = False) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For ``ids``, ``digits`` (decimal ids, a comma after each) and ``text`` (decoded, with the blank in front): all
        values of the block, and where each row's start."""
        raw = block.data.tobytes()
        odd = [i for i in range(block.rows) if _BLANK_BYTES in raw[block.offsets[i] : block.offsets[i + 1]]] if _BLANK_BYTES in raw else []
        if odd:  # blanks of their own: word by word
            return self._encode_odd(block, set(odd))
        rows, at = self._rows(block)
        out = {}
        for x in self.flat:
            n = self.length[x][rows]
            before = np.concatenate([[0], np.cumsum(n)])
            out[x] = (self.flat[x][ragged(self.begin[x][rows], n)], before[at])
        return out

    def _encode_odd(self, block: Block, odd: set[int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        got = {x: ([], [0]) for x in self.flat}
        for i in range(block.rows):
            data = block.data[block.offsets[i] : block.offsets[i + 1]]
            if i in odd:
                ids = self._by_word(data.tobytes().decode("utf-8", "replace"))
                one = {"ids": np.array(ids, dtype=np.int32), "digits": np.frombuffer(b"".join([b"%d," % k for k in ids]), dtype=np.uint8), "text": np.frombuffer(b"".join([self.model.text[k] for k in ids]), dtype=np.uint8)}
            else:
                one = {x: v[0] for x, v in self.encode(Block(data, np.array([0, len(data)]), 0)).items()}
            for x, v in one.items():
                got[x][0].append(v)
                got[x][1].append(got[x][1][-1] + len(v))
        return {x: (np.concatenate(v), np.array(at)) for x, (v, at) in got.items()}

    def _by_word(self, text: str) -> list[int]:
        m, out = self.model, []
        found = re.findall(f"({BLANK}*)([^{BLANK}\n]*)(\n?)", BLANK + text.replace(" ", BLANK))
        ids = iter(m.merge([BLANK * (len(b) > 0) + w for b, w, _ in found if w]))
        for b, w, line in found:
            own = next(ids) if w else []
            n = len(b) - (1 if w and b else 0)
            if w and b and own[0] == m.blanks[1]:
                own, n = own[1:], n + 1
            out += m.run(n) + own + ([m.bytes[10]] if line else [])
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text; with ``with_ids``
    also ids and decoded text.

    Null counts as empty (no ids, empty text). Texts and words of any length are encoded whole. Null doc_ids and repeated rows are carried through; an empty table gives none;
    other columns are ignored. No id begins or ends a text.
    """
    path = model or default_path()
    src = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for b in blocks(batch.column(1)):
                got = c.encode(b)
                ids, at = got["ids"]
                digits, d_at = got["digits"][0].tobytes(), got["digits"][1].tolist()
                text, t_at = got["text"][0].tobytes(), got["text"][1].tolist()
                decoded = [text[x + (text[x : x + 1] == b" ") : y] if y > x else b"" for x, y in zip(t_at[:-1], t_at[1:], strict=True)]
                cols = [
                    batch.column(0).slice(b.first_row, b.rows),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(digits[x : max(x, y - 1)]).hexdigest() for x, y in zip(d_at[:-1], d_at[1:], strict=True)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ]
                if with_ids:
                    cols += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array([x.decode("utf-8", "replace") for x in decoded])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
