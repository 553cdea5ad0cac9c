"""Exact copies by Patricia tries: of equal texts the row with the smallest doc_id stays.

Method: partitions by length and content hash insert whole normalised texts, byte for byte, into compressed radix tries whose terminal
nodes hold the smallest identifier and the number of rows. Within a partition texts come sorted by length and hash, so a trie is
closed between two keys once it holds ``TRIE_BYTES``; where a single key fills it (texts that collide), its largest subtrees are spilled: their
texts and all later ones with the same prefix go to another round, which has a trie for each prefix. Each task has a trie of its
own in front of the shuffle, which folds the copies that it meets, and the texts that make up more than a share of all rows
are folded once more in salted groups. Rows find their owner by the SHA-256 of the text, once tries have compared the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import lean, pick, shared_dir, written
from .textops import SPACE, blocks

#: Bytes of text that a trie holds.
TRIE_BYTES = 32 << 20
#: A text with more rows than this, and than one in ``HOT_SHARE`` of all, is folded in ``SALTS`` groups first; so there are at most ``HOT_SHARE`` such texts.
HOT_ROWS, HOT_SHARE, SALTS = 2_000, 10_000, 32


class Node:
    __slots__ = ("label", "below", "least", "count", "weight")

    def __init__(self, label: bytes):
        self.label, self.below = label, {}
        self.least: int | None = None
        self.count = 0
        self.weight = 0  # bytes of labels in this subtree


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A compressed radix trie of byte strings; terminal nodes hold the least identifier (None: an identifier that is null) and a count."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.spilled: list[bytes] = []  # prefixes whose texts belong to another round

    @property
    def bytes(self) -> int:
        return self.root.weight

    def away(self, text: bytes) -> bytes | None:
        """The spilled prefix that ``text`` starts with."""
        return next((p for p in self.spilled if text.startswith(p)), None)

    def add(self, text: bytes, least: int | None, count: int) -> None:
        path, node, at = [self.root], self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.below[text[at]] = child
                node, at = child, len(text)
                path.append(child)
                for x in path:
                    x.weight += len(child.label)
                break
            n = len(child.label)
            if text[at : at + n] != child.label:
                k = common(child.label, text[at : at + n])
                upper = Node(child.label[:k])
                upper.weight = child.weight
                child.label = child.label[k:]
                child.weight -= k
                upper.below[child.label[0]] = child
                node.below[text[at]] = upper
                child, n = upper, k
            node, at = child, at + n
            path.append(node)
        if node.count:
            node.least = _less(node.least, least)
        else:
            node.least = least
        node.count += count

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            x, before = stack.pop()
            text = before + x.label
            if x.count:
                yield text, x.least, x.count
            stack += [(y, text) for y in x.below.values()]

    def spill(self) -> list[tuple[bytes, bytes, int | None, int]]:
        """Take out the heaviest subtree below the first branching: (prefix, text, least, count) of its texts; none if nothing branches."""
        node, before = self.root, b""
        above = [node]
        while len(node.below) == 1 and not node.count:
            before += node.label
            node = next(iter(node.below.values()))
            above.append(node)
        if not node.below:
            return []
        before += node.label
        first, child = max(node.below.items(), key=lambda x: x[1].weight)
        prefix = before + child.label
        if not child.below:
            prefix = before + child.label[:1]  # a leaf: what else begins so follows it
        del node.below[first]
        for x in above:
            x.weight -= child.weight
        self.spilled.append(prefix)
        return [(prefix, *t) for t in self.terminals(child, before)]


def _less(a: int | None, b: int | None) -> int | None:
    """The smaller of two identifiers; null only where there is no other."""
    return b if a is None else a if b is None else min(a, b)


def normalised(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Texts with each run of white space replaced by one space."""
    space = SPACE[data]
    out = np.where(space, np.uint8(0x20), data)
    again = np.zeros(len(data), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    edges = offsets[1:-1]
    again[edges[edges < len(data)]] = False
    keep = ~again
    sums = np.concatenate([[0], np.cumsum(keep)])
    raw, at = out[keep].tobytes(), sums[offsets].tolist()
    return [raw[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def _digests(src: DataFrame) -> DataFrame:
    """doc_id, sha (of the normalised text) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                sha = [hashlib.sha256(t).digest() for t in normalised(b.data, b.offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first_row, b.rows), pa.array(sha, pa.binary())], ["doc_id", "sha"])

    return src.mapInArrow(lean(run), "doc_id long, sha binary")


_ROWS = "size long, hash binary, salt int, prefix binary, text binary, least long, n long, round int"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])


def _sliced(rows: Iterator[tuple], least: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``least`` bytes of text."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4]) + 64
        if size >= least:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _folded(src: DataFrame, hot: frozenset[bytes], trie_bytes: int, hash_bytes: int) -> DataFrame:
    """Texts of each task, copies folded as far as its trie reaches; hot texts get the task's salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS + 1

        def rows(t: Trie) -> Iterator[tuple]:
            for text, least, n in t.terminals():
                sha = hashlib.sha256(text).digest()
                yield len(text), sha[:hash_bytes], salt if sha in hot else 0, b"", text, least, n, 0

        t = Trie()
        for batch in batches:
            for b in blocks(batch.column(1)):
                ids = batch.column(0).slice(b.first_row, b.rows).to_pylist()
                for i, text in zip(ids, normalised(b.data, b.offsets), strict=True):
                    t.add(text, i, 1)
                if t.bytes > trie_bytes // 2:
                    yield from _sliced(rows(t))
                    t = Trie()
        yield from _sliced(rows(t))

    return src.mapInArrow(lean(run), _ROWS)


def _owners(rows: DataFrame, trie_bytes: int, hash_bytes: int) -> DataFrame:
    """Texts of each (size, hash, salt, prefix) through tries. A row for each text with its whole SHA-256 (and the text where it is
    salted), and with ``round`` 1 rows that another round has to fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, at = Trie(), None

        def closed() -> Iterator[tuple]:
            for text, least, n in t.terminals():
                yield len(text), hashlib.sha256(text).digest(), at[2], b"", text if at[2] else b"", least, n, 0

        def results() -> Iterator[tuple]:
            nonlocal t, at
            for batch in batches:
                for size, h, salt, prefix, text, least, n, _ in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                    key = (size, h, salt, prefix)
                    if at is not None and key != at and (t.spilled or 2 * t.bytes > trie_bytes or salt != at[2]):
                        yield from closed()
                        t = Trie()
                    at = key
                    if p := t.away(text):
                        yield size, h, salt, _short(p), text, least, n, 1
                        continue
                    t.add(text, least, n)
                    while t.bytes > trie_bytes and (found := t.spill()):
                        for p, x, i, k in found:
                            yield len(x), hashlib.sha256(x).digest()[:hash_bytes], salt, _short(p), x, i, k, 1
            if at is not None:
                yield from closed()

        yield from _sliced(results())

    key = ["size", "hash", "salt", "prefix"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(run), _ROWS)


def _short(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES, hash_bytes: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per row: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 (of the normalised text, lower-case hex).

    Texts are equal when identical after replacing each run of white space by one space; null counts as empty. Ids are whole numbers;
    null ids lose against any other, and of repeated rows (equal id and text) one is kept. Texts of any length are compared whole;
    an empty table gives none; other columns are ignored. ``trie_bytes``, ``hash_bytes`` and ``hot_rows`` only say how the work is cut.
    """
    spark, under = docs.sparkSession, shared_dir(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    digests = written(_digests(src), "digests", under)
    many = max(hot_rows, digests.count() // HOT_SHARE)
    hot = [bytes(r.sha) for r in digests.groupBy("sha").count().where(F.col("count") > many).select("sha").collect()]  # HOT_SHARE rows at most
    todo, owners, k = _folded(src, frozenset(hot), trie_bytes, hash_bytes), None, 0
    while True:
        found = written(_owners(todo, trie_bytes, hash_bytes), f"tries{k}", under)
        own = found.where("round = 0 and salt = 0").select(F.col("hash").alias("sha"), F.col("least").alias("keep_id"), F.col("n").alias("group_size"))
        owners = own if owners is None else owners.unionAll(own)
        rest = found.where("round = 1 or salt > 0")
        if rest.isEmpty():
            break
        again = F.col("round") == 1
        todo = rest.select("size", F.when(again, F.col("hash")).otherwise(F.substring("hash", 1, hash_bytes)).alias("hash"), F.when(again, F.col("salt")).otherwise(0).alias("salt"), "prefix", "text", "least", "n", "round")
        k += 1
    rows = digests.groupBy("doc_id", "sha").agg(F.count("*").alias("_rows"))
    if hot:
        rows = written(rows, "rows", under)
        few = F.broadcast(spark.createDataFrame([(x,) for x in hot], "sha binary"))
        big = F.broadcast(owners.join(few, "sha", "left_semi"))  # HOT_SHARE rows at most
        met = rows.join(big, "sha").unionByName(rows.join(few, "sha", "left_anti").join(owners, "sha"))
    else:
        met = rows.join(owners, "sha")
    each = met.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
