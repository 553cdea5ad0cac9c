"""Content-addressed store of token ids.

Method: a rolling hash over the last ``WINDOW`` ids cuts each document's id stream where its low bits are zero, so equal passages
give equal chunks. A chunk is stored once, under the BLAKE2b digest of its bytes. A document's recipe lists its chunks' digests;
Merkle roots of documents, of recipe parts and of the store verify a reconstruction.

Files, all Parquet: ``kind=chunk`` (digest, ids as little-endian unsigned 32-bit or 16-bit integers), ``recipes`` (documents in ascending
order of doc_id, with where their ids start) and ``manifest`` (part, documents, tokens, Merkle root, and the store's root).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import lean, pick
from .textops import U64, blocks, mix, strings
from .wordpiece import crc32, default_path, encoder

END_ID = 2
#: Ids that the rolling hash looks at; a power of two.
WINDOW = 16
LEAST, MEAN, MOST = 64, 512, 2048
DIGEST = 16


def cut_points(ids: np.ndarray, at: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each stream; ``at`` has where the streams start. They depend on the stream's own ids alone."""
    h = (mix(ids.astype(U64) + U64(1)) >> U64(32)).astype(np.uint32)
    k = 1
    while k < WINDOW:  # after each round h covers twice as many ids
        more = np.zeros_like(h)
        more[k:] = h[:-k] << np.uint32(k) if len(h) > k else 0
        h = h + more
        k *= 2
    hits = np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean - least) == 0) + 1
    ends: list[list[int]] = []
    bounds = np.searchsorted(hits, at)
    hits = hits.tolist()
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        own, last = [], lo
        for c in hits[bounds[i] : bounds[i + 1]]:
            if c - last < least or c - lo < WINDOW:
                continue
            while c - last > most:
                last += most
                own.append(last)
            if c - last >= least or c == hi:
                own.append(c)
                last = c
        while hi - last > most:
            last += most
            own.append(last)
        if hi > last:
            own.append(hi)
        ends.append(own)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; an odd node moves up as it is; no leaves: zeros."""
    level = leaves or [bytes(DIGEST)]
    while len(level) > 1:
        level = [blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def digest(body: bytes) -> bytes:
    return blake2b(b"\0" + body, digest_size=DIGEST).digest()


def _crc_shift(crc: int, matrix: list[int]) -> int:
    out = 0
    while crc:
        low = crc & -crc
        out ^= matrix[low.bit_length() - 1]
        crc ^= low
    return out


_shifts: dict[int, list[int]] = {}


def _shift_matrix(k: int) -> list[int]:
    """What 2**k zero bytes do to each bit of a CRC-32."""
    if k not in _shifts:
        if k == 0:
            one = [0xEDB88320, *[1 << i for i in range(31)]]  # a zero bit
            for _ in range(3):
                one = [_crc_shift(x, one) for x in one]
            _shifts[0] = one
        else:
            half = _shift_matrix(k - 1)
            _shifts[k] = [_crc_shift(x, half) for x in half]
    return _shifts[k]


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two parts from theirs."""
    k = 0
    while second_bytes:
        if second_bytes & 1:
            first = _crc_shift(first, _shift_matrix(k))
        second_bytes >>= 1
        k += 1
    return first ^ second


def _cut(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Chunk rows (key: digest; those of a task without its repeats) and recipe rows (key: the row's place) of one pass."""
    src = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, row = encoder(path), TaskContext.get().partitionId(), 0
        seen: set[bytes] = set()
        for batch in batches:
            for b in blocks(batch.column(1)):
                ids, at = enc.encode_with_end(b, end_id)
                wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
                raw = ids.astype("<u4" if wide else "<u2").tobytes()
                size = 4 if wide else 2
                keys, kinds, body, names, counts, recipes = [], [], [], [], [], []
                doc_ids = batch.column(0).slice(b.first_row, b.rows).to_pylist()
                for i, ends in enumerate(cut_points(ids, at)):
                    lo, own = int(at[i]), []
                    for hi in ends:
                        piece = raw[lo * size : hi * size]
                        d = digest((b"4" if wide else b"2") + piece)
                        own.append(d)
                        if d not in seen:
                            seen.add(d)
                            keys.append(d), kinds.append("chunk"), body.append(piece), names.append(None), counts.append(size), recipes.append(None)
                        lo = hi
                    keys.append(b"r" + part.to_bytes(8, "big") + row.to_bytes(8, "big"))
                    kinds.append("recipe"), body.append(None), names.append(doc_ids[i]), counts.append(int(at[i + 1] - at[i])), recipes.append(b"".join(own))
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(kinds, pa.string()), pa.array(body, pa.binary()), pa.array(names, pa.int64()), pa.array(counts, pa.int64()), pa.array(recipes, pa.binary())],
                    ["key", "kind", "body", "doc_id", "n", "recipe"],
                )

    return src.mapInArrow(lean(run), "key binary, kind string, body binary, doc_id long, n long, recipe binary")


def _once(cut: DataFrame) -> DataFrame:
    """One row for each key. Tasks have dropped their own repeats, so a key comes once from each task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            keep = [x != y for x, y in zip(keys, [last, *keys[:-1]], strict=True)]
            last = keys[-1] if keys else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), cut.schema)


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the store under ``path``.

    Null text counts as empty (its stream is the end id); texts of any length are cut whole. Ids are whole numbers, others are an
    error. Null ids sort first, equal ids by their content, repeated rows are
    documents of their own; an empty table gives a store without documents; other columns are ignored.
    """
    spark = docs.sparkSession
    _once(_cut(docs, tokenizer or default_path(), end_id)).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    rows = _read(spark, path, "recipe").select("doc_id", F.col("n").alias("n_tokens"), "recipe")
    ordered = rows.repartitionByRange("doc_id", "recipe").sortWithinPartitions("doc_id", "recipe")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = total + np.cumsum(n) - n
            roots = [merkle([r[i : i + DIGEST] for i in range(0, len(r), DIGEST)]) for r in batch.column(2).to_pylist()]
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, part), pa.int32()), pa.array(np.arange(row, row + k)), batch.column(0), batch.column(1), pa.array(before, pa.int64()), batch.column(2), pa.array(roots, pa.binary())],
                ["part", "row", "doc_id", "n_tokens", "start_in_part", "recipe", "root"],
            )
            row, total = row + k, total + int(n.sum())

    ordered.mapInArrow(lean(numbered), "part int, row long, doc_id long, n_tokens long, start_in_part long, recipe binary, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for p, r, n, root in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                found.setdefault(p, []).append((r, n, root))
        for p, own in found.items():
            own.sort()
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "documents": [len(own)], "tokens": [sum(x[1] for x in own)], "root": pa.array([merkle([x[2] for x in own])], pa.binary())})

    parts = spark.read.parquet(f"{path}/recipes").select("part", "row", "n_tokens", "root").repartition("part").mapInArrow(lean(roots), "part int, documents long, tokens long, root binary").orderBy("part").collect()  # a row for each recipe file
    before, lines, whole = 0, [], merkle([bytes(p.root) for p in parts])
    for p in parts:
        lines.append((p.part, p.documents, p.tokens, before, bytes(p.root), whole))
        before += p.tokens
    spark.createDataFrame(lines, "part int, documents long, tokens long, tokens_before long, root binary, store_root binary").coalesce(1).write.parquet(f"{path}/manifest")


_DATA = "key binary, body binary, doc_id long, n long, recipe binary, kind string"


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_DATA).parquet(f"{path}/data").where(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema("part int, row long, doc_id long, n_tokens long, start_in_part long, recipe binary, root binary").parquet(f"{path}/recipes")
    m = spark.read.schema("part int, documents long, tokens long, tokens_before long, root binary, store_root binary").parquet(f"{path}/manifest").select("part", "tokens_before")
    return r.join(m, "part").select("part", "row", "doc_id", "n_tokens", (F.col("tokens_before") + F.col("start_in_part")).alias("start"), "recipe", "root")  # Spark broadcasts the manifest if its size allows


def _references(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe: the document's place, the chunk's place in it, its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = strings(batch.column(2))
            n = np.diff(off) // DIGEST
            keys = pa.Array.from_buffers(pa.binary(DIGEST), int(n.sum()), [None, pa.py_buffer(raw[off[0] : off[-1]].tobytes())]).cast(pa.binary())
            seq = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            idx = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(idx), batch.column(1).take(idx), pa.array(seq, pa.int32()), keys], ["part", "row", "seq", "key"])

    return recipes.select("part", "row", "recipe").mapInArrow(lean(run), "part int, row long, seq int, key binary")


def _facts(chunks: DataFrame) -> DataFrame:
    """Read every stored chunk: does its content have its address, its number of ids, and their CRC-32 as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            raw, off = strings(batch.column(1))
            off = off.tolist()
            good, n, crc = [], [], []
            for i, (k, size) in enumerate(zip(keys, sizes.tolist(), strict=True)):
                body = raw[off[i] : off[i + 1]].tobytes()
                ids = np.frombuffer(body, dtype="<u4" if size == 4 else "<u2")
                good.append(digest((b"4" if size == 4 else b"2") + body) == k)
                n.append(len(ids)), crc.append(crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.bool_()), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["key", "good", "n", "crc"])

    return chunks.select("key", "body", "n").mapInArrow(lean(run), "key binary, good boolean, n int, crc long")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and ``verified`` (all chunks present and true to their
    addresses, the recipe true to its Merkle root).

    Every chunk is read and hashed once, where it lies; documents are then put together from the CRCs of their chunks in
    recipe order, so bodies aren't shuffled and a chunk that all documents share is read once.
    """
    recipes = _recipes(spark, path)
    refs = _references(recipes).join(_facts(_read(spark, path, "chunk")), "key", "left")
    own = refs.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc", "good", "key"))).alias("chunks"))
    lines = recipes.select("part", "row", "doc_id", "start", "n_tokens", "root").join(own, ["part", "row"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, n, crc = [], [], []
            lists = batch.column(4)
            at = lists.offsets.to_numpy()
            flat = lists.values
            c_n, c_crc = flat.field(1).fill_null(0).to_numpy(zero_copy_only=False).tolist(), flat.field(2).fill_null(0).to_numpy(zero_copy_only=False).tolist()
            c_good, c_key = flat.field(3).fill_null(False).to_pylist(), flat.field(4).to_pylist()
            for i, root in enumerate(batch.column(3).to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                total, joined = 0, 0
                for k in range(a, b):
                    joined = crc32_join(joined, c_crc[k], 4 * c_n[k]) if total else c_crc[k]
                    total += c_n[k]
                n.append(total), crc.append(joined)
                good.append(all(c_good[a:b]) and merkle(c_key[a:b]) == root)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.array(good, dtype=bool) & (np.array(n) == batch.column(2).to_numpy()))], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return lines.select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their whole id streams (doc_id, start, ids), rebuilt from recipes and chunks."""
    recipes = _recipes(spark, path)
    refs = _references(recipes).join(_read(spark, path, "chunk").select("key", "body", "n"), "key")
    own = refs.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "body"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(c["body"], dtype="<u4" if c["n"] == 4 else "<u2") for c in x]).astype(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    lines = recipes.select("part", "row", "doc_id", "start").join(own, ["part", "row"])
    return lines.select("doc_id", "start", "chunks").mapInArrow(lean(run), "doc_id long, start long, ids array<int>")
