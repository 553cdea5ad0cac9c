"""Importance resampling towards a target distribution, over hashed word n-grams.

Method: features are all runs of one to three words, hashed to buckets by CRC-32; a bucket's gain is the log ratio of its shares in
target and corpus, a document's weight the sum over its features, and Gumbel noise on top makes the highest scores a sample
without replacement. Texts beyond ``LONG_BYTES`` are skewed work: they are cut at word boundaries into chunks that own their
starting positions and carry the n-1 words behind them, so no feature is lost or counted twice; chunks are dealt out over all
tasks, and counts and weights summed by document. Bucket counts are summed in each task before they are shuffled.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import lean, pick, written
from .textops import Block, blocks, ragged

BUCKETS = 10_000
#: Words of the longest feature.
ORDER = 3
#: Texts of more bytes are cut into chunks of about so many.
LONG_BYTES = 1 << 16
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Lower-cased letters, digits and all bytes beyond ASCII are parts of words; everything else separates.
_WORD = np.full(256, 0x20, dtype=np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD[_b] = _b
_WORD[0x41:0x5B] = _WORD[0x61:0x7B]

U32 = np.uint32
#: Longer words are hashed by zlib one by one.
_MOST = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & U32(1), (c >> U32(1)) ^ U32(0xEDB88320), c >> U32(1))
    return c


_T = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: byte b at place k of a CRC after n zero bytes; a CRC of two parts is the first one's, moved so, xor the second's."""
    out = np.empty((_MOST + 2, 4, 256), dtype=U32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=U32) << U32(8 * k)
    for n in range(_MOST + 1):
        out[n + 1] = _T[out[n] & U32(0xFF)] ^ (out[n] >> U32(8))
    return out


_SHIFT = _shift_tables()


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _SHIFT[n, 0, crc & U32(0xFF)] ^ _SHIFT[n, 1, (crc >> U32(8)) & U32(0xFF)] ^ _SHIFT[n, 2, (crc >> U32(16)) & U32(0xFF)] ^ _SHIFT[n, 3, crc >> U32(24)]


_BLANK_CRC = U32(zlib.crc32(b" "))


class Words:
    """The words of a block with their CRC-32s, and those of runs of words joined by one space."""

    def __init__(self, block: Block):
        self.data = _WORD[block.data]
        self.starts, self.ends, self.at = Block(self.data, block.offsets, 0).words()
        self.size = self.ends - self.starts
        self.crc = np.zeros(len(self.starts), dtype=U32)
        self.long = self.size > _MOST
        order = np.argsort(-np.where(self.long, 0, self.size), kind="stable")
        sizes = np.where(self.long, 0, self.size)[order]
        if len(order):
            counts = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # words longer than each place
            c, first = np.full(len(order), 0xFFFFFFFF, dtype=U32), self.starts[order]
            for p, n in enumerate(counts.tolist()):
                c[:n] = _T[(c[:n] ^ self.data[first[:n] + p]) & U32(0xFF)] ^ (c[:n] >> U32(8))
            self.crc[order] = ~c
        for i in np.flatnonzero(self.long).tolist():
            self.crc[i] = zlib.crc32(self.data[self.starts[i] : self.ends[i]])
        short = np.where(self.long, 0, self.size)
        #: Of each word with a space in front.
        self.spaced = self.crc ^ _moved(np.full(len(short), _BLANK_CRC, dtype=U32), short)

    def longer(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRCs of runs (given theirs) with one more word."""
        out = _moved(crc, np.where(self.long[word], 0, self.size[word] + 1)) ^ self.spaced[word]
        for i in np.flatnonzero(self.long[word]).tolist():
            w = word[i]
            out[i] = zlib.crc32(self.data[self.starts[w] : self.ends[w]], zlib.crc32(b" ", int(crc[i])))
        return out


def features(block: Block, own: np.ndarray | None = None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each feature, the row of each, and words by row. ``own``: how many words of each row start features (default: all)."""
    words = Words(block)
    n = np.diff(words.at)
    own = n if own is None else own
    pos, row = ragged(words.at[:-1], own), np.repeat(np.arange(block.rows), own)
    limit = words.at[1:][row]
    crcs, rows = [words.crc[pos]], [row]
    crc = crcs[0]
    for k in range(1, order):
        inside = pos + k < limit
        pos, row, limit = pos[inside], row[inside], limit[inside]
        crc = words.longer(crc[inside], pos + k)
        crcs.append(crc), rows.append(row)
    return np.concatenate(crcs), np.concatenate(rows), n


def _chunks(docs: DataFrame, order: int, chunk_bytes: int) -> DataFrame:
    """Chunks of long texts (doc_id, key: a digest of the text, seq, own: starting words, part), dealt out over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in ((i, b) for i in range(batch.num_rows) for b in blocks(batch.column(1).slice(i, 1))):
                starts, ends, _ = Block(_WORD[b.data], b.offsets, 0).words()
                raw, key = b.data.tobytes(), hashlib.blake2b(b.data, digest_size=16).digest()
                first, cuts = 0, [0]
                while first < len(starts):
                    first = max(first + 1, int(np.searchsorted(starts, starts[first] + chunk_bytes)))
                    cuts.append(first)
                for lo in range(0, max(1, len(cuts) - 1), 16):
                    pairs = list(zip(cuts[lo:-1], cuts[lo + 1 :], strict=True))[:16] or [(0, 0)]
                    parts = [raw[starts[x] : ends[min(y + order - 2, len(ends) - 1)]] if y else b"" for x, y in pairs]
                    k = len(pairs)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1).take(pa.array([0] * k)), pa.array([key] * k, pa.binary()), pa.array(range(lo, lo + k), pa.int32()), pa.array([y - x for x, y in pairs], pa.int64()), pa.array(parts, pa.binary())],
                        ["doc_id", "key", "seq", "own", "part"],
                    )

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, seq int, own long, part binary").repartition("key", "seq")


def _counts(frame: DataFrame, text: int, own: int | None, order: int, buckets: int) -> DataFrame:
    """Feature counts by bucket, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in blocks(batch.column(text)):
                crc, _, _ = features(b, None if own is None else batch.column(own).to_numpy()[b.first_row : b.first_row + b.rows], order)
                total += np.bincount(crc % U32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    return frame.mapInArrow(lean(run), "bucket int, n long")


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, long_bytes: int = LONG_BYTES) -> np.ndarray:
    """How many features of all texts (columns doc_id, text) fall into each bucket."""
    size = F.octet_length("text")
    short, long = docs.where(size <= long_bytes), docs.where(size > long_bytes)
    found = _counts(short, 1, None, order, buckets).unionAll(_counts(_chunks(long, order, long_bytes), 4, 3, order, buckets))
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln(ratio of shares)) of each bucket, one added to every count."""
    k, s, t = len(target), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(a) + 1) * (s + k) / ((float(b) + 1) * (t + k)))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], dtype=np.int64)


def _weights(frame: DataFrame, text: int, own: int | None, keep: list[str], gain: np.ndarray, order: int) -> DataFrame:
    """Of each row: ``keep``, n_words (that start features), n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(text)):
                mine = None if own is None else batch.column(own).to_numpy()[b.first_row : b.first_row + b.rows]
                crc, row, n = features(b, mine, order)
                at = np.argsort(row, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[crc[at] % U32(len(gain))])])
                ends = np.cumsum(np.bincount(row, minlength=b.rows))
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(b.first_row, b.rows) for i in range(len(keep))), pa.array(n if mine is None else mine), pa.array(ends - starts), pa.array(sums[ends] - sums[starts])], [*keep, "n_words", "n_features", "weight"]
                )

    types = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(lean(run), f"{types}, n_words long, n_features long, weight long")


def weighted(docs: DataFrame, gain: np.ndarray, order: int = ORDER, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of ``docs`` (doc_id, text).

    Equal long rows share the key that their chunks are summed by; they are told apart again by their number.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = _weights(docs.where(size <= long_bytes), 1, None, ["doc_id"], gain, order)
    chunks = _weights(_chunks(docs.where(size > long_bytes), order, long_bytes).select("doc_id", "key", "seq", "own", "part"), 4, 3, ["doc_id", "key", "seq"], gain, order)
    sums = chunks.groupBy("doc_id", "key").agg(F.count_if(F.col("seq") == 0).alias("_rows"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    whole = sums.select("doc_id", *[F.expr(f"{c} div _rows").alias(c) for c in ("n_words", "n_features", "weight")], F.explode(F.sequence(F.lit(1), "_rows"))).drop("col")
    return short.unionAll(whole)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``place`` 1, 2, 3... by score descending, then doc_id: sorted by ranges, whose sizes give the rows before each."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    sort = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, part, dtype=np.int32)), pa.array(np.arange(row + 1, row + k + 1))], [*batch.schema.names, "_part", "_row"])
            row += k

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = written(sort.mapInArrow(lean(run), f"{types}, _part int, _row long"), "ranked")
    sizes = found.groupBy("_part").count().orderBy("_part").collect()  # a row for each range
    before, table = 0, []
    for r in sizes:
        table.append((r["_part"], before))
        before += r["count"]
    parts = rows.sparkSession.createDataFrame(table, "_part int, _before long")
    return found.join(F.broadcast(parts), "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED, long_bytes: int = LONG_BYTES, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank (1 is the highest score; null if not drawn) and n_words.

    ``percent`` of the documents with at least ``least_words`` words are drawn, the highest scores, ties by the smaller doc_id (null
    last). Null and empty texts have no features and weight 0; a null id's noise is that of an empty one; repeated rows are
    documents of their own, each with its rank; texts of any length are read whole; an empty table gives none, and an empty
    target weighs by the corpus alone; other columns are ignored.
    """
    src, aim = pick(docs, doc_id=id_col, text=text_col), pick(target, text=target_col).select(F.lit(0).alias("doc_id"), "text")
    gain = gains(bucket_counts(aim, order, buckets, long_bytes), bucket_counts(src, order, buckets, long_bytes))
    scored = written(weighted(src, gain, order, long_bytes).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = _numbered(able).select(*out, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"), "n_words")
    return ranked.unionAll(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"), "n_words"))


def drawn_documents(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn, with all their columns and ``rank``; ids must be unique, as rows are told apart by them."""
    picked = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("_drawn"), "rank")
    return docs.join(picked, docs["doc_id"] == picked["_drawn"]).drop("_drawn")
