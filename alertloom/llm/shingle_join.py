"""Near-duplicate texts: Jaccard join of word shingles with Bayesian candidate pruning.

Method: texts of the same words are one class. Each class has a signature of ``HASHES`` minimum hashes; classes that agree in
all hashes of a band meet there. Their signatures are compared a part at a time, and a pair is dropped when the posterior
probability that its similarity reaches the threshold (uniform prior, binomial agreement) falls below ``TOLERANCE``. What is
left groups classes by likely links; inside a group every pair's exact Jaccard similarity is computed from whole shingle
sets, in blocks. Two texts of similarity 0.8 share no band with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.operators.components import connected_components

from .frames import Forest, block_count, block_tasks, by_place, lean, pick, released, shared_dir, sorted_groups, written
from .textops import U64, blocks, mix, shingles, strings

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
#: Numbers of hashes after which pairs are judged.
STEPS = (36, 72, 126, HASHES)
#: Classes of a block when a band or a group holds more.
BAND_BLOCK, GROUP_BLOCK = 2048, 1024

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def least_agreement(n: int, threshold: float = LEAST, tolerance: float = TOLERANCE) -> int:
    """The fewest of n hashes that must agree for P(similarity >= threshold) to reach the tolerance."""
    total = 0.0
    for m in range(n + 1):  # the posterior Beta(m + 1, n - m + 1) exceeds t with the probability that Bin(n + 1, t) is at most m
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_NEEDED = [least_agreement(n) for n in STEPS]


def _signatures(docs: DataFrame) -> DataFrame:
    """uid, digest of the text's words in order, number of shingles, and the upper halves of its minimum hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, at = shingles(b, WORDS)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((b.rows, HASHES), dtype=np.uint16)
                digest = np.zeros((b.rows, 2), dtype=U64)
                if len(full):
                    start = at[:-1][full]
                    x = (h >> U64(32)).astype(np.uint32)
                    for k in range(HASHES):
                        sig[full, k] = np.minimum.reduceat(x * _A[k] + _B[k], start) >> np.uint32(16)
                    place = (np.arange(len(h)) - np.repeat(at[:-1], n)).astype(U64)
                    with np.errstate(over="ignore"):
                        for k in range(2):
                            digest[full, k] = np.add.reduceat(mix(h + mix(place + U64(k << 40 | 1))), start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first_row, b.rows), pa.array([r.tobytes() for r in digest], pa.binary()), pa.array(n.astype(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["uid", "digest", "n", "sig"],
                )

    return docs.select("uid", "text").mapInArrow(lean(run), "uid long, digest binary, n long, sig binary")


def _bands(rows: DataFrame) -> DataFrame:
    """A row (key, node) for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, off = strings(batch.column(1))
            sig = raw[off[0] : off[-1]].view(np.uint16).reshape(-1, BANDS, ROWS).astype(U64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(1, BANDS + 1).astype(U64), sig.shape[:2])
                for r in range(ROWS):
                    key = mix(key * U64(0x100000001B3) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))], ["key", "node"])

    return rows.select("node", "sig").mapInArrow(lean(run), "key long, node long")


def agree(sig: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows that no step drops."""
    step = STEPS[0]
    part = max(1, (1 << 22) // max(1, len(other) * step))
    left, right = [], []
    for a in range(0, len(sig), part):
        same = (sig[a : a + part, None, :step] == other[None, :, :step]).sum(axis=2)
        i, j = np.nonzero(same >= _NEEDED[0])
        count = same[i, j]
        for before, after, needed in zip(STEPS[:-1], STEPS[1:], _NEEDED[1:], strict=True):
            count = count + (sig[a + i, before:after] == other[j, before:after]).sum(axis=1)
            keep = count >= needed
            i, j, count = i[keep], j[keep], count[keep]
        left.append(a + i), right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _likely(tasks: DataFrame) -> DataFrame:
    """Likely links that join trees, from bands' blocks (key, i, j, own, node, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        src: list[int] = []
        dst: list[int] = []
        for g in sorted_groups(batches, 3):
            i, j = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            own, node = g.column(3).to_numpy(), g.column(4).to_numpy()
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(a) or not len(b) or len(node) < 2:
                continue
            roots = {forest.root(x) for x in node.tolist()}
            if len(roots) == 1:  # all of them are known to belong together
                continue
            sig = np.stack([np.frombuffer(s, dtype=np.uint16) for s in g.column(5).to_pylist()])
            for x, y in zip(*agree(sig[a], sig[b]), strict=True):
                s, t = int(node[a[x]]), int(node[b[y]])
                if s != t and forest.join(s, t):
                    src.append(s), dst.append(t)
            if len(src) > 50_000:
                yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})
                src, dst = [], []
        yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return tasks.mapInArrow(lean(run), "src long, dst long")


def _sets(texts: DataFrame) -> DataFrame:
    """The set of shingle hashes of each text, as bytes (component, node, copies, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(3)):
                h, at = shingles(b, WORDS)
                out = [np.unique(h[x:y]).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(b.first_row, b.rows) for k in range(3)), pa.array(out, pa.binary())], ["component", "node", "copies", "set"])

    return texts.mapInArrow(lean(run), "component long, node long, copies long, set binary")


def exact_links(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray, least: float = LEAST) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``rows`` which of ``others`` have a Jaccard similarity of ``least`` or more with it."""
    codes, uniques = pd.factorize(np.concatenate(sets))
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate([codes[at[o] : at[o + 1]] for o in others.tolist()])
    starts = np.concatenate([[0], np.cumsum(size[others])[:-1]])
    mark = np.zeros(len(uniques), dtype=np.int32)
    for r in rows.tolist():
        own = codes[at[r] : at[r + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        yield r, others[both >= least * (size[r] + size[others] - both) - 1e-9]


def _exact(tasks: DataFrame) -> DataFrame:
    """Exact links of groups' blocks: rows (node, other null, links: copies of linked classes) and tree links (node, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 3):
            i, j = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            own, node, copies = (g.column(k).to_numpy() for k in (3, 4, 5))
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(a) or not len(b):
                continue
            sets = [np.frombuffer(s, dtype=U64) for s in g.column(6).to_pylist()]
            links, forest = np.zeros(len(node), dtype=np.int64), Forest()
            src, dst = [], []
            for r, hit in exact_links(sets, a, b):
                hit = hit[hit != r]
                links[r] += copies[hit].sum()
                if i != j:
                    links[hit] += copies[r]
                for t in node[hit].tolist():
                    if forest.join(int(node[r]), t):
                        src.append(int(node[r])), dst.append(t)
            k = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*node[k].tolist(), *src], pa.int64()), pa.array([*[None] * len(k), *dst], pa.int64()), pa.array([*links[k].tolist(), *[None] * len(src)], pa.int64())],
                ["node", "other", "links"],
            )

    return tasks.mapInArrow(lean(run), "node long, other long, links long")


def _likely_groups(members: DataFrame, signatures: DataFrame, base: str) -> DataFrame:
    reps = signatures.join(members.where("uid = node and n > 0").select("uid"), "uid").select(F.col("uid").alias("node"), "sig")
    bands = written(_bands(reps), "bands", base)
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    meeting = written(bands.join(sizes, "key"), "meeting", base)
    released(members.sparkSession)
    tasks = block_tasks(meeting.join(reps.join(meeting.select("node").distinct(), "node"), "node"), "node", F.ceil(F.col("size") / F.lit(BAND_BLOCK)).cast("int"))
    rows = tasks.select("key", "i", "j", "own", "node", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    likely = written(_likely(rows), "likely", base)
    released(members.sparkSession)
    return connected_components(likely)


def _exact_links(keyed: DataFrame, members: DataFrame, groups: DataFrame, base: str) -> DataFrame:
    wanted = groups.join(members.where("uid = node").select("node", "copies"), "node")
    texts = keyed.select("uid", "text").join(wanted.withColumnRenamed("node", "uid"), "uid").select("component", F.col("uid").alias("node"), "copies", "text")
    sets = written(_sets(texts), "sets", base)
    released(members.sparkSession)
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("set")).alias("bytes"))
    tasks = block_tasks(sets.join(sizes, "component"), "node", block_count(F.col("size"), F.col("bytes"), GROUP_BLOCK))
    rows = tasks.select("component", "i", "j", "own", "node", "copies", "set").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    return written(_exact(rows), "exact", base)


def near_texts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id (the smallest doc_id of its linked documents, its own included), copy_id (the smallest doc_id with
    the same words), n_links (other documents of similarity 0.8 or more, copies among them), kept (doc_id = class_id).

    A text of fewer than five words has one shingle, all its words; one without words (null, empty, blank) links with nothing.
    Rows with a null or repeated doc_id are documents of their own: with nulls first, then equal ids by text, the first row
    of a class is its kept one. Other columns are ignored; an empty table gives none.
    """
    from .suffix_dedup import _keyed

    keyed, plain = _keyed(pick(docs, doc_id="doc_id", text="text"))
    base = shared_dir(docs.sparkSession)
    signatures = written(_signatures(keyed), "signatures", base)
    small = signatures.select("uid", "n", F.when(F.col("n") > 0, F.col("digest")).otherwise(F.col("uid").cast("string").cast("binary")).alias("digest"))
    # only repeated texts are joined, and by a written table: a text with many copies is then split like any skewed join
    classes = written(small.groupBy("digest").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated", base)
    named = small.join(classes, "digest", "left").select("uid", F.coalesce("node", "uid").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies"), "n")
    members = written(named, "classes", base)
    groups = _likely_groups(members, signatures, base)
    exact = _exact_links(keyed, members, groups, base)
    found = connected_components(exact.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    links = exact.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    about = found.join(links, "node", "left")
    out = members.join(about, "node", "left").select(
        "uid", F.coalesce("component", "node").alias("class_uid"), F.col("node").alias("copy_uid"), (F.coalesce("links", F.lit(0)) + F.when(F.col("n") > 0, F.col("copies") - 1).otherwise(0)).alias("n_links")
    )
    out = out.withColumn("kept", F.col("uid") == F.col("class_uid"))
    if plain:
        return out.select(F.col("uid").alias("doc_id"), F.col("class_uid").alias("class_id"), F.col("copy_uid").alias("copy_id"), "n_links", "kept")
    name = lambda as_: keyed.select(F.col("uid").alias(f"{as_}_uid" if as_ != "doc" else "uid"), F.col("doc_id").alias(f"{as_}_id"))
    return out.join(name("doc"), "uid").join(name("class"), "class_uid").join(name("copy"), "copy_uid").select("doc_id", "class_id", "copy_id", "n_links", "kept", "uid")


def without_near_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each class of ``near_texts``: that of the smallest doc_id.

    Rows with a null or repeated doc_id are documents of their own (nulls first, equal ids by text, of equal rows one stays).
    Null, empty and blank texts link with nothing and stay; texts of any length are compared whole; other columns, whatever
    their names, are carried through; an empty table gives none.
    """
    from .suffix_dedup import _keyed

    plain, (doc_id, text) = by_place(docs, "doc_id", "text")
    keyed, _ = _keyed(plain, doc_id, text)
    found = near_texts(keyed.select(F.col("uid").alias("doc_id"), F.col(text).alias("text")))
    gone = found.where("not kept").select(F.col("doc_id").alias("uid"))
    return keyed.join(gone, "uid", "left_anti").select(*plain.columns).toDF(*docs.columns)
