"""Toxicity by maximum-scoring segments of token log-odds.

Method: each word's log-odds of toxic against other labelled documents have an informative Dirichlet prior (its share of all
labelled documents, after Monroe, Colaresi and Quinn); a word without evidence of its own takes that of its first letters.
One linear scan (Ruzzo and Tompa) finds every maximal-scoring segment of a text's words less a drift. Segment scores become
evidence by extreme-value statistics (Karlin and Altschul): lambda solves the moment equation over the words of
non-toxic documents, and the normalised best score and the sum of significant segments are calibrated to a
probability by logistic regression on the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import bounded, lean, pick, written
from .textops import U64, Block, blocks, mix, shingles

#: Labelled rows that weights and calibration are fitted on at most, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Least z-score with which a word or prefix counts, as a share of the largest that chance gives among that many; weight of the
#: prior in documents.
LEAST_Z, PRIOR = 0.75, 20.0
DRIFT, LEAST_SCORE, CUT = 0.05, 1.0, 0.7
#: Bounds of lambda, for small or odd samples.
RATES = (0.8, 3.0)
#: Bytes of the prefixes that stand in for words without evidence.
PREFIXES = (6, 5, 4)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[0x80:] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x30:0x3A] = True


def tokens(block: Block) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all lower-case words of letters and digits, and of their prefixes (0: too short); words before each row."""
    low = _LOWER[block.data]
    second = np.flatnonzero(block.data == 0xC3) + 1
    second = second[second < len(low)]
    second = second[(low[second] < 0x9F) & (low[second] != 0x97)]
    low[second] += 32
    words = Block(np.where(_WORD[low], low, np.uint8(0x20)).astype(np.uint8), block.offsets, 0)
    starts, ends, at = words.words()
    out = [words.hashes(starts, ends)]
    for k, n in enumerate(PREFIXES):
        ok = ends - starts > n
        with np.errstate(over="ignore"):
            h = mix(words.hashes(starts, np.minimum(starts + n, ends)) + U64(k + 1))
        out.append(np.where(ok, h, U64(0)))
    return out, at


class Lexicon:
    """Weights of words and prefixes, in order of their hash."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.weights = keys[by], weights[by]

    def scores(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log-odds of each word: its own, or else those of its longest known prefix, or else 0. The k-th time that a text (their
        words start at ``at``) says a word counts 1/k, so repetition alone is little evidence."""
        out = np.zeros(len(hashes[0]))
        if not len(self.keys):
            return out
        todo = np.arange(len(out))
        for h in hashes:
            own = np.minimum(np.searchsorted(self.keys, h[todo]), len(self.keys) - 1)
            hit = self.keys[own] == h[todo]
            out[todo[hit]] = self.weights[own[hit]]
            todo = todo[~hit]
        found = np.flatnonzero(out)
        if len(found):
            row = np.searchsorted(at, found, side="right").astype(U64)
            with np.errstate(over="ignore"):
                key = hashes[0][found] ^ mix(row)
            by = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
            place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            out[found[by]] /= 1.0 + place
        return out


def segments(score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after the last, score) of a sequence, in one pass (Ruzzo and Tompa).

    Each segment keeps a link to the last one before it whose total in front is smaller; what lies between is never looked at again."""
    s = score - drift
    total = np.concatenate([[0.0], np.cumsum(s)])
    gain = np.flatnonzero(s > 0)
    lefts, rights = total[gain].tolist(), total[gain + 1].tolist()
    found: list[tuple[int, int, float, float, int]] = []  # first, after, total in front, total at the end, link
    for i, left, right in zip(gain.tolist(), lefts, rights, strict=True):
        a, k = i, len(found) - 1
        while k >= 0 and found[k][2] >= left:
            k = found[k][4]
        while k >= 0 and found[k][3] < right:  # one segment from there on
            a, _, left, _, link = found[k]
            del found[k:]
            k = link
        found.append((a, i + 1, left, right, k))
    return [(a, z, right - left) for a, z, left, right, _ in found]


class Model:
    def __init__(self, lexicon: Lexicon, rate: float, weights: np.ndarray):
        self.lexicon, self.rate, self.weights = lexicon, rate, weights

    def evidence(self, score: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Normalised best segment, sum over significant segments, and these, of one text's word scores."""
        if not (score > DRIFT).any():
            return 0.0, 0.0, []
        n = np.log(len(score) + 1.0)
        found = [x for x in segments(score) if x[2] >= LEAST_SCORE and self.rate * x[2] > n - 2]
        if not found:
            return 0.0, 0.0, []
        best = max(x[2] for x in found)
        return max(0.0, self.rate * best - n + 2), float(sum(self.rate * x[2] - n + 2 for x in found)), found

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        x = np.stack([np.ones(len(best)), np.log1p(best + total)], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _rate(score: np.ndarray, count: np.ndarray) -> float:
    """Positive lambda with mean(exp(lambda * (score - drift))) = 1 over the background, by bisection; 1 if there is none."""
    if not count.sum() or not (score > DRIFT).any():
        return 1.0
    p = count / count.sum()
    if float((p * (score - DRIFT)).sum()) >= 0:
        return RATES[0]
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (mid, high) if float((p * np.exp(np.minimum(mid * (score - DRIFT), 700))).sum()) < 1 else (low, mid)
    return min(max(low, RATES[0]), RATES[1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """Distinct labelled texts to learn from (text, toxic): rows whose crc32(doc_id as text) mod 3 is not 1, ``fit_rows`` at most."""
    lab = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 != 1")
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    each = docs.select("doc_id").join(F.broadcast(lab), "doc_id").groupBy("doc_id", "toxic").count()  # fit_rows rows of 12 bytes at most
    so_far = F.sum("count").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # ids may repeat
    few = each.withColumn("_n", so_far).where(F.col("_n") <= fit_rows).select("doc_id", "toxic")
    return docs.join(F.broadcast(few), "doc_id").where("text is not null")


def _without_copies(rows: DataFrame) -> DataFrame:
    """One row of each group of texts that share the least hash of their runs of five words, for two hashes in turn: near
    copies go but for few. Written, as it is read again and again."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, at = shingles(b, 5)
                first = []
                for k in range(2):
                    x = np.append(mix(h + U64(k)), U64(0))
                    m = np.minimum.reduceat(x, np.minimum(at[:-1], len(h)))
                    first.append(pa.array(np.where(np.diff(at) > 0, m, U64(0)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(b.first_row, b.rows) for i in range(3)), *first], ["doc_id", "text", "toxic", "m0", "m1"])

    found = written(rows.select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic")).mapInArrow(lean(least), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, toxic int, m0 long, m1 long"), "fit")
    for m in ("m0", "m1"):
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(m).orderBy("doc_id", "text"))).where("n = 1")
    return written(found.select("doc_id", "text", "toxic"), "distinct")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """None where the labelled rows have not both classes. Of copies and near copies hardly more than one counts."""
    rows = labelled(docs, labels, fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_numpy().astype(np.int64)
            for b in blocks(batch.column(1)):
                hashes, at = tokens(b)
                row = np.repeat(np.arange(b.rows), np.diff(at))
                own = toxic[b.first_row : b.first_row + b.rows]
                text = b.hashes(b.offsets[:-1], b.offsets[1:])
                with np.errstate(over="ignore"):
                    salt = mix(np.arange(1, b.rows + 1).astype(U64))
                keys, docs_ = [], []
                for h in hashes:
                    ok = h != 0
                    _, first = np.unique(h[ok] ^ salt[row[ok]], return_index=True)  # once per text
                    keys.append(h[ok][first])
                    docs_.append(row[ok][first])
                keys_, row_ = np.concatenate(keys), np.concatenate(docs_)
                yield pa.RecordBatch.from_arrays([pa.array(keys_.view(np.int64)), pa.array(text[row_].view(np.int64)), pa.array(own[row_].astype(np.int32))], ["key", "text", "toxic"])

    distinct = _without_copies(rows)
    sizes = {r.toxic: r.n for r in distinct.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    n0, n1 = sizes[0], sizes[1]
    seen = distinct.select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic")).mapInArrow(lean(count), "key long, text long, toxic int")
    table = seen.groupBy("key").agg(F.sum("toxic").cast("double").alias("y1"), F.count("*").cast("double").alias("y"))
    table = written(table, "counts")
    all_words, n_words = table.agg(F.sum(F.col("y") - F.col("y1")), F.count(F.when(F.col("y") >= 3, 1))).first()
    least_z = LEAST_Z * float(np.sqrt(2 * np.log(max(n_words, 10))))
    prior = PRIOR * F.col("y") / (n0 + n1)
    table = table.withColumn("a", prior).withColumn("y0", F.col("y") - F.col("y1")).where("y >= 3")
    odds = lambda y, n: F.log((F.col(y) + F.col("a")) / (n + PRIOR - F.col(y) - F.col("a")))
    table = table.select("key", (odds("y1", n1) - odds("y0", n0)).alias("w"), F.sqrt(1 / (F.col("y1") + F.col("a")) + 1 / (F.col("y0") + F.col("a"))).alias("s"), "y0", "y1")
    kept = table.where(F.abs(F.col("w")) >= least_z * F.col("s")).toPandas()  # words of fit_rows texts at most
    lexicon = Lexicon(kept["key"].to_numpy(dtype=np.int64).view(U64), kept["w"].to_numpy(dtype=np.float64))
    if not len(kept):
        return Model(lexicon, 1.0, np.array([np.log(n1 / n0), 0.0]))
    background = kept["y0"].to_numpy()  # the rest of the words have no weight
    rate = _rate(np.append(kept["w"].to_numpy(), 0.0), np.append(background, max(1.0, all_words - background.sum())))
    model = Model(lexicon, rate, np.zeros(2))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                best, total = _evidence(model, b)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(b.first_row, b.rows), pa.array(best), pa.array(total)], ["toxic", "best", "total"])

    got = distinct.select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic")).mapInArrow(lean(measure), "toxic int, best double, total double").toPandas()
    x = np.stack([np.ones(len(got)), np.log1p(got["best"] + got["total"])], axis=1)
    model.weights = _logistic(x, got["toxic"].to_numpy(dtype=np.float64))
    return model


def _evidence(model: Model, b: Block) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = tokens(b)
    score = model.lexicon.scores(hashes, at)
    best, total = np.zeros(b.rows), np.zeros(b.rows)
    sums = np.concatenate([[0], np.cumsum(score > DRIFT)])
    for i in np.flatnonzero(sums[at[1:]] > sums[at[:-1]]).tolist():
        best[i], total[i], _ = model.evidence(score[at[i] : at[i + 1]])
    return best, total


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the significant segments as word positions.

    Null and empty texts have no segments and get the score of such; null ids are carried through (held_out null); repeated rows
    score alike; texts of any length are scored whole, in linear time; other columns are never read. Without labelled rows of both classes every score is 0.
    """
    src = pick(docs, doc_id="doc_id", text="text")
    model = fit(src, labels, fit_rows)
    item = pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                best, total, found = np.zeros(b.rows), np.zeros(b.rows), [[] for _ in range(b.rows)]
                if model is not None:
                    hashes, at = tokens(b)
                    s = model.lexicon.scores(hashes, at)
                    sums = np.concatenate([[0], np.cumsum(s > DRIFT)])
                    for i in np.flatnonzero(sums[at[1:]] > sums[at[:-1]]).tolist():
                        best[i], total[i], own = model.evidence(s[at[i] : at[i + 1]])
                        found[i] = [{"first": x, "after": y, "score": z} for x, y, z in own]
                p = model.probability(best, total) if model is not None else best
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first_row, b.rows), pa.array(p), pa.array((p >= CUT).astype(np.int32)), pa.array(found, pa.list_(item))], ["doc_id", "score", "predicted", "segments"])

    out = src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, predicted int, segments array<struct<first:int,after:int,score:double>>")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score", "predicted", "segments")


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` (all columns) without the rows that ``score_toxicity`` predicts to be toxic.

    Rows are judged where they are read, without a join, so null and repeated ids make no difference; null and empty texts stay,
    texts of any length are judged whole, and other columns, whatever their names, are carried through. An empty table gives none;
    without labelled rows of both classes every row stays.
    """
    model = fit(pick(docs, doc_id="doc_id", text="text"), labels, fit_rows)
    if model is None:
        return docs

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.probability(*_evidence(model, b)) < CUT for b in blocks(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep), pa.bool_()))

    return bounded(docs).mapInArrow(lean(run), docs.schema)
