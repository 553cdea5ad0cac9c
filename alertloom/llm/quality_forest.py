"""Quality rules: exact per-document rule statistics judged by an isolation forest.

Method: random axis-parallel splits isolate unusual documents early, so a short mean path length marks an anomaly. The forest
and its threshold are fitted on a bounded sample of labelled rows (``FIT_ROWS``); statistics and verdicts cover all rows and
whole texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import lean, pick
from .textops import LEAD, SPACE, Block, blocks, exact_groups

#: Labelled rows that the forest is fitted on at most, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Good rows held out to set the threshold on, at least.
LEAST_HELD = 20
TREES, SUBSAMPLE, DEPTH = 120, 1024, 26
#: Share of labelled good documents that the threshold must keep.
KEEP_GOOD = 0.999
MIN_WORDS = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?;:=~^_{}[]@/\\")] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct_words"]
_TYPES = ", ".join(f"{x} long" for x in STATS)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), dtype=bool)
    flags[order[1:]] = same
    flags[order[:-1]] |= same
    return flags


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row; the keys already hold their row."""
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows[first], minlength=n)


def block_stats(block: Block) -> np.ndarray:
    """One row of ``STATS`` for each text of the block."""
    data, n = block.data, block.rows
    starts, ends, at = block.words()
    n_words = np.diff(at)
    row = np.repeat(np.arange(n), n_words)
    word, first = exact_groups(data, starts, ends, block.hashes(starts, ends))
    k = max(1, len(first))
    inside = row[2:] == row[:-2] if len(word) > 2 else np.zeros(0, dtype=bool)
    hit = np.zeros(len(word), dtype=bool)
    if inside.any():
        at_ = np.flatnonzero(inside)
        two, _ = pd.factorize(word[at_].astype(np.int64) * k + word[at_ + 1])
        three, _ = pd.factorize(two.astype(np.int64) * k + word[at_ + 2])
        rep = np.zeros(len(inside), dtype=bool)
        rep[at_] = _repeated(three.astype(np.int64) * n + row[at_])
        for j in range(3):
            hit[j : len(word) - 2 + j] |= rep
    sums = np.concatenate([[0], np.cumsum(hit)])
    lines, line_ends, line_row = block.lines()
    full_sums = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = full_sums[line_ends] > full_sums[lines]
    line, _ = exact_groups(data, lines[full], line_ends[full], block.hashes(lines[full], line_ends[full]))
    n_lines = np.bincount(line_row[full], minlength=n)
    out = {
        "n_words": n_words,
        "word_chars": block.count(LEAD[data] & ~SPACE[data]),
        "n_symbols": block.count(_SYMBOL[data]),
        "n_dup_lines": n_lines - _distinct(line_row[full], line.astype(np.int64) * n + line_row[full], n),
        "n_repeat_words": sums[at[1:]] - sums[at[:-1]],
        "n_upper": block.count(_UPPER[data]),
        "n_digits": block.count(_DIGIT[data]),
        "n_marks": block.count(_MARK[data]),
        "n_lines": n_lines,
        "n_distinct_words": _distinct(row, word.astype(np.int64) * n + row, n),
    }
    return np.stack([out[x] for x in STATS], axis=1).astype(np.int64)


def features(stats: np.ndarray) -> np.ndarray:
    """Scale-free inputs of the forest, on a scale that spreads small shares."""
    s = dict(zip(STATS, stats.T.astype(np.float64), strict=True))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    x = np.stack(
        [
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            s["n_repeat_words"] / words,
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            s["n_marks"] / words,
            s["n_distinct_words"] / words * np.log1p(words) / 6,
        ],
        axis=1,
    )
    return np.log1p(10 * x)


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), cut, left child, and the path length at leaves."""

    def __init__(self, rows: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], box, rng) for _ in range(trees)]

    @staticmethod
    def _grow(rows: np.ndarray, box: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Cuts are drawn over the node's part of the box, so values that no sampled row has end in empty leaves near the root."""
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0, box[0], box[1])]
        while todo:
            node, part, d, low, high = todo.pop()
            open_ = np.flatnonzero(high > low)
            if d >= DEPTH or len(part) < 2 or not len(open_):
                path[node] = d + float(_expected_path(len(part)))
                continue
            f = int(rng.choice(open_))
            c = float(rng.uniform(low[f], high[f]))
            feature[node], cut[node], left[node] = f, c, len(feature)
            for side in (False, True):
                lo, hi = low.copy(), high.copy()
                (lo if side else hi)[f] = c
                todo.append((len(feature), part[(part[:, f] > c) == side], d + 1, lo, hi))
                feature.append(-1), cut.append(0.0), left.append(0), path.append(0.0)
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; near 1: isolated after few splits."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, cut, left, path in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            open_ = feature[node] >= 0
            while open_.any():
                i = at_row[open_]
                f = feature[node[i]]
                node[i] = left[node[i]] + (rows[i, f] > cut[node[i]])
                open_ = feature[node] >= 0
            total += path[node]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(float(_expected_path(self.size)), 1e-9))


def base_failed(stats: np.ndarray) -> np.ndarray:
    words, repeat = stats[:, 0], stats[:, STATS.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeat > 50 * words)


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``STATS`` of every row: null and empty texts have zeros, repeated rows stay, other columns go."""
    src = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                s = block_stats(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first_row, b.rows), *map(pa.array, s.T)], ["doc_id", *STATS])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_TYPES}")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_good: float = KEEP_GOOD) -> tuple[Forest | None, float]:
    """Grow the forest on seven tenths of the good labelled rows and take the lowest threshold that still keeps ``keep_good`` of
    the others (with fewer than ``LEAST_HELD`` of those, of all).

    At most ``fit_rows`` labelled rows are used. Without labelled good rows there is no forest and nothing is anomalous.
    """
    lab = pick(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality is not null")
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    src = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(lab), "doc_id")  # at most fit_rows rows of 12 bytes
    once = rule_stats(src).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "s.*")  # of repeated ids the least row
    keep = once.join(lab, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) < 7).orderBy("doc_id").limit(fit_rows).toPandas()
    stats = keep[STATS].to_numpy(dtype=np.int64)
    good = (keep["quality"].to_numpy() == 1) & ~base_failed(stats) if len(keep) else np.zeros(0, dtype=bool)
    if good.sum() < 2:
        return None, 2.0
    x = features(stats)
    own = keep["own"].to_numpy(dtype=bool)
    grow, hold = good & own, good & ~own
    if grow.sum() < 2 or hold.sum() < LEAST_HELD:  # too few to hold any out
        grow = hold = good
    forest = Forest(x[grow], (x.min(axis=0), x.max(axis=0)))
    s = np.sort(forest.score(x[hold]))
    return forest, float(np.nextafter(s[min(len(s) - 1, int(np.floor(keep_good * len(s))))], 2))


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null text counts as empty (no words: it fails the base rules); a null doc_id is carried through; repeated rows get equal
    verdicts; an empty table gives an empty result; extra columns are ignored. ``anomaly`` is the forest's score.
    """
    forest, limit = fit(docs, labels, fit_rows)
    src = pick(docs, doc_id="doc_id", text="text")
    names = ["doc_id", *STATS, "anomaly", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                s = block_stats(b)
                bad = base_failed(s)
                a = forest.score(features(s)) if forest is not None else np.zeros(len(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first_row, b.rows), *map(pa.array, s.T), pa.array(a), pa.array(bad), pa.array(~bad & (a < limit))], names)

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_TYPES}, anomaly double, base_failed boolean, kept boolean")
