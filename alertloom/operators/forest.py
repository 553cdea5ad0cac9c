"""Isolation forest over daily activity, and its share in a user's risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.operators.sampling import hash_order

#: Three-hour slots of a day.
SLOTS = 8
#: Shares of the counts' risk and of the forest's score.
RISK_SHARE, FOREST_SHARE = 0.7, 0.3

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.Generator, most: int) -> Tree:
    """One tree: for each node its component (-1: leaf), cut, first child (the second follows it) and a leaf's expected depth."""
    feature, cut, child, depth = [-1], [0.0], [-1], [0.0]
    todo = [(0, rows, 0)]
    while todo:
        at, x, deep = todo.pop()
        wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if deep >= most or not len(wide):
            depth[at] = deep + expected_depth(len(x))
            continue
        f = int(rng.choice(wide))
        c = rng.uniform(x[:, f].min(), x[:, f].max())
        left = x[:, f] <= c
        feature[at], cut[at], child[at] = f, c, len(feature)
        for part in (x[left], x[~left]):
            todo.append((len(feature), part, deep + 1))
            feature.append(-1), cut.append(0.0), child.append(-1), depth.append(0.0)
    return np.array(feature), np.array(cut), np.array(child), np.array(depth)


def depths(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Depth of each row, all rows a level at a time."""
    feature, cut, child, depth = tree
    at = np.zeros(len(x), dtype=int)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        node = at[inner]
        at[inner] = child[node] + (x[inner, feature[node]] > cut[node])
    return depth[at]


def fit_forest(df: DataFrame, columns: list[str], id_col: str, trees: int = 100, sample: int = 256, seed: int = 42) -> tuple[list[Tree], float]:
    """Trees, each over ``sample`` rows (the method's own subsample), and the expected depth. The driver gets ``trees`` x ``sample``
    rows at most, chosen by hash order from all; rows with a missing component are left out. Fewer than ten rows give no trees."""
    whole = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pool = whole.orderBy(hash_order(id_col, seed), id_col).limit(trees * sample).toPandas()[columns].to_numpy(dtype=float)
    if len(pool) < 10:
        return [], 1.0
    rng, n = np.random.default_rng(seed), min(sample, len(pool))
    most = int(np.ceil(np.log2(n)))
    return [grow(pool[rng.choice(len(pool), n, replace=False)], rng, most) for _ in range(trees)], expected_depth(n)


def forest_score(df: DataFrame, columns: list[str], forest: tuple[list[Tree], float], name: str = "forest_score") -> DataFrame:
    """``name``: 50 (as deep as can be) to 100 (isolated at once); 0 without trees or with a missing component."""
    trees, usual = forest

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            whole = ~np.isnan(x).any(1)
            out = np.zeros(len(pdf))
            if trees and whole.any():
                mean = sum(depths(t, x[whole]) for t in trees) / len(trees)
                out[whole] = np.clip((1 + 2.0 ** (-mean / usual)) * 50, 0, 100)
            yield pdf.assign(**{name: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(score, f"{schema}, `{name}` double")


def slot_vectors(act: DataFrame, value: str, by: list[str]) -> DataFrame:
    """One row for each ``by`` with ``slot0`` to ``slot7``: the value of each three-hour slot, 0 where there is none."""
    return act.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("key") == str(i), F.col(value))), F.lit(0)).cast("double").alias(f"slot{i}") for i in range(SLOTS)])


def combined_risk(current: DataFrame, base: DataFrame, found: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    """Days with an anomaly (``found``, from ``anomalies``): the greatest risk, the forest's score of the day's counts among the
    baselines' (``base``), and both together; without trees the risk alone. ``current`` holds the days' counts (``activity``)."""
    columns = [f"slot{i}" for i in range(SLOTS)]
    usual = slot_vectors(base, "avg", ["user", "day_type"]).withColumn("id", F.concat_ws("|", "user", "day_type"))
    forest = fit_forest(usual, columns, "id", trees, seed=seed)
    days = forest_score(slot_vectors(current, "n", ["user", "day_type", "day"]), columns, forest)
    risk = found.groupBy("user", "day_type", "day").agg(F.max("risk").alias("risk"))
    both = risk.join(days.drop(*columns), ["user", "day_type", "day"], "left")
    score = F.coalesce("forest_score", F.lit(0.0))
    return both.select("user", "day_type", "day", "risk", score.alias("forest_score"), F.when(score > 0, RISK_SHARE * F.col("risk") + FOREST_SHARE * score).otherwise(F.col("risk")).alias("combined"))
