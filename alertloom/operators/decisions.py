"""Strategy choice, hybrid agreement, threshold adaptation and online centroids: rules that fold over ordered rows, per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.correlation import consensus, correlate
from alertloom.schema import FieldRoles

Scorer = Callable[[DataFrame], DataFrame]
#: Stands for no user yet, as a user may be null.
_NOBODY = object()


def correlate_auto(df: DataFrame, roles: FieldRoles, threshold: float = 0.3, scorer: Scorer | None = None, small: int = 100, large: int = 1000) -> DataFrame:
    """Correlation by rules below ``small`` rows or without a ``scorer``; the consensus of both below ``large``; else the scorer's
    clusters (``alert_idx``, ``cluster``). ``correlation_method`` names the way taken."""
    n = df.limit(large).count()
    rules = lambda: correlate(df, roles, threshold)
    if scorer is None or n < small:
        return rules().withColumn("correlation_method", F.lit("rules"))
    other = scorer(df).select("alert_idx", "cluster")
    if n < large:
        both = rules().join(other, "alert_idx")
        merged = consensus(both, "cluster", "pred_cluster").withColumnRenamed("cluster", "_c")
        return both.drop("cluster", "pred_cluster").join(merged, "alert_idx").withColumnRenamed("_c", "pred_cluster").withColumn("correlation_method", F.lit("hybrid"))
    return df.join(other, "alert_idx").withColumnRenamed("cluster", "pred_cluster").withColumn("correlation_method", F.lit("scorer"))


def agreement(df: DataFrame, first: str, second: str, confidence: str | None = None) -> DataFrame:
    """Share of a row's first cluster that is also in its second, and the joint confidence (1 where all agree)."""
    n = lambda *c: F.count(F.lit(1)).over(Window.partitionBy(*c))
    out = df.withColumn("agreement", n(first, second) / n(first))
    c = F.col(confidence) if confidence else F.lit(0.8)
    return out.withColumn("joint_confidence", F.when(F.col("agreement") == 1, 1.0).otherwise(0.7 * c + 0.24))


def adapt_thresholds(df: DataFrame, user: str, risk: str, anomalous: str, order: str, low: float = 31.0, high: float = 69.0, step: float = 1.0, bounds: tuple[float, float, float] = (5.0, 50.0, 95.0)) -> DataFrame:
    """Per user the thresholds after all its judged rows in order: a false alarm widens them, a miss narrows them, within bounds.

    Rows come sorted and are folded as they come, so a task holds one user's thresholds and not its rows. Rows without a risk or a verdict count for nothing."""
    least, middle, most = bounds
    rows = df.select(F.col(user).cast("string").alias("user"), F.col(risk).cast("double").alias("risk"), F.col(anomalous).cast("boolean").alias("bad"), order).where("risk is not null and bad is not null")
    rows = rows.repartition("user").sortWithinPartitions("user", order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, a, b, counts = _NOBODY, low, high, dict.fromkeys(("tp", "fp", "tn", "fn"), 0)
        names = ["user", "low", "high", *counts]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([a]), pa.array([b]), *[pa.array([n], pa.int64()) for n in counts.values()]], names)

        for batch in batches:
            for u, r, truth in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if u != at:
                    if at is not _NOBODY:
                        yield row()
                    at, a, b, counts = u, low, high, dict.fromkeys(counts, 0)
                said = r < a or r > b
                counts[("t" if said == truth else "f") + ("p" if said else "n")] += 1
                if said and not truth:
                    a, b = max(least, a - step), min(most, b + step)
                elif truth and not said:
                    a, b = min(middle, a + step), max(middle, b - step)
        if at is not _NOBODY:
            yield row()

    return rows.mapInArrow(fold, "user string, low double, high double, tp long, fp long, tn long, fn long")


def online_centroids(df: DataFrame, by: list[str], vector: str, order: str, least: float = 0.7, decay: float = 0.99) -> DataFrame:
    """Each row joins the nearest centroid of its key (cosine above ``least``), which moves towards it, or starts a new one.

    The order of a key's rows matters, so a key is folded in one task, row after row as they come sorted: memory holds a batch and the
    centroids, not the key. Rows with a null vector or order have none. ``streaming.stateful.centroid_stream`` does this on a stream.
    """
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + f", id {df.schema[order].dataType.simpleString()}, cluster int"
    keys = len(by)
    rows = df.where(F.col(vector).isNotNull() & F.col(order).isNotNull()).select(*by, order, F.col(vector).cast("array<double>").alias("_vector"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, centres, norms = None, 0, np.zeros((0, 0)), np.zeros(0)
        for batch in batches:
            out = []
            for *key, x in zip(*[batch.column(i).to_pylist() for i in range(keys)], batch.column(keys + 1).to_pylist(), strict=True):
                x = np.array(x)
                if key != last:
                    last, n, centres, norms = key, 0, np.zeros((8, len(x))), np.zeros(8)
                k = -1
                if n:
                    sims = centres[:n] @ x / (norms[:n] * np.linalg.norm(x) + 1e-8)
                    k = int(np.argmax(sims))
                    k = k if sims[k] > least else -1
                if k < 0:
                    if n == len(norms):
                        centres, norms = np.concatenate([centres, np.zeros_like(centres)]), np.concatenate([norms, np.zeros_like(norms)])
                    k, n = n, n + 1
                    centres[k] = x
                else:
                    centres[k] = decay * centres[k] + (1 - decay) * x
                norms[k] = np.linalg.norm(centres[k])
                out.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[: keys + 1], pa.array(out, pa.int32())], [*by, "id", "cluster"])

    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(fold, schema)
