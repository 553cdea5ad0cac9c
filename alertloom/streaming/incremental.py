"""Correlation of a stream, batch by batch, with the clusters that one correlation of all alerts gives.

Two alerts are linked if they share a group (``correlation.group_keys``). An index in keyed state knows the first alert of every group ever
seen, so a batch looks up its own groups and no others. What the found links do to clusters is worked out on the batch's own graph: new
alerts, the clusters that they touch, and nothing else; clusters that a batch joins are noted as merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from alertloom.operators.components import connected_components
from alertloom.operators.correlation import group_keys
from alertloom.plans.stage import removed
from alertloom.schema import FieldRoles
from alertloom.streaming.stateful import read_or_empty, with_state


#: Parts of a bucket of digests; the heads of a part are read and written as one value.
PARTS = 32
_HEAD = np.dtype([("h", "<i8"), ("g", "<i8"), ("head", "<i8")])


class _Heads(StatefulProcessor):
    """Per bucket of digests the first alert of each. Emits each alert once by itself and with the heads of its groups.

    The heads of a part of a bucket are one value of 24 bytes a group: state is called for a few times a part and batch, not a group."""

    def init(self, handle) -> None:
        self.heads = handle.getMapState("heads", "part int", "heads binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)  # a bucket's rows of one micro-batch
        part = lambda h: (h >> 20) % PARTS  # noqa: E731  the bucket is that of the lower bits
        parts = [int(p) for p in np.unique(part(batch["h"].to_numpy()))]
        held = {p: bytes(self.heads.getValue((p,))[0]) if self.heads.containsKey((p,)) else b"" for p in parts}
        before = np.frombuffer(b"".join(held.values()), dtype=_HEAD)
        least = batch.groupby(["h", "g"], sort=False)["id"].min().rename("head").reset_index()
        known = pd.concat([pd.DataFrame({c: before[c] for c in _HEAD.names}), least], ignore_index=True).astype("int64").drop_duplicates(["h", "g"])
        new = known.iloc[len(before) :].to_records(index=False).astype(_HEAD)
        at = part(new["h"])
        for p in np.unique(at):
            self.heads.updateValue((int(p),), (held[int(p)] + new[at == p].tobytes(),))
        yield batch[["h", "g", "id"]].merge(known, on=["h", "g"])[["id", "head"]].drop_duplicates()

    def close(self) -> None:
        pass


def head_links(stream: DataFrame, roles: FieldRoles, threshold: float, id_col: str = "alert_idx", buckets: int = 512) -> DataFrame:
    """``id`` and ``head`` (the first alert of a group that it is in) for all groups of all alerts of a stream; an alert may be its own head."""
    keyed = group_keys(with_state(stream), roles, threshold, id_col).select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), F.col("id").cast("long").alias("id"), "h", "g")
    return keyed.groupBy("bucket").transformWithStateInPandas(_Heads(), "id long, head long", "Append", "None")


class IncrementalCorrelator:
    """Keeps, under ``folder``: ``labels`` (node, label: the least alert of its cluster when it came), ``roots`` (label, into: where labels of clusters that
    were joined later have gone) and ``changed`` (cluster, added, joined: what each batch did). Tables are parted by batch; a batch that runs
    again overwrites its own. A batch costs its own alerts, and one join with the two columns of ``labels``; alerts themselves are never read again."""

    LABELS, ROOTS, CHANGED = "node long, label long, batch long", "label long, into long", "cluster long, added long, joined long, batch long"

    def __init__(self, folder: str, roles: FieldRoles | None = None, threshold: float = 0.5, id_col: str = "alert_idx"):
        self.folder, self.roles, self.threshold, self.id_col = folder.rstrip("/"), roles or FieldRoles(), threshold, id_col

    def _roots(self, spark: SparkSession, before: int) -> DataFrame:
        """Where joined labels have gone, as of the last batch before ``before``; one row for each label that a join has ended."""
        return read_or_empty(spark, f"{self.folder}/roots", f"{self.ROOTS}, batch long").where(F.col("batch") == before - 1).select("label", "into")

    def batch(self, links: DataFrame, number: int) -> None:
        spark = links.sparkSession
        links = links.persist()
        try:
            labels = read_or_empty(spark, f"{self.folder}/labels", self.LABELS).where(F.col("batch") < number)
            roots = self._roots(spark, number)
            heads = links.select(F.col("head").alias("node")).distinct()
            old = labels.join(heads, "node").join(roots, "label", "left").select(F.col("node").alias("head"), F.coalesce("into", "label").alias("root"))
            edges = links.join(old, "head", "left").select(F.col("id").alias("src"), F.coalesce("root", "head").alias("dst"))
            found = connected_components(edges)
            new = links.select(F.col("id").alias("node")).distinct()
            labelled = new.join(found, "node").select("node", F.col("component").alias("label"))
            labelled.write.mode("overwrite").parquet(f"{self.folder}/labels/batch={number}")
            gone = old.select(F.col("root").alias("node")).distinct().join(found, "node").select(F.col("node").alias("label"), F.col("component").alias("into"))
            moved = gone.where("label <> into")
            kept = roots.alias("r").join(moved.alias("m"), F.col("r.into") == F.col("m.label"), "left").select("r.label", F.coalesce("m.into", "r.into").alias("into"))
            kept.unionByName(moved).write.mode("overwrite").parquet(f"{self.folder}/roots/batch={number}")
            added = labelled.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("added"))
            joined = gone.groupBy(F.col("into").alias("cluster")).agg(F.count("*").alias("joined"))
            added.join(joined, "cluster", "left").select("cluster", "added", F.coalesce("joined", F.lit(0).cast("long")).alias("joined")).write.mode("overwrite").parquet(f"{self.folder}/changed/batch={number}")
            if number > 2:
                removed(spark, f"{self.folder}/roots/batch={number - 3}")
        finally:
            links.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = head_links(stream, self.roles, self.threshold, self.id_col).writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()

    def clusters(self, spark: SparkSession) -> DataFrame:
        """``alert_idx`` and ``cluster`` (its least alert) of all alerts that have a group, as of the last batch. Alerts without any value are clusters by
        themselves and have no row."""
        labels = read_or_empty(spark, f"{self.folder}/labels", self.LABELS)
        last = labels.agg(F.max("batch")).first()[0]
        roots = self._roots(spark, (last if last is not None else -1) + 1)
        return labels.join(roots, "label", "left").select(F.col("node").alias(self.id_col), F.coalesce("into", "label").alias("cluster"))

    def changes(self, spark: SparkSession) -> DataFrame:
        """What each batch did to clusters of two alerts or more: ``new`` (no cluster before), ``grown`` or ``merged``."""
        rows = read_or_empty(spark, f"{self.folder}/changed", self.CHANGED).where(F.col("added") + F.col("joined") >= 2)
        return rows.withColumn("kind", F.when(F.col("joined") == 0, "new").when(F.col("joined") == 1, "grown").otherwise("merged"))
