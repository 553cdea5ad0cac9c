"""Keyed state of streams: online centroids that expire, intervals that are judged once they close, and an index of groups.

State lives in RocksDB under the query's checkpoint; a restart goes on where the last micro-batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from alertloom.functions.scalars import day_interval, day_type
from alertloom.operators.behaviour import HIGH, LOW, judged, with_baseline

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"
SLOT_MS = 3 * 3600 * 1000


def with_state(df: DataFrame) -> DataFrame:
    """Have the session keep state in RocksDB, which keyed processors need."""
    if df.sparkSession.conf.get(_STORE, "") != _ROCKS:
        df.sparkSession.conf.set(_STORE, _ROCKS)
    return df


class _Centroids(StatefulProcessor):
    """Per key the centroids in use. A row at time t never joins a centroid that was made ``age_ms`` or more before t and has fewer than ``keep`` rows;
    timers take such centroids out of the state, so results don't hang on when they fire."""

    def __init__(self, key: str, least: float, decay: float, age_ms: int, keep: int):
        self.key, self.least, self.decay, self.age_ms, self.keep = key, least, decay, age_ms, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.centres = handle.getMapState("centres", "cluster int", "centre array<double>, n int, made long")
        self.next = handle.getValueState("next", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "id"], kind="stable")  # a key's rows of one micro-batch
        held = {k[0]: [np.array(v[0]), v[1], v[2]] for k, v in self.centres.iterator()} if self.centres.exists() else {}
        number = self.next.get()[0] if self.next.exists() else 0
        changed, gone, out = set(), [], []
        for ms, vector in zip(batch["ms"].tolist(), batch["vector"], strict=True):
            for k in [k for k, c in held.items() if c[1] < self.keep and c[2] + self.age_ms <= ms]:
                del held[k]
                gone.append(k)
            x = np.asarray(vector, dtype=float)
            names = sorted(held)
            best = None
            if names:
                c = np.stack([held[k][0] for k in names])
                sims = c @ x / (np.linalg.norm(c, axis=1) * np.linalg.norm(x) + 1e-8)
                at = int(np.argmax(sims))
                best = names[at] if sims[at] > self.least else None
            if best is None:
                best, number = number, number + 1
                held[best] = [x, 1, ms]
                self.handle.registerTimer(ms + self.age_ms)
            else:
                held[best][0] = self.decay * held[best][0] + (1 - self.decay) * x
                held[best][1] += 1
            changed.add(best)
            out.append(best)
        for k in gone:
            if self.centres.containsKey((k,)):
                self.centres.removeKey((k,))
        for k in changed & held.keys():
            self.centres.updateValue((k,), (held[k][0].tolist(), held[k][1], held[k][2]))
        self.next.update((number,))
        yield pd.DataFrame({self.key: [key[0]] * len(out), "id": batch["id"].to_numpy(), "cluster": np.array(out, dtype=np.int32)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k, (_, n, made) in list(self.centres.iterator()):
            if n < self.keep and made + self.age_ms <= now:
                self.centres.removeKey(k)
        yield pd.DataFrame({self.key: pd.Series([], dtype="object"), "id": pd.Series([], dtype="int64"), "cluster": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


def centroid_stream(stream: DataFrame, by: str, vector: str, id_col: str, time: str, least: float = 0.7, decay: float = 0.99, max_age_minutes: float = 60, keep: int = 5, delay: str = "0 seconds") -> DataFrame:
    """``by``, ``id`` and ``cluster`` of each row of a stream, as rows arrive: the nearest centroid of its key (cosine above ``least``), which moves towards
    it, or a new one. Centroids of fewer than ``keep`` rows expire ``max_age_minutes`` after they were made.

    A key's rows are taken by time and id within a micro-batch. Rows with a null key, vector or time are left out, rows later than the
    watermark's ``delay`` are dropped. State is bounded by the centroids in use; a key is folded in one task, as the order of its rows matters.
    """
    rows = with_state(stream).where(F.col(by).isNotNull() & F.col(vector).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(by, F.col(time), F.col(id_col).cast("long").alias("id"), F.unix_millis(time).alias("ms"), F.col(vector).cast("array<double>").alias("vector"))
    kind = stream.schema[by].dataType.simpleString()
    return rows.groupBy(by).transformWithStateInPandas(_Centroids(by, least, decay, int(max_age_minutes * 60_000), keep), f"{by} {kind}, id long, cluster int", "Append", "EventTime")


#: Groups that users are dealt to; a group's users of one interval are read and written as one value.
USER_GROUPS = 64


class _Slots(StatefulProcessor):
    """Per group of users and interval the counts and what is expected of them, in one value with one timer: state is called for once a
    group and batch, not once a user."""

    FIELDS = {"user": "object", "n": "int64", "avg": "float64", "total": "float64", "known": "bool", "told": "bool"}

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "user array<string>, n array<long>, avg array<double>, total array<double>, known array<boolean>, told array<boolean>")

    def _before(self) -> pd.DataFrame:
        columns = self.held.get() if self.held.exists() else [[]] * len(self.FIELDS)
        return pd.DataFrame({c: pd.Series(list(v), dtype=kind) for (c, kind), v in zip(self.FIELDS.items(), columns, strict=True)})

    @staticmethod
    def _risk(f: pd.DataFrame, factor: float = 2.0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(f["known"], 100.0 / (1.0 + np.exp(-(f["n"] - f["avg"]) / np.maximum(f["total"], 1.0) * factor)), 100.0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf.groupby("user", sort=False).agg(n=("slot", "size"), avg=("avg", "first"), total=("total", "first"), known=("known", "first")).reset_index() for pdf in rows])
        if not self.held.exists():
            self.handle.registerTimer(int(key[1]) + SLOT_MS)
        both = pd.concat([self._before(), new.assign(told=False)], ignore_index=True).astype(self.FIELDS)
        now = both.groupby("user", sort=False).agg(n=("n", "sum"), avg=("avg", "last"), total=("total", "last"), known=("known", "last"), told=("told", "max")).reset_index().astype(self.FIELDS)
        tell = now["user"].isin(new["user"]) & ~now["told"] & (self._risk(now) > HIGH)
        now["told"] |= tell
        self.held.update(tuple(now[c].tolist() for c in self.FIELDS))
        yield _slots(now[tell], int(key[1]), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self._before()
        self.held.clear()
        yield _slots(found, int(key[1]), True)

    def close(self) -> None:
        pass


def _slots(rows: pd.DataFrame, slot: int, closed: bool) -> pd.DataFrame:
    return rows.assign(slot=np.int64(slot), closed=closed)[["user", "slot", "n", "avg", "total", "known", "closed"]].astype({"slot": "int64", "closed": "bool"})


def interval_watch(stream: DataFrame, base: DataFrame, user: str = "SourceUserName", time: str = "EndDate", delay: str = "0 seconds") -> DataFrame:
    """Anomalies of three-hour intervals against a static baseline (``behaviour.baseline``): user, day_type, day, key, n, is_new, risk, closed.

    An interval is judged as a whole, once, when the watermark passes its end (``closed``: risk out of bounds on either side), and told of at once, once,
    when its running count passes the upper bound (not ``closed``). Users without a baseline have risk 100. Rows with a null user or time are
    left out; rows behind the watermark are dropped. The session's time zone must be one of whole three hours from UTC.
    """
    at = F.col(time).cast("timestamp")
    rows = with_state(stream).where(F.col(user).isNotNull() & F.col(time).isNotNull()).select(F.col(user).alias("user"), at.alias("at")).withWatermark("at", delay)
    keyed = rows.select("user", "at", day_type(F.col("at")).alias("day_type"), day_interval(F.col("at")).cast("string").alias("key"), (F.floor(F.unix_millis("at") / SLOT_MS) * SLOT_MS).alias("slot"))
    expected = with_baseline(keyed, base).select("user", "at", "slot", F.coalesce("avg", F.lit(0.0)).alias("avg"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("known", F.lit(False)).alias("known"))
    dealt = expected.withColumn("group", F.pmod(F.xxhash64("user"), F.lit(USER_GROUPS)).cast("int"))
    found = dealt.groupBy("group", "slot").transformWithStateInPandas(_Slots(), "user string, slot long, n long, avg double, total double, known boolean, closed boolean", "Append", "EventTime")
    start = F.timestamp_millis("slot")
    named = found.select("user", day_type(start).alias("day_type"), F.to_date(start).alias("day"), day_interval(start).cast("string").alias("key"), "n", "avg", "total", F.when(F.col("known"), True).alias("known"), "closed")
    return judged(named, low=LOW, high=HIGH, keep=["closed"])


def run_stream(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append all that a stream has by now to a Parquet table; started again with the same checkpoint it goes on behind that."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(partition_by) if partition_by else writer).start()


def finished(query: StreamingQuery, seconds: int = 3600) -> None:
    """Wait for a stream that reads what there is; an error of its own is raised here."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream hasn't ended in {seconds} s")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A streamed table, empty where no batch has written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
