"""Event search systems and syslog as streaming sources.

A search system is read by time: an offset is a point in time, a micro-batch the half-open span between two of them, cut into as many
windows as there are readers. A span that is read again, after a failure or a restart, gives the same rows, and rows of one timestamp lie
in one window, so none is lost or doubled as long as nothing is added further back than ``settle`` seconds.
"""

from __future__ import annotations

import re
import socket
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from alertloom.sources.connectors import Transport, read_pages

#: Seconds that events may come late, and of time that one task reads at most.
SETTLE, LONGEST = 30, 24 * 3600


def instant(value: object) -> int | None:
    """Milliseconds since 1970 of an ISO text (UTC without a zone), or of a number of seconds or milliseconds; None for anything else."""
    text = str(value).strip()
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        n = float(text)
        return round(n if abs(n) >= 1e11 else 1000 * n)
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def _said(name: str, ms: int) -> str:
    """A point in time as the system expects it."""
    if name == "splunk":
        return f"{ms / 1000:.3f}"
    at = datetime.fromtimestamp(ms / 1000, timezone.utc)
    return at.strftime("%Y-%m-%d %H:%M:%S") + f".{ms % 1000:03d}" if name == "qradar" else at.strftime("%Y-%m-%dT%H:%M:%S") + f".{ms % 1000:03d}Z"


def register_stream(spark: SparkSession, name: str, schema: str, transport: Transport, now: Callable[[], float] = time.time) -> None:
    """Make ``spark.readStream.format(f"alerts_{name}_stream")`` follow a connector's system.

    Options besides the connector's: ``since`` (start, ISO or epoch), ``time_field`` (the column that holds an event's time; rows outside the
    window that was asked for are left out), ``settle`` (seconds that events may come late), ``readers`` (windows that are read side by
    side) and ``longest`` (seconds of time that one window spans at most, so a long past is the work of many tasks).
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = dict(options)
            self.at: int | None = None

        def initialOffset(self) -> dict:
            start = instant(self.options.get("since", "0"))
            if start is None:
                raise ValueError(f"since: {self.options['since']!r} is no time")
            return {"at": start}

        def latestOffset(self) -> dict:
            end = round(1000 * (now() - float(self.options.get("settle", SETTLE))))
            self.at = end if self.at is None else max(self.at, end)  # a clock that goes back reads nothing again
            return {"at": self.at}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            a, z = start["at"], end["at"]
            self.at = max(z, self.at or z)
            n = max(1, int(self.options.get("readers", 1)), -(-(z - a) // round(1000 * float(self.options.get("longest", LONGEST)))))
            cuts = sorted({a + (z - a) * i // n for i in range(n + 1)}) if z > a else []
            return [InputPartition(w) for w in zip(cuts[:-1], cuts[1:], strict=True)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            a, z = partition.value
            where = {"since": _said(name, a), "until": _said(name, z)}
            field = self.options.get("time_field")
            for row in read_pages(name, self.options | where, transport):
                at = instant(row.get(field)) if field else None
                if at is None or a <= at < z:
                    yield tuple(None if row.get(c) is None else str(row[c]) for c in columns)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"alerts_{name}_stream"

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002
            return Reader(self.options)

    spark.dataSource.register(Source)


class Ring:
    """Lines of a datagram socket, numbered as they come. Of more than ``size`` unread ones the oldest go, and are counted."""

    def __init__(self, host: str, port: int, size: int):
        self.size, self.lines, self.next, self.dropped, self.lock = size, deque(), 0, 0, threading.Lock()
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((host, port))
        threading.Thread(target=self._listen, daemon=True).start()

    def _listen(self) -> None:
        while True:
            try:
                data, _ = self.socket.recvfrom(65_535)
            except OSError:
                return
            self.add(data.decode("utf-8", "replace").rstrip("\r\n\x00"))

    def add(self, line: str) -> None:
        with self.lock:
            self.lines.append((self.next, line))
            self.next += 1
            if len(self.lines) > self.size:
                self.lines.popleft()
                self.dropped += 1

    def resume(self, number: int) -> None:
        """Number lines from ``number`` on, where an earlier listener left off."""
        with self.lock:
            if number > self.next:
                shift = number - self.next
                self.lines = deque((n + shift, line) for n, line in self.lines)
                self.next += shift

    def between(self, start: int, end: int | None = None) -> tuple[list[tuple[int, str, int]], int]:
        with self.lock:
            end = self.next if end is None else end
            return [(n, line, self.dropped) for n, line in self.lines if start <= n < end], end

    def forget(self, before: int) -> None:
        with self.lock:
            while self.lines and self.lines[0][0] < before:
                self.lines.popleft()


class SyslogSource(DataSource):
    """``spark.readStream.format("syslog_udp")``: number, line and lines dropped so far, of datagrams to ``host``:``port``. A listener holds ``ring`` lines
    at most (10,000) until their micro-batch is committed. Datagrams that come while no query runs are lost, as nobody asks for them again."""

    @classmethod
    def name(cls) -> str:
        return "syslog_udp"

    def schema(self) -> str:
        return "number long, line string, dropped long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002
        return _SyslogReader(self.options)


class _SyslogReader(DataSourceStreamReader):
    """The listener lives where offsets are planned; lines travel to tasks in their partitions, ``ring`` of them at most."""

    def __init__(self, options: dict):
        self.options, self.ring = dict(options), None

    def _open(self, number: int = 0) -> Ring:
        if self.ring is None:
            self.ring = Ring(self.options.get("host", "127.0.0.1"), int(self.options["port"]), int(self.options.get("ring", 10_000)))
            self.ring.resume(time.time_ns() // 1000)  # beyond all numbers of an earlier run
        self.ring.resume(number)
        return self.ring

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        return {"number": self._open().next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows, _ = self._open(end["number"]).between(start["number"], end["number"])
        return [InputPartition(rows[i : i + 1000]) for i in range(0, len(rows), 1000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.value

    def commit(self, end: dict) -> None:
        self._open(end["number"]).forget(end["number"])
