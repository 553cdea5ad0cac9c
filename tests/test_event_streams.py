"""Search systems and syslog as streams, against simulated servers."""

import json
import re
import socket
import time
from pathlib import Path

import pytest

from alertloom.sources import connectors as cn
from alertloom.sources import event_streams as es

BASE = 1_700_000_000_000


class Server:
    """A system whose events lie in a file (time in ms, id by line), so that it goes on over restarts and is seen by all workers. It pages by
    ``limit``, honours bounds, and gives hits of one timestamp in another order at each search without a point in time."""

    def __init__(self, path, kind):
        self.path, self.kind = str(path), kind

    def events(self):
        return [tuple(map(int, x.split())) for x in Path(self.path).read_text().splitlines()] if Path(self.path).exists() else []

    def __call__(self, r):
        url, body = r["url"], r["body"]
        with Path(f"{self.path}.asked").open("a") as f:
            f.write(f"{r['method']} {url}\n")
        row = lambda e: {"time": str(e[0]), "id": str(e[1])}
        if self.kind == "elastic":
            if "/_pit" in url:
                return {"id": "point"} if r["method"] == "POST" else {}
            q = json.loads(body)
            span = q["query"]["bool"]["filter"][0]["range"]["@timestamp"] if q["query"]["bool"]["filter"] else {}
            found = [e for e in self.events() if es.instant(span.get("gte", "0")) <= e[0] < es.instant(span.get("lt", "9e15"[:1] + "0" * 15))]
            if "slice" in q:
                found = [e for e in found if e[1] % q["slice"]["max"] == q["slice"]["id"]]
            assert q["sort"][1] == {"_shard_doc": "asc"} and q["pit"]["id"] == "point" and "from" not in q
            found = sorted(e for e in found if "search_after" not in q or e > tuple(q["search_after"]))
            return {"hits": {"hits": [{"_source": row(e), "sort": list(e)} for e in found[: q["size"]]]}}
        if self.kind == "splunk":
            q = dict(p.split("=", 1) for p in body.split("&"))
            low, high = (float(re.search(rf"{w}%3D([\d.]+)", q["search"])[1]) * 1000 for w in ("earliest", "latest"))
            found = sorted(e for e in self.events() if low <= e[0] < high)[int(q["offset"]) :][: int(q["count"])]
            return {"results": [row(e) for e in found]}
        if self.kind == "sentinel":
            text = json.loads(body)["query"]
            low, high = (es.instant(re.search(rf'{w} datetime\("([^"]+)"', text)[1]) for w in (">=", "<"))
            a, z = (int(x) for x in re.search(r"_n > (\d+) and _n <= (\d+)", text).groups())
            found = sorted(e for e in self.events() if low <= e[0] < high)[a:z]
            return {"tables": [{"columns": [{"name": "time"}, {"name": "id"}], "rows": [list(map(str, e)) for e in found]}]}
        if r["method"] == "POST":
            from urllib.parse import unquote_plus

            low, high = (es.instant(re.search(rf"{w} '([^']+)'", unquote_plus(url))[1]) for w in ("START", "STOP"))
            return {"search_id": f"{low}-{high}"}
        if not url.endswith("/results"):
            return {"status": "COMPLETED" if time.time() * 10 % 3 > 1 else "EXECUTE"}
        low, high = (int(x) for x in url.split("/")[-2].split("-"))
        a, z = map(int, r["headers"]["Range"].removeprefix("items=").split("-"))
        return {"events": [row(e) for e in sorted(e for e in self.events() if low <= e[0] <= high)[a : z + 1]]}  # this one's bound is closed


@pytest.mark.parametrize("kind", sorted(cn.CONNECTORS))
def test_stream_loses_and_doubles_nothing(spark, tmp_path, kind):
    """Three runs on one checkpoint, with more events between them; many share one timestamp, also at the ends of windows."""
    server, clock = Server(tmp_path / "events", kind), tmp_path / "now"
    es.register_stream(spark, kind, "time string, id string", server, lambda: float(Path(clock).read_text()))
    n = 0
    for run in range(3):
        start = BASE + 10_000 * run
        with Path(server.path).open("a") as f:
            for k in range(40):
                f.write(f"{start + (k // 8) * 2000} {n}\n")
                n += 1
        clock.write_text(str((start + 10_000) / 1000 + 5))
        stream = spark.readStream.format(f"alerts_{kind}_stream").options(url="https://x", since=str(BASE), limit="3", settle="5", readers="5", time_field="time").load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        assert sorted(int(r.id) for r in got) == list(range(n))
    asked = Path(f"{server.path}.asked").read_text()
    if kind == "elastic":
        assert asked.count("POST https://x/*/_pit") == asked.count("DELETE https://x/_pit") > 0


def test_long_past_is_cut_into_windows(spark, tmp_path):
    server = Server(tmp_path / "events", "splunk")
    Path(server.path).write_text("".join(f"{BASE + 1000 * k} {k}\n" for k in range(100)))
    es.register_stream(spark, "splunk", "time string, id string", server, lambda: BASE / 1000 + 100)
    stream = spark.readStream.format("alerts_splunk_stream").options(url="https://x", since=str(BASE), settle="0", longest="30", time_field="time").load()
    found = []
    q = stream.writeStream.foreachBatch(lambda df, _: found.append((df.count(), df.rdd.getNumPartitions()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert found == [(100, 4)]


def test_elastic_is_read_in_slices(spark, tmp_path):
    server = Server(tmp_path / "events", "elastic")
    Path(server.path).write_text("".join(f"{BASE + k // 10} {k}\n" for k in range(50)))
    cn.register(spark, "elastic", "time string, id string", server)
    got = spark.read.format("alerts_elastic").options(url="https://x", limit="4", pages="3").load().collect()
    assert sorted(int(r.id) for r in got) == list(range(50))


def test_last_of_several_pages_reads_on(spark):
    events = [{"host": str(k)} for k in range(11)]

    def remote(r):
        q = dict(p.split("=", 1) for p in r["body"].split("&"))
        return {"results": events[int(q["offset"]) :][: int(q["count"])]}

    cn.register(spark, "splunk", "host string", remote)
    got = spark.read.format("alerts_splunk").options(url="https://x", limit="2", pages="3").load().collect()
    assert sorted(int(r.host) for r in got) == list(range(11))


def test_search_that_never_ends_is_given_up():
    with pytest.raises(TimeoutError):
        list(cn.read_pages("qradar", {"url": "https://x", "patience": "0.1"}, lambda r: {"search_id": "s"} if r["method"] == "POST" else {"status": "EXECUTE"}))


def test_instants():
    assert es.instant("2024-01-01") == es.instant("2024-01-01T00:00:00Z") == es.instant(1704067200) == es.instant("1704067200000")
    assert es.instant("2024-01-01T01:00:00+01:00") == 1704067200000 and es.instant("x") is None and es.instant(None) is None


def test_ring_drops_the_oldest():
    ring = es.Ring("127.0.0.1", 0, 5)
    for k in range(8):
        ring.add(str(k))
    rows, end = ring.between(0)
    assert [r[:2] for r in rows] == [(k, str(k)) for k in range(3, 8)] and end == 8 and ring.dropped == 3
    ring.forget(6)
    assert [r[0] for r in ring.between(0)[0]] == [6, 7]
    ring.resume(100)
    assert [r[0] for r in ring.between(0)[0]] == [98, 99]
    ring.socket.close()


def test_syslog_over_udp(spark, tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    spark.dataSource.register(es.SyslogSource)
    stream = spark.readStream.format("syslog_udp").options(port=str(port)).load()
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    out, sent, end, got = socket.socket(socket.AF_INET, socket.SOCK_DGRAM), 0, time.time() + 60, []
    while time.time() < end and len(got) < 20:
        out.sendto(f"<34>line {sent}\n".encode(), ("127.0.0.1", port))
        sent += 1
        time.sleep(0.1)
        if sent % 20 == 0 and list(Path(tmp_path).glob("out/*.parquet")):
            got = spark.read.schema("number long, line string, dropped long").parquet(f"{tmp_path}/out").collect()
    q.stop()
    numbers = [r.number for r in got]
    assert len(got) >= 20 and len(set(numbers)) == len(numbers) and all(re.fullmatch(r"<34>line \d+", r.line) for r in got)
    assert len({r.line for r in got}) == len(got) and all(r.dropped == 0 for r in got)
