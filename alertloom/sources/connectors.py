"""Python data sources for event search APIs, and a registry of connectors.

A connector turns options into requests, one for each page, and responses into rows; the transport (a callable from request to decoded
JSON) is pluggable, so tests and air-gapped clusters need no network. Time bounds (``since`` included, ``until`` not) and the place of
the page are part of the request: the filter runs in the remote system. Without ``pages`` one task reads page after page until one is
short; with it, that many tasks read side by side, the last of them all that follows. ``event_streams`` reads the same systems as a stream.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import count
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession

Transport = Callable[[dict], "list[dict] | dict"]
#: Rows of a page, seconds after which a search of its own counts as failed, and how long a point in time is kept between pages.
PAGE, PATIENCE, KEEP_ALIVE = 2000, 3600, "5m"
#: Keys that wrap a list of events.
WRAPPERS = ("events", "alerts", "data", "records", "results")


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    body: str = ""
    headers: dict = field(default_factory=dict)


def _limit(o: dict) -> int:
    return int(o.get("limit", PAGE))


def _bearer(o: dict) -> dict:
    return {"Authorization": f"Bearer {o['token']}"} if o.get("token") else {}


def splunk_request(o: dict, page: int = 0, last: dict | list | None = None) -> Request:  # noqa: ARG001
    query = o.get("query", "search index=*") + "".join(f" {word}={o[k]}" for k, word in (("since", "earliest"), ("until", "latest")) if o.get(k))
    return Request("POST", f"{o['url']}/services/search/jobs", urlencode({"search": query, "output_mode": "json", "exec_mode": "oneshot", "count": _limit(o), "offset": page * _limit(o)}), _bearer(o))


def elastic_request(o: dict, page: int = 0, last: dict | list | None = None) -> Request:
    """Pages in a row go on behind the last hit (no bound on depth), others by offset. With a point in time (``pit``) hits of one timestamp
    have an order of their own, and ``slice`` and ``slices`` part them between readers."""
    bounds = {word: o[k] for k, word in (("since", "gte"), ("until", "lt")) if o.get(k)}
    body = {"size": _limit(o), "sort": [{"@timestamp": "asc"}, {"_shard_doc" if o.get("pit") else "_doc": "asc"}], "query": {"bool": {"filter": [{"range": {"@timestamp": bounds}}] if bounds else []}}}
    if o.get("pit"):
        body["pit"] = {"id": o["pit"], "keep_alive": KEEP_ALIVE}
    if "slices" in o:
        body["slice"] = {"id": int(o["slice"]), "max": int(o["slices"])}
    hits = last.get("hits", {}).get("hits", []) if isinstance(last, dict) else []
    if hits and "sort" in hits[-1]:
        body["search_after"] = hits[-1]["sort"]
    elif page and not o.get("pit"):
        body["from"] = page * _limit(o)
    return Request("POST", f"{o['url']}/_search" if o.get("pit") else f"{o['url']}/{o.get('index', '*')}/_search", json.dumps(body), _bearer(o))


def kql_request(o: dict, page: int = 0, last: dict | list | None = None) -> Request:  # noqa: ARG001
    where = "".join(f' | where TimeGenerated {sign} datetime("{o[k]}")' for k, sign in (("since", ">="), ("until", "<")) if o.get(k))
    rows = f" | order by TimeGenerated asc | serialize _n = row_number() | where _n > {page * _limit(o)} and _n <= {(page + 1) * _limit(o)}"
    return Request("POST", f"{o['url']}/query", json.dumps({"query": o.get("query", "SecurityAlert") + where + rows}), _bearer(o))


def aql_request(o: dict, page: int = 0, last: dict | list | None = None) -> Request:  # noqa: ARG001
    where = "".join(f" {word} '{o[k]}'" for k, word in (("since", "START"), ("until", "STOP")) if o.get(k))
    return Request("POST", f"{o['url']}/api/ariel/searches?" + urlencode({"query_expression": o.get("query", "SELECT * FROM events") + where}), headers={"SEC": o["token"]} if o.get("token") else {})


def token_request(o: dict) -> Request:
    """A client's request for a token of the tenant."""
    body = {"grant_type": "client_credentials", "client_id": o["client_id"], "client_secret": o["client_secret"], "scope": f"{o['url'].rsplit('/v1', 1)[0]}/.default"}
    return Request("POST", f"{o.get('login', 'https://login.microsoftonline.com')}/{o['tenant_id']}/oauth2/v2.0/token", urlencode(body))


CONNECTORS: dict[str, Callable[..., Request]] = {"splunk": splunk_request, "elastic": elastic_request, "sentinel": kql_request, "qradar": aql_request}


def rows_of(answer: list[dict] | dict) -> list[dict]:
    """The rows of a response: a plain list, hits with their sources, tables of columns and rows, or a list under one of the usual keys."""
    if isinstance(answer, list):
        return answer
    if "hits" in answer:
        return [h.get("_source", h) for h in answer["hits"].get("hits", [])]
    if "tables" in answer:
        return [dict(zip([c["name"] for c in t.get("columns", [])], r, strict=True)) for t in answer["tables"][:1] for r in t.get("rows", [])]
    return next((answer[k] for k in (*WRAPPERS, "flows") if isinstance(answer.get(k), list)), [])


def _searched(o: dict, page: int, ask: Transport, search: str) -> dict | list:
    """A page of a finished search; waits until it is, ever longer between two asks, ``patience`` seconds at most."""
    at, headers = f"{o['url']}/api/ariel/searches/{search}", {"SEC": o["token"]} if o.get("token") else {}
    began, pause = time.monotonic(), 0.02
    while True:
        state = ask(asdict(Request("GET", at, headers=headers)) | {"page": page}).get("status", "COMPLETED")
        if state == "COMPLETED":
            span = f"items={page * _limit(o)}-{(page + 1) * _limit(o) - 1}"
            return ask(asdict(Request("GET", f"{at}/results", headers={**headers, "Range": span})) | {"page": page})
        if state in ("ERROR", "CANCELED"):
            raise RuntimeError(f"search {search}: {state}")
        if time.monotonic() - began > float(o.get("patience", PATIENCE)):
            raise TimeoutError(f"search {search} isn't finished after {o.get('patience', PATIENCE)} s")
        time.sleep(pause)
        pause = min(5.0, 1.5 * pause)


def read_pages(name: str, options: dict, transport: Transport, page: int | None = None, whole: bool = False) -> Iterator[dict]:
    """Rows of one page, or (``page`` None, or ``whole``: from that page on) of all pages until one has fewer than ``limit`` rows.

    Clients with a secret get a token, searches that run on their own are started once and read page by page. Search engines that can
    are read at a point in time, so hits neither shift between pages nor repeat.
    """
    o = dict(options)
    if o.get("client_secret"):
        o["token"] = transport(asdict(token_request(o)) | {"page": page or 0})["access_token"]
    if name == "elastic" and page is None:
        opened = transport(asdict(Request("POST", f"{o['url']}/{o.get('index', '*')}/_pit?keep_alive={KEEP_ALIVE}", headers=_bearer(o))) | {"page": 0})
        o["pit"] = opened.get("id") if isinstance(opened, dict) else None
        if not o["pit"] and "slices" in o:
            raise RuntimeError("reading in slices needs a point in time, which this server doesn't open")
    last, search = None, None
    try:
        for p in count(page or 0) if page is None or whole else [page]:
            if search is None:
                last = transport(asdict(CONNECTORS[name](o, p, last)) | {"page": p})
                search = last.get("search_id") if isinstance(last, dict) else None
            if search is not None:
                last = _searched(o, p, transport, search)
            rows = rows_of(last)
            yield from rows
            if len(rows) < _limit(o):
                return
    finally:
        if o.get("pit"):
            transport(asdict(Request("DELETE", f"{o['url']}/_pit", json.dumps({"id": o["pit"]}), _bearer(o))) | {"page": 0})


def register(spark: SparkSession, name: str, schema: str, transport: Transport) -> None:
    """Make ``spark.read.format(f"alerts_{name}")`` read a connector: one partition, or ``pages`` of them."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    columns = [c.strip().split()[0] for c in schema.split(",")]

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(int(self.options["pages"]))] if "pages" in self.options else [InputPartition(None)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            pages = int(self.options.get("pages", 1))
            if name == "elastic" and pages > 1:  # servers bound how far an offset reaches, slices have no bound
                found = read_pages(name, self.options | {"slice": partition.value, "slices": pages}, transport)
            else:
                found = read_pages(name, self.options, transport, partition.value, whole=partition.value == pages - 1)
            for row in found:
                yield tuple(None if row.get(c) is None else str(row[c]) for c in columns)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"alerts_{name}"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return Reader(self.options)

    spark.dataSource.register(Source)


def received(payload: bytes, headers: dict, secret: str = "", now: str | None = None) -> list[dict]:
    """Events of a posted document, for a receiver that puts them into the landing folder of ``webhook_stream``.

    With a secret, the signature of the bytes (X-Hub-Signature-256) or the secret itself (X-Webhook-Secret) must be right, else
    ``PermissionError``. A list, a list under one of the usual keys, or a single event; ``EndDate`` is ``now`` where it is missing.
    """
    if secret:
        signed = headers.get("X-Hub-Signature-256", "")
        if signed.startswith("sha256="):
            right, given = f"sha256={hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest()}", signed
        else:
            right, given = secret, headers.get("X-Webhook-Secret", "")
        if not hmac.compare_digest(right.encode(), given.encode()):
            raise PermissionError("wrong secret or signature")
    found = json.loads(payload)
    if isinstance(found, dict):
        found = next((found[k] for k in WRAPPERS if isinstance(found.get(k), list) and found[k]), [found])
    if not isinstance(found, list):
        raise ValueError(f"neither events nor an event: {type(found).__name__}")
    return [{"EndDate": now, **e} if now else e for e in found]


def syslog_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def webhook_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON documents that a receiver has put into a landing folder."""
    return spark.readStream.schema(schema).json(folder)
