"""Operators without SQL: spanning forests, feature baselines, connectors, and odd tables of the reports."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import correlation as co
from alertloom.operators import graph as gr
from alertloom.operators import reports as re_
from alertloom.schema import FieldRoles
from alertloom.sources import connectors as cn


def accepted(edges):
    up, out = {}, []

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, d, n in sorted(edges, key=lambda e: e[2]):
        if root(s) != root(d):
            up[root(s)] = root(d)
            out.append(n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spanning_edges_are_those_a_union_find_accepts(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40), n) for n in r.sample(range(1000), 60)]
    got = re_.spanning_edges(spark.createDataFrame(edges, "src long, dst long, n long"), "n")
    assert sorted(x.n for x in got.collect()) == sorted(accepted(edges))


def test_cluster_weights(spark):
    edges = [(1, 2, 0.5, 0), (2, 1, 9.0, 1), (2, 3, 0.25, 2), (7, 8, 1.0, 3), (1, 3, 4.0, 4)]
    got = re_.cluster_weights(spark.createDataFrame(edges, "src long, dst long, w double, n long"), "w", "n").collect()
    assert {(x.component, x.size, x.weight) for x in got} == {(1, 3, 0.75), (7, 2, 1.0)}
    none = spark.createDataFrame([], "src long, dst long, w double, n long")
    assert re_.cluster_weights(none, "w", "n").count() == 0


@pytest.mark.parametrize("sources", [5, 100])
def test_betweenness_is_the_same_by_joins(spark, sources):
    r = random.Random(3)
    edges = {(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)} | {("x", "y"), ("y", "z"), ("q", "q")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    small = {x.node: x.betweenness for x in gr.betweenness(df, sources).collect()}
    large = {x.node: x.betweenness for x in gr.betweenness(df, sources, most_edges=3).collect()}
    assert large == pytest.approx(small) and max(small.values()) == 1.0


def test_feature_baseline_finds_plain_groups(spark):
    rows = [(i, float(i % 3) * 100 + i * 0.01, "abc"[i % 3]) for i in range(60)]
    got = re_.feature_baseline(spark.createDataFrame(rows, "alert_idx long, x double, kind string"), ["x"], "kind").first()
    assert got.ari == pytest.approx(1.0)


def test_common_value_pairs_of_odd_rows(spark):
    rows = [(1, 1, "a", "b", "c"), (2, 1, "a", "b", "c"), (3, 1, "a", "b", None), (4, 2, "a", "b", "c"), (5, 1, "b", "a", "c"), (6, 1, "NIL", "NIL", "NIL"), (7, 1, "NIL", "NIL", "NIL"), (8, 1, "a", "a", "a"), (9, 1, "a", "a", "a")]
    df = spark.createDataFrame(rows, "alert_idx long, g int, x string, y string, z string")
    got = {(r.src, r.dst) for r in re_.common_value_pairs(df, "g", FieldRoles(["x", "y", "z"], [])).collect()}
    assert got == {(1, 2), (1, 5), (2, 5)}
    assert re_.common_value_pairs(df.limit(0), "g", FieldRoles(["x", "y", "z"], [])).count() == 0


def pairwise(rows, need, span):
    """Components by all pairs; rows: id, addresses, users, seconds."""
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            eq = lambda k: sum(x == y and x is not None for x, y in zip(a[k], b[k], strict=True))  # noqa: B023, E731
            near = max(0.0, 1 - abs(a[3] - b[3]) / 3600) if span else 0
            if 6 * eq(1) + 3 * eq(2) + near >= need - 1e-9:
                x, y = sorted((root(a[0]), root(b[0])))
                up[y] = x
    return {r[0]: root(r[0]) for r in rows}


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.32, 0.55, 0.6, 0.95, 1.0])
@pytest.mark.parametrize("span", [False, True])
def test_links_have_the_components_of_all_pairs(spark, threshold, span):
    r = random.Random(int(threshold * 100))
    some = lambda n: r.choice([None, *"abcd"[:n]])
    rows = [(i, [some(4), some(3)], [some(4)], r.randrange(20000)) for i in range(60)]
    df = spark.createDataFrame([(i, *a, *u, s) for i, a, u, s in rows], "alert_idx long, p string, q string, u string, s long").withColumn("EndDate", F.timestamp_seconds("s"))
    roles = FieldRoles(["p", "q"], ["u"])
    got = co.correlate(df, roles, threshold, time_col="EndDate" if span else None).collect()
    first = {}
    for x in sorted(got, key=lambda x: x.alert_idx):
        first.setdefault(x.pred_cluster, x.alert_idx)
    want = pairwise(rows, threshold * co.scale(roles, span), span)
    assert {x.alert_idx: first[x.pred_cluster] for x in got} == want


def test_max_scores_of_rows_with_missing_values(spark):
    rows = [(1, None, "a", "b"), (2, "a", None, "b"), (3, "a", "c", None), (4, "z", "z", "z"), (5, "y", "y", "y"), (6, "y", "y", "y"), (7, None, None, None), (8, None, None, None)]
    df = spark.createDataFrame(rows, "alert_idx long, p string, q string, u string")
    got = {r.alert_idx: round(r.max_correlation_score * 15) for r in co.max_scores(df, FieldRoles(["p", "q"], ["u"])).collect()}
    assert got == {1: 3, 2: 6, 3: 6, 4: 0, 5: 15, 6: 15, 7: 0, 8: 0}


class Remote:
    """A remote system of ``n`` events that answers as each of the connectors expects."""

    def __init__(self, n):
        self.events, self.asked = [{"host": f"h{i}"} for i in range(n)], []

    def __call__(self, r):
        self.asked.append(r)
        url, body = r["url"], r["body"]
        if url.endswith("/token"):
            return {"access_token": "t0k"}
        if "/services/search/jobs" in url:
            q = dict(p.split("=", 1) for p in body.split("&"))
            return {"results": self.events[int(q["offset"]) :][: int(q["count"])]}
        if url.endswith("/_search"):
            q = json.loads(body)
            at = q["search_after"][0] + 1 if "search_after" in q else q.get("from", 0)
            return {"hits": {"hits": [{"_source": e, "sort": [at + i]} for i, e in enumerate(self.events[at : at + q["size"]])]}}
        if url.endswith("/query"):
            low, high = (int(x.split()[0]) for x in json.loads(body)["query"].split("_n >")[1].replace("and _n <=", "|").split("|")[:2])
            return {"tables": [{"columns": [{"name": "host"}], "rows": [[e["host"]] for e in self.events[low:high]]}]}
        if url.endswith("/results"):
            low, high = map(int, r["headers"]["Range"].removeprefix("items=").split("-"))
            return {"events": self.events[low : high + 1]}
        return {"status": "COMPLETED"} if r["method"] == "GET" else {"search_id": "s1"}


@pytest.mark.parametrize("name", sorted(cn.CONNECTORS))
@pytest.mark.parametrize("n", [0, 5, 6, 7])
def test_connectors_read_all_pages(name, n):
    remote = Remote(n)
    got = [r["host"] for r in cn.read_pages(name, {"url": "https://x/v1", "limit": "3", "since": "2024-01-01"}, remote)]
    assert got == [f"h{i}" for i in range(n)]
    assert [r["host"] for r in cn.read_pages(name, {"url": "https://x", "limit": "3"}, remote, 1)] == [f"h{i}" for i in range(n)][3:6]


def test_client_gets_a_token():
    remote = Remote(1)
    o = {"url": "https://x/v1/workspaces/w", "client_id": "c", "client_secret": "s", "tenant_id": "t"}
    assert len(list(cn.read_pages("sentinel", o, remote))) == 1
    assert remote.asked[0]["url"].endswith("/t/oauth2/v2.0/token") and remote.asked[1]["headers"] == {"Authorization": "Bearer t0k"}


def test_received_checks_secrets_and_unwraps():
    body = json.dumps({"alerts": [{"a": 1}, {"a": 2, "EndDate": "x"}]}).encode()
    sign = {"X-Hub-Signature-256": "sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest()}
    assert cn.received(body, sign, "k", "now") == [{"EndDate": "now", "a": 1}, {"EndDate": "x", "a": 2}]
    assert cn.received(b'{"a": 1}', {"X-Webhook-Secret": "k"}, "k") == [{"a": 1}] and cn.received(b'[{"a": 1}]', {}) == [{"a": 1}]
    for wrong in ({}, {"X-Webhook-Secret": "j"}, {"X-Hub-Signature-256": "sha256=0"}):
        with pytest.raises(PermissionError):
            cn.received(body, wrong, "k")
    with pytest.raises(ValueError):
        cn.received(b"3", {})


def test_hubs_of_betweenness_are_dealt_out(spark, monkeypatch):
    rng = __import__("random").Random(6)
    rows = {tuple(sorted((f"n{rng.randrange(30)}", "hub" if rng.random() < 0.4 else f"n{rng.randrange(30)}"))) for _ in range(70)}
    df = spark.createDataFrame(sorted(r for r in rows if r[0] != r[1]), "src string, dst string")
    want = {x.node: x.betweenness for x in gr.betweenness(df).collect()}
    kept, tables = gr.written, {}
    monkeypatch.setattr(gr, "written", lambda d, name, *a: tables.setdefault(name, kept(d, name, *a)) if name == "both" else kept(d, name, *a))
    start = df.select("src").union(df.select("dst")).distinct().toDF("node")
    pairs = df.toDF("a", "b")
    got = {x.node: x.b for x in gr._dependencies(pairs, start, few=4).groupBy("node").agg({"b": "sum"}).toDF("node", "b").collect()}
    top = max(got.values())
    assert all(abs(got.get(n, 0.0) / top - x) < 1e-9 for n, x in want.items())
    of_hub = {r.part: r["count"] for r in tables["both"].where("v = 'hub'").groupBy("part").count().collect()}
    assert len(of_hub) > 1  # one task had all of them before
