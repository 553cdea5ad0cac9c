"""Entity graphs of alerts: edges, campaign and ego views, PageRank, betweenness."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.plans.stage import written
from alertloom.schema import clean

ENTITIES = {"SourceAddress": "ip", "DestinationAddress": "ip", "DeviceAddress": "ip", "SourceHostName": "host", "DeviceHostName": "host", "DestinationHostName": "host", "SourceUserName": "user"}

#: Neighbours of a node that one task meets, about.
HUB_PART = 10_000


def entities(df: DataFrame, id_col: str = "alert_idx", columns: dict[str, str] | None = None) -> DataFrame:
    """A row for each value of each entity column: id, place, kind, entity (kind:value)."""
    cols = list((columns or ENTITIES).items())
    parts = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), clean(c)).alias("entity")) for i, (c, k) in enumerate(cols)]
    return df.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("x")).where("x.entity is not null").select("id", "x.*")


def cooccurrence_edges(df: DataFrame, columns: dict[str, str] | None = None, id_col: str = "alert_idx") -> DataFrame:
    """Distinct undirected edges between entities of a row (src < dst)."""
    cols = list((columns or ENTITIES).items())
    name = lambda c, k: F.concat(F.lit(f"{k}:"), clean(c))
    pairs = [F.struct(F.least(name(*a), name(*b)).alias("src"), F.greatest(name(*a), name(*b)).alias("dst"), (name(*a).isNotNull() & name(*b).isNotNull() & (name(*a) != name(*b))).alias("ok")) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return df.select(F.explode(F.array(*pairs)).alias("x")).where("x.ok").groupBy("x.src", "x.dst").agg(F.count(F.lit(1)).alias("weight"))


def shared_entity_edges(df: DataFrame, id_col: str = "alert_idx") -> DataFrame:
    """Each alert to the first alert of each of its entities: a star in place of all pairs, with the same components."""
    e = entities(df, id_col).select("id", "entity").distinct()
    first = e.groupBy("entity").agg(F.min("id").alias("dst"))
    return e.join(first, "entity").where("id <> dst").select(F.col("id").alias("src"), "dst", "entity")


def hetero_edges(df: DataFrame, id_col: str = "alert_idx") -> DataFrame:
    """Typed bipartite edges alert to entity, one relation for each role."""
    return entities(df, id_col).select(F.concat(F.lit("alert_"), "column").alias("rel"), F.col("id").alias("src"), F.col("entity").alias("dst")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 5) -> DataFrame:
    """Undirected PageRank, no redistribution from dangling nodes, divided by the largest. Contributions are combined before
    they are shuffled; ranks are written every few rounds."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").distinct(), "both")
    degree = written(both.groupBy("src").agg(F.count(F.lit(1)).alias("d")), "degree")
    n = max(1, degree.count())
    out = written(both.join(degree, "src"), "out")
    rank = degree.select(F.col("src").alias("node"), F.lit(1.0 / n).alias("r"))
    for k in range(rounds):
        sums = out.join(rank, out.src == rank.node).groupBy("dst").agg(F.sum(F.col("r") / F.col("d")).alias("s"))
        rank = degree.join(sums, degree.src == sums.dst, "left").select(F.col("src").alias("node"), ((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))).alias("r"))
        if (k + 1) % every == 0:
            rank = written(rank, "rank")
    top = rank.agg(F.max("r").alias("_m"))
    return rank.crossJoin(F.broadcast(top)).select("node", (F.col("r") / F.col("_m")).alias("pagerank"))  # one row


def betweenness(edges: DataFrame, sources: int = 100, most_edges: int = 200_000) -> DataFrame:
    """Brandes' betweenness from up to ``sources`` nodes (all, or those of the smallest hash), divided by the largest.

    Up to ``most_edges`` distinct edges the adjacency goes to every task; a larger graph is searched level by level with joins.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    rows = pairs.limit(most_edges + 1).collect()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    start = nodes.orderBy(F.xxhash64("node"), "node").limit(sources)
    if len(rows) > most_edges:
        return _shares(nodes, _dependencies(pairs, start))
    near: dict[str, list[str]] = {}
    for r in rows:
        near.setdefault(r.a, []).append(r.b)
        near.setdefault(r.b, []).append(r.a)

    def brandes(batches):
        for batch in batches:
            total: dict[str, float] = {}
            for s in batch["node"]:
                order, before, paths, far = [], {s: []}, {s: 1.0}, {s: 0}
                todo = deque([s])
                while todo:
                    v = todo.popleft()
                    order.append(v)
                    for w in near.get(v, ()):
                        if w not in far:
                            far[w], paths[w], before[w] = far[v] + 1, 0.0, []
                            todo.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                gain = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        gain[v] += paths[v] / paths[w] * (1 + gain[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + gain[w]
            yield pd.DataFrame({"node": list(total), "b": list(total.values())})

    return _shares(nodes, start.repartition(8).mapInPandas(brandes, "node string, b double"))


def _shares(nodes: DataFrame, gains: DataFrame) -> DataFrame:
    sums = gains.groupBy("node").agg(F.sum("b").alias("b"))
    top = sums.agg(F.max("b").alias("_m"))
    scored = sums.crossJoin(F.broadcast(top)).select("node", F.when(F.col("_m") > 0, F.col("b") / F.col("_m")).otherwise(0.0).alias("betweenness"))  # one row
    return nodes.join(scored, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _dependencies(pairs: DataFrame, start: DataFrame, few: int = HUB_PART) -> DataFrame:
    """What each source (smallest hash first) adds to each node: paths are counted level by level, each level a written table, then gains go back
    up the same levels. A row for each source and node; the driver holds only the number of levels. A hub's neighbours are dealt out to
    parts of ``few``, and its rows go to each of them, so that it is the work of many tasks."""
    ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).union(pairs.select("b", "a"))
    parts = written(ends.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / few).cast("int").alias("parts")).where("parts > 1"), "parts")
    number = F.coalesce("parts", F.lit(1))
    both = written(ends.join(parts.hint("merge"), "v", "left").select("v", "w", F.pmod(F.xxhash64("w"), number).cast("int").alias("part")), "both")

    def met(rows: DataFrame) -> DataFrame:
        """Rows of nodes v with the neighbours w of these."""
        dealt = rows.join(parts.hint("merge"), "v", "left").withColumn("part", F.explode(F.sequence(F.lit(0), number - 1))).drop("parts")
        return dealt.join(both.hint("merge"), ["v", "part"])

    levels = [written(start.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")), "level")]
    while True:
        reached = met(levels[-1]).groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:  # a neighbour of a level is in it, in the one before or in the next
            reached = reached.join(seen.select("s", "v"), ["s", "v"], "left_anti")
        level = written(reached, "level")
        if level.limit(1).count() == 0:
            break
        levels.append(level)
    out, below = None, levels[-1].withColumn("gain", F.lit(0.0))
    for up in reversed(levels[:-1]):
        out = below if out is None else out.unionByName(below)
        shares = met(below.select("s", "v", ((1 + F.col("gain")) / F.col("paths")).alias("x"))).groupBy("s", F.col("w").alias("v")).agg(F.sum("x").alias("x"))
        below = written(up.join(shares, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("gain")), "gains")
    found = below if out is None else out.unionByName(below)
    return found.where("s <> v").select(F.col("v").alias("node"), F.col("gain").alias("b"))


def campaign_graph(df: DataFrame, hosts: tuple[str, ...] = ("SourceHostName", "DestinationHostName"), tactic: str = "MalwareIntelAttackType") -> DataFrame:
    """Weighted edges host to tactic."""
    rows = df.select(F.col(tactic).alias("tactic"), F.explode(F.array(*[clean(h) for h in hosts])).alias("host")).where("host is not null")
    return rows.groupBy("host", "tactic").agg(F.count(F.lit(1)).alias("weight"))


def ego_net(df: DataFrame, host: str = "SourceHostName", address: str = "DestinationAddress") -> DataFrame:
    """Addresses around the most frequent host (smallest on ties), with counts."""
    focus = df.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), host).limit(1).select(F.col(host).alias("focus"))
    return df.join(F.broadcast(focus), df[host] == F.col("focus")).groupBy("focus", F.col(address).alias("neighbour")).agg(F.count(F.lit(1)).alias("weight"))  # one row


def degree(edges: DataFrame) -> DataFrame:
    return edges.select("src").union(edges.select("dst")).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def drop_edges(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Edges that a hash of their ends keeps; the same ones in every run."""
    return edges.where(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1000)) >= int(1000 * share))


def top_neighbours(edges: DataFrame, k: int = 10, score: str = "weight") -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.col(score).desc(), "dst")
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
