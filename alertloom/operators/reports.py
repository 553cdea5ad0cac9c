"""Graph views, spanning forests, detection reports and feedback over results."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.baselines import kmeans
from alertloom.operators.components import connected_components
from alertloom.operators.evaluation import contingency, pair_scores
from alertloom.plans.stage import written
from alertloom.schema import FieldRoles, clean

#: Colours of tactics by the first name that a tactic holds, and the colour of others.
TACTIC_COLOURS = {
    "initial_access": "#ef4444", "execution": "#f97316", "persistence": "#f59e0b", "privilege_escalation": "#eab308", "defense_evasion": "#84cc16", "credential_access": "#22c55e",
    "discovery": "#10b981", "lateral_movement": "#14b8a6", "collection": "#06b6d4", "command_and_control": "#3b82f6", "exfiltration": "#6366f1", "impact": "#8b5cf6",
}
OTHER_COLOUR = "#6b7280"
#: What two domains in one window point to.
CROSS_DOMAIN = {"suspected_lateral_movement": ("network", "host"), "suspected_phishing_campaign": ("email", "network"), "suspected_cloud_compromise": ("cloud", "endpoint")}
#: Shares of simulated verdicts.
POSITIVE, NEW_POSITIVE, ANSWERED = 0.6, 0.25, 0.2


def tactic_colour(tactic: Column) -> Column:
    out = None
    for name, colour in TACTIC_COLOURS.items():
        hit = F.contains(F.lower(tactic), F.lit(name))
        out = F.when(hit, colour) if out is None else out.when(hit, colour)
    return out.otherwise(OTHER_COLOUR)


def graph_nodes(df: DataFrame, tactic: str = "MalwareIntelAttackType", hosts: tuple[str, ...] = ("SourceHostName", "DestinationHostName", "DeviceHostName")) -> DataFrame:
    """Tactics (size 20, coloured) and hosts (larger the more tactics they meet, up to 40) as nodes of a drawing; hosts have no colour."""
    tactics = df.select(F.col(tactic).alias("label")).where("label is not null").distinct().select("label", F.lit("tactic").alias("type"), tactic_colour(F.col("label")).alias("color"), F.lit(20).cast("long").alias("size"))
    seen = df.select(F.col(tactic).alias("t"), F.explode(F.array(*hosts)).alias("label")).where("label is not null and t is not null")
    sizes = seen.groupBy("label").agg((10 + F.least(F.lit(30), 5 * F.countDistinct("t"))).cast("long").alias("size"))
    return tactics.unionByName(sizes.select("label", F.lit("host").alias("type"), F.lit(None).cast("string").alias("color"), "size"))


def common_value_pairs(df: DataFrame, cluster: str, roles: FieldRoles, more_than: int = 2, id_col: str = "alert_idx") -> DataFrame:
    """Pairs (src < dst) of a cluster's rows that have more than ``more_than`` values in common, addresses and users each among themselves.

    Rows are matched by sets of ``more_than`` + 1 values, so only pairs of the result meet; these are as many as a drawing has lines.
    """
    values = F.array_distinct(F.filter(F.flatten(F.array(*[F.array(*[F.struct(F.lit(r).alias("r"), clean(c).alias("v")) for c in cs]) for r, cs in (("a", roles.addresses), ("u", roles.usernames)) if cs])), lambda x: x["v"].isNotNull()))
    width = len(roles.addresses) + len(roles.usernames)
    rows = df.select(F.col(id_col).alias("id"), F.col(cluster).alias("c"), F.array_sort(values).alias("x"))
    sets = [list(s) for s in combinations(range(width), more_than + 1)]
    at = lambda i: F.get("x", F.lit(i))
    differ = lambda s: reduce(and_, [at(i)["v"] != at(j)["v"] for i, j in combinations(s, 2)], at(s[-1]).isNotNull())
    digest = lambda s: F.struct(F.xxhash64(*map(at, s)).alias("h"), F.xxhash64(F.lit(1), *map(at, s)).alias("g"))  # noqa: E731  128 bits
    keyed = rows.select("id", "c", F.explode(F.array_compact(F.array(*[F.when(differ(s), digest(s)) for s in sets]))).alias("k")).select("id", "c", "k.*")
    a, b = keyed.alias("a"), keyed.alias("b")
    same = (F.col("a.c") == F.col("b.c")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id"))
    # the file's size knows nothing of exploded rows: no side may be broadcast
    return a.join(b.hint("merge"), same).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("a.c").alias(cluster)).distinct()


def spanning_edges(edges: DataFrame, order: str, rounds: int = 60) -> DataFrame:
    """The edges (src, dst, ``order``, ...) that join two trees when taken in ``order`` (unique): what a union-find accepts one by one.

    These are the minimum spanning forest by ``order``; each round every tree takes its least edge to another tree, so trees halve.
    """
    live = written(edges.where("src <> dst").withColumns({"_a": F.col("src"), "_b": F.col("dst")}), "live")
    taken = None
    for _ in range(rounds):
        ends = live.select(F.col("_a").alias("t"), F.col(order).alias("o")).unionByName(live.select(F.col("_b").alias("t"), F.col(order).alias("o")))
        least = ends.groupBy("t").agg(F.min("o").alias(order)).select(order).distinct()
        new = written(live.join(least, order, "left_semi"), "taken")
        if new.limit(1).count() == 0:
            break
        taken = new if taken is None else taken.unionByName(new)
        trees = written(connected_components(new, "_a", "_b"), "trees")
        at = lambda c: trees.select(F.col("node").alias(c), F.col("component").alias(f"{c}n"))  # noqa: B023, E731
        # every live tree has an edge to another, so it took one and is in the table
        moved = live.join(at("_a"), "_a").join(at("_b"), "_b").where("_an <> _bn")
        live = written(moved.select(*edges.columns, F.col("_an").alias("_a"), F.col("_bn").alias("_b")), "live")
    else:
        raise RuntimeError(f"trees still join after {rounds} rounds")
    return (live if taken is None else taken).select(*edges.columns)


def cluster_weights(edges: DataFrame, weight: str, order: str) -> DataFrame:
    """Per component its nodes and the weight of the edges that a union-find accepts in ``order``."""
    tree = written(spanning_edges(edges, order), "tree")
    at = written(connected_components(edges), "components")
    sums = tree.join(at, F.col("src") == F.col("node")).groupBy("component").agg(F.sum(weight).alias("weight"))
    sizes = at.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(sums, "component", "left").select("component", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def fusion_summary(df: DataFrame, windows: DataFrame, entities: tuple[str, ...], domain: str = "domain", tactic: str = "MalwareIntelAttackType", time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Per window that several domains reached: when it began, its domains, tactics and indicators with their numbers, and how many entity
    columns have a value."""
    rows = df.join(windows.select(F.col("id").alias(id_col), "window"), id_col)
    filled = sum((F.max(clean(c).isNotNull().cast("int")) for c in entities), F.lit(0))
    main = rows.groupBy("window").agg(F.min(time).alias("timestamp"), F.array_sort(F.collect_set(domain)).alias("d"), F.array_sort(F.collect_set(tactic)).alias("t"), filled.alias("num_entities")).where(F.size("d") > 1)
    both = lambda pair: F.array_contains("d", pair[0]) & F.array_contains("d", pair[1])
    found = F.filter(F.array(F.concat(F.lit("multi_domain:"), F.size("d").cast("string"), F.lit("_domains")), *[F.when(both(pair), name) for name, pair in CROSS_DOMAIN.items()]), lambda x: x.isNotNull())
    text = lambda c, name: [F.size(c).cast("long").alias(f"num_{name}"), F.array_join(c, ",").alias(name)]
    return main.select("window", "timestamp", *text("d", "domains"), *text("t", "tactics"), *text(found, "indicators"), F.col("num_entities").cast("long").alias("num_entities"))


def detection_report(times: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One table of the anomalies (user, day, key, is_new, risk) of slots, source addresses and target hosts, each with the text that says it.

    Slots of a user's day are one row, with the highest risk and their list as key.
    """
    slots = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_new"), F.col("key").cast("int")))), lambda x: x.cast("string")), ", ")
    time = times.groupBy("user", "day").agg(slots.alias("key"), F.max("is_new").alias("is_new"), F.max("risk").alias("risk"))
    parts = [time.select(F.lit("time").alias("kind"), "user", "day", "key", "is_new", "risk", F.when(F.col("is_new"), "New User").otherwise(F.concat(F.lit("Logon time, intervals: ["), "key", F.lit("]"))).alias("text"))]
    for kind, name, df in (("source", "Source Address", sources), ("target", "Destination Host", targets)):
        text = F.when(F.col("is_new"), f"New {name}").otherwise(F.concat(F.lit(f"{name} Anomaly "), F.format_string("%.1f", "risk")))
        parts.append(df.select(F.lit(kind).alias("kind"), "user", "day", "key", "is_new", "risk", text.alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _chance(seed: int, salt: str, *keys: str) -> Column:
    """A number from 0 to 1 that the keys decide, the same in every run."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), *[F.col(k).cast("string") for k in keys])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 2**32


def simulated_feedback(found: DataFrame, seed: int = 42, keys: tuple[str, ...] = ("user", "day", "key")) -> DataFrame:
    """``found`` (anomalies with is_new) with a verdict: new ones are always judged (a quarter positive), of others a fifth (three fifths of these
    positive), the rest is Nil."""
    new = F.when(_chance(seed, "n", *keys) <= NEW_POSITIVE, "New Positive").otherwise("New Negative")
    old = F.when(_chance(seed, "p", *keys) <= POSITIVE, "Positive").otherwise("Negative")
    return found.withColumn("verdict", F.when(F.col("is_new"), new).when(_chance(seed, "r", *keys) <= ANSWERED, old).otherwise("Nil"))


def feature_baseline(df: DataFrame, columns: list[str], label: str, id_col: str = "alert_idx", seed: int = 42) -> DataFrame:
    """One row: the agreement with ``label`` of a k-means over plain numbers (null: 0) with as many clusters as there are labels."""
    k = df.select(label).distinct().count()
    x = df.select(id_col, F.col(label).alias("true"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("_x"))
    return pair_scores(contingency(kmeans(x, "_x", max(k, 2), seed).select("true", F.col("cluster").alias("pred"))))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object (column ``json``) with nulls kept and numbers that JSON can't write (not a number, infinite) as null."""
    def safe(c: str, t: str) -> Column:
        if t not in ("double", "float"):
            return F.col(f"`{c}`").alias(c)
        wrong = F.isnan(f"`{c}`") | (F.abs(f"`{c}`") == float("inf"))
        return F.when(~wrong, F.col(f"`{c}`")).alias(c)

    return df.select(F.to_json(F.struct(*[safe(c, t) for c, t in df.dtypes]), {"ignoreNullFields": "false"}).alias("json"))


def cluster_graph(df: DataFrame, cluster: int, columns: dict[str, str], name: str = "pred_cluster") -> DataFrame:
    """The entity graph of one cluster; of a table written by cluster only its files are read. Callers that ask again keep it by ``cache``."""
    from alertloom.operators.graph import cooccurrence_edges

    return cooccurrence_edges(df.where(F.col(name) == cluster), columns)
