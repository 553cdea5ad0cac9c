"""Baseline clusterings: vectors by cosine, density, k-means, greedy time windows, and label rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.scalars import cosine
from alertloom.operators.components import connected_components
from alertloom.plans.stage import written

#: Rows of a block that are compared with another block's at once.
BLOCK_ROWS = 2048
#: The same for links by cosine, where each row is sent to all blocks.
LINK_ROWS = 8192
#: Share of all pairs that tables of signs would meet, from which on all pairs are compared in blocks instead.
SPARSE = 0.05


def centroids(df: DataFrame, vector: str, group: str) -> DataFrame:
    """Mean vector of each group, a component at a time, so it is a plain aggregation."""
    parts = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def cosine_links(df: DataFrame, vector: str, id_col: str, least: float, bits: int = 0, tables: int = 1, seed: int = 7) -> DataFrame:
    """Pairs (src < dst) of cosine ``least`` or more. With ``bits`` > 0 only pairs that agree in the signs of that many random
    projections in any of ``tables`` tables; with 0 all pairs.

    Where tables have so few bits that rows would meet in most of them, and without tables, all pairs are compared in matrix products of blocks whose
    size doesn't grow with the table: less work than meeting the same pairs table by table, and the same pairs are kept.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = base.select("v").first()
    if first is None:
        return df.sparkSession.createDataFrame([], "src long, dst long")
    planes = np.random.default_rng(seed).normal(size=(tables, bits, len(first["v"])))
    if tables >= SPARSE * 2**bits:
        blocks = max(16, -(-base.count() // LINK_ROWS))
        own = base.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        side = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("*", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
        rows = side.select("p", "q", "b", "id", "v")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
            a, b = pdf[pdf["b"] == p], pdf[pdf["b"] == q]
            if not len(a) or not len(b):
                return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
            x, y, ida, idb = np.stack(a["v"]), np.stack(b["v"]), a["id"].to_numpy(), b["id"].to_numpy()
            unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
            codes = lambda m: np.stack([(m @ t.T > 0) @ (1 << np.arange(bits)) for t in planes], axis=1)
            ux, uy = unit(x), unit(y)
            cx, cy = (codes(x), codes(y)) if bits else (None, None)
            found = []
            for at in range(0, len(ux), 512):  # so that no product is large
                i, j = np.nonzero(ux[at : at + 512] @ uy.T >= least)
                i += at
                keep = ida[i] < idb[j] if p == q else np.ones(len(i), dtype=bool)
                if bits:
                    keep &= (cx[i] == cy[j]).any(1)
                s, t = ida[i[keep]], idb[j[keep]]
                found.append(pd.DataFrame({"src": np.minimum(s, t), "dst": np.maximum(s, t)}))
            return pd.concat(found)

        return rows.groupBy("p", "q").applyInPandas(compare, "src long, dst long")
    sign = lambda t, k: F.when(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in planes[t, k]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) > 0, "1").otherwise("0")
    keys = base.select("id", "v", F.explode(F.array(*[F.concat(F.lit(f"{t}:"), *[sign(t, k) for k in range(bits)]) for t in range(tables)])).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    near = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).where(cosine(F.col("a.v"), F.col("b.v")) >= least)
    return near.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()


def mean_similarity_clusters(df: DataFrame, cluster: str, vector: str, least: float = 0.7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``cluster`` and ``merged`` (the least cluster that it is joined with): clusters whose members' pairwise cosines average ``least`` or more join.

    The mean of all pairwise cosines of two clusters is the dot product of their mean unit vectors, so no pair of members is ever made.
    That is at most the product of the two means' lengths: clusters are laid in blocks by length, longest first, and only pairs of
    blocks whose longest means reach ``least`` are compared. Rows without a vector or with a zero one count as members with cosine 0; a null cluster is none.
    """
    rows = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = rows.select("c", F.posexplode_outer(F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))).alias("i", "x"))
    sizes = rows.groupBy("c").agg(F.count("*").alias("n"))
    sums = parts.where("i is not null").groupBy("c", "i").agg(F.sum("x").alias("s")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("s"))
    means = sizes.join(sums, "c", "left").select("c", F.transform(F.coalesce("s", F.array().cast("array<double>")), lambda x: x / F.col("n")).alias("m"))
    means = written(means.withColumn("length", F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))), "means")
    blocks = max(1, -(-means.count() // block_rows))
    laid = written(means.repartitionByRange(blocks, F.col("length").desc()).withColumn("b", F.spark_partition_id()), "laid")
    most = {r.b: r.most for r in laid.groupBy("b").agg(F.max("length").alias("most")).collect()}  # a row for each block
    near = [(i, j) for i in sorted(most) for j in sorted(most) if i <= j and most[i] * most[j] >= least - 1e-9]
    if not near:
        return means.select(F.col("c").alias(cluster), F.col("c").alias("merged"))
    tasks = df.sparkSession.createDataFrame(near, "p int, q int")
    side = laid.join(tasks, (F.col("b") == F.col("p")) | (F.col("b") == F.col("q"))).select("p", "q", "b", "c", "m")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        a, b = pdf[pdf["b"] == p], pdf[pdf["b"] == q]
        width = max(map(len, pdf["m"]), default=0)
        stack = lambda x: np.stack([np.pad(np.asarray(m, dtype=float), (0, width - len(m))) for m in x])
        i, j = np.nonzero(stack(a["m"]) @ stack(b["m"]).T >= least - 1e-12)
        s, t = a["c"].to_numpy()[i], b["c"].to_numpy()[j]
        return pd.DataFrame({"src": s[s != t], "dst": t[s != t]})

    kind = df.schema[cluster].dataType.simpleString()
    comp = connected_components(side.groupBy("p", "q").applyInPandas(compare, f"src {kind}, dst {kind}"))
    return means.select(F.col("c").alias(cluster)).join(comp, F.col(cluster) == F.col("node"), "left").select(cluster, F.coalesce("component", cluster).alias("merged"))


def density_clusters(links: DataFrame, nodes: DataFrame, id_col: str, least: int = 3) -> DataFrame:
    """DBSCAN over given links: core rows have ``least`` neighbours or more (themselves included); border rows join their
    smallest core's cluster; others are clusters of their own."""
    links = written(links.select("src", "dst"), "links")  # they are read six times
    both = links.union(links.select("dst", "src")).toDF("src", "dst")
    core = written(both.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least - 1).select(F.col("src").alias("node")), "core")
    inner = both.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    comp = connected_components(inner)
    lone = core.join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    comp = comp.unionByName(lone)
    border = both.join(comp.withColumnRenamed("node", "dst"), "dst").join(core.withColumnRenamed("node", "src"), "src", "left_anti").groupBy("src").agg(F.min("component").alias("component"))
    found = comp.unionByName(border.withColumnRenamed("src", "node"))
    return nodes.select(F.col(id_col)).join(found, F.col(id_col) == F.col("node"), "left").select(id_col, F.coalesce("component", F.col(id_col)).alias("cluster"))


def kmeans(df: DataFrame, vector: str, k: int = 8, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(x).transform(x).drop("_v")


def hierarchy(df: DataFrame, vector: str, id_col: str, micro: int = 20, merge: float = 0.3, seed: int = 42) -> DataFrame:
    """Micro clusters by k-means, macro clusters by components of their centroids' cosine links."""
    small = written(kmeans(df.select(id_col, vector), vector, micro, seed).select(id_col, vector, F.col("cluster").cast("long").alias("micro")), "micro")
    links = cosine_links(centroids(small, vector, "micro"), "centroid", "micro", merge)
    comp = connected_components(links)
    return small.join(comp, small.micro == comp.node, "left").select(id_col, "micro", F.coalesce("component", "micro").alias("macro"))


def greedy_windows(df: DataFrame, columns: list[str], width_s: float = 86400.0, time: str = "EndDate", id_col: str = "alert_idx") -> DataFrame:
    """Each row joins the cluster of the earliest row before it that shares a value with it (in the same column) within ``width_s``
    seconds. The earliest match makes a forest; pointers double to its roots. Rows without a time, and values that are null, match nothing."""
    width = int(width_s * 1e6)
    rows = df.select(F.col(id_col).alias("id"), F.unix_micros(time).alias("us"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).where("us is not null and x.v is not null and x.v <> 'NIL'").select("id", "us", "x.c", "x.v")
    # a span of ``width`` ends in the row's own slice of time and begins in the slice before: its first row is the first at or behind its beginning
    # there, or else the first of the own slice. So a value of any number of rows is cut by time
    slice_of = lambda t: F.floor(t / width)
    begins = rows.select("c", "v", slice_of(F.col("us") - width).alias("slice"), (F.col("us") - width).alias("at"), F.lit(0).alias("kind"), F.col("id").alias("asks"), F.lit(None).cast("struct<us:bigint,id:bigint>").alias("row"))
    there = rows.select("c", "v", slice_of(F.col("us")).alias("slice"), F.col("us").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("asks"), F.struct("us", F.col("id").cast("long").alias("id")).alias("row"))
    backwards = Window.partitionBy("c", "v", "slice").orderBy(F.desc("at"), F.desc("kind"), F.desc("row.id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = begins.unionByName(there).withColumn("f", F.last("row", True).over(backwards)).where("kind = 0")
    heads = there.groupBy("c", "v", "slice").agg(F.min("row").alias("head"))
    found = met.withColumn("slice", F.col("slice") + 1).join(heads, ["c", "v", "slice"]).select(F.col("asks").alias("id"), F.coalesce("f", "head").alias("f"))
    first = found.groupBy("id").agg(F.min("f").alias("f"))
    up = written(df.select(F.col(id_col).alias("id")).join(first, "id", "left").select("id", F.coalesce("f.id", "id").alias("up")), "parents")
    while True:
        ahead = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
        moved = written(up.join(ahead, "up").select("id", F.col("up").alias("old"), F.col("next").alias("up")), "parents")
        up = moved.select("id", "up")
        if moved.where("old <> up").limit(1).count() == 0:
            return up.select(F.col("id").alias(id_col), F.col("up").alias("cluster"))


def label_majority(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """The most frequent label of each cluster, smallest on ties."""
    return df.groupBy(cluster).agg(F.expr(f"mode() WITHIN GROUP (ORDER BY {label})").alias("label"))
