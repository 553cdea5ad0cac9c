"""Datasets on disk: discovery, loading, conversion of public formats to alerts, and generated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.features import flow_alerts
from alertloom.functions.scalars import entity_hash
from alertloom.functions.tactics import label_stage, map_dataset_label
from alertloom.operators.correlation import dense
from alertloom.schema import first_present
from alertloom.sources.files import read_csv

#: Folders that hold no dataset, and the columns of logs without a header.
NO_DATASETS = ("processed", "loaders", "real_data", "__pycache__", ".git")
RAW_SCHEMA = "time string, src_computer string, dst_computer string, user string, red_team_tag string, logon_type string, authentication_package string"
#: Above this many bytes a dataset is read as a stream.
STREAM_BYTES = 500 << 20
DATASET_SCHEMA = "name string, path string, format string, n_files long, bytes long, streaming boolean"


def discover(spark: SparkSession, base: str, preferred: str = "mitre_format") -> DataFrame:
    """A row for each folder below ``base`` that holds data: name, path, format, files, bytes, and whether to read it as a stream.

    Files named ``preferred`` go before others, Parquet before CSV before JSON lines (or logs that begin with wls_). Only names and
    sizes are listed, by the driver.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for d in fs.listStatus(root):
        name = d.getPath().getName()
        if not d.isDirectory() or name in NO_DATASETS:
            continue
        files, walk = [], fs.listFiles(d.getPath(), True)
        while walk.hasNext():
            f = walk.next()
            files.append((f.getPath().getName(), f.getLen()))
        options = [("parquet", lambda n: n == f"{preferred}.parquet"), ("csv", lambda n: n == f"{preferred}.csv"), ("parquet", lambda n: n.endswith(".parquet")), ("csv", lambda n: n.endswith(".csv")), ("jsonl", lambda n: n.endswith(".jsonl") or n.startswith("wls_"))]
        for kind, fits in options:
            sizes = [b for n, b in files if fits(n)]
            if sizes:
                clear = name.replace(" ", "_").replace("-", "_").replace(".", "_")
                found.append((clear, d.getPath().toString(), kind, len(sizes), sum(sizes), kind == "jsonl" or sum(sizes) > STREAM_BYTES))
                break
    return spark.createDataFrame(found, DATASET_SCHEMA)


def load_dataset(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All files of a dataset with the name of each row's file: Parquet, CSV with a header, JSON lines, or logs without one (``raw``) whose
    lines that don't fit are left out."""
    reader = spark.read.option("recursiveFileLookup", True)
    if kind == "parquet":
        df = reader.option("pathGlobFilter", "*.parquet").parquet(path)
    elif kind == "csv":
        df = reader.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    elif kind == "jsonl":
        df = reader.json(path)
    else:
        df = reader.schema(RAW_SCHEMA).option("mode", "DROPMALFORMED").csv(path)
    return df.withColumn("_source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def load_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow records of a CSV file as alerts, its columns found by any of their usual names."""
    df = read_csv(spark, path)
    low = {c.lower(): c for c in reversed(df.columns)}
    # Names of columns in known datasets
    names = {"src": ("src ip", "source ip", "src_ip", "source"), "dst": ("dst ip", "destination ip", "dst_ip", "destination"), "time": ("timestamp", "time", "ts"), "label": ("label", "attack", "category")}
    for new, old in names.items():
        hit = next((low[o] for o in old if o in low), None)
        default = {"src": "0.0.0.0", "dst": "0.0.0.0", "label": "Normal"}.get(new)
        df = df.withColumn(f"_{new}", F.col(f"`{hit}`").cast("string") if hit else F.lit(default).cast("string"))
    return flow_alerts(df, "_src", "_dst", "_label", "_time").drop("_src", "_dst", "_label", "_time")


def _ticks(place: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + place * seconds)


def _byte(c: Column | str) -> Column:
    return F.pmod(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long"), F.lit(256)).cast("string")


def _host(c: Column) -> Column:
    return F.concat(F.lit("host-"), F.lpad(entity_hash(c, 1001).cast("string"), 3, "0"), F.lit(".local"))


def _campaign(c: Column, n: int) -> Column:
    return entity_hash(c, n + 1) - 1


def connection_alerts(df: DataFrame, id_col: str) -> DataFrame:
    """Connection records (duration, bytes, service, flag, label) as alerts: addresses from their numbers, five minutes a row in order of ``id_col``."""
    n = dense(df, id_col, "_i")
    label, tactic = F.col("label"), map_dataset_label(F.lit("nsl_kdd"), F.col("label"))
    user = F.when(F.col("logged_in") != 0, F.concat(F.lit("user_"), F.lpad(entity_hash(F.col("logged_in"), 101).cast("string"), 2, "0"), F.lit("@domain.com"))).otherwise("unknown@domain.com")
    return n.select(
        id_col, _ticks(F.col("_i"), 300).alias("timestamp"), F.concat(F.lit("10."), _byte("duration"), F.lit("."), _byte("src_bytes"), F.lit(".1")).alias("src_ip"), F.concat(F.lit("192.168."), _byte("dst_bytes"), F.lit(".1")).alias("dst_ip"),
        _host(F.col("service")).alias("hostname"), user.alias("username"), F.when(label == "normal", "normal").otherwise("attack").alias("alert_type"), tactic.alias("tactic"), _campaign(label, 50).alias("campaign_id"),
        F.col("protocol_type").alias("protocol"), "service", "flag", "src_bytes", "dst_bytes", label_stage(label, F.col("_i")).alias("stage"),
    )


def traffic_alerts(df: DataFrame, id_col: str) -> DataFrame:
    """Traffic records (attack_cat, label, proto, service, sbytes, dbytes) as alerts; addresses and times from the row's place where the table has
    none, a minute a row."""
    n = dense(df, id_col, "_i")
    i, text = F.col("_i"), lambda c: c.cast("string")
    src, dst, time = first_present(df, ["srcip", "src_ip"]), first_present(df, ["dstip", "dst_ip"]), first_present(df, ["timestamp"])
    made = F.concat(F.lit("10."), text(i % 256), F.lit("."), text(F.floor(i / 256) % 256), F.lit("."), text(i % 254 + 1))
    made_dst = F.concat(F.lit("192.168."), text(i % 256), F.lit("."), text(F.floor(i / 256) % 256 + 1))
    kind = F.col(first_present(df, ["attack_cat", "category"]) or "label").cast("string")
    user = first_present(df, ["username", "srcip"])
    return n.select(
        id_col, (F.col(time).cast("timestamp") if time else _ticks(i, 60)).alias("timestamp"), (F.col(src) if src else made).alias("src_ip"), (F.col(dst) if dst else made_dst).alias("dst_ip"), _host(F.col("service")).alias("hostname"),
        (F.col(user) if user else F.lit("unknown@domain.com")).alias("username"), F.when(F.lower(F.col("label").cast("string")).isin("1", "attack", "true"), "attack").otherwise("normal").alias("alert_type"),
        map_dataset_label(F.lit("unsw_nb15"), kind).alias("tactic"), _campaign(kind, 50).alias("campaign_id"), F.col("proto").alias("protocol"), "service", F.col("sbytes").alias("src_bytes"), F.col("dbytes").alias("dst_bytes"), label_stage(kind, i).alias("stage"),
    )


def labelled_flow_alerts(df: DataFrame, id_col: str, dataset: str = "cicids2017") -> DataFrame:
    """Labelled flows as alerts: host names from addresses, users from the protocol, campaign -1 where the label is benign; a second a row where the
    table has no times."""
    time = first_present(df, ["Timestamp"])
    n = df if time else dense(df, id_col, "_i")
    src, dst, label = first_present(df, ["Source IP", "Src IP"]), first_present(df, ["Destination IP", "Dst IP"]), F.col(first_present(df, ["Label", "label"]) or "Label").cast("string")
    address = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit("0.0.0.0")
    normal = (F.upper(label) == "BENIGN") | (F.lower(label) == "normal")
    return n.select(
        id_col, (F.col(time).try_cast("timestamp") if time else _ticks(F.col("_i"), 1)).alias("timestamp"), address(src).alias("src_ip"), address(dst).alias("dst_ip"), F.concat(F.lit("host-"), F.translate(address(src), ".", "-")).alias("hostname"),
        F.concat(F.lit("user_"), F.lpad((entity_hash(F.col("Protocol"), 101) - 1).cast("string"), 2, "0"), F.lit("@domain.com")).alias("username"), F.when(normal, "normal").otherwise("attack").alias("alert_type"),
        map_dataset_label(F.lit(dataset), label).alias("tactic"), F.when(F.upper(label) == "BENIGN", -1).otherwise(_campaign(label, 100)).cast("long").alias("campaign_id"),
    )


def generated_flows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` made-up flows, the same in every run: six tenths normal, a tenth of each attack; scans reach more addresses."""
    draw = lambda salt, size: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(size))
    kinds = F.array(*[F.lit(x) for x in ("Mirai-Greeth", "DoS-Syn", "Recon-PortScan", "DDoS-UDP")])
    rows = spark.range(n).withColumn("u", draw("label", 10)).withColumn("Label", F.when(F.col("u") < 6, "Normal").otherwise(F.get(kinds, (F.col("u") - 6).cast("int"))))
    normal, scan = F.col("Label") == "Normal", F.col("Label") == "Recon-PortScan"
    text = lambda c: c.cast("string")
    ports = F.array(*[F.lit(p) for p in (80, 443, 22, 23, 8080)])
    return rows.select(
        "id", F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2025-01-01 08:00:00").cast("timestamp")) + F.floor(F.col("id") * 86400 / max(n, 1))), "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        F.when(normal, F.concat(F.lit("192.168.1."), text(2 + draw("s", 48)))).otherwise(F.concat(F.lit("10.0.0."), text(1 + draw("s", 99)))).alias("Src IP"),
        F.concat(F.lit("192.168.1."), F.when(scan, text(2 + draw("d", 253))).otherwise(text(100 + draw("d", 100)))).alias("Dst IP"), (1024 + draw("sp", 64511)).alias("Src Port"),
        F.when(normal, 80).otherwise(F.get(ports, draw("dp", 5).cast("int"))).alias("Dst Port"), F.when(draw("pr", 2) == 0, 6).otherwise(17).alias("Protocol"), (1000 + draw("du", 9999000)).alias("Flow Duration"),
        (1 + draw("f", 99)).alias("Tot Fwd Pkts"), (1 + draw("b", 99)).alias("Tot Bwd Pkts"), "Label",
    )
