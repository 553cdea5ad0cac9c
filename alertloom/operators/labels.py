"""Campaign labels, factorised cells, batches of alerts and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.scalars import lookup
from alertloom.operators.correlation import dense
from alertloom.schema import first_present

# Label columns by priority.
LABEL_COLUMNS = ("campaign_id", "tactic", "label", "red_team_tag", "attack_cat", "Label", "class")
# Tactics of logged event numbers.
EVENT_TACTICS = {
    4688: "Execution", 4689: "Execution", 4624: "InitialAccess", 4625: "InitialAccess", 4648: "LateralMovement", 4672: "PrivilegeEscalation", 4634: "DefenseEvasion", 4768: "CredentialAccess", 4769: "CredentialAccess",
    4770: "CredentialAccess", 4771: "CredentialAccess", 4776: "CredentialAccess", 4800: "DefenseEvasion", 4801: "DefenseEvasion", 4802: "DefenseEvasion", 4803: "DefenseEvasion", 5136: "Persistence", 5137: "Persistence",
    5140: "LateralMovement", 5145: "LateralMovement",
}


def factorised(df: DataFrame, column: str, id_col: str, name: str) -> DataFrame:
    """``df`` with dense numbers of the column's values in order of first appearance; null is -1."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(id_col).alias("_first"))
    codes = dense(first, "_first", "_code").select(F.col(column).alias("_value"), "_code")
    return df.join(codes, F.col(column) == F.col("_value"), "left").withColumn(name, F.coalesce("_code", F.lit(-1)).cast("long")).drop("_value", "_code")


def campaign_labels(df: DataFrame, id_col: str = "alert_idx", name: str = "campaign") -> DataFrame:
    """``df`` with a number for each row's campaign, from the first label column that there is (text is factorised, numbers stand for
    themselves), else from event numbers, else alternating."""
    column = first_present(df, LABEL_COLUMNS)
    if column is None and "EventID" in df.columns:
        tactic = F.coalesce(lookup(F.coalesce(F.col("EventID"), F.lit(0)).cast("int"), EVENT_TACTICS), F.lit("Unknown"))
        return factorised(df.withColumn("_tactic", tactic), "_tactic", id_col, name).drop("_tactic")
    if column is None:
        return df.withColumn(name, F.pmod(F.col(id_col), F.lit(2)).cast("long"))
    if df.schema[column].dataType.simpleString() != "string":
        return df.withColumn(name, F.coalesce(F.col(column).cast("long"), F.lit(-1)))
    return factorised(df, column, id_col, name)


def first_row_labels(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """Every cell becomes the id of the first row that holds its value in any of the columns; null and zero become their own row's."""
    cells = df.select(F.col(id_col).alias("_row"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("_row", "x.c", "x.v")
    first = cells.where("v is not null and v <> '0'").groupBy("v").agg(F.min("_row").alias("f"))
    named = cells.join(first, "v", "left").withColumn("f", F.coalesce("f", "_row"))
    return named.groupBy("_row").pivot("c", columns).agg(F.first("f")).withColumnRenamed("_row", id_col)


def batch_columns(df: DataFrame, batch: Column, fields: dict[str, Column], order: list[str], size: int) -> DataFrame:
    """A row for each batch: its number, and for each field an array of ``size`` values in order, filled up with nulls, beside their ``mask``.
    Batches are of ``size`` rows at most."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c.alias(f"f_{n}") for n, c in fields.items()])))
    out = df.groupBy(batch.alias("batch")).agg(rows.alias("r"), F.count(F.lit(1)).alias("n"))
    steps = F.sequence(F.lit(1), F.lit(size))
    column = lambda n: F.transform(steps, lambda i: F.try_element_at("r", i)[f"f_{n}"]).alias(n)
    arrays = [column(n) for n in fields]
    return out.select("batch", "n", *arrays, F.transform(steps, lambda i: i <= F.col("n")).alias("mask"))


def batch_metadata(df: DataFrame, batch: Column, addresses: list[str], hosts: list[str], users: list[str], severity: str, time: str, tactic: str, technique: str) -> DataFrame:
    """Per batch: alerts, distinct entities (addresses, hosts and users each over all their columns), seconds that it spans, mean
    severity, and the share of alerts without tactic and without technique in percent."""
    def distinct(columns: list[str]) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNotNull())))))

    missing = lambda c: F.avg(F.col(c).isNull().cast("double")) * 100
    span = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6
    return df.groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("num_alerts"), (distinct(addresses) + distinct(hosts) + distinct(users)).cast("long").alias("num_entities"), span.alias("span"), F.avg(severity).alias("avg_severity"),
        missing(tactic).alias("missing_tactics_pct"), missing(technique).alias("missing_techniques_pct"),
    )


def tidy_names(df: DataFrame) -> DataFrame:
    """Column names without white space around them, in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def derived_entities(df: DataFrame, sent: str, sent_packets: str, received: str, received_packets: str, service: str, state: str, protocol: str) -> list[Column]:
    """Addresses and hosts made of flow features, where a dataset has none."""
    part = lambda c, n, more=0: (F.pmod(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(n)) + more).cast("string")
    code = lambda c, n, more=0: (F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(n)) + more).cast("string")
    named = lambda p, c: F.concat(F.lit(p), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return [
        F.concat(F.lit("10."), part(sent, 256), F.lit("."), part(sent_packets, 256), F.lit(".1")).alias("SourceAddress"),
        F.concat(F.lit("192.168."), part(received, 256), F.lit("."), part(received_packets, 254, 1)).alias("DestinationAddress"),
        F.concat(F.lit("172.16."), code(service, 256), F.lit("."), code(protocol, 254, 1)).alias("DeviceAddress"),
        named("svc-", service).alias("SourceHostName"), named("state-", state).alias("DeviceHostName"), named("proto-", protocol).alias("DestinationHostName"),
    ]


def sensors(df: DataFrame, user: str) -> DataFrame:
    """Rows of gateways (users that start with ``gateway_``) with ``sensor``, what stands after the user's last colon."""
    return df.where(F.col(user).startswith("gateway_")).withColumn("sensor", F.substring_index(user, ":", -1))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits over the temperature, from the largest down so that nothing overflows."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """The first place, from 0, of the largest value."""
    return F.array_position(values, F.array_max(values)).cast("long") - 1
