"""Projections to other layouts: flow records, feature codes, entity maps, tokens of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.scalars import severity_score, tactic_by_rules, tod_bucket
from alertloom.schema import TIME_COLUMNS, clean, first_present

# The columns that hold each kind of entity, by domain, in order of preference.
DOMAIN_COLUMNS = {
    "network": {"source": ("src_ip", "SourceAddress"), "target": ("dst_ip", "DestinationAddress")},
    "host": {"host": ("hostname", "SourceHostName"), "user": ("username", "SourceUserName")},
}


def flow_alerts(df: DataFrame, src: str, dst: str, label: str, time: str, fmt: str = "dd/MM/yyyy HH:mm:ss", default_time: str = "2018-01-01 00:00:00") -> DataFrame:
    """Flow records as alerts: addresses, host names made of them, an ISO time with a default, attack flag and tactic."""
    name = lambda c, p: F.concat(F.lit(p), F.regexp_replace(F.col(c), r"\.", "-"))
    attack = ~F.lower(label).isin("benign", "normal")
    return df.select(
        "*", F.col(src).alias("SourceAddress"), F.col(dst).alias("DestinationAddress"), name(src, "host-").alias("SourceHostName"), name(dst, "target-").alias("DestinationHostName"),
        F.date_format(F.coalesce(F.try_to_timestamp(F.col(time), F.lit(fmt)), F.lit(default_time).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss").alias("EndDate"), F.when(attack, "attack").otherwise("normal").alias("alert_type"), tactic_by_rules(F.col(label)).alias("MalwareIntelAttackType"),
    )


def coded(df: DataFrame, columns: list[str], fill: str | None = None) -> DataFrame:
    """Codes from 0 in order of each column's distinct values (null: -1, or ``fill`` as a value); the value tables stay small, so
    they are joined by broadcast up to 100,000 values and by shuffle beyond."""
    out = df
    for c in columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(fill)) if fill is not None else F.col(c).cast("string")
        out = out.withColumn("_v", v)
        values = out.select("_v").where("_v is not null").distinct()
        ranked = values.withColumn(f"{c}_code", (F.dense_rank().over(Window.orderBy("_v")) - 1).cast("long"))  # distinct values of one column
        out = out.join(ranked, "_v", "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1).cast("long"))).drop("_v")
    return out


def calendar(ts: Column) -> list[Column]:
    return [(F.hour(ts) / 23.0).alias("hour"), (F.weekday(ts) / 6.0).alias("day_of_week"), (F.dayofmonth(ts) / 31.0).alias("day")]


def entity_map(df: DataFrame, domain: str) -> Column:
    """Kind to value: of each kind the first column that is not null."""
    parts = []
    for kind, names in DOMAIN_COLUMNS[domain].items():
        have = [F.col(n).cast("string") for n in names if n in df.columns]
        parts += [F.lit(kind), F.coalesce(*have) if have else F.lit(None).cast("string")]
    return F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull())


def feature_vector(ts: Column, values: list[Column], width: int = 20) -> Column:
    """Time features and the given ones, filled up with zeros to ``width``."""
    own = [F.hour(ts) / 24.0, F.weekday(ts) / 7.0, F.dayofmonth(ts) / 31.0, *[v.cast("double") for v in values]]
    return F.concat(F.array(*own), F.array_repeat(F.lit(0.0), width - len(own)))


def alert_tokens(df: DataFrame) -> DataFrame:
    """Per alert: cleaned entities, five-minute bucket, severity, type."""
    t = first_present(df, TIME_COLUMNS)
    return df.select("alert_idx", F.coalesce(clean("SourceAddress"), F.lit("")).alias("src"), F.coalesce(clean("DeviceAddress"), F.lit("")).alias("device"), tod_bucket(F.col(t)).alias("bucket"), severity_score(F.col("AttackSeverity")).alias("severity"))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scores (population deviation; 0 where that is 0)."""
    one = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(one))  # one row
    return out.select(*df.columns, *[F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}_scaled") for c in columns])


def min_max_time(by: list[str], time: str) -> Column:
    """Time from 0 to 1 within each group."""
    w = Window.partitionBy(*by)
    us = F.unix_micros(time)
    span = F.max(us).over(w) - F.min(us).over(w)
    return F.when(span == 0, 0.0).otherwise((us - F.min(us).over(w)) / span)


def hashed_features(columns: list[str], size: int = 64) -> Column:
    """Counts of ``column=value`` tokens in ``size`` hash places."""
    place = [F.pmod(F.xxhash64(F.concat(F.lit(f"{c}="), F.coalesce(clean(c), F.lit("")))), F.lit(size)).cast("int") for c in columns]
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    if not place:
        return zeros(size)

    def laid(p: Column) -> Column:
        """Runs of zeros between the places, which ascend: work goes with the columns, not with columns x ``size``."""
        parts = []
        for j in range(len(place)):
            n = sum((F.when(p[m] == p[j], 1.0).otherwise(0.0) for m in range(len(place))), F.lit(0.0))
            gap = p[j] - p[j - 1] - 1 if j else p[j]
            parts.append(F.when(gap >= 0, F.concat(zeros(gap), F.array(n))).otherwise(zeros(0)))
        return F.concat(*parts, zeros(size - 1 - p[len(place) - 1]))

    return F.transform(F.array(F.array_sort(F.array(*place))), laid)[0]  # bound by a lambda, so places are worked out once a row


def with_aliases(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Standard names for columns that have others, where the standard name is absent."""
    return df.withColumns({new: F.col(old) for old, new in names.items() if old in df.columns and new not in df.columns})
