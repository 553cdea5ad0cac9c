"""Alert schema, field roles, plan-time column resolution, and the projection of ``events`` to alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of columns, in the order in which they are looked for.
ALERT_COLUMNS = (
    "AlertId", "SourceAddress", "DestinationAddress", "DeviceAddress", "SourceUserName", "SourceHostName", "DeviceHostName",
    "DestinationHostName", "MalwareIntelAttackType", "AttackSeverity", "EndDate", "CustomerName",
)
#: Strings that stand for no value.
SENTINELS = ("nan", "NIL", "UNKNOWN", "None", "")
#: Fixed values, as above.
SEVERITY_COLUMNS = ("AttackSeverity", "severity", "Severity", "score")
TACTIC_COLUMNS = ("MalwareIntelAttackType", "AttackType")
TIME_COLUMNS = ("EndDate", "timestamp", "Timestamp", "ts", "time", "date", "start_time", "event_time")


@dataclass(frozen=True)
class FieldRoles:
    """Which columns hold addresses and which users or hosts."""

    addresses: list[str] = field(default_factory=lambda: ["SourceAddress", "DestinationAddress", "DeviceAddress"])
    usernames: list[str] = field(default_factory=lambda: ["SourceHostName", "DeviceHostName", "DestinationHostName"])

    def check(self, df: DataFrame) -> None:
        if missing := [c for c in [*self.addresses, *self.usernames] if c not in df.columns]:
            raise ValueError(f"missing role columns: {missing}")


def first_present(df: DataFrame, names: tuple[str, ...] | list[str]) -> str | None:
    """The first of ``names`` that ``df`` has, decided when the plan is built."""
    return next((n for n in names if n in df.columns), None)


def clean(c: Column | str, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """``c`` as a string, null where it holds a sentinel."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(~s.isin(*sentinels), s)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts derived from ``events``: one row each, in order of ``alert_idx``."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    u, k, text = F.col("user_id"), F.col("k"), lambda c: c.cast("string")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("alert_idx"),
        F.concat(F.lit("ALERT-"), text(F.col("event_id"))).alias("AlertId"),
        F.concat(F.lit("10.0."), text(u % 16), F.lit("."), text(u % 250)).alias("SourceAddress"),
        F.concat(F.lit("192.168."), text(k % 4), F.lit("."), text(k)).alias("DestinationAddress"),
        F.when(k % 10 == 0, "NIL").otherwise(F.concat(F.lit("172.16.0."), text((u + k) % 16))).alias("DeviceAddress"),
        F.concat(F.lit("user_"), text(u)).alias("SourceUserName"),
        F.concat(F.lit("host-"), text(u)).alias("SourceHostName"),
        F.when(k % 7 != 0, F.concat(F.lit("fw-"), text((u + k) % 5))).alias("DeviceHostName"),
        F.concat(F.lit("srv-"), text(k)).alias("DestinationHostName"),
        F.when(kind == "error", "Exploits").when(kind == "view", "Reconnaissance").when(kind == "click", "Shellcode").when(kind == "signup", "Backdoors").otherwise("DoS").alias("MalwareIntelAttackType"),
        F.when(F.col("value") >= 100, "Critical").when(F.col("value") >= 50, "High").when(F.col("value") >= 20, "Medium").otherwise("Low").alias("AttackSeverity"),
        F.when(F.col("value") >= 100, F.lit(1.0)).otherwise(F.col("value") / 100.0).alias("severity"),
        F.col("ts").alias("EndDate"),
        F.concat(F.lit("CUST-"), text(u % 3)).alias("CustomerName"),
        u.alias("user_id"),
        k.alias("k"),
    )


#: The same projection in DuckDB's SQL, as common table expressions.
ALERTS_SQL = """e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
alerts AS (SELECT event_id AS alert_idx, 'ALERT-' || CAST(event_id AS VARCHAR) AS AlertId,
  '10.0.' || CAST(user_id % 16 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS SourceAddress,
  '192.168.' || CAST(k % 4 AS VARCHAR) || '.' || CAST(k AS VARCHAR) AS DestinationAddress,
  CASE WHEN k % 10 = 0 THEN 'NIL' ELSE '172.16.0.' || CAST((user_id + k) % 16 AS VARCHAR) END AS DeviceAddress,
  'user_' || CAST(user_id AS VARCHAR) AS SourceUserName, 'host-' || CAST(user_id AS VARCHAR) AS SourceHostName,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 'fw-' || CAST((user_id + k) % 5 AS VARCHAR) END AS DeviceHostName,
  'srv-' || CAST(k AS VARCHAR) AS DestinationHostName,
  CASE event_type WHEN 'error' THEN 'Exploits' WHEN 'view' THEN 'Reconnaissance' WHEN 'click' THEN 'Shellcode'
       WHEN 'signup' THEN 'Backdoors' ELSE 'DoS' END AS MalwareIntelAttackType,
  CASE WHEN value >= 100 THEN 'Critical' WHEN value >= 50 THEN 'High' WHEN value >= 20 THEN 'Medium' ELSE 'Low' END AS AttackSeverity,
  CASE WHEN value >= 100 THEN 1.0::DOUBLE ELSE value / 100.0::DOUBLE END AS severity,
  ts AS EndDate, 'CUST-' || CAST(user_id % 3 AS VARCHAR) AS CustomerName, user_id, k FROM e)"""
