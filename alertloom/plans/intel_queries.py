"""Threat intelligence from files and its lookups, sources of data, judged feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions.scalars import source_status
from alertloom.operators import intel as it
from alertloom.plans.registry import over_alerts, query
from alertloom.plans.stage import shared_dir
from alertloom.schema import alerts, table


@query("""SELECT 'technique:T' || s_suppkey AS entity_id, 'technique' AS kind, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.5 END::DOUBLE AS severity,
  CASE s_suppkey % 4 WHEN 0 THEN 'discovery,Impact' WHEN 1 THEN 'odd' WHEN 2 THEN '' ELSE 'execution' END AS tactics, '' AS groups FROM supplier
UNION ALL SELECT 'cve:CVE-' || p_partkey, 'cve', 'CVE-' || p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE round((p_partkey % 101) / 100.0::DOUBLE, 9) END::DOUBLE, '', '' FROM part
UNION ALL SELECT 'malware:' || c_name, 'malware', c_name, CASE WHEN c_custkey % 5 = 0 THEN 0.5 ELSE (c_custkey % 10) / 10.0::DOUBLE END, 'impact', CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE '' END FROM customer""")
def src21_threat_intel(spark, d):
    base = shared_dir(spark)
    k = F.col("s_suppkey") % 4
    tactics = F.when(k == 0, F.array(F.lit("discovery"), F.lit("Impact"))).when(k == 1, F.array(F.lit("odd"))).when(k == 3, F.array(F.lit("execution")))
    table(spark, d, "supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), tactics.alias("tactics")).write.json(f"{base}/techniques")
    score = F.when(F.col("p_partkey") % 7 != 0, F.struct(((F.col("p_partkey") % 101) / F.lit(10.0)).alias("base_score")))
    table(spark, d, "part").select(F.concat(F.lit("CVE-"), "p_partkey").alias("id"), score.alias("cvss")).write.json(f"{base}/cves")
    c = F.col("c_custkey")
    groups = F.when(c % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    table(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(c % 5 != 0, (c % 10) / F.lit(10.0)).alias("severity"), F.array(F.lit("impact")).alias("tactics"), groups.alias("apt_groups")).write.json(f"{base}/malware")
    found = it.load_intel(spark, f"{base}/techniques", f"{base}/cves", f"{base}/malware", lines=True)
    return found.select("entity_id", "kind", "name", F.round("severity", 9).alias("severity"), F.array_join("tactics", ",").alias("tactics"), F.array_join("groups", ",").alias("groups"))


_ASKED = ("technique:T1566", "RYUK", "Impact", "malware", "persistence", "phishing", "nothing", "MALWARE", "exfiltration channel", "Technique:T1566")
_INTEL = ", ".join(f"('technique:{i}', 'technique', '{n}', {list(t)})" for i, n, t, _ in it.TECHNIQUES) + ", " + ", ".join(f"('malware:{n}', 'malware', '{n}', {list(t)})" for n, _, t, _ in it.MALWARE)


@query(
    over_alerts(
        "SELECT v AS value, how, entity_id, n FROM a JOIN ks ON (how IN ('id', 'kind') AND key = v) OR (how IN ('name', 'tactic') AND key = lower(v))",
        f"a AS (SELECT {list(_ASKED)}[1 + CAST(k % {len(_ASKED)} AS INT)] AS v, count(*) AS n FROM alerts GROUP BY 1)",
        f"i AS (SELECT * FROM (VALUES {_INTEL}) x(entity_id, kind, name, tactics))",
        "ks AS (SELECT entity_id, 'id' AS how, entity_id AS key FROM i UNION ALL SELECT entity_id, 'kind', kind FROM i UNION ALL SELECT entity_id, 'name', lower(name) FROM i UNION ALL SELECT entity_id, 'tactic', unnest(tactics) FROM i)",
    )
)
def f18_intel_lookup(spark, d):
    asked = alerts(spark, d).select(F.get(F.array(*map(F.lit, _ASKED)), (F.col("k") % len(_ASKED)).cast("int")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return it.looked_up(asked, it.load_intel(spark)).join(asked, "value").select("value", "how", "entity_id", "n")


_SOURCES = ("CIC-IDS2017 day 1", "my_Synthetic-set", "Ton-IoT", "UNSW_NB15", "mock_cicids2017", "unheard")


@query(over_alerts(f"SELECT alert_idx, ['approved', 'rejected', 'approved', 'approved', 'approved', 'unknown'][1 + CAST(k % {len(_SOURCES)} AS INT)] AS status FROM alerts"))
def f14_source_status(spark, d):
    name = F.get(F.array(*map(F.lit, _SOURCES)), (F.col("k") % len(_SOURCES)).cast("int"))
    return alerts(spark, d).select("alert_idx", source_status(name).alias("status"))
