"""Threat intelligence: techniques, vulnerabilities and malware families as one table, lookups, and names found in texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default malware families (name, severity, tactics, groups).
MALWARE = (
    ("Emotet", 0.8, ("initial_access", "execution", "persistence"), ("TA542",)),
    ("TrickBot", 0.85, ("execution", "persistence", "credential_access"), ("WizardSpider",)),
    ("CobaltStrike", 0.75, ("execution", "command_and_control", "lateral_movement"), ("WizardSpider", "APT29")),
    ("Ryuk", 0.9, ("impact",), ("WizardSpider",)),
    ("QakBot", 0.8, ("initial_access", "execution", "persistence"), ()),
)
# Default techniques (id, name, tactics, severity).
TECHNIQUES = (
    ("T1566", "Phishing", ("initial_access",), 0.7),
    ("T1059", "Command and Scripting Interpreter", ("execution",), 0.6),
    ("T1053", "Scheduled Task/Job", ("execution", "persistence"), 0.5),
    ("T1078", "Valid Accounts", ("persistence", "privilege_escalation"), 0.8),
    ("T1098", "Account Manipulation", ("persistence",), 0.7),
    ("T1110", "Brute Force", ("credential_access",), 0.6),
    ("T1021", "Remote Services", ("lateral_movement",), 0.7),
    ("T1041", "Exfiltration Over C2 Channel", ("exfiltration",), 0.8),
    ("T1486", "Data Encrypted for Impact", ("impact",), 0.9),
    ("T1567", "Exfiltration Over Web Service", ("exfiltration",), 0.8),
)
# How severe a technique of each tactic is.
TACTIC_WEIGHTS = {
    "initial_access": 0.8, "execution": 0.7, "persistence": 0.8, "privilege_escalation": 0.9, "defense_evasion": 0.8, "credential_access": 0.9,
    "discovery": 0.5, "lateral_movement": 0.8, "collection": 0.6, "command_and_control": 0.7, "exfiltration": 0.9, "impact": 0.9,
}
_SCHEMA = "entity_id string, kind string, name string, severity double, tactics array<string>, groups array<string>"

#: Names of one block in a task's automaton, and texts of a group, at most.
BLOCK_NAMES, BLOCK_TEXTS = 200_000, 50_000


def malware_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"malware:{n}", "malware", n, s, list(t), list(g)) for n, s, t, g in MALWARE], _SCHEMA)


def default_techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"technique:{i}", "technique", n, s, list(t), []) for i, n, t, s in TECHNIQUES], _SCHEMA)


def _entities(spark: SparkSession, path: str, field: str, fields: str, lines: bool) -> DataFrame:
    """Entities of JSON files: of one document with a list each, or of one entity a line, which tasks read in parts."""
    if lines:
        return spark.read.schema(fields).json(path)
    return spark.read.schema(f"{field} array<struct<{fields}>>").option("multiLine", True).json(path).select(F.explode(field).alias("t")).select("t.*")


def _none() -> Column:
    return F.array().cast("array<string>")


def _listed(c: str) -> Column:
    return F.coalesce(F.col(c), _none())


def technique_table(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Techniques of a JSON file (id, name, tactics), each as severe as its most severe tactic; 0.5 without or with unknown ones."""
    raw = _entities(spark, path, "techniques", "id string, name string, tactics array<string>", lines)
    table = F.create_map(*[F.lit(x) for kv in TACTIC_WEIGHTS.items() for x in kv])
    weights = F.transform(_listed("tactics"), lambda x: F.coalesce(table[F.lower(x)], F.lit(0.5)))
    return raw.select(F.concat(F.lit("technique:"), "id").alias("entity_id"), F.lit("technique").alias("kind"), "name", F.coalesce(F.array_max(weights), F.lit(0.5)).alias("severity"), _listed("tactics").alias("tactics"), _none().alias("groups"))


def cve_table(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Vulnerabilities of a JSON file (id, cvss.base_score), as severe as a tenth of their score; 0 without one."""
    raw = _entities(spark, path, "cves", "id string, cvss struct<base_score: double>", lines)
    return raw.select(F.concat(F.lit("cve:"), "id").alias("entity_id"), F.lit("cve").alias("kind"), F.col("id").alias("name"), (F.coalesce("cvss.base_score", F.lit(0.0)) / 10).alias("severity"), _none().alias("tactics"), _none().alias("groups"))


def malware_file(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Malware families of a JSON file (name, severity, tactics, apt_groups); 0.5 without a severity."""
    raw = _entities(spark, path, "malware", "name string, severity double, tactics array<string>, apt_groups array<string>", lines)
    return raw.select(F.concat(F.lit("malware:"), "name").alias("entity_id"), F.lit("malware").alias("kind"), "name", F.coalesce("severity", F.lit(0.5)).alias("severity"), _listed("tactics").alias("tactics"), _listed("apt_groups").alias("groups"))


def load_intel(spark: SparkSession, techniques: str | None = None, cves: str | None = None, malware: str | None = None, lines: bool = False) -> DataFrame:
    """All entities, one a ``entity_id``: techniques and malware from files or the defaults, vulnerabilities from a file if there is one.
    Of equal ids the one first in order of its values stays."""
    out = technique_table(spark, techniques, lines) if techniques else default_techniques(spark)
    out = out.unionByName(malware_file(spark, malware, lines) if malware else malware_table(spark))
    if cves:
        out = out.unionByName(cve_table(spark, cves, lines))
    rest = [c for c in out.columns if c != "entity_id"]
    return out.groupBy("entity_id").agg(F.min(F.struct(*rest)).alias("e")).select("entity_id", "e.*")


def by_id(intel: DataFrame, entity_id: str) -> DataFrame:
    return intel.where(F.col("entity_id") == entity_id)


def by_kind(intel: DataFrame, kind: str) -> DataFrame:
    return intel.where(F.col("kind") == kind)


def by_name(intel: DataFrame, name: str) -> DataFrame:
    return intel.where(F.lower("name") == name.lower())


def by_tactic(intel: DataFrame, tactic: str) -> DataFrame:
    return intel.where(F.exists("tactics", lambda x: F.lower(x) == tactic.lower()))


def looked_up(asked: DataFrame, intel: DataFrame, value: str = "value") -> DataFrame:
    """``value``, ``how`` and ``entity_id``: the entities whose id or kind equals a value, or whose name or one of whose tactics does
    whatever its case. Values are made distinct before they are joined; null is none."""
    low = F.lower("v")
    ways = F.array(
        F.struct(F.lit("id").alias("how"), F.array("entity_id").alias("k")), F.struct(F.lit("kind").alias("how"), F.array("kind").alias("k")),
        F.struct(F.lit("name").alias("how"), F.array(F.lower("name")).alias("k")), F.struct(F.lit("tactic").alias("how"), F.array_distinct(F.transform("tactics", lambda x: F.lower(x))).alias("k")),
    )
    keys = intel.select("entity_id", F.explode(ways).alias("w")).select("entity_id", "w.how", F.explode("w.k").alias("key"))
    values = asked.select(F.col(value).cast("string").alias("v")).where("v is not null").distinct()
    exact, folded = F.array(F.lit("id"), F.lit("kind")), F.array(F.lit("name"), F.lit("tactic"))
    values = values.select("v", F.explode(F.array(F.struct(F.col("v").alias("key"), exact.alias("ways")), F.struct(low.alias("key"), folded.alias("ways")))).alias("a")).select("v", "a.key", F.explode("a.ways").alias("how"))
    return values.join(keys, ["key", "how"]).select(F.col("v").alias(value), "how", "entity_id")


def _automaton(names: list[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for n in names:
        found.add_word(n, n)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _hits(texts: pd.Series, found: ahocorasick.Automaton | None) -> pd.DataFrame:
    pairs = [(t, n) for t in texts for n in {n for _, n in found.iter(t)}] if found else []
    return pd.DataFrame(pairs, columns=["t", "n"], dtype=object)


def names_in_texts(texts: DataFrame, names: DataFrame, block_names: int = BLOCK_NAMES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """``t`` and ``n``: each distinct text with each name that it holds, both taken as they are. Nulls and empty names are in no text.

    Aho-Corasick reads a text once for all names. At most ``block_names`` names of 200 bytes in the mean go to every task; more are dealt
    out to blocks by hash, and so are texts, and each block of names meets each block of texts in a task.
    """
    t = texts.select("t").where("t is not null").distinct()
    n = names.select("n").where("n is not null and n <> ''").distinct()
    size = n.agg(F.count("n").alias("k"), F.coalesce(F.sum(F.octet_length("n")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["k"] // block_names), -(-size["bytes"] // (200 * block_names)), 1)
    if blocks == 1:
        held = [r[0] for r in n.collect()]  # both counts are checked

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = _automaton(held)
            for pdf in batches:
                yield _hits(pdf["t"], found)

        return t.mapInPandas(run, "t string, n string")
    groups = max(1, -(-t.count() // block_texts))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt_t = t.withColumn("g", F.pmod(F.xxhash64("t"), F.lit(groups)).cast("int")).withColumn("b", each(blocks))
    dealt_n = n.withColumn("b", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")).withColumn("g", each(groups))
    return dealt_t.groupBy("b", "g").cogroup(dealt_n.groupBy("b", "g")).applyInPandas(lambda x, y: _hits(x["t"], _automaton(y["n"].tolist())), "t string, n string")
