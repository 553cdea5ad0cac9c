"""Queries of the tactic maps, label operators, threshold tiers and subnet blocking."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import tactics as ta
from alertloom.functions.scalars import TACTICS
from alertloom.operators import correlation as co
from alertloom.operators import labels as la
from alertloom.plans.core_queries import _COMPONENTS, _NUMBERED, ROLES
from alertloom.plans.registry import ORACLE, over_alerts, query
from alertloom.schema import FieldRoles, alerts

#: Labels that reach every branch of the maps.
LABELS = ("Mirai", "DDoS", "portscans", "R2L", "cnc", "rootkit", " SSH ", "web_servic", "strange thing", "normal", "Exploits", "brute force-web", "ssh_patator2", "", "Lateral Movement 7", "Web Attack", "data exfiltration")
DATASETS = (*ta.DATASET_TACTICS, "NSL_KDD", "other")
DATASET_LABELS = ("neptune", "DoS", "Bot", "normal", "Normal", "Mirai", "Execution", "PortScan", "xss", "back", "PortSweep")


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def labelled(spark, d):
    return alerts(spark, d).withColumn("label", _pick(LABELS, F.col("k") + F.col("user_id")))


_LABELLED = f"lab AS (SELECT *, {_list(LABELS)}[(k + user_id) % {len(LABELS)} + 1] AS label FROM alerts)"
_PAT = f"pat(p, t, o) AS ({_values((p, t, i) for i, (p, t) in enumerate(ta.PATTERNS.items()))})"
_FUZ = f"fuz(p, t) AS ({_values(ta.FUZZY.items())})"
_MAPPED = f"""mapped AS (SELECT label, CASE WHEN c >= 0.8 AND c > 0 THEN t WHEN f IS NOT NULL THEN f ELSE 'Unknown' END AS tactic, CASE WHEN c >= 0.8 AND c > 0 THEN c WHEN f IS NOT NULL THEN 0.9 ELSE 0 END::DOUBLE AS confidence
  FROM (SELECT l.label, pat.t, fuz.t AS f, CASE WHEN pat.p IS NOT NULL THEN least(length(w), length(pat.p))::DOUBLE / greatest(length(w), length(pat.p)) END AS c, row_number() OVER (PARTITION BY l.label ORDER BY CASE WHEN pat.p IS NOT NULL THEN least(length(w), length(pat.p))::DOUBLE / greatest(length(w), length(pat.p)) END DESC NULLS LAST, o) AS rn
    FROM (SELECT DISTINCT label, lower(trim(label)) AS w FROM lab) l LEFT JOIN pat ON contains(w, pat.p) OR contains(pat.p, w) LEFT JOIN fuz ON fuz.p = w) WHERE rn = 1)"""


@query(over_alerts("SELECT alert_idx, tactic, round(confidence, 9)::DOUBLE AS confidence FROM lab JOIN mapped USING (label)", _LABELLED, _PAT, _FUZ, _MAPPED))
def s2_mapped_tactic(spark, d):
    return ta.with_tactics(labelled(spark, d), "label").select("alert_idx", "tactic", F.round("confidence", 9).alias("confidence"))


@query(
    over_alerts(
        f"""SELECT alert_idx, coalesce(e.t, (SELECT arg_min(t, o) FROM pat WHERE contains(w, pat.p)), (SELECT arg_min(n, i) FROM tac WHERE contains(w, replace(lower(n), ' ', '_'))), 'Unknown') AS tactic
        FROM (SELECT alert_idx, replace(replace(lower(label), ' ', '_'), '-', '_') AS w FROM lab) l LEFT JOIN pat e ON e.p = w""",
        _LABELLED, _PAT, f"tac(n, i) AS ({_values((t, i) for i, t in enumerate(ta.TACTIC_PATTERNS))})",
    )
)
def s3_signature_tactic(spark, d):
    return labelled(spark, d).select("alert_idx", ta.map_signature(F.col("label")).alias("tactic"))


_DATASET = f"{_list(DATASETS)}[k % {len(DATASETS)} + 1] AS ds, {_list(DATASET_LABELS)}[user_id % {len(DATASET_LABELS)} + 1] AS label"


@query(over_alerts(f"SELECT alert_idx, coalesce(t, 'Unknown') AS tactic FROM (SELECT alert_idx, {_DATASET} FROM alerts) a LEFT JOIN ({_values((d, k, t) for d, own in ta.DATASET_TACTICS.items() for k, t in own.items())}) m(d, l, t) ON m.d = lower(a.ds) AND m.l = a.label"))
def s5_dataset_tactic(spark, d):
    a = alerts(spark, d).select("alert_idx", _pick(DATASETS, F.col("k")).alias("ds"), _pick(DATASET_LABELS, F.col("user_id")).alias("label"))
    return a.select("alert_idx", ta.map_dataset_label(F.col("ds"), F.col("label")).alias("tactic"))


@query(
    over_alerts(
        "SELECT user_id, string_agg(tactic || ':' || printf('%.3f', c), '>' ORDER BY e, i) AS chain FROM (SELECT user_id, tactic, min(EndDate) AS e, arg_min(alert_idx, (EndDate, alert_idx)) AS i, arg_min(confidence, (EndDate, alert_idx)) AS c FROM lab JOIN mapped USING (label) WHERE tactic NOT IN ('None', 'Unknown') GROUP BY 1, 2) GROUP BY 1",
        _LABELLED, _PAT, _FUZ, _MAPPED,
    )
)
def s7_mapped_chain(spark, d):
    c = ta.mapped_chain(labelled(spark, d), "user_id", "label", "EndDate", "alert_idx")
    return c.select("user_id", F.array_join(F.transform("chain", lambda x: F.format_string("%s:%.3f", x["tactic"], x["confidence"])), ">").alias("chain"))


@query(
    over_alerts(
        f"SELECT count(*) AS n_labels, count(CASE WHEN hit THEN 1 END) AS n_mapped, round(count(CASE WHEN hit THEN 1 END) / count(*)::DOUBLE, 9) AS coverage FROM (SELECT label, EXISTS (SELECT 1 FROM (VALUES {', '.join(f'($${k}$$)' for k in TACTICS)}) v(x) WHERE contains(lower(x), lower(label)) OR contains(lower(label), lower(x))) AS hit FROM (SELECT label FROM lab GROUP BY label ORDER BY min(alert_idx) LIMIT 20))",
        _LABELLED,
    )
)
def s14_partial_coverage(spark, d):
    return ta.partial_coverage(labelled(spark, d), "label", TACTICS, "alert_idx").withColumn("coverage", F.round("coverage", 9))


_STAGE_LABELS = (*ta.LABEL_STAGES, "Worm", "None")


@query(over_alerts(f"SELECT alert_idx, coalesce(t, 'Stage_' || CAST(alert_idx % 5 AS VARCHAR)) AS stage FROM (SELECT alert_idx, {_list(_STAGE_LABELS)}[k % {len(_STAGE_LABELS)} + 1] AS label FROM alerts) LEFT JOIN ({_values(ta.LABEL_STAGES.items())}) m(l, t) ON l = label"))
def p29_label_stage(spark, d):
    return alerts(spark, d).select("alert_idx", ta.label_stage(_pick(_STAGE_LABELS, F.col("k")), F.col("alert_idx")).alias("stage"))


@query(over_alerts("SELECT alert_idx, coalesce(c, -1) AS campaign FROM lab2 LEFT JOIN (SELECT label, row_number() OVER (ORDER BY min(alert_idx)) - 1 AS c FROM lab2 WHERE label IS NOT NULL GROUP BY label) USING (label)", _LABELLED, "lab2 AS (SELECT alert_idx, nullif(label, '') AS label FROM lab)"))
def p18_campaign_labels(spark, d):
    a = labelled(spark, d).select("alert_idx", F.nullif("label", F.lit("")).alias("label"))
    return la.campaign_labels(a).select("alert_idx", "campaign")


_EVENTS = (*la.EVENT_TACTICS, 1, 2)


@query(
    over_alerts(
        "SELECT alert_idx, c AS campaign FROM ev JOIN (SELECT t, row_number() OVER (ORDER BY min(alert_idx)) - 1 AS c FROM ev GROUP BY t) USING (t)",
        f"ev AS (SELECT alert_idx, coalesce(t, 'Unknown') AS t FROM (SELECT alert_idx, [{', '.join(map(str, _EVENTS))}][k % {len(_EVENTS)} + 1] AS e FROM alerts) LEFT JOIN ({_values(la.EVENT_TACTICS.items())}) m(n, t) ON n = e)",
    )
)
def p18_event_campaigns(spark, d):
    a = alerts(spark, d).select("alert_idx", F.element_at(F.array(*map(F.lit, _EVENTS)), (F.col("k") % len(_EVENTS) + 1).cast("int")).alias("EventID"))
    return la.campaign_labels(a).select("alert_idx", "campaign")


_CELLS = "cells AS (SELECT alert_idx, 'a' AS c, CAST(k % 50 AS VARCHAR) AS v FROM alerts UNION ALL SELECT alert_idx, 'b', DeviceHostName FROM alerts UNION ALL SELECT alert_idx, 'c', CAST(user_id % 60 AS VARCHAR) FROM alerts)"


@query(over_alerts("SELECT alert_idx, max(f) FILTER (c = 'a') AS a, max(f) FILTER (c = 'b') AS b, max(f) FILTER (c = 'c') AS c FROM (SELECT x.alert_idx, x.c, coalesce(y.f, x.alert_idx) AS f FROM cells x LEFT JOIN (SELECT v, min(alert_idx) AS f FROM cells WHERE v <> '0' GROUP BY v) y ON x.v = y.v) GROUP BY alert_idx", _CELLS))
def p19_first_row_labels(spark, d):
    a = alerts(spark, d).select("alert_idx", (F.col("k") % 50).alias("a"), F.col("DeviceHostName").alias("b"), (F.col("user_id") % 60).alias("c"))
    return la.first_row_labels(a, ["a", "b", "c"], "alert_idx")


@query(over_alerts("SELECT alert_idx // 64 AS batch, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY EndDate, alert_idx) || repeat(',-', CAST(64 - count(*) AS INT)) AS ks, CAST(count(*) AS INT) AS masked FROM alerts GROUP BY 1"))
def p16_batch_columns(spark, d):
    b = la.batch_columns(alerts(spark, d), F.floor(F.col("alert_idx") / 64), {"k": F.col("k"), "severity": F.col("severity")}, ["EndDate", "alert_idx"], 64)
    return b.select("batch", "n", F.array_join(F.transform("k", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("ks"), F.size(F.filter("mask", lambda x: x)).alias("masked"))


@query(
    over_alerts(
        """SELECT alert_idx // 64 AS batch, count(*) AS num_alerts, len(list_distinct(list_concat(list(SourceAddress), list(DestinationAddress)))) + len(list_distinct(list(DeviceHostName))) + count(DISTINCT SourceUserName) AS num_entities,
        round(epoch(max(EndDate)) - epoch(min(EndDate)), 3)::DOUBLE AS span, round(avg(severity), 9) AS avg_severity, round(avg((DeviceHostName IS NULL)::INT) * 100, 6)::DOUBLE AS missing_tactics_pct, 0::DOUBLE AS missing_techniques_pct FROM alerts GROUP BY 1"""
    )
)
def p17_batch_metadata(spark, d):
    b = la.batch_metadata(alerts(spark, d), F.floor(F.col("alert_idx") / 64), ["SourceAddress", "DestinationAddress"], ["DeviceHostName"], ["SourceUserName"], "severity", "EndDate", "DeviceHostName", "CustomerName")
    return b.withColumn("span", F.round("span", 3)).withColumn("avg_severity", F.round("avg_severity", 9)).withColumn("missing_tactics_pct", F.round("missing_tactics_pct", 6))


@query(over_alerts("SELECT alert_idx, SourceAddress AS sourceaddress, AttackSeverity AS attackseverity FROM alerts"))
def p2_tidy_names(spark, d):
    a = alerts(spark, d).select("alert_idx", F.col("SourceAddress").alias(" SourceAddress "), F.col("AttackSeverity").alias("AttackSeverity\t"))
    return la.tidy_names(a)


@query(over_alerts("SELECT alert_idx, '10.' || CAST(k * 7 % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) || '.1' AS SourceAddress, '192.168.' || CAST(k * 11 % 256 AS VARCHAR) || '.' || CAST(user_id % 254 + 1 AS VARCHAR) AS DestinationAddress, 'svc-' || coalesce(DeviceHostName, 'none') AS SourceHostName, 'state-' || AttackSeverity AS DeviceHostName, 'proto-' || CustomerName AS DestinationHostName FROM alerts"))
def p35_derived_entities(spark, d):
    a = alerts(spark, d).select("alert_idx", (F.col("k") * 7).alias("sb"), F.col("user_id").alias("u"), (F.col("k") * 11).alias("rb"), "DeviceHostName", "AttackSeverity", "CustomerName")
    return a.select("alert_idx", *la.derived_entities(a, "sb", "u", "rb", "u", "DeviceHostName", "AttackSeverity", "CustomerName")).drop("DeviceAddress")


@query(over_alerts("SELECT alert_idx, CAST(k AS VARCHAR) AS sensor FROM alerts WHERE k % 4 = 0"))
def j25_sensors(spark, d):
    a = alerts(spark, d).withColumn("u", F.when(F.col("k") % 4 == 0, F.concat(F.lit("gateway_1:cam:"), F.col("k").cast("string"))).otherwise(F.col("SourceUserName")))
    return la.sensors(a, "u").select("alert_idx", "sensor")


@query("SELECT vec_id, round(list_max(p), 9)::DOUBLE AS top, list_position(p, list_max(p)) - 1 AS best FROM (SELECT vec_id, [exp(x / 0.5) / list_sum([exp(z / 0.5) FOR z IN e]) FOR x IN e] AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def m14_softmax(spark, d):
    from alertloom.schema import table

    e = table(spark, d, "embeddings").select("vec_id", la.softmax(F.transform("embedding", lambda x: x.cast("double")), 0.5).alias("p"))
    return e.select("vec_id", F.round(F.array_max("p"), 9).alias("top"), la.argmax(F.col("p")).alias("best"))


@query(f"SELECT 'override' AS threshold_source, 0.55::DOUBLE AS threshold UNION ALL SELECT 'confidence_guided', threshold FROM ({ORACLE['m3_confidence_threshold']}) UNION ALL SELECT 'adaptive_stats', threshold FROM ({ORACLE['m4_adaptive_threshold']}) UNION ALL SELECT 'baseline', 0.3")
def c1_tiers(spark, d):
    a = alerts(spark, d)
    found = [co.tier(a, ROLES, override=0.55, confidence="severity"), co.tier(a, ROLES, confidence="severity"), co.tier(a, ROLES), co.tier(a, ROLES, adaptive=False)]
    return spark.createDataFrame([(s, round(t, 9)) for t, s in found], "threshold_source string, threshold double")


_SPARSE = "sp AS (SELECT alert_idx, CASE WHEN k % 10 <> 0 THEN '10.0.' || CAST(k % 4 AS VARCHAR) || '.' || CAST(alert_idx // 9 AS VARCHAR) END AS a, CAST(alert_idx // 6 AS VARCHAR) AS h1, CAST(alert_idx // 4 AS VARCHAR) AS h2 FROM alerts)"


@query(
    over_alerts(
        _NUMBERED, _SPARSE,
        "l AS (SELECT x.alert_idx AS i, y.alert_idx AS j FROM sp x JOIN sp y ON x.alert_idx // 36 = y.alert_idx // 36 AND x.alert_idx <> y.alert_idx WHERE coalesce(x.a = y.a, false) OR (x.h1 = y.h1 AND x.h2 = y.h2 AND (x.a IS NULL OR y.a IS NULL OR regexp_replace(x.a, '\\.[^.]*$', '') = regexp_replace(y.a, '\\.[^.]*$', ''))))",
        _COMPONENTS.format(a="alerts"), recursive=True,
    )
)
def j2_subnet_blocked(spark, d):
    i = F.col("alert_idx")
    part = lambda n: F.floor(i / n).cast("string")
    a = alerts(spark, d).select(i, F.when(F.col("k") % 10 != 0, F.concat(F.lit("10.0."), (F.col("k") % 4).cast("string"), F.lit("."), part(9))).alias("a"), part(6).alias("h1"), part(4).alias("h2"))
    return co.blocked_clusters(a, FieldRoles(["a"], ["h1", "h2"]), 0.5).select("alert_idx", "pred_cluster")
