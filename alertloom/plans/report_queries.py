"""Queries of the graph views, detection reports, feedback and dataset conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions.tactics import DATASET_TACTICS, LABEL_STAGES
from alertloom.operators import behaviour as be
from alertloom.operators import reports as re_
from alertloom.operators import temporal as te
from alertloom.plans.analysis_queries import _ROWS, _WINDOWS, _behaviour_sql
from alertloom.plans.core_queries import ROLES
from alertloom.plans.registry import over_alerts, query
from alertloom.schema import alerts, table
from alertloom.sources import datasets as ds

DOMAINS = ("network", "host", "cloud", "email", "endpoint")
#: Names that reach the colours: each alert's kind with one of these behind it.
STEPS = ("initial_access", "lateral_movement", "impact", "unheard of")


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("k") % 5).cast("int"))


def _sql_map(pairs: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in pairs.items())}}}"


_COLOUR = "CASE " + " ".join(f"WHEN contains(lower(t), '{n}') THEN '{c}'" for n, c in re_.TACTIC_COLOURS.items()) + f" ELSE '{re_.OTHER_COLOUR}' END"
_STEPPED = f"st AS (SELECT *, MalwareIntelAttackType || ' ' || {_sql_list(STEPS)}[1 + CAST(k % 4 AS INT)] AS t FROM alerts)"


@query(
    over_alerts(
        f"SELECT t AS label, 'tactic' AS type, {_COLOUR} AS color, 20 AS size FROM (SELECT DISTINCT t FROM st) UNION ALL SELECT h, 'host', NULL, 10 + least(30, 5 * count(DISTINCT t)) FROM (SELECT t, unnest([SourceHostName, DestinationHostName, DeviceHostName]) AS h FROM st) WHERE h IS NOT NULL GROUP BY 1",
        _STEPPED,
    )
)
def s13_graph_nodes(spark, d):
    step = F.get(F.array(*[F.lit(x) for x in STEPS]), (F.col("k") % 4).cast("int"))
    return re_.graph_nodes(alerts(spark, d).withColumn("t", F.concat("MalwareIntelAttackType", F.lit(" "), step)), "t")


_CELLS = "x AS (SELECT alert_idx, user_id, [v FOR v IN [SourceAddress, DestinationAddress, nullif(DeviceAddress, 'NIL')] IF v IS NOT NULL] AS a, [v FOR v IN [SourceHostName, DeviceHostName, DestinationHostName] IF v IS NOT NULL] AS u FROM alerts)"


@query(over_alerts("SELECT p.alert_idx AS src, q.alert_idx AS dst, p.user_id FROM x p JOIN x q ON p.user_id = q.user_id AND p.alert_idx < q.alert_idx WHERE len(list_distinct(list_concat(list_intersect(p.a, q.a), list_intersect(p.u, q.u)))) > 2", _CELLS))
def j24_common_value_pairs(spark, d):
    return re_.common_value_pairs(alerts(spark, d), "user_id", ROLES)


@query()
def g2_cluster_weights(spark, d):
    a = alerts(spark, d)
    edges = a.select(F.col("user_id").alias("src"), (F.col("k") + 1_000_000).alias("dst"), F.col("severity").alias("weight"), "alert_idx")
    return re_.cluster_weights(edges, "weight", "alert_idx")


@query(
    over_alerts(
        "SELECT head AS \"window\", count(DISTINCT dm) AS num_domains, string_agg(DISTINCT dm, ',' ORDER BY dm) AS domains, count(DISTINCT MalwareIntelAttackType) AS num_tactics, string_agg(DISTINCT MalwareIntelAttackType, ',' ORDER BY MalwareIntelAttackType) AS tactics, 1 + (bool_or(dm = 'host') AND bool_or(dm = 'network'))::INT + (bool_or(dm = 'email') AND bool_or(dm = 'network'))::INT + (bool_or(dm = 'cloud') AND bool_or(dm = 'endpoint'))::BIGINT AS num_indicators, 'multi_domain:' || count(DISTINCT dm) || '_domains' || CASE WHEN bool_or(dm = 'host') AND bool_or(dm = 'network') THEN ',suspected_lateral_movement' ELSE '' END || CASE WHEN bool_or(dm = 'email') AND bool_or(dm = 'network') THEN ',suspected_phishing_campaign' ELSE '' END || CASE WHEN bool_or(dm = 'cloud') AND bool_or(dm = 'endpoint') THEN ',suspected_cloud_compromise' ELSE '' END AS indicators, (count(SourceAddress) > 0)::INT + (count(nullif(DeviceAddress, 'NIL')) > 0)::INT + (count(DestinationHostName) > 0)::BIGINT AS num_entities FROM m GROUP BY head HAVING count(DISTINCT dm) > 1",
        _ROWS[0], _WINDOWS,
        f"m AS (SELECT wd.head, alerts.*, {_sql_list(DOMAINS)}[1 + CAST(k % 5 AS INT)] AS dm FROM wd JOIN alerts USING (alert_idx))",
        recursive=True,
    )
)
def a15_fusion_summary(spark, d):
    a = alerts(spark, d).withColumn("domain", _pick(DOMAINS))
    return re_.fusion_summary(a, te.anchored_windows(a, ["user_id"], 36000.0), ("SourceAddress", "DeviceAddress", "DestinationHostName")).drop("timestamp")


_PARTS = (("time", "CAST(hour(EndDate) // 3 AS VARCHAR)", "interval", 2.0, False), ("source", "SourceAddress", "SourceAddress", 1.0, True), ("target", "DestinationHostName", "DestinationHostName", 1.0, True))


def _found_sql(key: str, factor: float, new: bool) -> str:
    whole = _behaviour_sql(key, factor, new)
    return "(" + whole[: whole.rindex('SELECT u AS "user"')] + "SELECT u, dy, ky, nw, rk FROM ri WHERE rk > 69 OR rk < 31)"


def _found(spark, d):
    a, out = alerts(spark, d), []
    for _, _, key, factor, new in _PARTS:
        act = be.activity(a, key)
        marked = act.crossJoin(F.broadcast(act.agg(F.date_add(F.min("day"), 20).alias("cut"))))  # one row
        out.append(be.anomalies(marked.where("day >= cut").drop("cut"), be.baseline(marked.where("day < cut").drop("cut")), factor, new))
    return out


_T, _S, _D = [_found_sql(sql, factor, new) for _, sql, _, factor, new in _PARTS]
_REPORT = f"""SELECT 'time' AS kind, u AS "user", dy AS day, ky AS "key", nw AS is_new, rk AS risk, CASE WHEN nw THEN 'New User' ELSE 'Logon time, intervals: [' || ky || ']' END AS text FROM (SELECT u, dy, coalesce(string_agg(ky, ', ' ORDER BY ky) FILTER (NOT nw), '') AS ky, bool_or(nw) AS nw, max(rk) AS rk FROM {_T} GROUP BY 1, 2)
UNION ALL SELECT 'source', u, dy, ky, nw, rk, CASE WHEN nw THEN 'New Source Address' ELSE 'Source Address Anomaly ' || printf('%.1f', rk) END FROM {_S}
UNION ALL SELECT 'target', u, dy, ky, nw, rk, CASE WHEN nw THEN 'New Destination Host' ELSE 'Destination Host Anomaly ' || printf('%.1f', rk) END FROM {_D}"""


@query(f'SELECT kind, "user", day::VARCHAR AS day, "key", is_new, text, round(risk, 4)::DOUBLE AS risk FROM ({_REPORT})')
def b3_detection_report(spark, d):
    return re_.detection_report(*_found(spark, d)).select("kind", "user", F.col("day").cast("string").alias("day"), "key", "is_new", "text", F.round("risk", 4).alias("risk"))


def _chance_sql(salt: str) -> str:
    return f"""(('0x' || substr(md5('42{salt}|' || "user" || '|' || day::VARCHAR || '|' || "key"), 1, 8))::BIGINT / 4294967296.0)"""


@query(f"""SELECT kind, "user", day::VARCHAR AS day, "key", CASE WHEN is_new THEN CASE WHEN {_chance_sql('n')} <= 0.25 THEN 'New Positive' ELSE 'New Negative' END WHEN {_chance_sql('r')} <= 0.2 THEN CASE WHEN {_chance_sql('p')} <= 0.6 THEN 'Positive' ELSE 'Negative' END ELSE 'Nil' END AS verdict FROM ({_REPORT})""")
def b4_simulated_feedback(spark, d):
    return re_.simulated_feedback(re_.detection_report(*_found(spark, d))).select("kind", "user", F.col("day").cast("string").alias("day"), "key", "verdict")


@query()
def k16_feature_baseline(spark, d):
    return re_.feature_baseline(alerts(spark, d), ["severity", "k"], "MalwareIntelAttackType")


@query(over_alerts("""SELECT '{"alert_idx":' || alert_idx || ',"DeviceHostName":' || coalesce('"' || DeviceHostName || '"', 'null') || ',"k":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE k || '.0' END || '}' AS json FROM alerts"""))
def p31_json_rows(spark, d):
    k = F.when(F.col("k") % 3 == 0, F.when(F.col("k") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("k").cast("double"))
    return re_.json_rows(alerts(spark, d).select("alert_idx", "DeviceHostName", k.alias("k")))


_COLUMNS = {"SourceHostName": "host", "DestinationAddress": "ip", "DeviceAddress": "ip"}


@query(over_alerts("SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM (SELECT 'host:' || SourceHostName AS a, 'ip:' || DestinationAddress AS b FROM alerts WHERE user_id = 3 UNION ALL SELECT 'host:' || SourceHostName, 'ip:' || nullif(DeviceAddress, 'NIL') FROM alerts WHERE user_id = 3 UNION ALL SELECT 'ip:' || DestinationAddress, 'ip:' || nullif(DeviceAddress, 'NIL') FROM alerts WHERE user_id = 3) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2"))
def g8_cluster_graph(spark, d):
    return re_.cluster_graph(alerts(spark, d), 3, _COLUMNS, "user_id")


# --- conversions of public datasets, from records made of the alerts
def _hash_sql(c: str, size: int) -> str:
    return f"CASE WHEN coalesce(trim(lower({c})), '') = '' THEN 0 ELSE CAST(('0x' || substr(md5(':' || lower(trim({c}))), 1, 15))::BIGINT % {size - 1} + 1 AS BIGINT) END"


def _host_sql(c: str) -> str:
    return f"'host-' || lpad(CAST({_hash_sql(c, 1001)} AS VARCHAR), greatest(3, 3), '0') || '.local'"


_STAGE = lambda c, i: f"coalesce({_sql_map(LABEL_STAGES)}[{c}], 'Stage_' || CAST({i} % 5 AS VARCHAR))"
KDD = ("neptune", "normal", "satan", "spy", "odd")
UNSW = ("DoS", "Normal", "Fuzzers", "Reconnaissance", "odd")
CIC = ("BENIGN", "Bot", "DDoS", "normal", "odd")


_KDD = f"r AS (SELECT alert_idx, row_number() OVER (ORDER BY alert_idx) - 1 AS i, k AS duration, user_id * 7 AS sb, k * 11 AS db, DestinationHostName AS service, k % 2 AS li, {_sql_list(KDD)}[1 + CAST(k % 5 AS INT)] AS label FROM alerts)"


@query(
    over_alerts(
        f"SELECT alert_idx, CAST(epoch(TIMESTAMP '2024-01-01') + 300 * i AS BIGINT) AS at, '10.' || duration % 256 || '.' || sb % 256 || '.1' AS src_ip, '192.168.' || db % 256 || '.1' AS dst_ip, {_host_sql('service')} AS hostname, CASE WHEN li <> 0 THEN 'user_' || lpad(CAST({_hash_sql('CAST(li AS VARCHAR)', 101)} AS VARCHAR), 2, '0') || '@domain.com' ELSE 'unknown@domain.com' END AS username, CASE WHEN label = 'normal' THEN 'normal' ELSE 'attack' END AS alert_type, coalesce({_sql_map(DATASET_TACTICS['nsl_kdd'])}[label], 'Unknown') AS tactic, {_hash_sql('label', 51)} - 1 AS campaign_id, {_STAGE('label', 'i')} AS stage FROM r",
        _KDD,
    )
)
def src11_connection_alerts(spark, d):
    a = alerts(spark, d)
    r = a.select("alert_idx", F.col("k").alias("duration"), (F.col("user_id") * 7).alias("src_bytes"), (F.col("k") * 11).alias("dst_bytes"), F.col("DestinationHostName").alias("service"), (F.col("k") % 2).alias("logged_in"), F.lit("tcp").alias("protocol_type"), F.lit("SF").alias("flag"), _pick(KDD).alias("label"))
    out = ds.connection_alerts(r, "alert_idx").withColumn("at", F.unix_timestamp("timestamp"))
    return out.select("alert_idx", "at", "src_ip", "dst_ip", "hostname", "username", "alert_type", "tactic", "campaign_id", "stage")


_UNSW = f"r AS (SELECT alert_idx, row_number() OVER (ORDER BY alert_idx) - 1 AS i, DestinationHostName AS service, k % 5 AS label, {_sql_list(UNSW)}[1 + CAST(k % 5 AS INT)] AS cat FROM alerts)"


@query(
    over_alerts(
        f"SELECT alert_idx, CAST(epoch(TIMESTAMP '2024-01-01') + 60 * i AS BIGINT) AS at, '10.' || i % 256 || '.' || (i // 256) % 256 || '.' || (i % 254 + 1) AS src_ip, '192.168.' || i % 256 || '.' || ((i // 256) % 256 + 1) AS dst_ip, {_host_sql('service')} AS hostname, CASE WHEN label = 1 THEN 'attack' ELSE 'normal' END AS alert_type, coalesce({_sql_map(DATASET_TACTICS['unsw_nb15'])}[cat], 'Unknown') AS tactic, {_hash_sql('cat', 51)} - 1 AS campaign_id, {_STAGE('cat', 'i')} AS stage FROM r",
        _UNSW,
    )
)
def src11_traffic_alerts(spark, d):
    a = alerts(spark, d)
    r = a.select("alert_idx", F.col("DestinationHostName").alias("service"), F.lit("tcp").alias("proto"), F.lit(1).alias("sbytes"), F.lit(2).alias("dbytes"), (F.col("k") % 5).alias("label"), _pick(UNSW).alias("attack_cat"))
    out = ds.traffic_alerts(r, "alert_idx").withColumn("at", F.unix_timestamp("timestamp"))
    return out.select("alert_idx", "at", "src_ip", "dst_ip", "hostname", "alert_type", "tactic", "campaign_id", "stage")


_CIC = f"r AS (SELECT alert_idx, SourceAddress AS s, DestinationAddress AS t, EndDate, CASE WHEN k % 2 = 0 THEN '6' ELSE '17' END AS p, {_sql_list(CIC)}[1 + CAST(k % 5 AS INT)] AS label FROM alerts)"


@query(
    over_alerts(
        f"SELECT alert_idx, CAST(floor(epoch(EndDate)) AS BIGINT) AS at, s AS src_ip, t AS dst_ip, 'host-' || replace(s, '.', '-') AS hostname, 'user_' || lpad(CAST({_hash_sql('p', 101)} - 1 AS VARCHAR), 2, '0') || '@domain.com' AS username, CASE WHEN upper(label) = 'BENIGN' OR lower(label) = 'normal' THEN 'normal' ELSE 'attack' END AS alert_type, coalesce({_sql_map(DATASET_TACTICS['cicids2017'])}[label], 'Unknown') AS tactic, CASE WHEN label = 'BENIGN' THEN -1 ELSE {_hash_sql('label', 101)} - 1 END AS campaign_id FROM r",
        _CIC,
    )
)
def src12_flow_alerts(spark, d):
    a = alerts(spark, d)
    r = a.select("alert_idx", F.col("SourceAddress").alias("Src IP"), F.col("DestinationAddress").alias("Dst IP"), F.col("EndDate").cast("string").alias("Timestamp"), F.when(F.col("k") % 2 == 0, 6).otherwise(17).alias("Protocol"), _pick(CIC).alias("Label"))
    out = ds.labelled_flow_alerts(r, "alert_idx").withColumn("at", F.unix_timestamp("timestamp"))
    return out.drop("timestamp")


@query("SELECT name, 'parquet' AS format, 1::BIGINT AS n_files, false AS streaming FROM (VALUES ('nation_set'), ('region_set')) v(name)")
def src5_discover(spark, d):
    from alertloom.plans.stage import shared_dir

    base = shared_dir(spark)
    for name in ("nation", "region"):
        table(spark, d, name).coalesce(1).write.parquet(f"{base}/{name}-set")
        table(spark, d, name).coalesce(1).write.csv(f"{base}/{name}-set/more", header=True)
    return ds.discover(spark, base).select("name", "format", "n_files", "streaming")


@query("SELECT n_name, n_regionkey::VARCHAR AS n_regionkey, true AS named FROM nation")
def src4_load_dataset(spark, d):
    from alertloom.plans.stage import shared_dir

    path = shared_dir(spark)
    table(spark, d, "nation").write.csv(f"{path}/part", header=True)
    return ds.load_dataset(spark, path, "csv").select("n_name", "n_regionkey", F.endswith("_source_file", F.lit(".csv")).alias("named"))


@query(over_alerts("SELECT alert_idx::VARCHAR AS alert_idx, SourceAddress, 'host-' || replace(SourceAddress, '.', '-') AS SourceHostName, CASE WHEN k % 5 = 0 THEN 'normal' ELSE 'attack' END AS alert_type FROM alerts"))
def src10_load_flows(spark, d):
    from alertloom.plans.stage import shared_dir

    path = f"{shared_dir(spark)}/flows"
    raw = alerts(spark, d).select("alert_idx", F.col("SourceAddress").alias("Src IP"), F.col("DestinationAddress").alias("Dst IP"), F.date_format("EndDate", "dd/MM/yyyy HH:mm:ss").alias("Timestamp"), F.when(F.col("k") % 5 == 0, "Benign").otherwise("Mirai-x").alias("Label"))
    raw.write.csv(path, header=True)
    return ds.load_flows(spark, path).select("alert_idx", "SourceAddress", "SourceHostName", "alert_type")


@query("SELECT 10000::BIGINT AS n, true AS shares, true AS ports, true AS ordered")
def src24_generated_flows(spark, d):
    f = ds.generated_flows(spark, 10000)
    normal = F.avg((F.col("Label") == "Normal").cast("double"))
    ports = F.min(((F.col("Label") != "Normal") | (F.col("Dst Port") == 80)).cast("int")) == 1
    return f.agg(F.count(F.lit(1)).alias("n"), normal.between(0.57, 0.63).alias("shares"), ports.alias("ports"), (F.min("Timestamp") == "01/01/2025 08:00:00").alias("ordered"))
