"""Tactics of attack labels: pattern scores with a fuzzy table, signatures, and maps of single datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.scalars import lookup

# Tactics in order and the patterns of their attacks.
TACTIC_PATTERNS = {
    "Reconnaissance": ("scan", "portscan", "portsweep", "ipsweep", "satan", "nmap", "recon", "reconnaissance", "discovery", "host_discovery", "network_sniffing", "passive_dns", "whois", "dns_enumeration"),
    "Resource Development": ("acquire_infrastructure", "compromise_infrastructure", "develop_capabilities", "obtain_capabilities", "upload_malware", "build_arsenal"),
    "Initial Access": ("exploit", "back", "phf", "imap", "land", "sql_injection", "sql", "xss", "injection", "exploit_public_facing", "external_remote_service", "phishing", "supply_chain", "trusted_relationship", "valid_accounts"),
    "Execution": ("shellcode", "buffer_overflow", "loadmodule", "perl", "execution", "command_execution", "user_execution", "scripting", "powershell", "python", "bash", "fuzzers", "analysis", "generic", "webshell"),
    "Persistence": ("rootkit", "backdoor", "create_account", "local_account", "domain_account", "web_shell", "modify_authentication", "hijack_execution_flow", "bootkit", "create_service", "scheduled_task", "registry_run_keys", "startup_folder"),
    "Privilege Escalation": ("privilege_escalation", "elevate", "sudo", "sudoers", "process_injection", "token_impersonation", "access_token_manipulation", "bypass_user_account_control", "elevated_execution"),
    "Defense Evasion": ("rootkit", "hidden", "obfuscated", "encrypted", "packed", "packed_malware", "vm_aware", "sandbox_aware", "disable_security_tools", "indicator_removal", "clear_logs", "timestomp", "masquerading"),
    "Credential Access": ("brute", "bruteforce", "crack", "password", "credential", "guess_passwd", "ftp_write", "patator", "ssh_patator", "ftp_patator", "credential_dumping", "lsass", "kerberoasting", "credential_harvesting", "heartbleed", "ssl_heartbeat"),
    "Discovery": ("system_information_discovery", "system_network_configuration", "account_discovery", "software_discovery", "process_discovery", "network_service_scanning", "file_and_directory_discovery", "remote_system_discovery"),
    "Lateral Movement": ("lateral", "move", "multihop", "worm", "worms", "remote_services", "ssh", "rdp", "smb", "pass_the_hash", "pass_the_ticket", "remote_file_copy", "taint_shared_content"),
    "Collection": ("spy", "collection", "data_staged", "data_compressed", "screen_capture", "input_capture", "clipboard_data", "audio_capture", "video_capture", "email_collection", "data_from_local_system", "data_from_network"),
    "Command and Control": ("bot", "mirai", "c2", "command_and_control", "warezclient", "warezmaster", "gafgyt", "tsunami", "hajime", "reaper", "satori", "mozi", "application_layer_protocol", "web_protocol", "dns", "encrypted_channel", "data_encoding"),
    "Exfiltration": ("exfiltration", "exfil", "data_exfiltration", "over_c2_channel", "over_alternative_protocol", "web_service", "cloud_storage", "data_transfer_size_limits"),
    "Impact": ("dos", "ddos", "neptune", "smurf", "pod", "teardrop", "hulk", "goldeneye", "slowloris", "slowhttptest", "data_destruction", "disk_content_wipe", "account_access_removal", "service_stop", "resource_hijacking", "data_encrypted_for_impact", "defacement", "ransomware"),
}
# Short names and their tactics.
FUZZY = {
    "normal": "None", "benign": "None", "clean": "None", "scan": "Reconnaissance", "probe": "Reconnaissance", "r2l": "Initial Access", "u2r": "Privilege Escalation", "u2l": "Lateral Movement",
    "dos": "Impact", "ddos": "Impact", "botnet": "Command and Control", "cnc": "Command and Control", "c&c": "Command and Control", "infiltration": "Lateral Movement", "web attack": "Initial Access",
    "ftp": "Credential Access", "ssh": "Credential Access", "sql": "Initial Access", "xss": "Execution",
}
# Labels of single datasets and their tactics.
DATASET_TACTICS = {
    "nsl_kdd": {
        "neptune": "Impact", "smurf": "Impact", "pod": "Impact", "back": "Initial Access", "teardrop": "Impact", "ipsweep": "Reconnaissance", "portsweep": "Reconnaissance", "satan": "Reconnaissance", "nmap": "Reconnaissance",
        "guess_passwd": "Credential Access", "ftp_write": "Lateral Movement", "multihop": "Lateral Movement", "phf": "Initial Access", "spy": "Collection", "buffer_overflow": "Execution", "rootkit": "Persistence",
        "loadmodule": "Execution", "perl": "Execution", "warezclient": "Command and Control", "warezmaster": "Command and Control", "imap": "Initial Access", "land": "Impact", "normal": "None",
    },
    "unsw_nb15": {
        "Fuzzers": "Execution", "Analysis": "Collection", "Backdoor": "Persistence", "DoS": "Impact", "Exploits": "Initial Access", "Generic": "Initial Access", "Reconnaissance": "Reconnaissance", "Shellcode": "Execution",
        "Worms": "Lateral Movement", "Normal": "None",
    },
    "cicids2017": {
        "BENIGN": "None", "FTP-Patator": "Credential Access", "SSH-Patator": "Credential Access", "DoS slowloris": "Impact", "DoS Slowhttptest": "Impact", "DoS Hulk": "Impact", "DoS GoldenEye": "Impact",
        "Heartbleed": "Credential Access", "Web Attack - Brute Force": "Credential Access", "Web Attack - XSS": "Execution", "Web Attack - Sql Injection": "Initial Access", "Infiltration": "Lateral Movement",
        "Bot": "Command and Control", "PortScan": "Reconnaissance", "DDoS": "Impact",
    },
    "cse_cic_ids2018": {
        "Benign": "None", "Bot": "Command and Control", "Brute Force -Web": "Credential Access", "Brute Force -XSS": "Execution", "Brute Force -SQL": "Initial Access", "DoS attacks-GoldenEye": "Impact",
        "DoS attacks-Hulk": "Impact", "DoS attacks-SlowHTTPTest": "Impact", "DoS attacks-Slowloris": "Impact", "FTP-BruteForce": "Credential Access", "SSH-BruteForce": "Credential Access",
        "Infilteration": "Lateral Movement", "SQL Injection": "Initial Access",
    },
    "ton_iot": {
        "normal": "None", "backdoor": "Persistence", "ddos": "Impact", "dos": "Impact", "injection": "Initial Access", "mitm": "Collection", "password": "Credential Access", "ransomware": "Impact", "scanning": "Reconnaissance",
        "xss": "Execution",
    },
    "cicapt_iiot": {
        "Normal": "None", "PortScan": "Reconnaissance", "DDoS": "Impact", "DoS": "Impact", "MITM": "Collection", "Injection": "Initial Access", "Password": "Credential Access", "Ransomware": "Impact", "XSS": "Execution",
        "Backdoor": "Persistence",
    },
    "datasense_iiot": {
        "Normal": "None", "Benign": "None", "Mirai": "Command and Control", "Mirai-Greeth": "Command and Control", "DoS-Syn": "Impact", "DDoS-UDP": "Impact", "Recon-PortScan": "Reconnaissance", "PortScan": "Reconnaissance",
        "BruteForce": "Credential Access", "WebAttack": "Initial Access", "XSS": "Execution", "Injection": "Initial Access",
    },
    "linux_apt": {
        "Normal": "None", "Persistence": "Persistence", "Discovery": "Discovery", "LateralMovement": "Lateral Movement", "CredentialAccess": "Credential Access", "Execution": "Execution", "CommandAndControl": "Command and Control",
        "Exfiltration": "Exfiltration", "DefenseEvasion": "Defense Evasion", "PrivilegeEscalation": "Privilege Escalation",
    },
}
# Stages of labels.
LABEL_STAGES = {
    "Reconnaissance": "Initial Discovery", "Initial Access": "Initial Compromise", "Credential Access": "Credential Dumping", "Lateral Movement": "Lateral Movement", "Impact": "Impact", "normal": "Normal", "Normal": "Normal",
}

#: Patterns in order of their first tactic; one that several tactics name has the last of these.
PATTERNS = {p: t for t, own in TACTIC_PATTERNS.items() for p in own}


def _table(patterns: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("p"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (p, t) in enumerate(patterns.items())])


def map_label(c: Column, patterns: dict[str, str] | None = None, threshold: float = 0.8, fuzzy: dict[str, str] | None = None) -> Column:
    """struct(tactic, confidence): the pattern that holds the label, or is held by it, with the best ratio of lengths (the first of equals)
    if that reaches the threshold; else 0.9 by the fuzzy table; else Unknown with 0. Null is Unknown."""
    low = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    hits = F.filter(_table(patterns or PATTERNS), lambda x: F.contains(low, x["p"]) | F.contains(x["p"], low))
    ratio = lambda x: F.least(F.length(low), F.length(x["p"])) / F.greatest(F.length(low), F.length(x["p"]))
    best = F.array_max(F.transform(hits, lambda x: F.struct(ratio(x).alias("c"), x["o"].alias("o"), x["t"].alias("t"))))
    by_name = lookup(low, FUZZY if fuzzy is None else fuzzy)
    answer = lambda t, n: F.struct(t.alias("tactic"), n.cast("double").alias("confidence"))
    found = answer(best["t"], best["c"])
    return F.when((best["c"] >= threshold) & (best["c"] > 0), found).when(by_name.isNotNull(), answer(by_name, F.lit(0.9))).otherwise(answer(F.lit("Unknown"), F.lit(0.0)))


def with_tactics(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` with ``tactic`` and ``confidence``: each distinct label is scored once."""
    # the score hangs on an aggregate, so a filter by tactic stays above it and is not worked out for each row
    distinct = df.groupBy(label).agg(F.max(label).alias("_l")).withColumn("_m", map_label(F.col("_l"), **options))
    return df.join(distinct.select("_l", "_m.tactic", "_m.confidence"), F.col(label).eqNullSafe(F.col("_l")), "left").drop("_l")


def map_signature(c: Column, patterns: dict[str, str] | None = None, tactics: tuple[str, ...] = tuple(TACTIC_PATTERNS)) -> Column:
    """A signature's tactic: that of the equal pattern, or of the first pattern that it holds, or the first tactic that it names.

    Spaces and dashes count as underscores. A larger table of signatures is a parameter.
    """
    table = PATTERNS if patterns is None else patterns
    low = F.translate(F.lower(c), " -", "__")
    first = F.try_element_at(F.filter(_table(table), lambda x: F.contains(low, x["p"])), F.lit(1))["t"]
    named = F.try_element_at(F.filter(F.array(*map(F.lit, tactics)), lambda t: F.contains(low, F.translate(F.lower(t), " ", "_"))), F.lit(1))
    return F.coalesce(lookup(low, table), first, named, F.lit("Unknown"))


def map_dataset_label(dataset: Column, label: Column, maps: dict[str, dict[str, str]] | None = None) -> Column:
    """The tactic of a label by its dataset's own map; Unknown where that has none."""
    flat = {f"{d}\x1f{k}": t for d, own in (maps or DATASET_TACTICS).items() for k, t in own.items()}
    return F.coalesce(lookup(F.concat(F.lower(dataset), F.lit("\x1f"), label), flat), F.lit("Unknown"))


def label_stage(label: Column, index: Column) -> Column:
    return F.coalesce(lookup(label, LABEL_STAGES), F.concat(F.lit("Stage_"), F.pmod(index, F.lit(5)).cast("string")))


def mapped_chain(df: DataFrame, entity: str, label: str, time: str, id_col: str) -> DataFrame:
    """Per entity its tactics in order of first appearance, each with the confidence that it first had; None and Unknown left out."""
    rows = with_tactics(df.select(entity, label, time, id_col), label).where("tactic not in ('None', 'Unknown')")
    first = rows.groupBy(entity, "tactic").agg(F.min(F.struct(time, id_col, "confidence")).alias("f"))
    steps = F.array_sort(F.collect_list(F.struct(F.col(f"f.{time}").alias("at"), F.col(f"f.{id_col}").alias("id"), "tactic", F.col("f.confidence").alias("confidence"))))
    return first.groupBy(entity).agg(F.transform(steps, lambda x: F.struct(x["tactic"], x["confidence"])).alias("chain"))


def partial_coverage(df: DataFrame, label: str, table: dict[str, str], id_col: str, most: int = 20) -> DataFrame:
    """One row over the first ``most`` distinct labels: how many an entry of ``table`` equals, holds or is held by, and their share."""
    first = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(id_col).alias("i")).orderBy("i").limit(most)
    low = F.lower(label)
    hit = F.exists(F.array(*[F.lit(k) for k in table]), lambda k: (k == low) | F.contains(F.lower(k), low) | F.contains(low, F.lower(k)))
    n = F.count(F.lit(1))
    return first.agg(n.alias("n_labels"), F.count(F.when(hit, 1)).alias("n_mapped")).withColumn("coverage", F.col("n_mapped") / F.greatest(F.col("n_labels"), F.lit(1)))
