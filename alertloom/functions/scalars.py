"""Scalar expressions: pure functions of columns, all inside whole-stage code generation."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.schema import SENTINELS, clean

# Severity words and their scores.
SEVERITY_SCORES = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "info": 0.1, "normal": 0.0}
# Tactics of attack labels.
TACTICS = {
    "Connection to Malicious URL for malware_download": "INITIAL ACCESS",
    "Event Triggered Execution": "EXECUTION",
    "Persistence - Registry Key Manipulation": "PERSISTENCE",
    "Privilege Escalation - Exploiting Vulnerability": "PRIVILEGE ESCALATION",
    "Defense Evasion - Signature-based Evasion": "DEFENSE EVASION",
    "Credential Access - Password Guessing": "CREDENTIAL ACCESS",
    "Discovery - Network Service Scanning": "DISCOVERY",
    "Lateral Movement - Remote Desktop Protocol (RDP) Exploitation": "LATERAL MOVEMENT",
    "Collection - Data Exfiltration via Email": "COLLECTION",
    "Command and Control - Communication over Tor Network": "COMMAND AND CONTROL",
    "Exfiltration - File Transfer to External Server": "EXFILTRATION",
    "Impact - Denial-of-Service (DoS) Attack": "IMPACT",
    "Fuzzers": "DISCOVERY", "Analysis": "DISCOVERY", "Backdoors": "PERSISTENCE", "DoS": "IMPACT", "Exploits": "EXECUTION",
    "Generic": "INITIAL ACCESS", "Reconnaissance": "RECONNAISSANCE", "Shellcode": "EXECUTION", "Worms": "LATERAL MOVEMENT",
    "Normal": "BENIGN", "neptune": "IMPACT", "smurf": "IMPACT", "portsweep": "RECONNAISSANCE", "ipsweep": "RECONNAISSANCE",
    "land": "IMPACT", "back": "IMPACT", "teardrop": "IMPACT", "satan": "RECONNAISSANCE", "buffer_overflow": "EXECUTION",
    "warezmaster": "EXFILTRATION", "guess_passwd": "CREDENTIAL ACCESS", "pod": "IMPACT", "nmap": "RECONNAISSANCE",
    "multihop": "LATERAL MOVEMENT", "rootkit": "PERSISTENCE", "ftp_write": "EXFILTRATION", "imap": "INITIAL ACCESS",
    "phf": "INITIAL ACCESS", "spy": "COLLECTION", "warezclient": "EXFILTRATION", "normal": "BENIGN",
}
# Label substrings and the tactic that the first hit gives.
LABEL_RULES = (
    (("normal", "benign"), "None"),
    (("recon", "portscan", "scan"), "Discovery"),
    (("mirai", "bot"), "Command and Control"),
    (("dos", "ddos", "flood"), "Impact"),
    (("brute", "crack"), "Credential Access"),
    (("spoof", "mitm"), "Collection"),
    (("web", "sql", "xss"), "Initial Access"),
)
# Tactics that together make a stage, most severe first.
STAGES = (
    ("Potential Hit", ("INITIAL ACCESS", "EXECUTION", "PERSISTENCE", "PRIVILEGE ESCALATION", "DEFENSE EVASION", "CREDENTIAL ACCESS", "DISCOVERY", "LATERAL MOVEMENT", "COLLECTION", "COMMAND AND CONTROL", "IMPACT")),
    ("Potential Hit", ("INITIAL ACCESS", "EXECUTION", "DEFENSE EVASION", "EXFILTRATION", "IMPACT")),
    ("Potential Hit", ("PERSISTENCE", "CREDENTIAL ACCESS", "COLLECTION", "EXFILTRATION")),
    ("Partial", ("PERSISTENCE", "PRIVILEGE ESCALATION", "CREDENTIAL ACCESS", "DISCOVERY")),
    ("Initial", ("INITIAL ACCESS", "EXECUTION")),
    ("Initial", ("INITIAL ACCESS", "EXECUTION", "PERSISTENCE")),
    ("Initial", ("INITIAL ACCESS", "CREDENTIAL ACCESS", "DISCOVERY")),
)
# Groups of keywords whose attacks count as related.
RELATED = (
    ("scan", "portscan", "recon", "reconnaissance"),
    ("exploit", "injection", "sql", "xss", "web"),
    ("brute", "password", "credential"),
    ("dos", "ddos", "flood"),
    ("mirai", "bot", "botnet", "cnc"),
    ("backdoor", "rootkit", "persistence"),
)


def lookup(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[c]


def email_domain(c: Column) -> Column:
    """Of an address its domain (all after the first at-sign); other values as they are."""
    return F.when(c.rlike(r"^\S+@\S+\.\S+"), F.regexp_extract(c, "^[^@]*@(.*)$", 1)).otherwise(c)


def time_bucket(ts: Column, minutes: int = 5) -> Column:
    """Start of the tumbling window of ``minutes`` that holds ``ts``."""
    width = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / width) * width)


def tod_bucket(ts: Column) -> Column:
    """Five-minute bucket of the day, 0 to 287."""
    return F.least(F.floor((F.hour(ts) * 60 + F.minute(ts)) / 5), F.lit(287)).cast("int")


def entity_hash(c: Column, size: int, salt: str = "") -> Column:
    """1 to ``size`` - 1 from the first 15 hexadecimal digits of an MD5; 0 for null, empty and blank."""
    v = F.lower(F.trim(c.cast("string")))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), v)), 1, 15), 16, 10).cast("long")
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit(0)).otherwise(F.pmod(h, F.lit(size - 1)) + 1).cast("long")


def severity_score(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(c.cast("string")), SEVERITY_SCORES), F.lit(0.5))


def byte_ip(c: Column) -> Column:
    return F.concat(F.lit("10.0.0."), F.pmod(c.cast("long"), F.lit(256)).cast("string"))


def subnet24(c: Column) -> Column:
    """First three parts of an address of exactly four; other values as they are."""
    return F.when(F.size(F.split(c, r"\.")) == 4, F.substring_index(c, ".", 3)).otherwise(c)


def day_type(ts: Column) -> Column:
    d = F.weekday(ts)
    return F.when(d <= 4, "WD").when(d == 5, "Sat").otherwise("Sun")


def day_interval(ts: Column, hours: int = 3) -> Column:
    return F.floor(F.hour(ts) / hours).cast("int")


def decimal_day(ts: Column) -> Column:
    """Day of the month with the time of day in hundredths of a day."""
    return F.dayofmonth(ts) + F.round((F.hour(ts) * 60 + F.minute(ts)) / 14.4) / 100.0


def tactic_exact(c: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(lookup(c, TACTICS), F.lit(default))


def tactic_by_rules(c: Column) -> Column:
    low, out = F.lower(c), F
    for words, tactic in LABEL_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, tactic)
    return out.otherwise("Execution")


def attack_stage(tactics: Column) -> Column:
    """Stage of a set of tactics: the first pattern that it contains."""
    out = F
    for name, pattern in STAGES:
        out = out.when(F.size(F.array_except(F.array(*map(F.lit, pattern)), tactics)) == 0, name)
    return out.otherwise("Other")


def related_groups(label: Column) -> Column:
    """Numbers of the groups of related attacks that the label has a keyword of."""
    mask = related_mask(label)
    return F.filter(F.array(*[F.lit(k) for k in range(len(RELATED))]), lambda k: F.getbit(mask, k) == 1)


def related_mask(label: Column) -> Column:
    """A bit for each group of related attacks that the label has a keyword of."""
    low, mask = F.lower(label), F.lit(0)
    for k, words in enumerate(RELATED):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        mask = mask + F.when(hit, F.lit(1 << k)).otherwise(F.lit(0))
    return mask.cast("int")


def alert_severity(size: Column, types: Column) -> Column:
    return F.when((size >= 10) & (types >= 4), "CRITICAL").when((size >= 5) & (types >= 3), "HIGH").when((size >= 3) | (types >= 2), "MEDIUM").otherwise("LOW")


def weighted_score(addresses: Column, users: Column, temporal: Column, scale: Column) -> Column:
    return F.least(F.lit(1.0), (0.6 * addresses + 0.3 * users + 0.1 * temporal) / scale)


def temporal_proximity(a: Column, b: Column) -> Column:
    """1 at the same time, 0 an hour apart or more; 0 where a time is null."""
    gap = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1e6
    return F.coalesce(F.greatest(F.lit(0.0), 1 - gap / 3600.0), F.lit(0.0))


def importance(size: Column, severity: Column, critical: Column, w: tuple[float, float, float] = (0.3, 0.5, 0.2)) -> Column:
    return w[0] * F.log1p(size) + w[1] * severity + w[2] * critical


def threat_score(severity: Column, pagerank: Column, betweenness: Column) -> Column:
    return 0.4 * severity + 0.4 * pagerank + 0.2 * betweenness


def risk_score(x: Column) -> Column:
    """Numerically stable sigmoid, times 100."""
    return F.when(x >= 0, 100.0 / (1.0 + F.exp(-x))).otherwise(100.0 * F.exp(x) / (1.0 + F.exp(x)))


def review_priority(size: Column, severity: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.3), size / 100.0) + severity / 20.0)


def explanation_importance(size: Column, attention: Column, severity: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 * F.log1p(size) / 5.0 + 0.4 * F.coalesce(attention, F.lit(0.5)) + 0.3 * severity / 10.0)


def running_average(avg: Column, n: Column, x: Column) -> Column:
    """New mean after one more value, rounded half to even."""
    return F.bround((x + avg * n) / (n + 1), 2)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def common_values(left: list[str], right: list[str]) -> Column:
    """Values that two rows hold at equal places, distinct, in order of place."""
    return F.array_distinct(F.filter(F.array(*[F.when(clean(a) == clean(b), clean(a)) for a, b in zip(left, right, strict=True)]), lambda x: x.isNotNull()))


def parse_cef(line: Column) -> Column:
    """Header fields and ``key=value`` extensions of a CEF line; null for others."""
    p = F.split(line, r"\|", 8)
    ext = F.str_to_map(F.coalesce(p[7], F.lit("")), F.lit(" "), F.lit("="))
    return F.when(
        line.startswith("CEF:") & (F.size(p) == 8),
        F.struct(p[1].alias("vendor"), p[2].alias("product"), p[4].alias("signature"), p[5].alias("name"), p[6].alias("severity"), ext["src"].alias("src"), ext["dst"].alias("dst"), ext["suser"].alias("suser")),
    )


def without_sentinels(columns: list[str]) -> list[Column]:
    return [clean(c, SENTINELS).alias(c) for c in columns]


# Public research datasets, and words in names of synthetic ones. Case, ``_`` and ``-`` don't count.
PUBLIC_SOURCES = ("unswnb15", "nslkdd", "cicids2017", "toniot", "cicaptiiot", "ynuiotmal")
SYNTHETIC_WORDS = ("synthetic", "generated", "simulated", "fake", "mock")


def source_status(name: Column, approved: tuple[str, ...] = PUBLIC_SOURCES) -> Column:
    """``approved`` if the name holds that of an approved dataset, else ``rejected`` if a word that tells a synthetic one, else ``unknown``."""
    low = F.regexp_replace(F.lower(name), "[_-]", "")
    known = [low.contains(re.sub("[_-]", "", a.lower())) for a in approved]
    marked = [low.contains(w) for w in SYNTHETIC_WORDS]
    none = F.lit(False)
    return F.when(reduce(Column.__or__, known, none), "approved").when(reduce(Column.__or__, marked, none), "rejected").otherwise("unknown")
