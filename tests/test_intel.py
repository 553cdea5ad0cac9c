"""Threat intelligence files, lookups, and names in texts against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from alertloom.functions.scalars import source_status
from alertloom.operators import behaviour as be
from alertloom.operators import intel as it


def test_intel_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"techniques": [{"id": "T1", "name": "N", "tactics": ["Impact", "x"]}, {"id": "T2", "name": "M"}, {"id": "T1", "name": "A"}]}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"cves": [{"id": "CVE-1", "cvss": {"base_score": 9.8}}, {"id": "CVE-2"}]}))
    (tmp_path / "m.json").write_text(json.dumps({"malware": [{"name": "Bad", "severity": 0.7, "tactics": ["impact"], "apt_groups": ["G"]}, {"name": "Plain"}]}))
    got = {r.entity_id: r for r in it.load_intel(spark, *[f"{tmp_path}/{f}.json" for f in "tcm"]).collect()}
    assert {k: round(r.severity, 9) for k, r in got.items()} == {"technique:T1": 0.5, "technique:T2": 0.5, "cve:CVE-1": 0.98, "cve:CVE-2": 0.0, "malware:Bad": 0.7, "malware:Plain": 0.5}
    assert got["malware:Bad"].groups == ["G"] and got["malware:Plain"].tactics == []
    base = it.load_intel(spark)
    assert base.count() == 15 and it.by_kind(base, "malware").count() == 5 and it.by_id(base, "technique:T1110").first().name == "Brute Force"
    assert it.by_name(base, "rYuK").count() == 1 and it.by_tactic(base, "IMPACT").count() == 2


@pytest.mark.parametrize("block_names", [7, 10_000])
def test_names_in_texts(spark, block_names):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("ab") for _ in range(k))
    names = [word(rng.randint(1, 6)) for _ in range(60)] + ["", None, "é"]
    texts = [word(rng.randint(0, 12)) for _ in range(80)] + [None, "", "caféx" * 1000]
    n, t = spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in texts], "t string")
    got = it.names_in_texts(t, n, block_names, 20).collect()
    want = {(x, y) for x in texts for y in names if x is not None and y and y in x}
    assert len(got) == len(want) and {(r.t, r.n) for r in got} == want
    assert it.names_in_texts(t, n.limit(0), block_names).count() == it.names_in_texts(t.limit(0), n, block_names).count() == 0


def test_sources_and_feedback(spark):
    df = spark.createDataFrame([("CIC-IDS2017",), ("Fake_data",), (None,), ("own",)], "n string")
    assert [r[0] for r in df.select(source_status(F.col("n"))).collect()] == ["approved", "rejected", "unknown", "unknown"]
    assert [r[0] for r in df.select(source_status(F.col("n"), ("o_w",))).collect()] == ["unknown", "rejected", "unknown", "approved"]
    fb = spark.sql("SELECT 'false_positive' AS feedback_type, 0.9D AS confidence, timestamp'2024-01-02' AS timestamp UNION ALL SELECT 'false_positive', 0.9D, timestamp'2024-01-01' UNION ALL SELECT 'confirmed', 1D, timestamp'2024-02-01'")
    assert be.false_positives(fb, 0.8).count() == 2 and be.false_positives(fb, 0.8, "2024-01-02").count() == 1 and be.false_positives(fb, kind="confirmed").count() == 1
