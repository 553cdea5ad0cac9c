import re

import numpy as np

from alertloom.llm import quality_forest
from alertloom.llm.queries import QUERIES

from .helpers import documents, empty_documents, odd_documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for p in where.values() if len(p) > 1 for i in p for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_query_statistics_are_exact(spark, small):
    got = QUERIES["op10_quality_rules"](spark, small).toPandas().sort_values("doc_id")
    pdf = documents(small).sort_values("doc_id")
    want = np.array([brute(t) for t in pdf.text])
    assert (got[COLS].to_numpy() == want).all()
    failed = (want[:, 0] < 50) | (100 * want[:, 4] > 50 * want[:, 0])
    assert (got.base_failed.to_numpy() == failed).all()
    assert not (got.kept & got.base_failed).any()


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    import pandas as pd

    got = QUERIES["op10_quality_rules"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.35


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_forest.quality_rules(docs, labels)
    rows, pdf = got.select("doc_id", *COLS).toPandas(), docs.toPandas().iloc[:, :2]
    pdf.columns = ["doc_id", "text"]
    key = lambda x: [str(v) for v in x]
    assert sorted(map(key, rows[COLS].to_numpy().tolist())) == sorted(map(key, [brute(t) for t in pdf.text]))
    assert quality_forest.quality_rules(empty_documents(spark), labels.limit(0)).count() == 0
