import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd

from alertloom.llm.queries import QUERIES
from alertloom.llm.target_sampling import Words, drawn_documents, resample
from alertloom.llm.textops import Block

from .helpers import ODD, documents, empty_documents, odd_documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def runs(w):
    return [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(ids, texts, target):
    s, t = np.zeros(10_000, dtype=int), np.zeros(10_000, dtype=int)
    own = [[zlib.crc32(x) % 10_000 for x in runs(words(x))] for x in texts]
    for f in own:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, [zlib.crc32(y) % 10_000 for y in runs(words(x))], 1)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (s.sum() + 10_000.0) / ((float(a) + 1) * (t.sum() + 10_000.0)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x, f in zip(ids, texts, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    return pd.DataFrame(rows, columns=["doc_id", "n_features", "weight", "score", "n_words"])


def test_query_is_exact(spark, small):
    pdf = documents(small)
    bench = pd.read_parquet(f"{small}/benchmark.parquet")
    want = expected(pdf.doc_id.tolist(), pdf.text.tolist(), bench.text.tolist())
    able = want[want.n_words >= 20].sort_values(["score", "doc_id"], ascending=[False, True])
    want["rank"] = pd.Series(range(1, 5 * len(able) // 100 + 1), index=able.index[: 5 * len(able) // 100])
    got = QUERIES["op12_target_sampling"](spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = want.sort_values("doc_id").reset_index(drop=True)
    for c in ("doc_id", "n_features", "weight", "score", "rank"):
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c


def test_odd_rows_cut_into_chunks(spark):
    texts = [*ODD, "w" * 70 + " short " + "é" * 200 + " x " + "z" * 65, "one two three four " * 3000, "v" * 100_000 + " a"]
    docs = odd_documents(spark, texts)
    rows = [(r[0], r[1]) for r in docs.collect()]
    target = spark.createDataFrame([("one two three",), (None,), ("a b c a b",)], "text string")
    want = expected([r[0] for r in rows], [r[1] for r in rows], ["one two three", "a b c a b"])
    got = resample(docs, target, percent=50, long_bytes=100).toPandas()
    able = want[want.n_words >= 20]
    assert got["rank"].notna().sum() == len(able) * 50 // 100
    assert sorted(got["rank"].dropna()) == list(range(1, len(able) * 50 // 100 + 1))
    key = ["doc_id", "n_features", "weight", "score", "n_words"]
    assert sorted(map(str, got[key].fillna(-1).astype(int).values.tolist())) == sorted(map(str, want[key].fillna(-1).astype(int).values.tolist()))
    assert resample(empty_documents(spark), target).count() == 0
    assert resample(docs, empty_documents(spark)).count() == len(rows)


def test_runs_of_long_words():
    text = b"Aa " + b"q" * 65 + b" b " + b"r" * 200 + b" " + b"s" * 64 + b" c"
    block = Block(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), 0)
    w = Words(block)
    crc = w.longer(w.longer(w.crc[:-2], np.arange(1, len(w.crc) - 1)), np.arange(2, len(w.crc)))
    assert crc.tolist() == [zlib.crc32(x) for x in runs(words(text.decode()))[-4:]]


def test_drawn_documents(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("documents", "benchmark"))
    got = drawn_documents(docs, bench, percent=10)
    assert got.columns == [*docs.columns, "rank"] and got.count() == docs.where("size(regexp_extract_all(text, '[^\\\\x00-\\\\x2F\\\\x3A-@\\\\[-`{-\\\\x7F]+', 0)) >= 20").count() // 10
