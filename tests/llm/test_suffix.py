import hashlib
import random

import numpy as np
import pytest

from alertloom.llm import suffix_dedup as sd
from alertloom.llm.queries import QUERIES

from .helpers import documents, empty_documents, odd_documents


def brute(texts, rests=None):
    """(n_bytes, n_removed, n_spans, sha) of texts in order of their ids; ``rests`` gets what is left of each."""
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            else:
                seen.add(w)
        if rests is not None:
            rests.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def test_query_is_exact(spark, small):
    pdf = documents(small).sort_values("doc_id")
    assert result(QUERIES["op7_suffix_dedup"](spark, small)) == brute(pdf.text)


@pytest.mark.parametrize("seed", range(2))
def test_shared_passages(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé \n") for _ in range(rnd.randint(1, 6)))
    passages = ["".join(word() for _ in range(rnd.randint(20, 60))) for _ in range(6)]
    texts = ["".join(rnd.choice([rnd.choice(passages), word() * rnd.randint(1, 60), word(), passages[0][5:140]]) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    texts[7] = texts[3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rests = []
    assert result(sd.remove_repeats(docs)) == brute(texts, rests)
    assert {r.doc_id: r.text for r in sd.without_repeats(docs).collect()} == dict(enumerate(rests))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r[0], r[1]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sd.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute([t for _, t in rows]))
    assert sd.remove_repeats(empty_documents(spark)).count() == 0
    assert sd.without_repeats(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("alphabet", [2, 4, 250])
def test_suffix_order_is_sorted(alphabet):
    rng = np.random.default_rng(alphabet)
    data = rng.integers(0, alphabet, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    data[2000:2300] = 1
    need = rng.random(3000) < 0.5
    need[2890:] = False
    order = sd.suffix_order(data, need)
    raw = data.tobytes()
    assert sorted(order.tolist()) == np.flatnonzero(need).tolist()
    cut = [raw[i : i + 100] for i in order.tolist()]
    assert cut == sorted(cut)
    seen, want = set(), np.zeros(3000, dtype=bool)
    for i in np.flatnonzero(need).tolist():
        want[i] = raw[i : i + 100] in seen
        seen.add(raw[i : i + 100])
    assert (sd.later_windows(data, need) == want).all()


def test_hot_anchors_are_split(spark, monkeypatch):
    """One phrase in ever new surroundings, some of which come again."""
    monkeypatch.setattr(sd, "HOT", 8)
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    phrase = "the same forty bytes and some more of it "
    sides = [word(60) for _ in range(12)]
    texts = [rnd.choice([word(60), rnd.choice(sides)]) + phrase + rnd.choice([word(60), rnd.choice(sides)]) for _ in range(150)]
    texts += [(phrase + word(70)) * 2 + phrase for _ in range(20)] + [phrase * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert result(sd.remove_repeats(docs)) == brute(texts)
    contexts = sd._written_contexts(docs.selectExpr("doc_id as uid", "text")).where("body is not null")
    most = lambda df: df.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert most(sd._dealt(contexts)) < most(contexts) / 2
