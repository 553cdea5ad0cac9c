import random
import re

from alertloom.llm import shingle_join as sj
from alertloom.llm.queries import QUERIES

from .helpers import documents, empty_documents, odd_documents


def brute(pairs):
    """doc_id -> (links, class) for (doc_id, text) in order of doc_id."""
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(pairs)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(pairs[i][0], links[i], pairs[root(i)][0]) for i in range(n)]


def result(df):
    return [(r.doc_id, r.n_links, r.class_id) for r in df.orderBy("doc_id").collect()]


def test_query_against_brute_force(spark, small):
    pdf = documents(small).sort_values("doc_id")
    got = QUERIES["op5_shingle_join"](spark, small)
    assert result(got) == brute(list(zip(pdf.doc_id, pdf.text, strict=True)))


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(sj, "BAND_BLOCK", 24)
    monkeypatch.setattr(sj, "GROUP_BLOCK", 16)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(30, 200))]
        for _ in range(rnd.choice([1, 2, 20])):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 60))):
                t[rnd.randrange(len(t))] = word()
            texts.append("  ".join(t) if rnd.random() < 0.3 else " ".join(t))
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert result(sj.near_texts(docs)) == brute(list(enumerate(texts)))
    kept = {r.doc_id for r in sj.without_near_texts(docs).collect()}
    assert kept == {i for i, _, c in brute(list(enumerate(texts))) if i == c}


def test_pruning_keeps_true_pairs():
    assert sj._NEEDED == sorted(sj._NEEDED) and sj._NEEDED[-1] < 0.75 * sj.HASHES and sj._NEEDED[-1] > 0.5 * sj.HASHES


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = sorted(((r[0], r[1]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sj.near_texts(docs).orderBy("uid").collect()
    want = brute(rows)
    assert [(r.doc_id, r.n_links, r.class_id) for r in got] == want
    assert sj.near_texts(empty_documents(spark)).count() == 0
    assert sj.without_near_texts(empty_documents(spark)).count() == 0
