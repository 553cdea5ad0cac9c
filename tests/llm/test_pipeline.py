import pandas as pd

import corpus_pipeline
from alertloom.llm import secret_net, shingle_join, suffix_dedup, toxicity
from alertloom.plans.stage import written
from tests.llm.test_join import brute as near
from tests.llm.test_spans import brute_secrets
from tests.llm.test_suffix import brute as repeats
from tests.llm.test_tokens import crc

from .helpers import documents, empty_documents, odd_documents


def test_stages_against_brute_force(spark, tmp_path, small):
    sf = "/root/testdata/sf0.01"
    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), f"file://{tmp_path}"
    steps = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        steps.append(docs.toPandas().sort_values("doc_id"))
    first = documents(sf)
    scored = toxicity.score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    assert set(steps[0].doc_id) == set(scored[scored.predicted == 0].doc_id)
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    clean = labels[labels.toxic == 0].doc_id
    assert clean.isin(steps[0].doc_id).mean() > 0.99
    want = near(list(zip(steps[0].doc_id, steps[0].text, strict=True)))
    assert set(steps[1].doc_id) == {i for i, _, c in want if i == c}
    rests = []
    repeats(steps[1].text, rests)
    assert steps[2].text.tolist() == rests and steps[2].n_chars.tolist() == list(map(len, rests))
    for t, kept in zip(rests, steps[3].text, strict=True):
        assert not brute_secrets(kept)
        if not brute_secrets(t) and "[secret]" not in kept:
            assert t == kept
    assert all(list(s.columns) == list(first.columns) for s in steps[:4])
    from tokenizers import Tokenizer

    from alertloom.llm.wordpiece import default_path

    tok = Tokenizer.from_file(default_path())
    by = dict(zip(steps[3].doc_id, steps[3].text, strict=True))
    for i, own in steps[4].groupby("doc_id"):
        ids = [*tok.encode(by[i], add_special_tokens=False).ids, 2]
        own = own.sort_values("start")
        assert own.length.sum() == len(ids) and own.ids_crc32.tolist() == [crc(ids[s : s + n]) for s, n in zip(own.start, own.length, strict=True)]
    assert set(steps[4].doc_id) == set(by)


def test_run_gives_what_the_stages_give(spark, small):
    got = corpus_pipeline.run(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, small), "stage")
    want = docs.toPandas()
    names = list(want.columns)
    assert got[names].sort_values(names).values.tolist() == want.sort_values(names).values.tolist()


def clashing(spark):
    """Odd texts and names that differ in case or are those that operators use inside."""
    names = "doc_id long, text string, TEXT string, kind string, n long, uid long, ranges long, lo long, digest long, node long, n_chars long"
    rows = [(*r, 7, 8, 9, 10, 11, 12) for r in odd_documents(spark).collect()]
    long = "one word of many, " * 300_000  # over 5 MB
    rows += [(900, long, "x", "y", None, 7, 8, 9, 10, 11, 12), (901, "token: abcdefghij0123456789 " + "zebra " * 60, "x", "y", None, 7, 8, 9, 10, 11, 12)]
    return spark.createDataFrame(rows, names).repartition(3), rows


def test_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs, rows = clashing(spark)
    rest = lambda r: tuple(r[2:10])
    key = lambda r: tuple(map(repr, r))
    same = toxicity.without_toxic(docs, labels).collect()
    assert sorted(map(key, same)) == sorted(map(key, rows))
    masked = secret_net.without_secrets(docs)
    assert masked.columns == docs.columns
    by = {r[0]: r for r in masked.collect()}
    assert by[901][1].startswith("[secret] zebra") and by[901][10] == len(by[901][1]) and by[900][1] == rows[-2][1] and by[0][1] is None
    assert sorted(repr(rest(r)) for r in by.values() if r[0] in (900, 901)) == [repr(rest(rows[-1]))] * 2
    once = shingle_join.without_near_texts(docs)
    kept = once.collect()
    assert once.columns == docs.columns and len(kept) < len(rows) and {r[0] for r in kept} >= {900, 901}
    assert all(rest(r) == ("x", "y", None, 7, 8, 9, 10, 11) for r in kept)
    cut = suffix_dedup.without_repeats(docs)
    got = cut.collect()
    assert cut.columns == docs.columns and len(got) == len(rows) and all(rest(r) == ("x", "y", None, 7, 8, 9, 10, 11) for r in got)
    texts = {r[0]: r[1] for r in got}
    assert len(texts[900]) < 200 and texts[900] == rows[-2][1][: len(texts[900])] and texts[0] is None
    empty = empty_documents(spark)
    for f in (secret_net.without_secrets, shingle_join.without_near_texts, suffix_dedup.without_repeats, lambda d: toxicity.without_toxic(d, labels)):
        assert f(empty).count() == 0 and f(empty).columns == empty.columns


def test_packing_takes_odd_rows(spark):
    docs, rows = clashing(spark)
    got = corpus_pipeline.pack(spark, docs, "").select("doc_id", "start", "length", "doc_tokens").toPandas()
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum() and len(got[got.start == 0]) == len(rows)


def test_mask_joins_overlaps():
    assert secret_net.mask("abcdefgh", [(1, 3), (2, 5), (6, 7)]) == "a[secret]f[secret]h"
    assert secret_net.mask("ab", [(0, 2)]) == "[secret]" and secret_net.mask("ab", []) == "ab"
