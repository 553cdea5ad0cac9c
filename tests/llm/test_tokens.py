import zlib

import numpy as np
import pytest

from alertloom.llm import packing, token_store, wordpiece
from alertloom.llm.frames import shared_dir
from alertloom.llm.queries import QUERIES

from .helpers import documents, empty_documents, odd_documents


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordpiece.default_path())


def streams(pdf, tokenizer):
    return {(i, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip(pdf.doc_id, pdf.text, strict=True)}


def crc(ids):
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())


def test_store_query_is_exact(spark, small, tokenizer):
    got = QUERIES["op1_token_store"](spark, small).toPandas().sort_values("doc_id")
    pdf = documents(small).sort_values("doc_id")
    want = list(streams(pdf, tokenizer).values())
    assert got.doc_id.tolist() == pdf.doc_id.tolist()
    assert got.n_tokens.tolist() == [len(x) for x in want]
    assert got.ids_crc32.tolist() == [crc(x) for x in want]
    assert got.start.tolist() == (np.cumsum([len(x) for x in want]) - [len(x) for x in want]).tolist()
    assert got.verified.all()


def test_store_round_trip_and_uniqueness(spark, tokenizer):
    docs, path = odd_documents(spark), shared_dir(spark)
    token_store.write_store(docs, path)
    got = token_store.read_documents(spark, path).toPandas()
    pdf = docs.select("doc_id", docs.columns[1]).toDF("doc_id", "text").toPandas() if False else docs.toPandas().iloc[:, :2]
    pdf.columns = ["doc_id", "text"]
    want = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for t in pdf.text)
    assert sorted(map(tuple, got.ids)) == want
    got = got.sort_values("start")
    assert got.start.tolist() == (np.cumsum(got.ids.map(len)) - got.ids.map(len)).tolist()
    keys = spark.read.parquet(f"{path}/data").where("kind = 'chunk'").select("key")
    assert keys.count() == keys.distinct().count()
    assert token_store.read_checksums(spark, path).where("not verified").count() == 0


def test_store_empty(spark):
    path = shared_dir(spark)
    token_store.write_store(empty_documents(spark), path)
    assert token_store.read_checksums(spark, path).count() == 0


def test_store_notices_damage(spark, small):
    path = shared_dir(spark)
    token_store.write_store(spark.read.parquet(f"{small}/documents.parquet").limit(20), path)
    bad = spark.read.parquet(f"{path}/data").where("kind = 'chunk'").selectExpr("key", "concat(body, x'0000') as body", "n")
    assert token_store._facts(bad).where("good").count() == 0


def test_crc_join():
    a, b = b"some bytes", bytes(range(256)) * 33
    assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cut_points_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 40000, 30_000).astype(np.int32)
    b = np.concatenate([rng.integers(0, 40000, 777).astype(np.int32), a])
    (x,), (y,) = token_store.cut_points(a, np.array([0, len(a)])), token_store.cut_points(b, np.array([0, len(b)]))
    assert len({p + 777 for p in x} & set(y)) > 0.9 * len(x)
    assert max(np.diff([0, *x])) <= token_store.MOST


def check_packing(got, want):
    assert sorted(map(str, got.doc_id.unique())) == sorted({str(i) for i, _ in want})
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
        n = int(s.length.sum())
        assert n == s.sequence_length.iloc[0] and (n == 4096 or n & (n - 1) == 0)


def test_packing_query_is_exact(spark, small, tokenizer):
    got = QUERIES["op4_packing"](spark, small).toPandas()
    want = streams(documents(small), tokenizer)
    check_packing(got, want)
    for (i, _), ids in want.items():
        own = got[got.doc_id == i].sort_values("start")
        assert (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [crc(ids[s : s + n]) for s, n in zip(own.start, own.length, strict=True)]


def test_packing_odd_rows(spark, tokenizer):
    docs = odd_documents(spark)
    got = packing.pack_documents(docs).toPandas()
    pdf = docs.toPandas().iloc[:, :2]
    pdf.columns = ["doc_id", "text"]
    assert got.length.sum() == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in pdf.text)
    assert (got.ids.map(len) == got.length).all()
    assert packing.pack_documents(empty_documents(spark)).count() == 0


def test_pack_balances_cost():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 3000, 500).tolist()
    pieces = packing.pack(n)
    cost = np.zeros(len(packing.capacities(sum(n))))
    for _, _, take, k, _ in pieces:
        cost[k] += packing.LINEAR * take + packing.QUADRATIC * take * take
    full = cost[: sum(n) // 4096]
    assert full.std() / full.mean() < 0.25
    assert len(pieces) < 1.5 * len(n)
