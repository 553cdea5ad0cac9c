import hashlib
import random

import pytest

from alertloom.llm import piece_codec
from alertloom.llm.queries import QUERIES

from .helpers import documents, empty_documents, odd_documents


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_codec.default_path())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query_is_exact(spark, small, library):
    got = {r.doc_id: r for r in QUERIES["op6_piece_codec"](spark, small).collect()}
    for i, t in documents(small)[["doc_id", "text"]].itertuples(index=False):
        ids = library.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_rows(spark, library):
    rnd = random.Random(5)
    more = ["".join(rnd.choice("ab \n▁é漢 th e\t") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    more += [" " * k + "x" * (k % 3) for k in range(60)] + ["a" * 8 * k for k in range(9)]
    more += ["".join(rnd.choice(["the", "in", "ing", "tion", " ", "  ", "a", "on", "1"]) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    docs = odd_documents(spark)
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    for df, texts in ((docs, [r[1] for r in docs.collect()]), (extra, more)):
        got = sorted((tuple(r.ids), r.decoded, r.n_tokens, r.ids_sha256) for r in piece_codec.encode_documents(df).collect())
        want = []
        for t in texts:
            ids = library.encode(t or "")
            want.append((tuple(ids), library.decode(ids), len(ids), sha(",".join(map(str, ids)))))
        assert got == sorted(want)
    assert piece_codec.encode_documents(empty_documents(spark)).count() == 0
