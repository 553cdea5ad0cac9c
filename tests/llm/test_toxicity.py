import random
import zlib

import numpy as np
import pandas as pd

from alertloom.llm import toxicity
from alertloom.llm.queries import QUERIES

from .helpers import empty_documents, odd_documents


def brute_segments(s):
    """Maximal scoring segments by definition: the best segment, then the same on either side of it."""
    def rest(lo, hi):
        best, where = 0.0, None
        for a in range(lo, hi):
            total = 0.0
            for z in range(a, hi):
                total += s[z]
                if total > best + 1e-12:
                    best, where = total, (a, z + 1)
        if where is None:
            return []
        return [*rest(lo, where[0]), (*where, best), *rest(where[1], hi)]

    return rest(0, len(s))


def test_segments_are_all_maximal_ones():
    rnd = random.Random(8)
    for _ in range(300):
        s = np.array([rnd.gauss(-0.3, 2) for _ in range(rnd.randint(1, 25))])  # no ties
        got = toxicity.segments(s, drift=0.0)
        want = brute_segments(s.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op3_toxicity"](spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"]).doc_id)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    x = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert x[x.toxic == 1].predicted.mean() > 0.85
    assert x[x.toxic == 0].predicted.mean() < 0.01


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(0, None), (None, 1), (2, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    docs = odd_documents(spark)
    for lab in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(docs, lab).toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all() and not got.predicted.any()
    assert toxicity.score_toxicity(empty_documents(spark), labels).count() == 0
