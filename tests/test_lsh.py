"""Recall of the hashed candidates against all pairs."""

from alertloom.operators import baselines as ba
from alertloom.plans.catalog import QUERIES
from alertloom.schema import table


def test_lsh_candidates_find_most_pairs(spark):
    d = "/root/testdata/sf0.01"
    want = {tuple(r) for r in ba.cosine_links(table(spark, d, "embeddings"), "embedding", "vec_id", 0.35).collect()}
    got = {tuple(r) for r in QUERIES["j3_lsh_candidates"](spark, d).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
