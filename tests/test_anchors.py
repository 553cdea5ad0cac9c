"""Scores of anchors against all pairs."""

import random

import pytest

from alertloom.operators.anchors import anchor_scores, best_chains

A, U = ("a1", "a2", "a3"), ("u1", "u2")


def by_pairs(rows, both):
    out, chains = {}, {}
    values = lambda r, lo, hi: {x for x in r[lo:hi] if x not in (None, "NIL")}
    for r in rows:
        score = k = 0
        chain = [r[0]]
        for q in sorted(rows):
            if q[1] != r[1] or r[1] is None or q[0] <= r[0]:
                continue
            a, u = values(r, 2, 5) & values(q, 2, 5), values(r, 5, 7) & values(q, 5, 7)
            if (a and u) if both else (a or u):
                k += 1
                score += (len(a) + len(u)) / 2 if k == 1 else len(a) + len(u) + 0.8 * k
                chain.append(q[0])
        if score > 0.3:
            out[r[0]] = (round(score, 6), k)
            old = chains.get(r[1])
            if old is None or score > old[0] + 1e-9:
                chains[r[1]] = (score, chain)
    return out, {(c, i) for c, (_, chain) in chains.items() for i in chain}


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("block_rows", [150, 10**6])
def test_anchors_against_pairs(spark, both, block_rows):
    rng = random.Random(3)
    pick = lambda p: rng.choice(["hot"] * 3 + ["NIL", None] + [f"{p}{i}" for i in range(9)])
    rows = [(i, rng.choice([1, 1, 1, 2, None]), pick("x"), pick("x"), pick("y"), pick("x"), pick("z")) for i in range(130)]
    df = spark.createDataFrame(rows, "alert_idx long, pred_cluster int, a1 string, a2 string, a3 string, u1 string, u2 string")
    want, members = by_pairs(rows, both)
    got = {r.anchor: (round(r.score, 6), r.matches) for r in anchor_scores(df, A, U, both, block_rows=block_rows).collect()}
    assert got == want
    assert {(r.pred_cluster, r.id) for r in best_chains(df, A, U, both, block_rows=block_rows).collect()} == members
    assert anchor_scores(df.limit(0), A, U, both).count() == 0


def test_best_chains_read_their_input_once(spark):
    df = spark.createDataFrame([(1, 1, "a", "u"), (2, 1, "a", "u"), (3, 1, "b", "u"), (4, 2, "a", "u")], "alert_idx long, pred_cluster int, a1 string, u1 string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    got = best_chains(df.mapInPandas(counted, df.schema), ["a1"], ["u1"], True).collect()
    assert {(r.pred_cluster, r.anchor, r.id) for r in got} == {(1, 1, 1), (1, 1, 2)}
    assert seen.value == 4  # several scans before
