import hashlib
import random
import re

import pytest

from alertloom.llm.exact_dedup import Trie, exact_copies
from alertloom.llm.queries import QUERIES

from .helpers import ODD, documents, empty_documents, odd_documents


def expected(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row, sorted."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, done = min(known) if known else None, False
        for i in ids:
            first = i == keep and not done
            done |= first
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_query_is_exact(spark, small):
    pdf = documents(small)
    assert got(QUERIES["op11_exact_dedup"](spark, small)) == expected(zip(pdf.doc_id.tolist(), pdf.text.tolist(), strict=True))


def test_odd_rows(spark):
    docs = odd_documents(spark, [*ODD, "x y", "a  b", "a\tb ", "long " * 400_000])
    rows = [(r[0], r[1]) for r in docs.collect()]
    assert got(exact_copies(docs)) == expected(rows)
    assert exact_copies(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("hash_bytes", [0, 1, 16])
def test_spilled_subtrees_and_salted_texts(spark, hash_bytes):
    """Tries of 2 KB, hashes that collide, and texts that are hot from 5 rows on."""
    rnd = random.Random(3)
    stems = ["", "a" * 300, "a" * 299 + "b", "xy" * 150]
    texts = [rnd.choice(stems) + "".join(rnd.choices("ab ", k=rnd.choice([0, 3, 40]))) for _ in range(300)] + ["hot text " * 30] * 150 + [None] * 9
    rows = [(rnd.choice([k, None, 7]), t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(exact_copies(docs, trie_bytes=2048, hash_bytes=hash_bytes, hot_rows=5)) == expected(rows)


def test_trie_against_a_dictionary():
    rnd = random.Random(1)
    for size in (10, 200, 3000):
        t, want, held = Trie(), {}, {}
        for i in range(400):
            x = bytes(rnd.choices(b"ab", k=rnd.choice([0, 1, 5, 30])))
            if t.away(x):
                held.setdefault(x, []).append(i)
            else:
                t.add(x, i, 1)
            want.setdefault(x, []).append(i)
            while t.bytes > size and (out := t.spill()):
                for p, y, least, n in out:
                    assert y.startswith(p)
                    held.setdefault(y, []).extend([least] * n)
        for y, least, n in t.terminals():
            assert want[y][0] == least and len(want[y]) == n and y not in held
            want.pop(y)
        assert {y: len(x) for y, x in want.items()} == {y: len(x) for y, x in held.items()}
        assert all(min(held[y]) == min(x) for y, x in want.items())
