"""Texts made to collide, to be quadratic, or to be longer than anything else."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from alertloom.llm import piece_codec, quality_forest, wordpiece
from alertloom.llm.pii import digests, find, find_personal_data
from alertloom.llm.textops import Block, blocks, exact_groups
from alertloom.llm.toxicity import DRIFT, segments

#: Two strings whose polynomial hashes modulo 2**64 are equal for any odd base.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))
COLLIDING = ["x " + THUE + " " + MORSE, THUE + "\n" + MORSE, MORSE, THUE, "x " + MORSE + " " + THUE, THUE + " " + THUE]


def random_word(letters, n, seed=1):
    return "".join(random.Random(seed).choices(letters, k=n))


LONG = [random_word("0123456789.", 1_000_000), random_word("abcdefghijklmnopqrstuvwxyz", 1_000_000), random_word("ABCDabcdefghij0123456789+/", 1_000_000), "ha" * 500_000]


def test_colliding_strings_are_told_apart():
    data = np.frombuffer((THUE + MORSE + THUE).encode(), dtype=np.uint8)
    b = Block(data, np.array([0, len(data)]), 0)
    starts = np.array([0, 1024, 2048])
    h = b.hashes(starts, starts + 1024)
    assert h[0] == h[1]
    codes, first = exact_groups(data, starts, starts + 1024, h)
    assert codes.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_ids_of_colliding_and_long_words():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    sp, tok = SentencePieceProcessor(model_file=piece_codec.default_path()), Tokenizer.from_file(wordpiece.default_path())
    pieces, words = piece_codec.codec(piece_codec.default_path()), wordpiece.encoder(wordpiece.default_path())
    texts = [*COLLIDING, *LONG]
    began = time.time()
    for b in blocks(pa.array(texts)):
        for (ids, at), encode in ((pieces.encode(b)["ids"], sp.encode), (words.encode(b), lambda t: tok.encode(t, add_special_tokens=False).ids)):
            for i in range(b.rows):
                assert ids[at[i] : at[i + 1]].tolist() == encode(texts[b.first_row + i])
    assert time.time() - began < 120


@pytest.mark.parametrize("letters", ["ab", "aab", "the and rene", "áé漢x", "hathan"])
def test_long_words_merge_as_in_the_library(letters):
    from sentencepiece import SentencePieceProcessor

    sp, model = SentencePieceProcessor(model_file=piece_codec.default_path()), piece_codec.codec(piece_codec.default_path()).model
    for n in (1, 2, 7, 100, 3000):
        for seed in range(10):
            w = random_word(letters.replace(" ", ""), n, seed)
            assert model.merge_long("▁" + w) == sp.encode(w)


def test_counts_of_colliding_lines_and_words():
    for b in blocks(pa.array(COLLIDING)):
        got = quality_forest.block_stats(b)
        assert got[:, quality_forest.STATS.index("n_dup_lines")].tolist() == [0] * len(COLLIDING)
        assert got[:, quality_forest.STATS.index("n_distinct_words")].tolist() == [3, 2, 1, 1, 3, 1]


def test_segments_are_linear_and_as_defined():
    began = time.time()
    for pattern in ([1.0, -2.0], [1.0, -0.5], [2.0, -1.0, -1.5, 0.2]):
        segments(np.array(pattern * 250_000) + DRIFT)
    assert time.time() - began < 30
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.normal(size=rng.integers(1, 30)) * 2
        got = segments(s + DRIFT)
        sums = np.concatenate([[0], np.cumsum(s)])
        for a, z, score in got:
            assert score == pytest.approx(sums[z] - sums[a])
            assert (sums[a + 1 : z + 1] > sums[a]).all() and (sums[a:z] < sums[z]).all()
        inside = {i for a, z, _ in got for i in range(a, z)}
        assert set(np.flatnonzero(s > 0)) <= inside


def test_addresses_of_many_digits(spark):
    rule = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
    rnd = random.Random(2)
    for _ in range(2000):
        x = "".join(rnd.choices("12.0 5a.", k=rnd.choice([5, 20, 60])))
        assert find(x)["ip"] == [m.span() for m in rule.finditer(x) if all(int(g) <= 255 for g in m.groups())]
    texts = ["ip " + "1" * 5000 + ".1.1.1", "0" * 9000 + "7.1.1.1 and 1.1.1.256", "1" * 1_000_000 + ".1", "1." * 500_000, "+1" * 300_000, "1 " * 400_000]
    began = time.time()
    got = digests(find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.n_ip for r in got] == [0, 1, 0, 125_000, 0, 0] and time.time() - began < 60
