"""Alignment of tokens against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrilake.llm import alignment
from tests.llm import brute

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_gallop():
    rng = random.Random(1)
    for _ in range(300):
        longer = sorted(rng.sample(range(1, 400), rng.randrange(1, 120)))  # its last end is the largest of both
        shorter = sorted(rng.sample(range(1, longer[-1] + 1), rng.randrange(1, min(40, longer[-1] + 1))))
        assert alignment.gallop(shorter, longer) == [sum(x < end for x in longer) for end in shorter]
    assert alignment.gallop([], [3]) == []


def test_align_whichever_list_is_shorter():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randrange(1, 40)
        a, b = (sorted({*rng.sample(range(1, size + 1), rng.randrange(1, size + 1)), size}) for _ in range(2))
        at_a, at_b, a_last, b_last = alignment.align(np.array(a), np.array(b))
        ranges = [list(zip([0, *x], x)) for x in (a, b)]
        want = {(i, j) for i, (p, q) in enumerate(ranges[0]) for j, (r, s) in enumerate(ranges[1]) if max(p, r) < min(q, s)}
        assert len(at_a) == len(want) and set(zip(at_a.tolist(), at_b.tolist())) == want
        assert [a[i] for i in a_last] == [b[i] for i in b_last] == sorted({*a} & {*b})


@pytest.mark.parametrize("text", ["a", " a", "  a  b ", "a\tb\n\nc", "\u00e9 \uff41\u6f22\u5b57", "\x00", "<s> <|endoftext|> </s>", "<0x41>",
                                  "word " * 40, "don't re-entrant 12345 \U0001f600", "a" * 300])
def test_pieces_are_the_library(text):
    both = alignment.tokenizers()
    for _ in range(2):
        assert np.frombuffer(both.pieces([text])[0], "<i4").tolist() == brute.pieces().encode(text)
    assert alignment.text_groups(text).count(";") + 1 == brute.alignments([(1, text)])[0][3]


def test_rows(spark):
    texts = [None, "", " \n\t ", "a b", "a b", "has \u2581 inside", "  two  spaces ", "<|endoftext|> as text", "the the the then",
             " ".join(f"word{i % 97}x{i % 13}" for i in range(300))]
    docs = [(None if i == 3 else i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("block", "kind", "links", "pair", "number", "counted"):
        df = df.withColumn(name, F.lit("extra"))
    got = alignment.align_documents(df.repartition(3))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.alignments(docs), key=repr)
    assert {r.n_links for r in got.where("doc_id IN (0, 1, 5)").collect()} == {0}
    assert alignment.align_documents(df.where("false")).count() == 0


def test_counts_are_of_the_whole_corpus(spark, monkeypatch):
    """Blocks of one text each: a pair's count spans them."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    docs = [(i, f"the cat {'sat on ' * (i % 3)}the mat {i}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, alignment.align_documents(df).collect())) == sorted(brute.alignments(docs))


def test_numbers_stand_for_the_pairs_of_a_block():
    """Two bytes a link, or four where the list is longer than two can number."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 -_/", k=4000)) for _ in range(150)]
    rows, pairs = alignment._align_block(alignment.tokenizers(), texts, str)
    n = len(pairs) // 16
    width = 4 if n > 65536 else 2
    assert n > 5000 and all(len(row[-1]) == width * row[3] for row in rows)
    listed, times = np.frombuffer(pairs, "<i8").reshape(2, -1)
    numbers = np.frombuffer(b"".join(row[-1] for row in rows), f"<u{width}")
    assert np.bincount(numbers, minlength=n).tolist() == times.tolist() and sorted(set(listed)) == listed.tolist()
