"""Streams of ids and of text against the tokenizers library."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrilake.llm import transducer
from sentrilake.llm.transducer import DecodeStream, EncodeStream, Rules, RunWindow, decode_ids, encode_text, rules
from tests.llm import brute

# Besides common parts: special tokens and their beginnings, contractions, and characters newer than this Python.
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "\u00e9", "\u6f22", "1", "!", "\t", "<|endoftext|>", "<|endof", "the ",
         "ing", "aaaa", "\u3000", "\U0001f600", "\u0627", "\u0558", "\U00031abc", "\u1c89"]


@pytest.fixture(scope="module")
def library():
    return brute.library()


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def numbers(data):
    return np.frombuffer(data, "<i4").tolist()


def test_streams_do_not_depend_on_their_parts(library):
    rng, known = random.Random(1), rules()
    for k in range(600):
        text = "".join(rng.choices(PARTS, k=rng.randrange(60)))
        want = ids_of(library, text)
        stream, out, at = EncodeStream(known, long_run=rng.choice([4, 9, 4096]), window=rng.choice([1, 5, 8192])), b"", 0
        while at < len(text):
            size = rng.randrange(1, 9)
            out += stream.push(text[at : at + size])
            at += size
        assert numbers(out + stream.finish()) == want
        if k % 3 == 0:
            known.learn([text])
        assert encode_text(known, text).tolist() == want
        assert decode_ids(known, want) == library.decode(want, skip_special_tokens=False) == text


def test_decoding_replaces_what_is_no_character(library):
    rng, known = random.Random(2), rules()
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(20)]
        stream = DecodeStream(known)
        assert "".join([*(stream.push([x]) for x in ids), stream.finish()]) == library.decode(ids, skip_special_tokens=False)
    assert decode_ids(known, [-1, 64, 10**6]) == "a"


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 20_000 + "x", "\n" * 9999 + " x", "ab" * 10_000, "!?.,-=" * 4000,
                                  "1234567890" * 2000, "\u6f22\u5b57" * 6000])
def test_long_runs(library, text):
    assert encode_text(rules(), text).tolist() == ids_of(library, text)


def test_merges_agree():
    rng, known = random.Random(3), rules()
    units = ["".join(rng.choices("etaoinshrd aaab\u00e9\u6f22.,", k=rng.randrange(1, 30))).encode() for _ in range(1000)]
    one = [known.merge(x) for x in units]
    sizes = np.array([len(x) for x in units])
    ids, counts = known.merge_many(np.frombuffer(b"".join(units), np.uint8), sizes)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == one
    assert not any(map(len, known.merge_many(np.zeros(0, np.uint8), np.zeros(0, np.int64))))
    assert [known._merge_large([known.byte_ids[b] for b in x]) for x in units] == one


def vocabulary(path, merges):
    """A vocabulary file with the given merges."""
    names = [*transducer.byte_alphabet(), *("".join(m) for m in merges)]
    data = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False},
            "model": {"type": "BPE", "vocab": {x: i for i, x in enumerate(dict.fromkeys(names))}, "merges": merges}}
    path.write_text(json.dumps(data))
    return Rules(str(path))


def test_lookahead_is_enough(tmp_path):
    """All texts over a small alphabet: what ends the lookahead before the end never changes. A chain of merges
    attains it."""
    known = vocabulary(tmp_path / "v.json", [["c", "d"], ["b", "c"], ["a", "b"], ["e", "a"]])
    assert known.lookahead == 4
    assert known.merge(b"eab") != known.merge(b"eabc")[: len(known.merge(b"eab"))]
    rng = random.Random(4)
    for _ in range(40):
        merges, tokens = [], list("abc")
        for _ in range(8):
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens:
                merges.append([x, y])
                tokens.append(x + y)
        known = vocabulary(tmp_path / "v.json", merges)
        for _ in range(100):
            text = "".join(rng.choices("abc", k=rng.randrange(1, 40))).encode()
            window = RunWindow(known, 1)
            out = [i for b in text for i in window.push(bytes([b]))]
            assert len(window.data) <= 1 + known.lookahead + max(map(len, known.bytes.values()))
            assert out + window.finish() == known.merge(text)


def test_merge_lists_without_a_bound_are_refused(tmp_path):
    with pytest.raises(ValueError):
        vocabulary(tmp_path / "v.json", [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]])


def test_rows(spark, library):
    texts = [None, "", " \n\t ", "a b", "a b", "x" * 20_000, "\x00 <|endoftext|>"]
    df = spark.createDataFrame([(None if i == 3 else i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    df = df.withColumn("ids", F.lit("extra"))
    found = transducer.decode_documents(transducer.encode_documents(df))
    assert found.columns == ["doc_id", "ids", "text"]
    got = sorted((r.text, r.ids, r.doc_id is None) for r in found.collect())
    assert got == sorted((x or "", ids_of(library, x or ""), i == 3) for i, x in enumerate(texts))
    assert transducer.decode_documents(transducer.encode_documents(df.where("false"))).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [64, None, 65])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in transducer.decode_documents(lists).collect()} == {1: "", 2: "ab"}
