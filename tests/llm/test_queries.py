"""The registered queries over whole tables against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from sentrilake.llm import alignment
from sentrilake.llm.queries import QUERIES
from tests.llm import brute

FOLDER = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(name, *columns):
    table = pq.read_table(f"{FOLDER}/{name}.parquet", columns=list(columns))
    return list(zip(*(table[c].to_pylist() for c in columns)))


def run(spark, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect()]


def test_ngram_jaccard(spark):
    got = run(spark, "op1_ngram_jaccard", "doc_id", "n_shingles", "component_id")
    want = brute.jaccard(rows("documents", "doc_id", "text"))
    assert sorted(got) == sorted(want)
    assert len({c for _, _, c in want}) < len(want)


def test_token_ids(spark):
    got = run(spark, "op2_token_ids", "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(got) == brute.store(rows("documents", "doc_id", "text"))


def test_compression_bands(spark):
    got = run(spark, "op3_compression_bands", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(got) == sorted((d, *brute.quality_base(t)) for d, t in rows("documents", "doc_id", "text"))
    kept = dict(run(spark, "op3_compression_bands", "doc_id", "kept"))
    assert not any(kept[r[0]] for r in got if r[-1])
    good = [d for d, q in rows("labels", "doc_id", "quality") if q == 1]
    passed = {r[0] for r in got if not r[-1]}
    assert all(kept[d] for d in good if d in passed)


def test_link_trust(spark):
    got = run(spark, "op4_link_trust", "page_id", "host", "path", "rule", "verdict")
    assert len(got) == len(rows("pages", "page_id"))
    urls = dict(rows("pages", "page_id", "url"))
    for page, host, path, rule, verdict in got:
        assert (host, path) == brute.url_parts(urls[page])
        want, say = brute.url_rule(host, path)
        assert rule == want and verdict == (say or verdict) and verdict in ("allow", "block")


def test_crf_language(spark):
    got = {r[0]: r[1:] for r in run(spark, "op5_crf_language", "doc_id", "held_out", "lang_pred", "score")}
    docs = rows("documents", "doc_id", "text", "lang")
    assert len(got) == len(docs)
    right = n = 0
    for d, text, lang in docs:
        held, found, score = got[d]
        assert held == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= score <= 1
        if held and text and len(text.split()) >= 5:
            right, n = right + (found == lang), n + 1
    assert right >= 0.95 * n > 0


def test_best_fit_packing(spark):
    got = run(spark, "op6_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for d, piece, start, length, crc, sequence, offset in got:
        pieces[d].append((piece, start, length, crc))
        sequences[sequence].append((offset, length))
    for d, ids in brute.token_rows(rows("documents", "doc_id", "text"), 2):
        found, at = sorted(pieces.pop(d)), 0
        assert [p[0] for p in found] == list(range(len(found)))
        for k, (_, start, length, crc) in enumerate(found):
            assert start == at and crc == brute.crc(ids[at : at + length])
            assert length == 1024 or k == 0
            at += length
        assert at == len(ids)
    assert not pieces
    total = 0
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(sequences) <= total / 1024 * 1.02 + 3


def test_cover_tree(spark):
    got = run(spark, "op7_cover_tree", "vec_id", "n_links", "component_id", "kept")
    assert sorted(got) == brute.vector_links(rows("embeddings", "vec_id", "embedding", "label"))


def test_warc_normaliser(spark):
    got = run(spark, "op8_warc_normaliser", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(got) == sorted(brute.warc_rows(rows("pages", "page_id", "html")))


def test_source_mixing(spark):
    got = run(spark, "op9_source_mixing", "doc_id", "size", "source_size", "target", "taken")
    docs = rows("documents", "doc_id", "text", "source")
    size = {d: len(brute.WORD.findall(t or "")) for d, t, _ in docs}
    source, sizes, taken = {d: s for d, _, s in docs}, defaultdict(int), defaultdict(int)
    for d, s in source.items():
        sizes[s] += size[d]
    target = brute.mix_targets(sizes)
    assert len(got) == len(docs)
    for d, n, source_size, t, k in got:
        assert (n, source_size) == (size[d], sizes[source[d]])
        assert t == pytest.approx(target[source[d]], rel=1e-9)
        assert 0 <= k <= 3 * n
        taken[source[d]] += k
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * 64
    assert sorted(got) == sorted(run(spark, "op9_source_mixing", "doc_id", "size", "source_size", "target", "taken"))


def test_license_templates(spark):
    got = run(spark, "op10_license_templates", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(got, key=repr) == sorted(((d, *brute.license_base(t)) for d, t in rows("documents", "doc_id", "text")), key=repr)
    for labels, base, score in run(spark, "op10_license_templates", "labels", "base_labels", "score"):
        assert set(filter(None, base.split(","))) <= set(labels.split(",")) and 0 <= score <= 1


def test_bpe_transducer(spark):
    got = run(spark, "op13_bpe_transducer", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    library = brute.library()
    want = []
    for d, text in rows("documents", "doc_id", "text"):
        ids = library.encode(text or "", add_special_tokens=False).ids
        texts = ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in texts)))
    assert sorted(got) == sorted(want)


def test_hard_negatives(spark):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = run(spark, "op12_hard_negatives", *columns)
    table = rows("embeddings", "vec_id", "embedding", "label")
    moved = [(d, [math.floor(256 * float(x)) for x in v], (b + 1) % 10 if d % 7 == 0 else b)
             for d, v, b in table if v is not None and b is not None]
    assert sorted(got) == brute.negatives(moved) and got


def test_galloping_alignment(spark):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = rows("documents", "doc_id", "text")
    got, short = run(spark, "op11_galloping_alignment", *columns), [x for x in docs if len(x[1] or "") < 3000]
    # All pairs of tokens are compared, so the sums over the corpus are those of the short texts.
    df = spark.createDataFrame(short, "doc_id long, text string")
    want = brute.alignments(short)
    assert sorted(map(tuple, alignment.align_documents(df).select(*columns).collect())) == sorted(want)
    whole = {x[0]: (*x[1:5], x[7]) for x in got}
    assert len(got) == len(docs) and all(whole[x[0]] == (*x[1:5], x[7]) for x in want)
