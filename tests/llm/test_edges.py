"""Nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrilake.llm import covertree, jaccard, language, linkgraph, mixing, packing, quality, templates, token_store, warc
from sentrilake.llm.elias_fano import EliasFano, encode
from sentrilake.llm.tokens import default_tokenizer, encoder

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
DOCS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "a b", "en", "b"), (4, "a b", "en", "b"),
    (None, "x y z", "fr", None), (5, LONG, "en", "b"), (6, LONG + " end", "fr", "c"), (7, "12 34 !!", "fr", "c"),
]
CLASH = ["least", "kept_id", "doc", "n_words", "size", "node", "row", "length", "keys", "begin", "score", "place"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    for name in CLASH:
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_jaccard(docs, empty):
    got = rows(jaccard.join_documents(docs), "doc_id", "n_shingles", "component_id")
    sizes = {d: n for d, n, _ in got}
    assert len(got) == len(DOCS) and sizes[1] == sizes[2] == sizes[3] == 0 and sizes[4] == 1
    assert {d: c for d, _, c in got} == {1: 1, 2: 2, 3: 3, 4: 4, None: None, 5: 5, 6: 5, 7: 7}
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert [r[0] for r in rows(kept, "doc_id")] == [1, 2, 3, 4, 5, 7, None]
    assert jaccard.join_documents(empty).count() == 0


def test_subsets_find_the_same_links(spark):
    """Small sets meet by subsets, large ones by lists: the result does not depend on the boundary."""
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in rng.integers(14, 70, 40)]
    texts = []
    for words in base:
        for _ in range(4):
            other = list(words)
            other[0] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(other + [f"t{k}" for k in range(int(rng.integers(3)))]))
    from tests.llm import brute

    want = brute.jaccard(list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(jaccard.join_documents(df, boundary=40), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert len({c for _, _, c in want}) < len(want)


def test_token_store(docs, empty):
    manifest = token_store.write_store(docs)
    got = rows(token_store.read_store(manifest), "doc_id", "start", "n_tokens")
    assert len(got) == len(DOCS) and {n for d, _, n in got if d in (1, 2)} == {1}
    assert sorted(s for _, s, _ in got)[0] == 0
    assert token_store.read_store(token_store.write_store(empty)).count() == 0
    first = manifest.orderBy("shard").first()
    index = token_store.ShardIndex(first.index_path)
    ids = [token_store.read_document(first.ids_path, index, i) for i in range(len(index))]
    assert all(x[-1] == 0 for x in ids) and sum(map(len, ids)) == first.n_tokens


@pytest.mark.parametrize("values", [[], [5], [0, 0, 0], [-4, -4, 7, 2**40], list(range(0, 9000, 3)), [1] * 700 + [10**9]])
def test_elias_fano(values):
    data = encode(np.array(values, np.int64))
    found = EliasFano(data)
    assert found.slice(0, len(values)).tolist() == values
    assert [found.select(i) for i in range(0, len(values), 97)] == values[::97]
    if len(values) == 3000:
        assert len(data) < 3000 * 8 / 8


def test_encoder_is_the_library():
    encode_texts = encoder(default_tokenizer())
    texts = ["", " ", "  a", "a  b", "a \n b\t c", "it's 's", "q\x1cz \x85 q 　x", "<|endoftext|> a", LONG[:5000]]
    want = encode_texts.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert encode_texts(texts) == [np.array(x.ids, "<u2").tobytes() for x in want]


def test_encoder_with_end_ids_and_small_caches(monkeypatch):
    import random

    import pyarrow as pa

    from sentrilake.llm import tokens

    monkeypatch.setattr(tokens, "_CACHED_UNITS", 20)
    found, rng = tokens.Encoder(default_tokenizer()), random.Random(3)
    parts = [*"ab \n\t9'.,!s\u00e9\u00d7\u00aa\u3000\u5b57<|>_-&\x85\u0130", "'s", "'ll", "<|endoftext|>", "foo", "bar ", " x", " the,", " the.\nFoo", "w" * 50]
    for _ in range(20):
        texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(50)]
        want = [x.ids for x in found.tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids, ends = found.encode(pa.array(["left out", *texts])[1:], b"\2\0")
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*x, 2] for x in want]
        assert found(texts) == [np.array(x, "<u2").tobytes() for x in want]
    assert found([]) == [] and found.encode(pa.array([""]))[0].tolist() == []


def test_encoder_encodes_a_word_once_whatever_follows(monkeypatch):
    from sentrilake.llm import tokens

    found, seen = tokens.Encoder(default_tokenizer()), []
    plain = found._encode_units
    monkeypatch.setattr(found, "_encode_units", lambda units: [seen.append(u) for u in units] and None or plain(units))
    found(["a word, word. word;\nthen word! word", "a word? other:", "a other's, other"])
    assert sorted(seen) == ["other", "word"]


def test_quality(docs, empty):
    got = quality.judge_quality(docs)
    assert got.count() == len(DOCS) and quality.judge_quality(empty).count() == 0
    assert {r[0] for r in rows(got.where("doc_id < 5"), "kept")} == {False}
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_bands_reject_both_ends():
    rng = np.random.default_rng(1)
    noise = " ".join(rng.bytes(12).hex() for _ in range(400)).encode()
    digits = bytes(rng.integers(33, 127, 4000, dtype=np.uint8)).replace(b"\n", b"x")
    random_text = b" ".join(digits[i : i + 8] for i in range(0, 4000, 8))
    lines = b"\n".join(b"item %d of the same list again and again" % (i % 7) for i in range(300))
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(400)).encode()
    import pyarrow as pa

    verdict = [x[6] for x in quality._judge(pa.array([noise, random_text, lines, prose], pa.binary()), quality.Bands())]
    assert verdict[1] is False and verdict[2] is False and verdict[3] is True


def _prose(rng, n):
    words = [w for w in " ".join("".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(800)).split()]
    return b" ".join(words[i].encode() for i in rng.integers(0, len(words), n))[:n]


def test_bands_reject_encoded_parts():
    """Base64 in the middle, in the tail after the last full chunk, and in texts shorter than a chunk."""
    import base64

    import pyarrow as pa

    rng = np.random.default_rng(4)

    def encoded(n):
        return b" ".join(base64.b64encode(rng.bytes(57)) for _ in range(n // 77 + 1))[:n]

    def kept(*parts):
        return quality._judge(pa.array([b" ".join(parts)], pa.binary()), quality.Bands())[0][6:]

    assert all(kept(_prose(rng, n))[0] for n in (600, 1000, 1500, 2047, 2048, 2049, 4000, 60_000))
    assert kept(_prose(rng, 60_000), encoded(40_000))[0] is False
    assert kept(_prose(rng, 2100), encoded(1900))[0] is False
    assert kept(_prose(rng, 500), encoded(1400))[0] is False
    # A small encoded part of a long text is within the share of odd chunks.
    assert kept(_prose(rng, 60_000), encoded(2000))[0] is True
    # Hex digits have the ratio of prose, alone and mixed: no chunk is odd for them.
    digits = b" ".join(rng.bytes(16).hex().encode() for _ in range(200))
    assert kept(digits)[2] == kept(_prose(rng, 3000), digits)[2] == 0.0


def test_url_filter(spark):
    link = '<a href="http://{}/x">x</a>'
    pages = spark.createDataFrame(
        [(1, "http://bad.net/a", None), (2, "http://spam.test/a", link.format("bad.net")), (3, None, None), (4, "no url", ""),
         (5, "http://Good.org/fr/x?q#f", link.format("friend.test")), (6, "http://friend.test", "<p>"), (6, "http://friend.test", "<p>"),
         (7, "http://other.test/", link.format("other.test"))],
        "page_id long, url string, html string",
    ).withColumn("host", F.lit("extra")).withColumn("rule", F.lit("extra"))
    got = linkgraph.judge_urls(pages)
    verdict = {r.page_id: r for r in got.collect()}
    assert got.count() == 8 and linkgraph.judge_urls(pages.where("false")).count() == 0
    assert verdict[1].verdict == verdict[2].verdict == "block" and verdict[2].rule is None
    assert all(verdict[i].verdict == "allow" for i in (3, 4, 5, 6, 7)) and verdict[6].trust > 0
    assert (verdict[3].host, verdict[3].path, verdict[5].host, verdict[5].path) == ("", "", "good.org", "/fr/x")


def test_page_rank_against_matrix(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 8, (24, 2)) if a != b})
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", 1) for a, b in pairs], "source string, target string, n long")
    seeds = spark.createDataFrame([("h0", "trust"), ("h1", "distrust")], "host string, kind string")
    got = {(r.kind, r.host): r.score for r in linkgraph.propagate(edges, seeds, tolerance=0.0, rounds=25).collect()}
    for kind, seed in (("trust", 0), ("distrust", 1)):
        m = np.zeros((8, 8))
        for a, b in pairs:
            m[(a, b) if kind == "trust" else (b, a)] = 1
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1)
        base = np.zeros(8)
        base[seed] = 0.15
        score = base
        for _ in range(25):
            score = base + 0.85 * score @ m
        for h in range(8):
            assert got.get((kind, f"h{h}"), 0.0) == pytest.approx(score[h], abs=1e-4)


def test_link_farm(spark):
    """Every host of a farm is blocked, however many they are, and links among themselves do not help them."""
    link = '<a href="http://{}/x">x</a>'
    pages = [(0, "http://bad.net/a", None), (1, "http://good.org/fr/a", link.format("friend.test") + link.format("friend2.test"))]
    pages += [(100 + i, f"http://farm{i}.test/", link.format("bad.net")) for i in range(300)]
    pages += [(1000 + i, f"http://ring{i}.test/", link.format("bad.net") + link.format(f"ring{(i + 1) % 50}.test")) for i in range(50)]
    # One link of twenty to a blocked host that many link to: no suspect.
    pages += [(2000, "http://portal.test/", "".join(link.format(f"site{i}.test") for i in range(19)) + link.format("bad.net"))]
    pages += [(3000, "http://friend.test/", None), (3001, "http://site1.test/", link.format("site2.test"))]
    got = linkgraph.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    blocked = {r.page_id for r in got if r.verdict == "block"}
    assert blocked == {p[0] for p in pages if p[0] == 0 or 100 <= p[0] < 2000}


def test_seeds_without_pages_and_with_ports(spark):
    """Hosts that are only linked are seeds by the rules, and a port does not part a host from its links."""
    link = '<a href="http://{}">x</a>'
    pages = spark.createDataFrame(
        [(1, "http://a.test/", link.format("bad.net/q")), (2, "http://b.test/", link.format("BAD.net")),
         (3, "http://c.test/", link.format("u@bad.net:8080/q?x")), (4, "http://worse.net:81/a", None),
         (5, "http://d.test/", link.format("worse.net:81/a")), (6, "http://e.test/", link.format("www.example.com/de/a")),
         (7, "http://f.test/", link.format("w2.example.com/de/a") + link.format("w2.example.com/x") + link.format("w2.example.com/y")),
         (8, "http://g.test:99/", link.format("bad.net/q")), (9, "http://h.test/", link.format("g.test:99/"))],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r for r in linkgraph.judge_urls(pages).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6, 8, 9}
    assert (got[4].host, got[4].rule, got[8].host) == ("worse.net:81", None, "g.test:99")


def test_propagation_reaches_its_tolerance(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, n long")
    seeds = spark.createDataFrame([("a", "trust")], "host string, kind string")
    got = {r.host: r.score for r in linkgraph.propagate(edges, seeds).collect()}
    assert got["a"] == pytest.approx(0.15 / (1 - 0.85**2), rel=1e-5) and got["b"] == pytest.approx(0.85 * got["a"], rel=1e-5)
    with pytest.raises(RuntimeError, match="3 rounds"):
        linkgraph.propagate(edges, seeds, rounds=3)


def test_language(docs, empty):
    texts = ["the house and the garden of the king"] * 8 + ["das haus und der garten von dem und"] * 8
    model = language.fit(texts, ["en"] * 8 + ["de"] * 8)
    got = {r[0]: r[1:] for r in language.predict_language(docs, model).collect()}
    assert len(got) == len({d[0] for d in DOCS}) and language.predict_language(empty, model).count() == 0
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 7)) and got[5][0] in ("en", "de")
    words = language.label_words(model, "the king of the garden und das haus von dem")
    assert [w[1] for w in words] == ["en"] * 5 + ["de"] * 5
    assert language.predict_language(docs, language.train(empty)).where("lang_pred != 'und'").count() == 0
    kept = language.keep_language(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (1, 2, 3, 7)").count() == 0


def test_every_letter_is_read():
    """Runs without spaces are several units, cut at script changes; languages may change within them."""
    thai, han, kana = ("".join(chr(at + i * 7 % 40) for i in range(4000)) for at in (0x0E01, 0x4E00, 0x3042))
    for word in (thai, han + kana, "x" * 1000, han + "word" + thai, "a1b2-c"):
        assert "".join(language.units(word)) == "".join(c for c in word if c.isalpha())
    assert language.units("Donaudampfschiffahrtsgesell") == ["donaudampfsch", "iffahrtsgesell"]
    assert language.units("\u4e2d\u6587word") == ["\u4e2d\u6587", "word"] and language.units("12") == []
    rng = np.random.default_rng(6)

    def run(at, n):
        return "".join(chr(at + x) for x in rng.integers(0, 60, n))

    a, b = 0x4E00, 0x5E00
    model = language.fit([run(a, 900) for _ in range(8)] + [run(b, 900) for _ in range(8)], ["a"] * 8 + ["b"] * 8)
    got = [w[1] for w in language.label_words(model, run(a, 400) + run(b, 1200))]
    assert len(got) == 400 and got[:98] == ["a"] * 98 and got[102:] == ["b"] * 298
    assert language.Labeller(model).documents([run(a, 400) + run(b, 1200), run(a, 90) + " 1"])[0][0] == "b"


def test_more_than_64_languages():
    names = [f"l{i:02}" for i in range(70)]
    texts = [" ".join([f"{chr(97 + i // 26)}{chr(97 + i % 26)}" * 3] * 6) for i in range(70)]
    model = language.fit(texts * 2, names * 2, epochs=4)
    assert sorted(set(model.lexicon[1].tolist())) == list(range(70))
    found = language.word_features([texts[i].split()[0] for i in range(70)], model.lexicon, 70)[:, -1]
    assert found.tolist() == [(1 << 16) + i for i in range(70)] and found.max() < len(model.weights) - 1
    assert [x[0] for x in language.Labeller(model).documents(texts)] == names


def test_packing(docs, empty):
    got = packing.pack_documents(docs)
    assert got.where("doc_id = 4").count() == 2 and got.where("doc_id = 1").first().length == 1
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bound_and_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 1025, 60))[::-1]
    bins = packing.best_fit_decreasing(lengths)
    assert np.bincount(bins, lengths).max() <= 1024
    assert -(-lengths.sum() // 1024) <= packing.lower_bound(lengths) <= bins.max() + 1
    assert packing.lower_bound(np.full(10, 600)) == 10


def test_cover_tree(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 8))
    vectors = [(i, (centers[i % 30] + rng.normal(size=8) * 0.2).tolist(), i % 2) for i in range(300)]
    vectors += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0] * 8, None), (304, [None] * 8, 0),
                (305, vectors[0][1], 0), (306, [1.0], 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    from tests.llm import brute

    want = sorted(brute.vector_links(vectors), key=repr)
    for cell_rows in (4096, 40):
        assert rows(covertree.link_vectors(df, cell_rows=cell_rows), "vec_id", "n_links", "component_id", "kept") == want
    assert covertree.link_vectors(df.where("false")).count() == 0


def test_warc(spark):
    big = "é" * 300_000
    pages = spark.createDataFrame(
        [(1, "http://a/", big), (2, None, None), (3, "http://ü/ x", big), (None, "http://n/", big), (4, "u", "short"), (5, "u", "short"),
         (6, "u", "y" * 100), (6, "u", "y" * 100), (7, "u", "a\r\n\r\nb" * 40)],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit("extra"))
    members = warc.archive_pages(pages)
    got = warc.read_records(members, with_payload=True).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    assert kinds == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None),
                            (5, "response", None), (6, "response", None), (6, "response", None), (7, "response", None)], key=repr)
    payload = {r.page_id: bytes(r.payload).decode() for r in got}
    assert payload[1] == big and payload[7] == "a\r\n\r\nb" * 40 and payload[2] == ""
    assert warc.read_records(warc.archive_pages(pages.where("false"))).count() == 0
    again = warc.normalise(members.select("path"))  # members in, members out
    assert warc.read_records(again).count() == 9


def test_mixing(docs, empty):
    got = rows(mixing.take_blocks(docs), "doc_id", "size", "taken")
    assert len(got) == len(DOCS) and all(0 <= t <= 3 * n for _, n, t in got)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.take_blocks(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_sainte_lague(spark):
    sizes = {"a": 64_000, "b": 30_123, "c": 999, "d": 200_000, None: 7_777}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    seats = {r.source: r for r in mixing.sainte_lague(mixing.source_targets(df)).collect()}
    total = -(-sum(sizes.values()) // 64)
    quotients = sorted(((seats[s].target / (2 * k + 1), s) for s in sizes for k in range(total)), key=lambda x: -x[0])[:total]
    want = {s: sum(q[1] == s for q in quotients) for s in sizes}
    assert {s: r.seats for s, r in seats.items()} == want
    quotas = mixing.shard_quotas(mixing.sainte_lague(mixing.source_targets(df)), 7).groupBy("source").agg(F.sum("blocks")).collect()
    assert dict(quotas) == want


def test_templates(docs, empty):
    assert templates.scan_licenses(docs).count() == len(DOCS) and templates.scan_licenses(empty).count() == 0
    auto = templates.compile_template("x", "grant [of {who:1-2}] to all")
    for text, found in (("we grant to all", 1), ("grant of many men to all", 1), ("grant of to all", 0), ("grant to nearly all", 0),
                        ("grant to all grant of us to all", 2)):
        assert len(auto.stretches(templates.words_of(text.encode()))) == found
    with pytest.raises(ValueError):
        templates.compile_template("x", "[a")


def _labels(text):
    automata = [templates.compile_template(*x) for x in templates.TEMPLATES]
    return set(templates._scan(text.encode(), {}, automata)[5].split(",")) - {""}


def _filled(label):
    import re

    text = next(t for x, t in reversed(templates.TEMPLATES) if x == label)
    return re.sub(r"\{\w+:\d+-\d+\}", "someone", re.sub(r"[\[\]]", "", text))


@pytest.mark.parametrize("label", ["mit-text", "isc-text", "bsd-2-clause-text", "bsd-3-clause-text", "bsd-4-clause-text", "apache-2.0-header"])
def test_short_licenses_are_whole(label):
    text = _filled(label)
    words = text.split()
    assert label in _labels("Copyright 2020 A. B. " + text + ".")
    for altered in (words[:-5], words[: len(words) // 2], words[: len(words) // 2] + ["not"] + words[len(words) // 2 :],
                    words[:60] + "shall be used for good not evil".split() + words[60:]):
        assert not [x for x in _labels(" ".join(altered)) if x.endswith(("text", "header"))]
    assert [x for x in _labels(text) if x.endswith("text")] == ([label] if label.endswith("text") else [])


@pytest.mark.parametrize("name, label", [("Apache-2.0", "apache-2.0-text"), ("GPL-2", "gpl-2.0-text"), ("GPL-3", "gpl-3.0-text"),
                                         ("LGPL-2", "lgpl-2.0-text"), ("LGPL-2.1", "lgpl-2.1-text"), ("LGPL-3", "lgpl-3.0-text"), ("MPL-1.1", "mpl-1.1-text"), ("MPL-2.0", "mpl-2.0-text")])
def test_full_licenses(name, label):
    import pkgutil

    text = pkgutil.get_data("sentrilake.llm", f"licenses/{name}.txt").decode()
    assert label in _labels(text)
    assert label in _labels(text.replace("https://", "http://").replace("51 Franklin Street, Fifth Floor", "59 Temple Place, Suite 330"))
    assert label not in _labels(text[: len(text) // 2]) and label not in _labels(text.replace("distribute", "sell", 1))


def test_license_notices():
    gnu = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License"
           " as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    assert _labels(gnu.format("", "3")) == {"gpl-3.0-notice"} and _labels(gnu.format("", "2")) == {"gpl-2.0-notice"}
    assert _labels(gnu.format("Lesser ", "2.1")) == {"lgpl-2.1-notice"} and _labels(gnu.format("Library ", "2")) == {"lgpl-2.0-notice"}
    assert _labels(gnu.format("", "4")) == set()
    mpl = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
           " with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
    assert _labels(mpl) == {"mpl-2.0-notice"} and _labels(mpl.replace("v. 2.0", "v. 1.0")) == set()
