from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sentrilake.operators import forest, graph, integrity, ordering, sequence
from sentrilake.operators.skew import salted_join
from tests.conftest import connect, opened, wrote


def ids(df, col="event_id"):
    return {r[col] for r in df.collect()}


def seed(spark, event, artifact="s1"):
    return spark.createDataFrame([(artifact, event)], "artifact_id string, event_id string")


def test_explicit_chain(spark, make):
    events = make(
        dict(type="ProcessStart", id="e1", pid=1),
        dict(type="DnsResponse", id="e2", parent="e1", addresses=["93.184.216.34"], pid=2),
        connect("93.184.216.34", id="e3", causal=["e2"], pid=3),
        ordered=True,
    )
    assert ids(graph.ancestors(events, seed(spark, "e3"))) == {"e1", "e2"}
    assert ids(graph.descendants(events, seed(spark, "e1"))) == {"e2", "e3"}
    assert ids(graph.causal_neighborhood(events, seed(spark, "e1"), 1)) == {"e2"}
    assert ids(graph.causal_neighborhood(events, seed(spark, "e1"), 2)) == {"e2", "e3"}


def test_missing_parent(spark, make):
    events = make(opened("/a", id="e1", parent="gone"), opened("/b", id="e2", pid=7, parent="gone"), ordered=True)
    counts = graph.graph_counts(events).first()
    assert (counts.nodes, counts.edges) == (2, 2)
    assert ids(graph.ancestors(events, seed(spark, "e1"))) == set()
    # The neighbourhood passes through the missing event but does not return it.
    assert ids(graph.causal_neighborhood(events, seed(spark, "e1"), 2)) == {"e2"}


def test_dns_needs_earlier_answer(make):
    events = make(
        connect("1.2.3.4", pid=1), dict(type="DnsResponse", addresses=["1.2.3.4", "1.2.3.4"], pid=2),
        connect("1.2.3.4", pid=3), ordered=True,
    )
    edges = [(r.src[-1], r.dst[-1]) for r in graph.dns_edges(events).collect()]
    assert edges == [("1", "2"), ("1", "2")]
    assert graph.graph_counts(events).first().edges == 2


def test_lineage_links_reused_pid(make):
    events = make(
        dict(type="ProcessStart", pid=9), dict(type="ProcessSpawn", pid=1, child_pid=9),
        dict(type="ProcessStart", pid=9), dict(type="ProcessStart", pid=9), ordered=True,
    )
    assert graph.lineage_edges(events).count() == 3
    assert [(r.src[-1], r.dst[-1]) for r in graph.lineage_edges(events, strict=True).collect()] == [("1", "2")]


def random_events(make, n=120, seed_=1):
    rnd = random.Random(seed_)
    specs = []
    for i in range(n):
        pid = rnd.randrange(6)
        ip = f"10.0.0.{rnd.randrange(3)}"
        kind = rnd.randrange(6)
        base = dict(pid=pid, id=f"e{i:04d}")
        if rnd.random() < 0.2:
            base["parent"] = f"e{rnd.randrange(n + 5):04d}"
        specs.append(
            [
                opened(f"/f{rnd.randrange(4)}", **base), wrote(f"/f{rnd.randrange(4)}", **base),
                connect(ip, **base), dict(type="DnsResponse", addresses=[ip], **base),
                dict(type="ProcessSpawn", child_pid=rnd.randrange(6), **base),
                dict(type="ProcessStart", **base),
            ][kind]
        )
    return make(*specs, ordered=True)


@pytest.mark.parametrize("size", [3, 10_000])
def test_traversal_matches_plain_search(spark, make, size, monkeypatch):
    """Grouped traversal and counts against a walk over the listed edges."""
    events = random_events(make)
    rows = events.select(graph.KEY, "event_id", "ord")
    assert rows.count() == 120
    edges = [(r.src, r.dst) for r in graph.build_edges(events).collect()]
    nodes = ids(events)
    counts = graph.graph_counts(events, size).first()
    assert (counts.nodes, counts.edges) == (120, len(edges))
    for start in ("e0007", "e0060", "e0110"):
        for backward in (True, False):
            reached, todo = set(), [start]
            while todo:
                at = todo.pop()
                for s, d in edges:
                    a, b = (d, s) if backward else (s, d)
                    if a == at and b in nodes and b not in reached and b != start:
                        reached.add(b)
                        todo.append(b)
            walk = graph.ancestors if backward else graph.descendants
            assert ids(walk(events, seed(spark, start), size)) == reached


@pytest.mark.parametrize("size", [4, 10_000])
def test_spans_and_edges_of_given_events(spark, make, size):
    events = random_events(make)
    listed = [tuple(r)[:4] for r in graph.build_edges(events).collect()]
    spans = graph.edge_spans(events, size)
    assert sum(r.sources for r in spans.collect()) == (
        graph.dns_edges(events).count() + graph.lineage_edges(events).count())
    assert spans.count() <= graph.memberships(events).count()
    for wanted in (["e0007", "e0110", "none"], [f"e{i:04d}" for i in range(120)]):
        rows = spark.createDataFrame([("s1", x) for x in wanted], "artifact_id string, event_id string")
        got = sorted(tuple(r)[:4] for r in graph.edges_into(events, rows).collect())
        assert got == sorted(e for e in listed if e[2] in wanted)
    assert graph.edge_spans(events.where("false")).count() == 0


def test_adjacent_pairs_over_buckets(make):
    events = random_events(make, 50)
    rows = events.select("artifact_id", F.col("process_identity.pid").alias("pid"), "event_id", "ord")
    one = set(map(tuple, ordering.adjacent_pairs(rows, ["artifact_id", "pid"], "event_id").collect()))
    many = set(map(tuple, ordering.adjacent_pairs(rows, ["artifact_id", "pid"], "event_id", size=4).collect()))
    assert one == many and len(one) > 30


def test_graph_hash_ignores_row_order(make):
    events = random_events(make, 30)
    shuffled = events.orderBy(F.rand(5))
    assert graph.graph_hash(events).first() == graph.graph_hash(shuffled).first()
    changed = events.withColumn("event_type", F.when(F.col("ord") == 3, "X").otherwise(F.col("event_type")))
    assert graph.graph_hash(events).first() != graph.graph_hash(changed).first()


def test_forest(make):
    events = make(
        dict(type="ProcessStart", pid=10, exe="/bin/init"), dict(type="ProcessStart", pid=20, ppid=10, exe="/bin/sh"),
        dict(type="ProcessExit", pid=20, ppid=10, exe="/bin/sh", exit_code=3),
    )
    lines = forest.render_forest(forest.process_forest(events)).orderBy("path").collect()
    assert lines[0].line.startswith("init [pid: 10, events: 1")
    assert lines[1].line == "  sh [pid: 20, events: 2, files: 0, net: 0, crypto: 0] (exit: 3)"


def test_forest_drops_cycles(make):
    chain = [opened("/a", pid=100 + i, ppid=99 + i) for i in range(40)]
    events = make(opened("/a", pid=1, ppid=2), opened("/a", pid=2, ppid=1), opened("/a", pid=3, ppid=3), *chain)
    rows = {r.pid: r for r in forest.process_forest(events).collect()}
    assert set(rows) == set(range(100, 140))
    assert rows[139].depth == 39 and rows[139].path == list(range(100, 140))


@pytest.mark.parametrize("hot_rows", [3, 7, 100])
def test_salted_join_equals_plain_join(spark, hot_rows):
    """Hot on both sides, on one side, on none."""
    left = spark.createDataFrame([(k % 3, k) for k in range(20)], "k int, a int")
    right = spark.createDataFrame([(0 if k < 60 else k % 4, k) for k in range(80)], "k int, b int")
    plain = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, salted_join(left, right, ["k"], "a", "b", hot_rows=hot_rows).collect())) == plain


def test_sequence_overlaps_and_borders(make):
    events = make(opened("/a"), opened("/b"), opened("/c"))
    rows = sequence.match_sequence(events, ["FileOpen", "fileopen"]).orderBy("hit", "step").collect()
    assert [(r.hit, r.step) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sequence.match_sequence(events, ["FileOpen"]).count() == 0


def test_sequence_buckets(spark, make):
    rnd = random.Random(2)
    kinds = [rnd.choice(["A", "B"]) for _ in range(100)]
    rows = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "artifact_id string, seq long, event_type string")
    wanted = ["A", "B", "A"]
    want = sorted((i, j) for i in range(98) for j in range(3) if kinds[i : i + 3] == wanted)
    for size in (3, 4, 7, 1000):
        got = sequence.match_sequence(rows, wanted, position="seq", size=size)
        assert sorted((r.hit, r.step) for r in got.collect()) == want


def test_sequence_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, i, x) for i, x in enumerate("abab")], "artifact_id string, seq long, event_type string")
    got = sequence.match_sequence(rows, ["a", "B"])
    assert got.columns == ["artifact_id", "seq", "event_type", "hit", "step"]
    assert sorted((r.seq, r.hit, r.step) for r in got.collect()) == [(0, 0, 0), (1, 0, 1), (2, 2, 0), (3, 2, 1)]


def test_dense_position(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else "cold", 997 * i % 1000) for i in range(1000)], "k string, v int")
    out = ordering.dense_position(rows.repartition(7), ["k"], ["v"]).orderBy("k", "v").collect()
    seen = {}
    for r in out:
        assert r.ord == seen.get(r.k, 0)
        seen[r.k] = r.ord + 1
    assert sum(seen.values()) == 1000


def test_merkle(spark):
    import hashlib

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def root(leaves):
        level = [sha("leaf:" + x) for x in leaves]
        while len(level) > 1:
            level = [sha("node:" + level[i] + (level[i + 1] if i + 1 < len(level) else level[i]))
                     for i in range(0, len(level), 2)]
        return level[0]

    sizes = [1, 2, 3, 5, 8, 17, 33]
    rows = [(f"s{n}", i, sha(f"{n}/{i}")) for n in sizes for i in range(n)]
    manifest = spark.createDataFrame(rows, "artifact_id string, block_index long, block_hash string")
    want = {f"s{n}": root([sha(f"{n}/{i}") for i in range(n)]) for n in sizes}
    for fold in (1, 2, 10):
        got = {r.artifact_id: r.merkle_root for r in integrity.merkle_root(manifest, fold=fold).collect()}
        assert got == want
    roots = integrity.merkle_root(manifest)
    broken = manifest.withColumn(
        "block_hash", F.when((F.col("artifact_id") == "s5") & (F.col("block_index") == 2), "x").otherwise(F.col("block_hash"))
    )
    verdicts = {r.artifact_id: r.verdict for r in integrity.verify_manifest(broken, manifest, roots).collect()}
    assert verdicts.pop("s5") == "REJECTED" and set(verdicts.values()) == {"VERIFIED"}
