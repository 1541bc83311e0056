from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from sentrilake.functions.fields import JSON_OPTIONS
from sentrilake.functions.predicates import pred
from sentrilake.sources.events import read_events_stream
from sentrilake.sources.rules import builtin_rules
from sentrilake.streaming import feed
from sentrilake.operators.detect import criterion_counts, risk_report
from sentrilake.streaming.watch import HostBuffer, RiskWatch, newest_per_task, watch_entries
from tests.conftest import connect, crypto, opened, wrote


def write_lines(events, path, bad=0):
    rows = [r[0] for r in events.select(F.to_json(F.struct(*[c for c in events.columns if c != "seq"]), JSON_OPTIONS)).collect()]
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(rows + ["{broken"] * bad) + "\n")


def test_find_and_bad_lines(spark, make, tmp_path):
    write_lines(make(connect(), opened("/a")), tmp_path / "in" / "a.json", bad=2)
    records = feed.observe_ingest(read_events_stream(spark, str(tmp_path / "in")), "m")
    hits = feed.stream_find(feed.accepted_events(records), pred("type", "=", "NetworkConnect"))
    query = feed.append_to_table(hits, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    seen = [p.observedMetrics["m"] for p in query.recentProgress if "m" in p.observedMetrics]
    assert sum(m.received for m in seen) == 4 and sum(m.errors for m in seen) == 2


def test_windowed_scan_equals_batch(spark, make, tmp_path):
    events = make(*[wrote(f"/{i}", at=600 * i) for i in range(10)], crypto(at=1200), connect(at=90_000))
    write_lines(events, tmp_path / "in" / "a.json")
    stream = feed.windowed_rule_scan(
        feed.accepted_events(read_events_stream(spark, str(tmp_path / "in"))), builtin_rules()
    )
    feed.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = feed.windowed_rule_scan(events, builtin_rules())
    closed = batch.filter(F.col("window_end") <= F.lit("2024-05-02 12:50:00").cast("timestamp"))
    assert got == sorted(map(str, closed.collect())) and len(got) == 2


def test_duplicates(make):
    events = make(opened("/a"), opened("/a"))
    assert feed.drop_duplicate_events(events.unionByName(events)).count() == 2


def test_newest_per_task(spark, make):
    events = make(*[opened(f"/{i}", host=f"h{i % 2}") for i in range(50)])
    entries = watch_entries(events, builtin_rules(), "host_id").repartition(3)
    got = newest_per_task(entries, 4)
    assert got.schema == entries.schema and got.count() <= 24
    best = {r.event_id for r in entries.orderBy(F.desc("wall")).limit(8).collect()}
    assert best <= {r.event_id for r in got.collect()}
    assert newest_per_task(entries.where("false"), 4).count() == 0


def test_watch_over_batches(spark, make, tmp_path):
    watch = RiskWatch(str(tmp_path / "w"), buffer=3)
    batches = [
        make(wrote("/a", at=1, id="e1"), opened("/b", at=2, id="e2")),
        make(crypto(at=3, id="e3"), opened("/c", at=3, id="x1", host="quiet")),
        make(opened("/d", at=4, id="e4")),
    ]

    def run():
        events = feed.accepted_events(read_events_stream(spark, str(tmp_path / "in"), max_files_per_trigger=1))
        watch.start(events, str(tmp_path / "ck"), once=True).awaitTermination()

    for i, batch in enumerate(batches):
        write_lines(batch, tmp_path / "in" / f"{i}.json")
        run()  # the state outlives the query
    run()
    incidents = watch.incidents(spark).collect()
    # e1 leaves the buffer of three in the last batch, so the rule stops firing.
    assert [(r.host_id, r.risk_score, r.batch, r.total_events) for r in incidents] == [("h1", 100, 1, 3)]
    snapshot = watch.snapshots(spark)
    assert sorted(r.event_id for r in snapshot.collect()) == ["e1", "e2", "e3"]
    assert snapshot.where("event_id = 'e1'").first().data.payload.path == "/a"


def test_only_active_hosts_are_written(spark, make, tmp_path):
    """The state rows that a batch changes are those of its one active host, and a full list is trimmed."""
    watch = RiskWatch(str(tmp_path / "w"), buffer=4)
    hosts = [opened("/a", host=f"h{i}", id=f"a{i}") for i in range(40)]
    batches = [hosts, *[[opened("/b", host="h7", id=f"b{k}{i}", at=50 + k) for i in range(5)] for k in range(3)]]
    changed = []
    for i, batch in enumerate(batches):
        write_lines(make(*batch), tmp_path / "in" / f"{i}.json")
        events = feed.accepted_events(read_events_stream(spark, str(tmp_path / "in")))
        query = watch.start(events, str(tmp_path / "ck"), once=True)
        query.awaitTermination()
        changed.append(sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators))
    assert changed[0] >= 40 and max(changed[1:]) <= 9
    assert watch.incidents(spark).count() == 0 and watch.snapshots(spark).count() == 0


def test_risk_is_that_of_the_scan(make):
    events = make(wrote("/a"), crypto(), connect(), opened("/etc/sam"), dict(type="SocketCreate", protocol="TCP"))
    rules = builtin_rules()
    row = criterion_counts(events, rules).first()
    assert HostBuffer(rules, 10, 75).risk(list(row.counts)) == risk_report(events, rules).first().risk_score == 100
    for kept in (["SocketCreate"], ["FileWrite"], ["FileOpen"], []):
        some = events.where(F.col("event_type").isin("DnsQuery", *kept)) if kept else events.where("false")
        counts = [0] * 6 if not kept else list(criterion_counts(some, rules).first().counts)
        want = risk_report(some, rules).first().risk_score if kept else 0
        assert HostBuffer(rules, 10, 75).risk(counts) == want


def test_fleet_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "node_id string, at timestamp, kind string, hostname string, ip_address string, os_name string"
    spark.createDataFrame([("n", t, "register", "h", "ip", "os")], schema).write.parquet(str(tmp_path / "in"))
    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        feed.updates_to_table(
            feed.fleet_heartbeat(stream), str(tmp_path / "out"), "node_id", str(tmp_path / "ck"), once=True
        ).awaitTermination()
        return feed.latest_rows(spark, str(tmp_path / "out"), "node_id").first()

    assert run().incidents == 0
    spark.createDataFrame([("n", t + dt.timedelta(1), "incident", None, None, None)], schema).write.mode(
        "append"
    ).parquet(str(tmp_path / "in"))
    row = run()
    assert (row.hostname, row.incidents) == ("h", 1)


def test_reads_touch_the_base_and_the_newer_deltas(spark, tmp_path):
    feed_dir, out = tmp_path / "in", tmp_path / "out"
    feed_dir.mkdir()
    for i in range(8):
        (feed_dir / f"{i}.json").write_text("".join(json.dumps({"k": k, "v": i}) + "\n" for k in ("a", f"only{i}")))
        stream = spark.readStream.schema("k string, v long").json(str(feed_dir)).groupBy("k").agg(F.max("v").alias("v"))
        feed.updates_to_table(stream, str(out), "k", str(tmp_path / "ck"), once=True, compact_every=3).awaitTermination()
    assert sorted(p.name for p in (out / "base").iterdir()) == ["batch=2", "batch=5"]
    assert sorted(p.name for p in (out / "delta").iterdir()) == [f"batch={i}" for i in range(3, 8)]
    # A base that is not complete does not count.
    (out / "base" / "batch=7").mkdir()
    rows = feed.latest_rows(spark, str(out), "k")
    assert sorted(map(tuple, rows.collect())) == [("a", 7), *((f"only{i}", i) for i in range(8))]
    read = {f.split("batch=")[1].split("/")[0] + f.split("/batch=")[0][-5:] for f in rows.inputFiles()}
    assert read == {"5/base", "6delta", "7delta"}


def test_counters_of_many_batches(spark, tmp_path):
    """More batches than the query keeps progress reports of."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    feed_dir = tmp_path / "in"
    feed_dir.mkdir()
    for i in range(8):
        good = json.dumps({"event_id": f"e{i}", "event_type": "FileOpen"})
        (feed_dir / f"s{i}.ndjson").write_text(good + ("\n{ cut" if i % 5 == 0 else "") + "\n")
    records = read_events_stream(spark, str(feed_dir), max_files_per_trigger=1)
    out, counts = str(tmp_path / "out"), str(tmp_path / "counts")
    feed.accept_to_table(records, out, counts, str(tmp_path / "progress"), once=True).awaitTermination()
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert tuple(feed.ingest_totals(spark, counts).first()) == (10, 8, 2)
    rows = spark.read.parquet(out)
    assert rows.count() == 8
    # Without an artifact_id of its own a record belongs to the session that its file names.
    assert rows.filter("artifact_id = 's' || substr(event_id, 2)").count() == 8
