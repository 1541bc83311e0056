from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sentrilake.functions.fields import event_hash
from sentrilake.operators import diff, privacy, search
from sentrilake.sinks import events as sinks
from sentrilake.sources.events import (
    read_corpus, read_events, read_raw_events, read_rejects, rejected_sessions, write_events,
)
from sentrilake.sources.rules import builtin_rules
from tests.conftest import connect, crypto, opened, wrote


def test_diff(make):
    old = make(dict(type="ProcessStart", executable_path="/bin/a"), opened("/x"))
    new = make(dict(type="ProcessStart", executable_path="/bin/a"), opened("/x"), connect("192.168.1.100"))
    changes = diff.behavior_changes(old, new).collect()
    assert [(c.change, c.description) for c in changes] == [("added", "tool -> network 192.168.1.100:443")]
    assert diff.behavior_similarity(old, new).first().similarity == pytest.approx(80.0)
    assert diff.high_risk_divergences(old, new).count() == 1


def test_empty_sessions_are_equal(make):
    empty = make(dict(type="SocketCreate", protocol="TCP"))
    assert diff.behavior_similarity(empty, empty).first().similarity == 100.0
    assert diff.behavior_similarity(empty, empty, ["artifact_id"]).first().similarity == 100.0


def test_changed_tls(make):
    old = make(dict(type="TlsObserved", version="1.2"), dict(type="TlsObserved", version="1.3"))
    new = make(dict(type="TlsObserved", version="1.3"))
    row = diff.changed_tls(old, new).first()
    assert (row.old_value, row.new_value, row.category) == ("1.2", "1.3", "TLS Protocol")
    assert diff.changed_tls(old, old).count() == 0


def test_self_similarity(make):
    start = dict(type="ProcessStart", executable_path="/bin/a")
    events = make(dict(start, artifact="a"), dict(start, artifact="b"), wrote("/x", artifact="c"))
    vectors = search.behavior_vectors(events)
    rows = {r.artifact_id: r for r in search.search_similar(vectors, "a").collect()}
    assert rows["b"].similarity == pytest.approx(1, abs=1e-4)
    assert rows["b"].label == "HIGHLY SIMILAR (VARIANT)" and rows["b"].percent == "100.00%"


def test_many_queries_in_several_passes(make, monkeypatch):
    specs = []
    for i in range(6):
        specs += [opened(f"/{j}", artifact=f"a{i}") for j in range(i + 1)] + [connect(artifact=f"a{i}")]
    vectors = search.behavior_vectors(make(*specs))
    ids = vectors.select("artifact_id")
    whole = sorted(map(tuple, search.search_similar_many(vectors, ids).collect()))
    monkeypatch.setattr(search, "QUERIES_PER_PASS", 4)
    assert sorted(map(tuple, search.search_similar_many(vectors, ids).collect())) == whole
    single = search.search_similar(vectors, "a2").count()
    assert sum(1 for r in whole if r[1] == "a2") == single


def test_sanitizer(make):
    events = make(
        dict(type="ProcessStart", environment_keys=["SECRET_KEY", "PATH"], privacy="SECRET"),
        dict(type="ProcessStart", environment_keys=["SECRET_KEY", "PATH"], user="me", raw={"a": "b"}),
        wrote("/a", privacy="SENSITIVE"), wrote("/b", content_hash="h"),
    )
    assert privacy.sanitize_events(events, "PUBLIC").count() == 2
    rows = privacy.sanitize_events(events, "SENSITIVE", redact_raw_evidence=True).orderBy("seq").collect()
    assert len(rows) == 3
    assert rows[0].data.payload.environment_keys == ["PATH"]
    assert rows[0].process_identity.user == "[REDACTED_USER]" and rows[0].raw_evidence == {}
    assert rows[1].data.payload.content_hash == "[REDACTED_HASH]" and rows[1].process_identity.user is None
    assert rows[2].data.payload.content_hash == "h"


def test_json_array_and_bad_files(spark, make, tmp_path):
    events = make(dict(type="ProcessStart", executable_path="/usr/bin/curl", environment_keys=["PATH"]), opened("/a"))
    rows = [json.loads(r[0]) for r in events.orderBy("seq").select(F.to_json(F.struct("*"))).collect()]
    for r in rows:
        r.pop("artifact_id")
    (tmp_path / "one.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "two.json").write_text("{ not json")
    with pytest.raises(Exception, match="record that is no event"):
        read_events(spark, str(tmp_path), "json").collect()
    rejects = read_rejects(spark, str(tmp_path), "json").collect()
    assert [(r.artifact_id, r.reason) for r in rejects] == [("two", "not an event record")]
    assert rejects[0].file.endswith("two.json") and rejects[0].record == "{ not json"
    back = read_events(spark, str(tmp_path), "json", strict=False).orderBy("seq").collect()
    assert [r.event_type for r in back] == ["ProcessStart", "FileOpen"]
    assert {r.artifact_id for r in back} == {"one"}
    assert back[0].process_identity.executable_path == "/usr/bin/tool"
    raw = read_raw_events(spark, str(tmp_path), "json").collect()
    assert sum(r._corrupt is not None for r in raw) == 1


def test_address_and_ndjson(spark, make, tmp_path):
    events = make(dict(type="MemoryMap", address=2**64 - 1, size_bytes=1, permissions="R"), opened("/a", privacy="SECRET"))
    sinks.write_ndjson(events, str(tmp_path / "n"))
    row = read_events(spark, str(tmp_path / "n"), "ndjson").first()
    assert int(row.data.payload.address) == 2**64 - 1 and row.seq == 0


def test_corpus(spark, make, tmp_path):
    path = str(tmp_path / "c")
    write_events(make(opened("/a", artifact="q"), opened("/b", artifact="r")), path)
    assert [r.artifact_id for r in read_corpus(spark, path, exclude="q").collect()] == ["r"]


def test_stix_parts(make):
    events = make(*[opened(f"/{i}") for i in range(5)], ordered=True)
    docs = [json.loads(r.bundle) for r in sinks.to_stix(events, per_bundle=2).orderBy("part").collect()]
    assert [d["objects"][0]["number_observed"] for d in docs] == [2, 2, 1]
    assert set(docs[2]["objects"][0]["objects"]) == {"4"}
    assert docs[0]["objects"][0]["objects"]["0"]["name"] == "tool"
    assert sinks.to_stix(events).count() == 1


def test_sarif(make):
    doc = json.loads(sinks.to_sarif(make(connect()), builtin_rules()).first().sarif)
    assert doc["version"] == "2.1.0" and doc["$schema"].endswith("2.1.0.json")
    result = doc["runs"][0]["results"][0]
    assert result["level"] == "error" and result["message"]["text"].startswith("Outbound connection")


def test_incident_context(make):
    text = sinks.incident_context(make(*[opened(f"/{i}") for i in range(60)]), builtin_rules()).first().markdown
    assert text.count('{"event_id"') == 50 and "- none" in text and "events: 60" in text


def test_event_hash_is_stable(make):
    events = make(opened("/etc/passwd", id="00000000-0000-0000-0000-000000000000"))
    first, second = (events.select(event_hash()).first()[0] for _ in range(2))
    assert first == second and len(first) == 64
    other = make(crypto(id="00000000-0000-0000-0000-000000000000"))
    assert other.select(event_hash()).first()[0] != first


def test_damaged_parquet_fails(spark, make, tmp_path):
    path = tmp_path / "c"
    make(opened("/a"), opened("/b")).write.parquet(str(path))
    (path / "part-broken.parquet").write_bytes(b"not a parquet file")
    for read in (read_events, read_corpus):
        with pytest.raises(Exception):
            read(spark, str(path)).collect()


def test_corpus_leaves_out_rejected_sessions_whole(spark, make, tmp_path):
    events = make(opened("/a", artifact="q"), opened("/b", artifact="r"), opened("/c", artifact="r"))
    lines = {r.artifact_id: [] for r in events.collect()}
    for r in events.select("artifact_id", F.to_json(F.struct("*")).alias("line")).collect():
        lines[r.artifact_id].append(r.line)
    (tmp_path / "q.ndjson").write_text("\n".join(lines["q"]))
    (tmp_path / "r.ndjson").write_text("\n".join([*lines["r"], lines["r"][0][:40]]))
    assert [r.artifact_id for r in read_corpus(spark, str(tmp_path), "ndjson").collect()] == ["q"]
    rejected = {r.artifact_id: r.rejected for r in rejected_sessions(spark, str(tmp_path)).collect()}
    assert rejected == {"r": 1}


def test_report_of_a_session_without_public_events(make):
    events = make(opened("/a", artifact="q", privacy="SECRET"), opened("/b", artifact="r"))
    sarif = {r.artifact_id: json.loads(r.sarif) for r in sinks.to_sarif(events, builtin_rules()).collect()}
    assert set(sarif) == {"q", "r"} and sarif["q"]["runs"][0]["results"] == []
    text = {r.artifact_id: r.markdown for r in sinks.incident_context(events, builtin_rules()).collect()}
    assert "- events: 0\n- risk score: 0/100" in text["q"] and "/a" not in text["q"]
    stix = {r.artifact_id: json.loads(r.bundle)["objects"][0] for r in sinks.to_stix(events).collect()}
    assert stix["q"]["number_observed"] == 0 and stix["q"]["objects"] == {}
    assert stix["r"]["number_observed"] == 1


def test_shared_paths_name_their_file_system(spark, tmp_path):
    """A plain folder, one with a scheme and the default all give paths that Spark and other readers resolve alike."""
    from sentrilake.session import qualified, shared_path

    assert qualified(spark, str(tmp_path)) == qualified(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
    path = shared_path(spark, "table")
    assert path.startswith("file:///") and path != shared_path(spark, "table")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
