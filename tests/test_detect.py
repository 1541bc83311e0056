from __future__ import annotations

from sentrilake.operators import beacon, detect, explain
from sentrilake.operators import stats as st
from sentrilake.sources.rules import Criterion, Rule, builtin_rules, load_rules, parse_rule
from tests.conftest import connect, crypto, opened, wrote


def test_ransomware_pattern(make):
    events = make(*[wrote(f"/files/doc_{i}") for i in range(5)], crypto("AES-256-CBC", "ENCRYPT"))
    row = detect.risk_report(events, builtin_rules()).first()
    assert row.risk_score == 100 and row.risk_band == "CRITICAL"
    alert = detect.evaluate_rules(events, builtin_rules()).first()
    assert alert.rule_id == "SEC-001" and alert.matched_events == 6
    assert detect.alert_events(events, builtin_rules()).count() == 6


def test_every_criterion_must_match(make):
    assert detect.evaluate_rules(make(wrote("/a")), builtin_rules()).count() == 0


def test_zero_minimum(make):
    rule = Rule("R", "t", "LOW", "", (Criterion("SocketCreate", min_event_count=0),))
    both = Rule("R2", "t", "LOW", "", rule.criteria + (Criterion("FileWrite"),))
    rows = detect.evaluate_rules(make(wrote("/a")), [rule, both]).collect()
    assert [r.rule_id for r in rows] == ["R2"]


def test_risk_is_capped_and_clean_sessions_stay(make):
    events = make(
        wrote("/a", artifact="bad"), crypto(artifact="bad"), connect(artifact="bad"),
        opened("/x", artifact="clean"),
    )
    got = {r.artifact_id: (r.risk_score, r.risk_band) for r in detect.risk_report(events, builtin_rules()).collect()}
    assert got == {"bad": (100, "CRITICAL"), "clean": (0, "BENIGN / CLEAN")}


def test_many_criteria_take_several_passes(make, monkeypatch):
    monkeypatch.setattr(detect, "CRITERIA_PER_PASS", 2)
    rules = builtin_rules()
    events = make(wrote("/a"), crypto(), connect(), dict(type="SocketCreate", protocol="TCP"))
    got = {r.rule_id for r in detect.evaluate_rules(events, rules).collect()}
    assert got == {"SEC-001", "SEC-002", "SEC-005"}


def test_rule_files(tmp_path):
    good = "id: A\ntitle: t\ndescription: d\nauthor: a\nseverity: HIGH\ncriteria:\n  - event_type: FileOpen\nremediation: r\n"
    (tmp_path / "a.yml").write_text(good)
    (tmp_path / "b.yaml").write_text(good.replace("HIGH", "LOUD"))
    (tmp_path / "c.yml").write_text("id: [")
    (tmp_path / "d.txt").write_text(good)
    (tmp_path / "e.yml").write_text("just text")
    loaded = load_rules(str(tmp_path))
    assert loaded.loaded_from_files == 1 and len(loaded.rules) == 6
    assert parse_rule(good).criteria[0].minimum == 1
    assert load_rules(str(tmp_path / "none")).loaded_from_files == 0


def test_rwx(make):
    alerts = detect.rwx_memory_alerts(
        make(
            dict(type="MemoryProtect", address=0x400000, size_bytes=4096,
                 new_permissions="PAGE_EXECUTE_READWRITE"),
            dict(type="MemoryMap", address=2**64 - 1, size_bytes=1, permissions="RWX"),
            dict(type="MemoryProtect", address=1, size_bytes=1, new_permissions="rwx"),
        )
    ).orderBy("event_id").collect()
    assert [a.mitre_id for a in alerts] == ["T1106 / T1055"] * 2
    assert alerts[0].description.endswith("addr=0x400000 size=4096")
    assert "0xFFFFFFFFFFFFFFFF" in alerts[1].description


def test_beacon(make):
    row = beacon.beacon_profiles(make(*[connect("192.168.1.100", at=10 * i) for i in range(5)])).first()
    assert row.is_beaconing and abs(row.mean_interval_seconds - 10) < 0.1 and row.jitter_percentage < 5
    assert row.target == "192.168.1.100:443" and row.sample_count == 5
    assert "seconds 50" in row.suricata_rule and "jitter 0.0 percent" in row.snort_rule


def test_beacon_needs_gaps(make):
    assert beacon.beacon_profiles(make(*[connect(at=0) for _ in range(3)])).count() == 0
    assert beacon.beacon_profiles(make(connect(at=0), connect(at=9))).count() == 0


def test_beacon_gaps_match_sorted_list(make):
    """Gaps over second and day borders equal those of the plain sorted list."""
    import random

    rnd = random.Random(3)
    times = sorted(rnd.uniform(0, 3 * 86400) for _ in range(60)) + [5.0, 5.2, 5.4, 6.39, 6.4]
    row = beacon.beacon_profiles(make(*[connect(at=t) for t in times])).first()
    micros = sorted(round(t * 1e6) for t in times)
    gaps = [g for g in ((b - a) // 1_000_000 for a, b in zip(micros, micros[1:])) if g > 0]
    assert abs(row.mean_interval_seconds - sum(gaps) / len(gaps)) < 1e-6


def test_dga_queries(make):
    events = make(
        dict(type="DnsQuery", query_name="xkzjqpwbvrtyqpl.com"),
        dict(type="DnsQuery", query_name="google.com"),
        dict(type="DnsResponse", query_name="xkzjqpwbvrtyqpl.com", addresses=[]),
    )
    assert [r.query_name for r in detect.dga_queries(events).collect()] == ["xkzjqpwbvrtyqpl.com"]


def test_explain(make):
    row = explain.explain_incidents(make(connect(exe="/bin/sh")), builtin_rules()).first()
    assert row.root_process == "sh" and row.risk_score == 75
    assert row.observations == [
        "SEC-002 (high, 1 events): Outbound connection to an external address; compare T1059: Command and Scripting Interpreter",
        "Score 75 of 100, tier respond",
    ]
    assert row.actions[0] == "Check the remote address and the command line of the process."
    assert row.actions[1:] == ["Contain the machine first, then follow what sh left behind."]
    assert "level: critical" in row.sigma_rule
    quiet = explain.explain_incidents(make(opened("/a")), builtin_rules()).first()
    assert quiet.observations == ["Score 0 of 100, tier archive"] and len(quiet.actions) == 1


def test_destinations_in_text_order(make):
    events = make(*[connect(f"10.0.0.{i}") for i in range(12)], connect("10.0.0.9"))
    got = [r.destination for r in st.network_destinations(events).orderBy("position").collect()]
    assert got == sorted(f"10.0.0.{i}:443" for i in range(12))[:10]
    top = st.network_destinations(events, 1, by="count").first()
    assert (top.destination, top.events) == ("10.0.0.9:443", 2)


def test_socket_counts_only_in_manifest(make):
    events = make(dict(type="SocketCreate", protocol="TCP"))
    assert st.session_manifest(events).first().network_events == 1
    assert st.inspect_summary(events).first().network_flows == 0


def test_fleet(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [("n", t, "register", "host", "10.0.1.15", "Linux"),
            ("n", t + dt.timedelta(1), "incident", None, None, None)]
    df = spark.createDataFrame(
        rows, "node_id string, at timestamp, kind string, hostname string, ip_address string, os_name string"
    )
    row = st.fleet_status(df).first()
    assert (row.hostname, row.incidents, row.last_heartbeat) == ("host", 1, t + dt.timedelta(1))
