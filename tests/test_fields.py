from __future__ import annotations

from pyspark.sql import functions as F

from sentrilake.functions import fields
from sentrilake.functions.domains import domain_entropy, is_likely_dga
from sentrilake.functions.predicates import pred
from sentrilake.functions.register import register_functions
from sentrilake.functions.tls import ja3_hash, ja3_string, known_threat
from sentrilake.functions.vectors import cosine_similarity
from sentrilake.operators.diff import normalize_temp_path
from sentrilake.operators.find import find_events, text_search
from tests.conftest import connect, crypto, opened, wrote


def values(spark, inputs, make_column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", make_column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_canonical_name(spark):
    paths = ["C:\\Windows\\System32\\cmd.exe", "/usr/bin/curl", "/usr/bin/", "", "plain"]
    assert values(spark, paths, fields.canonical_process_name) == [
        "cmd.exe", "curl", "/usr/bin/", "unknown", "plain"
    ]


def test_temp_paths(spark):
    paths = ["/srv/template/a.txt", "/tmp/", "/tmp/x/.", "/tmp/..", "/data/a", "/TMP/b.log", "tmp"]
    assert values(spark, paths, normalize_temp_path) == [
        "<TEMP_DIR>/a.txt", "<TEMP_DIR>/tmp", "<TEMP_DIR>/x", "/tmp/..", "/data/a",
        "<TEMP_DIR>/b.log", "<TEMP_DIR>/tmp",
    ]


def test_dga(spark):
    names = ["xkzjqpwbvrtyqpl.com", "q9v8w7x6z5k4j3.net", "google.com", "microsoft.com", "github.com", ""]
    want = [True, True, False, False, False, False]
    assert values(spark, names, is_likely_dga) == want
    register_functions(spark)
    assert values(spark, names, lambda c: F.call_function("is_likely_dga", c)) == want
    assert values(spark, ["", "aaaa.com", "ab.com", "é.com"], domain_entropy) == [0.0, 0.0, 1.0, 1.0]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        "SELECT canonical_process_name('C:\\\\a\\\\cmd.exe') n, canonical_process_name('') u, "
        "round(domain_entropy('abab.com'), 6) e, "
        "cosine_similarity(array(1D, 0D), array(1D, 0D)) c, "
        "cosine_similarity(array(1D), array(1D, 0D)) d"
    ).first()
    assert tuple(row) == ("cmd.exe", "unknown", 1.0, 1.0, 0.0)


def test_env_keys(spark):
    got = values(
        spark, [["API_TOKEN", "KEYBOARD", "PATH", "my_secret"]], fields.drop_sensitive_env_keys,
        "array<string>",
    )
    assert got == [["PATH"]]


def test_ja3(spark):
    df = spark.range(1).select(
        F.lit(771).alias("v"), F.array(F.lit(1), F.lit(2)).alias("a"),
        F.array().cast("array<int>").alias("e"),
    )
    args = (F.col("v"), F.col("a"), F.col("e"), F.col("a"), F.col("e"))
    row = df.select(ja3_string(*args).alias("s"), ja3_hash(*args).alias("h")).first()
    assert row.s == "771,1-2,,1-2,"
    assert len(row.h) == 32
    assert values(spark, ["E7D705A3286E19EA42F587B344EE6865", "x"], known_threat) == [
        "Sliver C2 Implant Framework", None
    ]


def test_cosine_clamped(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(cosine_similarity(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_find_two_fields(make):
    events = make(crypto(), dict(type="ProcessStart", executable_path="/usr/bin/tool"))
    hit = find_events(
        events, pred("type", "=", "CryptoOperation") & pred("crypto.algorithm", "=", "sha256")
    ).collect()
    assert len(hit) == 1 and hit[0].summary == "Hash algo:SHA256 provider:OpenSSL"


def test_find_external(make):
    events = make(connect(pid=200), connect(external=False))
    assert find_events(events, pred("network.external", "=", True)).count() == 1


def test_two_valued_logic(make):
    events = make(opened("/a/x"), connect(port=443), dict(type="FileRename", old_path="x", new_path="y"))
    port = pred("network.remote_port", "=", 443)
    assert {r.event_type for r in find_events(events, ~port).collect()} == {"FileOpen", "FileRename"}
    assert find_events(events, pred("network.remote_port", "!=", 443)).count() == 0
    assert find_events(events, pred("path", "CONTAINS", "x")).count() == 1
    assert find_events(events, pred("confidence", ">=", 0.9)).count() == 0
    assert find_events(events, pred("bogus", "=", 1)).count() == 0
    assert find_events(events, pred("type", "!=", "nosuchtype")).count() == 3


def test_limit_zero_gives_one(make):
    assert find_events(make(opened("/a"), opened("/b")), limit=0).count() == 1


def test_number_values(make):
    events = make(opened("/f/443", pid=5), opened("/f/1.5", pid=6))
    assert find_events(events, pred("path", "CONTAINS", 443.0)).count() == 1
    assert find_events(events, pred("path", "CONTAINS", 1.5)).count() == 1
    assert find_events(events, pred("pid", "=", "5")).count() == 1
    assert find_events(events, pred("pid", "=", "abc")).count() == 0
    assert find_events(events, pred("pid", ">", True)).count() == 2
    assert find_events(events, pred("pid", "CONTAINS", 5)).count() == 0


def test_summaries(make):
    specs = [
        dict(type="DnsResponse", query_name="a.b", addresses=["1.1.1.1", 'x"y'], rcode=0),
        dict(type="TlsObserved", version="1.3", cipher_suite=None),
        dict(type="TlsObserved", version="1.3", cipher_suite="AES"),
        dict(type="NetworkAccept", remote_address="2.2.2.2", remote_port=9),
        dict(type="NetworkClose", bytes_sent=1, bytes_received=2),
        dict(type="MemoryMap", size_bytes=4096, permissions="RWX"),
        dict(type="IpcConnect", target_endpoint="/run/x"),
        dict(type="IpcSend", message_bytes=7),
        dict(type="UserSession", username="u"),
        dict(type="SystemMetadata", os_name="Linux", architecture="x86"),
        dict(type="FileRename", old_path="a", new_path="b"),
    ]
    got = [r.s for r in make(*specs).orderBy("seq").select(fields.event_summary().alias("s")).collect()]
    assert got == [
        'resolved a.b -> ["1.1.1.1", "x\\"y"]', "TLS 1.3 ciphersuite:None",
        'TLS 1.3 ciphersuite:Some("AES")', "accept from 2.2.2.2:9", "close sent:1 recv:2",
        "mmap size:4096 perm:RWX", "ipc connect /run/x", "ipc send 7 bytes", "user u",
        "os Linux arch x86", "rename a -> b",
    ]


def test_text_search(make):
    events = make(wrote("/a", exe="/bin/Evil"), wrote("/b"))
    assert text_search(events, "EVIL100high2024-05-01 12").count() == 1


def test_filters_reach_parquet(spark, make, tmp_path, capsys):
    path = str(tmp_path / "t")
    make(opened("/a")).write.parquet(path)
    for where, pushed in [
        (pred("type", "=", "fileopen"), "EqualNullSafe(event_type,FileOpen)"),
        (pred("network.remote_port", ">", 443), "GreaterThan(data.payload.remote_port,443)"),
    ]:
        find_events(spark.read.parquet(path), where).explain("formatted")
        assert pushed in capsys.readouterr().out


def test_times_do_not_follow_the_session_zone(spark, make):
    events = make(connect(at=0.25), connect(at=-50_000))
    texts = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            row = events.select(
                F.collect_list(fields.wall_text()).alias("a"),
                F.collect_list(fields.utc_instant(F.col("timestamp_wall"))).alias("b"),
                F.collect_list(fields.utc_day(F.col("timestamp_wall"))).alias("c"),
            ).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        texts.append(row)
    assert texts[0] == texts[1]
    assert "2024-05-01 12:00:00.250 UTC" in texts[0].a and "2024-04-30T22:06:40.000000Z" in texts[0].b
