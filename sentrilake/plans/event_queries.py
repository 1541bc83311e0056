"""Queries over events: filters, summaries, windows, detection, privacy, diff, search."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrilake.functions import fields
from sentrilake.functions.domains import domain_entropy, is_likely_dga
from sentrilake.functions.predicates import pred
from sentrilake.functions.register import register_functions
from sentrilake.functions.tls import ja3_hash, ja3_string
from sentrilake.operators import beacon, detect, diff, explain, find, ordering, privacy, search, stats
from sentrilake.operators.sequence import match_sequence
from sentrilake.plans.adapter import (
    daily_events,
    load,
    session_events,
)
from sentrilake.plans.query import RESULT_ROW, SUMMARY, Query, with_events
from sentrilake.schema import CATEGORY_SCHEMES
from sentrilake.session import shared_path
from sentrilake.sinks import events as sinks
from sentrilake.sources.events import read_corpus, read_events, write_events
from sentrilake.sources.rules import Criterion, Mitre, Rule, builtin_rules, load_rules

RULES = builtin_rules()
RULE_FOLDER = str(Path(__file__).resolve().parents[2] / "rules")

# ---- filters ---------------------------------------------------------------

# name -> (predicate, the same condition in SQL)
_FILTERS = {
    "find_type_equals": (lambda: pred("type", "=", "filewrite"), "event_type = 'FileWrite'"),
    "find_type_contains": (
        lambda: pred("event_type", "CONTAINS", "process"), "event_type LIKE 'Process%'"
    ),
    "find_type_starts_with": (
        lambda: pred("event.type", "STARTS_WITH", "Dns"), "event_type LIKE 'Dns%'"
    ),
    "find_process_equals": (
        lambda: pred("process.name", "=", "PROC3.exe"), "process_name = 'proc3.exe'"
    ),
    "find_process_contains": (
        lambda: pred("executable", "CONTAINS", "C7."), "process_name LIKE '%c7.%'"
    ),
    "find_pid_range": (
        lambda: pred("pid", ">=", 103) & pred("process.pid", "<", "105.5"),
        "pid >= 103 AND pid < 105.5",
    ),
    "find_pid_fraction": (lambda: pred("pid", "=", 103.5), "false"),
    "find_algorithm": (
        lambda: pred("crypto.algorithm", "STARTS_WITH", "AES"),
        "event_type = 'CryptoOperation' AND lower(algorithm) LIKE 'aes%'",
    ),
    "find_provider": (
        lambda: pred("provider", "!=", "openssl"),
        "event_type = 'CryptoOperation' AND lower(provider) <> 'openssl'",
    ),
    "find_external": (
        lambda: pred("network.external", "=", True),
        "event_type = 'NetworkConnect' AND is_external",
    ),
    "find_external_text": (
        lambda: pred("network.is_external", "!=", "TRUE"),
        "event_type = 'NetworkConnect' AND NOT is_external",
    ),
    "find_address": (
        lambda: pred("network.dst_ip", "STARTS_WITH", "10.0.0.1"),
        "event_type = 'NetworkConnect' AND remote_address LIKE '10.0.0.1%'",
    ),
    "find_port": (
        lambda: pred("network.remote_port", ">", 443),
        "event_type = 'NetworkConnect' AND remote_port > 443",
    ),
    "find_port_not_equal": (
        lambda: pred("network.dst_port", "!=", 443),
        "event_type = 'NetworkConnect' AND remote_port <> 443",
    ),
    "find_path": (
        lambda: pred("file.path", "CONTAINS", "sam"),
        "event_type IN ('FileOpen','FileRead','FileWrite','FileDelete') "
        "AND lower(path) LIKE '%sam%'",
    ),
    "find_confidence": (lambda: pred("confidence", "=", "High"), "confidence = 'HIGH'"),
    "find_privacy": (lambda: pred("privacy", "!=", "public"), "privacy <> 'PUBLIC'"),
    "find_unknown_field": (
        lambda: pred("no.such.field", "=", 1) | pred("pid", "=", 100), "pid = 100"
    ),
    "find_not_unknown_field": (lambda: ~pred("no.such.field", "=", 1), "true"),
    "find_number_as_text": (
        lambda: pred("path", "CONTAINS", 1.0),
        "event_type IN ('FileOpen','FileRead','FileWrite','FileDelete') AND path LIKE '%1%'",
    ),
    "find_not": (
        lambda: ~pred("network.remote_port", "=", 443),
        "NOT coalesce(event_type = 'NetworkConnect' AND remote_port = 443, false)",
    ),
    "find_and_or": (
        lambda: (pred("type", "=", "CryptoOperation") & pred("algorithm", "=", "SHA256"))
        | (pred("type", "=", "NetworkConnect") & ~pred("network.external", "=", True)),
        "(event_type = 'CryptoOperation' AND algorithm = 'SHA256') "
        "OR (event_type = 'NetworkConnect' AND NOT is_external)",
    ),
}


def _filter_query(make, condition: str) -> Query:
    return Query(
        lambda spark, d: find.find_events(session_events(spark, d), make()),
        with_events(f"SELECT {RESULT_ROW} FROM ev WHERE {condition}"),
    )


# ---- helpers ---------------------------------------------------------------


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Old and new session of each user: before and from 16 January."""
    events = session_events(spark, d)
    border = F.lit("2024-01-16").cast("timestamp")
    return (
        events.filter(F.col("timestamp_wall") < border),
        events.filter(F.col("timestamp_wall") >= border),
    )


_KEYS = ["artifact_id"]

_BEHAVIOR_SQL = """behavior AS (
  SELECT artifact_id, ts, process_name, event_type AS behavior_type,
    CASE event_type
      WHEN 'ProcessStart' THEN process_path
      WHEN 'ProcessSpawn' THEN child_path
      WHEN 'FileOpen' THEN CASE WHEN path LIKE '/tmp/%'
        THEN '<TEMP_DIR>/' || substr(path, 6) ELSE path END
      WHEN 'FileWrite' THEN CASE WHEN path LIKE '/tmp/%'
        THEN '<TEMP_DIR>/' || substr(path, 6) ELSE path END
      WHEN 'DnsQuery' THEN lower(dns_name)
      WHEN 'NetworkConnect' THEN CASE WHEN is_external THEN remote_address ELSE 'localhost' END
        || ':' || remote_port
      WHEN 'CryptoOperation' THEN upper(algorithm)
      WHEN 'TlsObserved' THEN tls_version END AS target_resource,
    CASE event_type
      WHEN 'FileOpen' THEN 'r:true w:' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
      WHEN 'NetworkConnect' THEN remote_hostname
      WHEN 'CryptoOperation' THEN provider
      WHEN 'TlsObserved' THEN cipher_suite END AS secondary_attribute
  FROM ev WHERE event_type IN ('ProcessStart','ProcessSpawn','FileOpen','FileWrite','DnsQuery',
    'NetworkConnect','CryptoOperation','TlsObserved')),
old_b AS (SELECT DISTINCT artifact_id, process_name, behavior_type, target_resource,
  secondary_attribute FROM behavior WHERE ts < TIMESTAMP '2024-01-16'),
new_b AS (SELECT DISTINCT artifact_id, process_name, behavior_type, target_resource,
  secondary_attribute FROM behavior WHERE ts >= TIMESTAMP '2024-01-16'),
added AS (SELECT * FROM new_b EXCEPT SELECT * FROM old_b),
removed AS (SELECT * FROM old_b EXCEPT SELECT * FROM new_b),
common AS (SELECT * FROM new_b INTERSECT SELECT * FROM old_b)"""

_DESCRIPTION_SQL = """process_name || ' -> ' || CASE behavior_type
  WHEN 'NetworkConnect' THEN 'network ' || target_resource
  WHEN 'ProcessSpawn' THEN 'spawn ' || target_resource
  WHEN 'CryptoOperation' THEN 'crypto ' || target_resource
    || coalesce(' (' || secondary_attribute || ')', '')
  WHEN 'FileOpen' THEN 'open file ' || target_resource
  WHEN 'FileWrite' THEN 'write file ' || target_resource
  WHEN 'DnsQuery' THEN 'resolve dns ' || target_resource
  ELSE behavior_type || ' ' || target_resource END"""

# Counts per session of the built-in criteria, and the rules that fire.
_SCAN_SQL = """counts AS (
  SELECT artifact_id, count(*) AS total_events,
    count(*) FILTER (event_type = 'FileWrite') AS writes,
    count(*) FILTER (event_type = 'CryptoOperation') AS cryptos,
    count(*) FILTER (event_type = 'NetworkConnect' AND is_external) AS externals,
    count(*) FILTER (event_type = 'FileOpen' AND lower(path) LIKE '%sam%') AS sams,
    count(*) FILTER (event_type = 'ProcessSpawn') AS spawns,
    count(*) FILTER (event_type = 'SocketCreate') AS sockets
  FROM ev GROUP BY artifact_id),
fired AS (
  SELECT artifact_id, 'SEC-001' AS rule_id, 'CRITICAL' AS severity, 100 AS score,
    'Impact' AS tactic, 'T1486: Data Encrypted for Impact' AS technique,
    writes + cryptos AS matched_events FROM counts WHERE writes > 0 AND cryptos > 0
  UNION ALL SELECT artifact_id, 'SEC-002', 'HIGH', 75, 'Command and Control',
    'T1059: Command and Scripting Interpreter', externals FROM counts WHERE externals > 0
  UNION ALL SELECT artifact_id, 'SEC-003', 'HIGH', 75, 'Credential Access',
    'T1003: OS Credential Dumping', sams FROM counts WHERE sams > 0
  UNION ALL SELECT artifact_id, 'SEC-004', 'MEDIUM', 40, 'Defense Evasion',
    'T1218: System Binary Proxy Execution', spawns FROM counts WHERE spawns > 0
  UNION ALL SELECT artifact_id, 'SEC-005', 'LOW', 15, 'Discovery',
    'T1046: Network Service Discovery', sockets FROM counts WHERE sockets > 0)"""

_RISK_SQL = """risk AS (
  SELECT c.artifact_id, total_events,
    CAST(least(100, coalesce(sum(f.score), 0)) AS INT) AS risk_score,
    CAST(count(f.rule_id) AS INT) AS alert_count
  FROM counts c LEFT JOIN fired f USING (artifact_id) GROUP BY c.artifact_id, total_events)"""

_BAND_SQL = """CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 40 THEN 'ELEVATED'
  WHEN risk_score > 0 THEN 'LOW RISK' ELSE 'BENIGN / CLEAN' END AS risk_band"""

# Rules that use every kind of condition, minimum counts and zero minimums.
EXTRA_RULES = [
    Rule(
        "T-1", "bulk writes", "HIGH", "check",
        (Criterion("filewrite", target_resource_contains="/DATA/", min_event_count=3),
         Criterion("DnsQuery", target_resource_contains="site", min_event_count=0)),
    ),
    Rule(
        "T-2", "named process", "INFO", "check",
        (Criterion(process_name_contains="PROC4"),), Mitre("Discovery", "T1", "Name"),
    ),
    Rule("T-3", "never", "LOW", "check", (Criterion("SocketCreate", min_event_count=0),
                                          Criterion("NoSuchType"))),
    Rule("T-4", "internal connect", "LOW", "check",
         (Criterion(is_external_network=False, min_event_count=2),)),
    Rule("T-5", "no criteria", "LOW", "check", ()),
]


def _ndjson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "ndjson")
    sinks.write_ndjson(session_events(spark, d), path)
    back = read_events(spark, path, "ndjson")  # restores the time order as seq
    return back.select(
        "artifact_id", "seq", "event_id", "event_type", "privacy",
        F.col("process_identity.user").alias("user"),
        F.col("data.payload.path").alias("path"),
        F.col("data.payload.content_hash").alias("content_hash"),
        F.array_join("data.payload.environment_keys", ",").alias("environment_keys"),
        F.col("data.payload.address").cast("long").alias("address"),
        F.unix_micros("timestamp_wall").alias("at"),
    )


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "events")
    write_events(session_events(spark, d), path)
    return stats.event_type_counts(read_corpus(spark, path, exclude="7"))


def _csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sinks.write_csv(session_events(spark, d), path)
    schema = "event_id string, event_type string, process_name string, pid long, " \
             "confidence string, privacy string"
    return spark.read.schema(schema).option("header", True).csv(path)


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    url = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return load(spark, d, "pages").select("page_id", url.alias("host"))


_HOSTS_SQL = """hosts AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)"""


def _label_entropy_sql(source: str, ident: str, text: str) -> str:
    """Entropy of the lower-cased first label, from counted bytes."""
    return f"""labels_ AS (
  SELECT {ident}, lower(split_part({text}, '.', 1)) AS label FROM {source}),
letters AS (
  SELECT {ident}, label, unnest(regexp_extract_all(hex(encode(label)), '..')) AS b FROM labels_),
per_byte AS (SELECT {ident}, label, b, count(*) AS n FROM letters GROUP BY ALL),
entropy AS (
  SELECT {ident}, label, abs(sum((n / strlen(label)) * log2(n / strlen(label)))) AS h
  FROM per_byte GROUP BY ALL),
dga AS (
  SELECT l.{ident}, coalesce(h, 0) AS h, strlen(l.label) >= 8 AND (
    (coalesce(h, 0) > 3.65
      AND length(regexp_replace(l.label, '[^aeiou]', '', 'g')) / strlen(l.label) < 0.18)
    OR (length(regexp_replace(l.label, '[^0-9]', '', 'g')) > 5 AND coalesce(h, 0) > 3.2)
    OR (length(regexp_replace(l.label, '[^\\p{{L}}]', '', 'g'))
      - length(regexp_replace(l.label, '[^aeiou]', '', 'g')) > 9
      AND length(regexp_replace(l.label, '[^aeiou]', '', 'g')) <= 1)) AS is_dga
  FROM labels_ l LEFT JOIN entropy e USING ({ident}))"""


def _with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.col("raw_evidence")["k"].cast("int"))


def _tls_rows(spark: SparkSession, d: str) -> DataFrame:
    """TLS hellos of the events; every tenth carries a listed fingerprint."""
    rows = _with_k(session_events(spark, d)).filter(F.col("event_type") == "TlsObserved")
    k = F.col("k")
    hello = (
        F.lit(771),
        F.array(F.lit(4865) + k % 3, F.lit(4866), F.lit(49195)),
        F.array(F.lit(0), k % 17, F.lit(65281)),
        F.when(k % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(29), F.lit(23))),
        F.array(F.lit(0)),
    )
    return rows.select(
        "artifact_id", "event_id", "k", ja3_string(*hello).alias("ja3_string"),
        ja3_hash(*hello).alias("ja3_hash"),
    )


_JA3_SQL = """tls AS (
  SELECT artifact_id, event_id, k, concat('771,', CAST(4865 + k % 3 AS VARCHAR), '-4866-49195,0-',
    CAST(k % 17 AS VARCHAR), '-65281,', CASE WHEN k % 4 = 0 THEN '' ELSE '29-23' END, ',0')
    AS ja3_string FROM ev WHERE event_type = 'TlsObserved')"""


def _known_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    listed = "A0E9F5D64349FB13191BC781F81F42E1"
    rows = _tls_rows(spark, d).withColumn(
        "ja3_hash", F.when(F.col("k") % 10 == 0, F.lit(listed)).otherwise(F.col("ja3_hash"))
    )
    return detect.malicious_fingerprints(rows).select("artifact_id", "event_id", "ja3_hash", "threat")


def _node_events(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "register").when(
        F.col("event_type") == "error", "incident"
    )
    return raw.select(
        F.col("user_id").alias("node_id"),
        F.col("ts").cast("timestamp").alias("at"),
        kind.alias("kind"),
        F.concat(F.lit("node-"), F.col("user_id").cast("string"), F.lit("-"),
                 (F.col("event_id") % 3).cast("string")).alias("hostname"),
        F.concat(F.lit("10.1.0."), (F.col("event_id") % 250).cast("string")).alias("ip_address"),
        F.lit("Linux").alias("os_name"),
    ).filter(F.col("kind").isNotNull())


_FLEET_SQL = """SELECT user_id AS node_id,
  arg_max('node-' || user_id || '-' || (event_id % 3), ts)
    FILTER (event_type = 'signup') AS hostname,
  arg_max('10.1.0.' || (event_id % 250), ts) FILTER (event_type = 'signup') AS ip_address,
  CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'Linux' END AS os_name,
  count(*) FILTER (event_type = 'error') AS incidents,
  epoch_us(max(ts)) AS last_heartbeat, 'ONLINE (HEALTHY)' AS status
FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id"""


def fleet_columns(status: DataFrame) -> DataFrame:
    return status.withColumn("last_heartbeat", F.unix_micros("last_heartbeat"))


def _ingest_records(spark: SparkSession, d: str) -> DataFrame:
    return _with_k(session_events(spark, d)).select(
        "host_id",
        "collector",
        (F.col("k") % 13 == 0).alias("is_error"),
        (F.col("k") % 17 == 1).alias("is_dropped"),
    )


def _sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    hosts = _hosts(spark, d)
    return hosts.select(
        "page_id",
        F.expr("round(domain_entropy(host), 6)").alias("entropy"),
        F.expr("is_likely_dga(host)").alias("is_dga"),
        F.expr("canonical_process_name(concat('/srv/', host))").alias("name"),
        F.expr(
            "cosine_similarity(array(1D, 0D), array(cast(page_id % 2 as double), 0.5D))"
        ).alias("cosine"),
    )


def _beacons(keys: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = beacon.beacon_profiles(session_events(spark, d), keys)
        return out.select(
            *keys, "sample_count", "target",
            F.round("mean_interval_seconds", 4).alias("mean_interval_seconds"),
            F.round("jitter_percentage", 4).alias("jitter_percentage"),
            "is_beaconing", "confidence", "suricata_rule",
            F.regexp_replace("snort_rule", "jitter [0-9.]+ percent", "jitter").alias("snort_rule"),
        )

    return run


def _beacon_sql(keys: str) -> str:
    return with_events(
        f"""SELECT {keys}, sample_count, target, round(m, 4) AS mean_interval_seconds,
  round(100 * s / m, 4) AS jitter_percentage,
  m BETWEEN 1 AND 600 AND 100 * s / m <= 35 AS is_beaconing,
  CASE WHEN m BETWEEN 1 AND 600 AND 100 * s / m <= 35 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence,
  'alert tcp any any -> ' || regexp_replace(target, ':[0-9]+$', '') || ' any (msg:"sentrilake: host calls back at even intervals"; '
    || 'flow:to_server,established; threshold:type both, track by_src, count 5, seconds ' || CAST(floor(m * 5) AS BIGINT)
    || '; classtype:bad-unknown; sid:4710011; rev:1;)' AS suricata_rule,
  'alert ip $HOME_NET any -> ' || regexp_replace(target, ':[0-9]+$', '') || ' any (msg:"sentrilake: even call-backs, jitter"; '
    || 'detection_filter:track by_src, count 5, seconds ' || CAST(floor(m * 5) AS BIGINT) || '; sid:4710012; rev:1;)' AS snort_rule
FROM heads JOIN (SELECT {keys}, avg(gap) AS m, stddev_pop(gap) AS s FROM gaps WHERE gap > 0
  GROUP BY {keys} HAVING count(*) >= 2) USING ({keys}) WHERE sample_count >= 3""",
        more=f"""connects AS (
  SELECT artifact_id, process_name AS process, remote_address || ':' || remote_port AS destination,
    epoch_us(ts) AS us, event_id FROM ev WHERE event_type = 'NetworkConnect'),
gaps AS (
  SELECT {keys}, (us - lag(us) OVER (PARTITION BY {keys} ORDER BY us)) // 1000000 AS gap
  FROM connects),
heads AS (
  SELECT {keys}, count(*) AS sample_count, arg_min(destination, (us, event_id)) AS target
  FROM connects GROUP BY {keys})""",
    )


def _explain(spark: SparkSession, d: str) -> DataFrame:
    out = explain.explain_incidents(daily_events(spark, d), RULES)
    return out.select(
        "artifact_id", "root_process", "risk_score", "summary",
        F.md5(F.array_join("observations", "\n")).alias("observations_md5"),
        F.md5(F.array_join("actions", "\n")).alias("actions_md5"),
        F.md5("yara_rule").alias("yara_md5"), F.md5("sigma_rule").alias("sigma_md5"),
    )


def _explain_sql() -> str:
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rules = ", ".join(f"({text(r.id)}, {text(r.title)}, {text(r.remediation)}, {i})" for i, r in enumerate(RULES))
    tiers = " ".join(f"WHEN risk_score >= {least} THEN {text(tier)}" for least, tier, _ in explain.TIERS)
    steps = " ".join(
        f"WHEN risk_score >= {least} THEN replace({text(step)}, '{{}}', root_process)" for least, _, step in explain.TIERS
    )
    return f"""SELECT r.artifact_id, root_process, risk_score,
  root_process || ': ' || alert_count || ' of {len(RULES)} rules matched in ' || total_events || ' events' AS summary,
  md5(concat_ws(chr(10), findings, 'Score ' || risk_score || ' of 100, tier ' || CASE {tiers} END)) AS observations_md5,
  md5(concat_ws(chr(10), remediations, CASE {steps} END)) AS actions_md5,
  md5('rule sentrilake_session_' || substr(r.artifact_id, 1, 8) || chr(10) || '{{' || chr(10)
    || '  meta:' || chr(10) || '    session = "' || r.artifact_id || '"' || chr(10)
    || '    risk = ' || risk_score || chr(10) || '  strings:' || chr(10)
    || '    $root_program = "' || root_process || '"' || chr(10) || '  condition:' || chr(10)
    || '    $root_program' || chr(10) || '}}') AS yara_md5,
  md5('title: Program of a risky session - ' || root_process || chr(10) || 'id: '
    || regexp_replace(md5('sigma:' || r.artifact_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
    || chr(10) || 'status: experimental' || chr(10)
    || 'description: Starts of the root program of a session that the rule scan rated' || chr(10)
    || 'logsource:' || chr(10) || '  category: process_creation' || chr(10) || 'detection:' || chr(10)
    || '  selection:' || chr(10) || '    Image|endswith: ''' || root_process || '''' || chr(10)
    || '  condition: selection' || chr(10) || 'level: '
    || CASE WHEN risk_score >= 75 THEN 'critical' ELSE 'high' END || chr(10)) AS sigma_md5
FROM risk r JOIN (SELECT artifact_id, arg_min(process_name, num_id) AS root_process FROM ev GROUP BY 1) USING (artifact_id)
LEFT JOIN (SELECT artifact_id,
    string_agg(rule_id || ' (' || lower(severity) || ', ' || matched_events || ' events): ' || title || '; compare ' || technique,
      chr(10) ORDER BY score DESC, place) AS findings,
    string_agg(remediation, chr(10) ORDER BY score DESC, place) AS remediations
  FROM fired JOIN (VALUES {rules}) AS known(rule_id, title, remediation, place) USING (rule_id)
  GROUP BY 1) USING (artifact_id)"""


def _sarif(spark: SparkSession, d: str) -> DataFrame:
    docs = sinks.to_sarif(daily_events(spark, d), RULES)
    return docs.select(
        "artifact_id",
        F.get_json_object("sarif", "$.version").alias("version"),
        F.explode_outer(
            F.from_json(
                F.get_json_object("sarif", "$.runs[0].results"),
                "array<struct<ruleId:string,level:string>>",
            )
        ).alias("r"),
    ).select("artifact_id", "version", "r.*")


def _stix(spark: SparkSession, d: str) -> DataFrame:
    docs = sinks.to_stix(session_events(spark, d), per_bundle=25)
    objects = F.from_json(
        F.get_json_object("bundle", "$.objects[0].objects"),
        "map<string,struct<type:string,pid:bigint,name:string,command_line:string>>",
    )
    return docs.select(
        "artifact_id", "part",
        F.get_json_object("bundle", "$.objects[0].number_observed").cast("long").alias("observed"),
        F.explode_outer(objects).alias("position", "sco"),
    ).select(
        "artifact_id", "part", "observed", F.col("position").cast("long").alias("position"),
        F.col("sco.pid").alias("pid"), F.col("sco.name").alias("name"),
        F.col("sco.command_line").alias("command_line"),
    )


def _context(spark: SparkSession, d: str) -> DataFrame:
    docs = sinks.incident_context(session_events(spark, d), RULES)
    return docs.select(
        "artifact_id",
        F.regexp_extract("markdown", r"events: (\d+)", 1).cast("long").alias("events"),
        F.regexp_extract("markdown", r"risk score: (\d+)", 1).cast("int").alias("risk_score"),
        F.regexp_count("markdown", F.lit(r'\{"event_id":"')).alias("samples"),
    )


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return search.behavior_vectors(session_events(spark, d)).select(
        "artifact_id", F.posexplode("vector").alias("dimension", "value")
    ).select("artifact_id", "dimension", F.round("value", 6).alias("value"))


def _similar(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    out = search.search_similar(vectors, 0, threshold=0.05, key="vec_id")
    return out.select("vec_id", F.round("similarity", 5).alias("similarity"), "label")


def _similar_many(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "embeddings")
    vectors = raw.select("vec_id", F.col("embedding").alias("vector"))
    queries = raw.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    out = search.search_similar_many(vectors, queries, threshold=0.1, key="vec_id")
    return out.select("vec_id", "query_id", F.round("similarity", 5).alias("similarity"), "label")


def _similar_sessions(spark: SparkSession, d: str) -> DataFrame:
    vectors = search.behavior_vectors(session_events(spark, d))
    out = search.search_similar(vectors, "1")
    return out.select("artifact_id", F.round("similarity", 5).alias("similarity"), "label")


_COSINE_SQL = """list_sum(list_transform(list_zip(a.embedding, b.embedding),
  lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"""
_LABEL_SQL = "CASE WHEN s >= 0.9 THEN 'HIGHLY SIMILAR (VARIANT)' ELSE 'RELATED' END AS label"

_TYPE_SUMS = ", ".join(
    f"count(*) FILTER (event_type = '{t}')" for t in search.VECTOR_TYPES
)
_TYPE_LIST = ", ".join(f"'{t}'" for t in search.VECTOR_TYPES)
_VECTOR_SQL = f"""raw_vec AS (
  SELECT artifact_id, [{_TYPE_SUMS}, count(*) FILTER (event_type NOT IN ({_TYPE_LIST})),
    count(DISTINCT path) FILTER (event_type IN ('FileOpen', 'FileWrite')),
    count(DISTINCT remote_address), count(DISTINCT process_name), count(*),
    0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS v FROM ev GROUP BY artifact_id),
vec AS (
  SELECT artifact_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v,
    lambda y: y * y)))) AS embedding FROM raw_vec)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    hits = match_sequence(session_events(spark, d), ["fileopen", "FileWrite", "FileOpen"])
    return hits.select("artifact_id", "hit", "step", *fields.result_row())


def _process_matches(spark: SparkSession, d: str) -> DataFrame:
    events = session_events(spark, d).withColumn("pid", fields.pid())
    hits = match_sequence(events, ["FileWrite", "CryptoOperation"], ["artifact_id", "pid"])
    return hits.select("artifact_id", "pid", "hit", "step", "event_id")


def _role_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations")
    return match_sequence(
        rows, ["user", "assistant", "user"], ["conv_id"], ["turn", "role"], label="role"
    ).select("conv_id", "turn", "hit", "step")


def _sequence_sql(keys: str, order: str, label: str, wanted: list[str], source: str, out: str) -> str:
    k = len(wanted)
    leads = " AND ".join(
        f"lead({label}, {i}) OVER w = '{name}'" if i else f"{label} = '{name}'"
        for i, name in enumerate(wanted)
    )
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS pos FROM {source}),
starts AS (
  SELECT {keys}, pos AS hit FROM (SELECT {keys}, pos, {leads} AS ok FROM numbered
    WINDOW w AS (PARTITION BY {keys} ORDER BY pos)) WHERE ok),
hits AS (
  SELECT n.*, s.hit, CAST(n.pos - s.hit AS INT) AS step FROM numbered n JOIN starts s
    ON {' AND '.join(f'n.{c.strip()} = s.{c.strip()}' for c in keys.split(','))}
    AND n.pos BETWEEN s.hit AND s.hit + {k - 1})
{out}"""


_SEQ_EVENTS = with_events("", more=_sequence_sql(
    "artifact_id", "num_id", "event_type", ["FileOpen", "FileWrite", "FileOpen"], "ev",
    f"SELECT {RESULT_ROW.replace('num_id AS seq, ', 'hit, step, ')} FROM hits"))
_SEQ_PROCESS = with_events("", more=_sequence_sql(
    "artifact_id, pid", "num_id", "event_type", ["FileWrite", "CryptoOperation"], "ev",
    "SELECT artifact_id, pid, hit, step, event_id FROM hits"))
_SEQ_ROLES = "WITH " + _sequence_sql(
    "conv_id", "turn, role", "role", ["user", "assistant", "user"], "conversations",
    "SELECT conv_id, turn, hit, step FROM hits")


def _category(name: str, scheme: str) -> str:
    members = ", ".join(f"'{t}'" for t in CATEGORY_SCHEMES[scheme][name])
    return f"count(*) FILTER (event_type IN ({members}))"


def _time_text(spark: SparkSession, d: str) -> DataFrame:
    return session_events(spark, d).select("event_id", fields.wall_text().alias("wall"))


_PRIVACY_RANK = "CASE privacy WHEN 'PUBLIC' THEN 1 WHEN 'INTERNAL' THEN 2 WHEN 'SENSITIVE' THEN 3 ELSE 4 END"


def _sanitized(allowed: str, redact_raw_evidence: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        clean = privacy.sanitize_events(
            session_events(spark, d), allowed, redact_raw_evidence=redact_raw_evidence
        )
        return clean.select(
            "event_id", "event_type", "privacy",
            F.col("process_identity.user").alias("user"),
            F.col("data.payload.content_hash").alias("content_hash"),
            F.array_join("data.payload.environment_keys", ",").alias("environment_keys"),
            F.size("raw_evidence").alias("raw_entries"),
        )

    return run


def _sanitized_sql(rank: int, raw_entries: int) -> str:
    return with_events(f"""SELECT event_id, event_type, privacy,
  CASE WHEN user_name IS NOT NULL THEN '[REDACTED_USER]' END AS user,
  CASE WHEN event_type = 'FileWrite' AND privacy = 'SENSITIVE' THEN '[REDACTED_HASH]'
    WHEN event_type = 'FileWrite' AND k % 2 = 0 THEN md5(path) END AS content_hash,
  CASE WHEN event_type = 'ProcessStart' THEN 'PATH,HOME' END AS environment_keys,
  {raw_entries} AS raw_entries FROM ev WHERE {_PRIVACY_RANK} <= {rank}""")


EVENT_QUERIES: dict[str, Query] = {
    name: _filter_query(make, condition) for name, (make, condition) in _FILTERS.items()
}
EVENT_QUERIES |= {
    "find_limit": Query(
        lambda s, d: find.find_events(session_events(s, d), pred("type", "=", "FileOpen"), 25),
        with_events(
            f"SELECT {RESULT_ROW} FROM ev WHERE event_type = 'FileOpen' "
            "ORDER BY artifact_id, num_id LIMIT 25"
        ),
    ),
    "find_limit_zero": Query(
        lambda s, d: find.find_events(session_events(s, d), limit=0),
        with_events(f"SELECT {RESULT_ROW} FROM ev ORDER BY artifact_id, num_id LIMIT 1"),
    ),
    "find_all": Query(
        lambda s, d: find.find_all(session_events(s, d)), with_events(f"SELECT {RESULT_ROW} FROM ev")
    ),
    "find_network_connections": Query(
        lambda s, d: find.find_network_connections(session_events(s, d)),
        with_events(f"SELECT {RESULT_ROW} FROM ev WHERE event_type = 'NetworkConnect'"),
    ),
    "find_crypto_operations": Query(
        lambda s, d: find.find_crypto_operations(session_events(s, d)),
        with_events(f"SELECT {RESULT_ROW} FROM ev WHERE event_type = 'CryptoOperation'"),
    ),
    "text_search": Query(
        lambda s, d: find.text_search(session_events(s, d), "proC3.exe103"),
        with_events(
            f"SELECT {RESULT_ROW} FROM ev WHERE lower(substr(event_id, 1, 8) || event_type || "
            "process_name || pid || confidence || CAST(ts AS VARCHAR)) LIKE '%proc3.exe103%'"
        ),
    ),
    "wall_text": Query(
        _time_text,
        with_events("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S')
  || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
    WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0')
    ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || ' UTC' AS wall FROM ev"""),
    ),
    "event_summary": Query(
        lambda s, d: session_events(s, d).select(
            "event_id", fields.process_name().alias("process"),
            fields.event_summary().alias("summary"),
        ),
        with_events(f"SELECT event_id, process_name AS process, {SUMMARY} AS summary FROM ev"),
    ),
    "event_categories": Query(
        lambda s, d: session_events(s, d)
        .groupBy(
            "event_type", *[fields.event_category(c).alias(c) for c in ("manifest", "inspect", "tree")]
        )
        .agg(F.count("*").alias("n")),
        with_events("""SELECT event_type,
  CASE WHEN event_type LIKE 'Process%' THEN 'process' WHEN event_type LIKE 'File%' THEN 'file'
    WHEN event_type LIKE 'Network%' OR event_type = 'SocketCreate' THEN 'network'
    WHEN event_type LIKE 'Dns%' THEN 'dns'
    WHEN event_type IN ('CryptoOperation', 'TlsObserved') THEN 'crypto' END AS manifest,
  CASE WHEN event_type LIKE 'File%' THEN 'file' WHEN event_type LIKE 'Network%' THEN 'network'
    WHEN event_type LIKE 'Dns%' THEN 'dns'
    WHEN event_type IN ('CryptoOperation', 'TlsObserved') THEN 'crypto' END AS inspect,
  CASE WHEN event_type LIKE 'File%' THEN 'file'
    WHEN event_type LIKE 'Network%' OR event_type LIKE 'Dns%' THEN 'network'
    WHEN event_type IN ('CryptoOperation', 'TlsObserved') THEN 'crypto' END AS tree,
  count(*) AS n FROM ev GROUP BY ALL"""),
    ),
    # ---- sources and sinks
    "ndjson_roundtrip": Query(
        _ndjson_roundtrip,
        with_events(f"""SELECT artifact_id,
  row_number() OVER (PARTITION BY artifact_id ORDER BY ts, num_id, event_id) - 1 AS seq, event_id,
  event_type, privacy, CASE WHEN user_name IS NOT NULL THEN '[REDACTED_USER]' END AS user, path,
  CASE WHEN event_type = 'FileWrite' AND k % 2 = 0 THEN md5(path) END AS content_hash,
  CASE WHEN event_type = 'ProcessStart' THEN 'PATH,HOME' END AS environment_keys,
  CAST(address AS BIGINT) AS address, epoch_us(ts) AS at
FROM ev WHERE {_PRIVACY_RANK} <= 2"""),
    ),
    "corpus_without_query_session": Query(
        _corpus,
        with_events(
            "SELECT artifact_id, event_type, count(*) AS n FROM ev "
            "WHERE artifact_id <> '7' GROUP BY ALL"
        ),
    ),
    "csv_export": Query(
        _csv_roundtrip,
        with_events(
            "SELECT event_id, event_type, process_name, pid, confidence, privacy FROM ev "
            f"WHERE {_PRIVACY_RANK} <= 2"
        ),
    ),
    "stix_export": Query(
        _stix,
        with_events(
            """SELECT artifact_id, p // 25 AS part,
  count(*) OVER (PARTITION BY artifact_id, p // 25) AS observed, p AS position, pid,
  process_name AS name, process_path AS command_line FROM kept
UNION ALL SELECT DISTINCT artifact_id, 0, 0, NULL, NULL, NULL, NULL FROM ev
WHERE artifact_id NOT IN (SELECT artifact_id FROM kept)""",
            more=f"""kept AS (SELECT *,
  row_number() OVER (PARTITION BY artifact_id ORDER BY num_id) - 1 AS p
  FROM ev WHERE {_PRIVACY_RANK} <= 2)""",
        ),
    ),
    "sarif_export": Query(
        _sarif,
        with_events(
            "SELECT artifact_id, '2.1.0' AS version, rule_id AS ruleId, CASE WHEN rule_id IS NULL "
            "THEN NULL WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' "
            "THEN 'warning' ELSE 'note' END AS level "
            "FROM (SELECT DISTINCT artifact_id FROM ev) LEFT JOIN fired USING (artifact_id)",
            daily=True,
            more=f"kept AS (SELECT * FROM ev WHERE {_PRIVACY_RANK} <= 2), "
            + _SCAN_SQL.replace("FROM ev", "FROM kept"),
        ),
    ),
    "incident_context": Query(
        _context,
        with_events(
            "SELECT artifact_id, coalesce(total_events, 0) AS events, "
            "CAST(coalesce(risk_score, 0) AS INT) AS risk_score, "
            "CAST(least(50, coalesce(total_events, 0)) AS INT) AS samples "
            "FROM (SELECT DISTINCT artifact_id FROM ev) LEFT JOIN risk USING (artifact_id)",
            more=f"kept AS (SELECT * FROM ev WHERE {_PRIVACY_RANK} <= 2), "
            + _SCAN_SQL.replace("FROM ev", "FROM kept") + ", " + _RISK_SQL,
        ),
    ),
    # ---- aggregates
    "event_type_counts": Query(
        lambda s, d: stats.event_type_counts(session_events(s, d)),
        with_events("SELECT artifact_id, event_type, count(*) AS n FROM ev GROUP BY ALL"),
    ),
    "category_count_map": Query(
        lambda s, d: stats.category_counts(session_events(s, d)).select(
            "artifact_id", F.explode("event_category_counts").alias("event_type", "n")
        ),
        with_events("SELECT artifact_id, event_type, count(*) AS n FROM ev GROUP BY ALL"),
    ),
    "session_manifest": Query(
        lambda s, d: stats.session_manifest(session_events(s, d))
        .withColumn("command", F.array_join("command", " "))
        .withColumn("start_time", F.unix_micros("start_time"))
        .withColumn("end_time", F.unix_micros("end_time")),
        with_events(f"""SELECT artifact_id, arg_min(process_path, num_id) AS command,
  arg_min(pid, num_id) AS target_pid, 'linux' AS platform, epoch_us(min(ts)) AS start_time,
  epoch_us(max(ts)) AS end_time, count(*) AS total_events,
  {_category('process', 'manifest')} AS process_events, {_category('file', 'manifest')} AS file_events,
  {_category('network', 'manifest')} AS network_events, {_category('dns', 'manifest')} AS dns_events,
  {_category('crypto', 'manifest')} AS crypto_events,
  (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, CAST(0 AS BIGINT) AS dropped_events
FROM ev GROUP BY artifact_id"""),
    ),
    "inspect_summary": Query(
        lambda s, d: stats.inspect_summary(session_events(s, d)),
        with_events(f"""SELECT artifact_id, count(*) AS total_events,
  {_category('file', 'inspect')} AS filesystem_ops, {_category('network', 'inspect')} AS network_flows,
  {_category('dns', 'inspect')} AS dns_queries, {_category('crypto', 'inspect')} AS crypto_ops,
  (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms FROM ev GROUP BY artifact_id"""),
    ),
    "network_destinations": Query(
        lambda s, d: stats.network_destinations(session_events(s, d)),
        with_events("""SELECT * FROM (SELECT artifact_id, remote_address || ':' || remote_port AS destination,
  count(*) AS events, CAST(row_number() OVER (PARTITION BY artifact_id
    ORDER BY remote_address || ':' || remote_port) AS INT) AS position
  FROM ev WHERE event_type = 'NetworkConnect' GROUP BY 1, 2) WHERE position <= 10"""),
    ),
    "network_destinations_by_count": Query(
        lambda s, d: stats.network_destinations(session_events(s, d), 5, by="count"),
        with_events("""SELECT * FROM (SELECT artifact_id, remote_address || ':' || remote_port AS destination,
  count(*) AS events, CAST(row_number() OVER (PARTITION BY artifact_id
    ORDER BY count(*) DESC, remote_address || ':' || remote_port) AS INT) AS position
  FROM ev WHERE event_type = 'NetworkConnect' GROUP BY 1, 2) WHERE position <= 5"""),
    ),
    "crypto_operations": Query(
        lambda s, d: stats.crypto_operations(session_events(s, d)),
        with_events("""SELECT * FROM (SELECT artifact_id, num_id AS seq, CASE event_type
    WHEN 'CryptoOperation' THEN CASE crypto_category WHEN 'HASH' THEN 'Hash' ELSE 'Encrypt' END
      || ' - ' || algorithm || ' (' || provider || ')'
    ELSE 'TLS - ' || tls_version END AS operation,
  CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY num_id) AS INT) AS position
  FROM ev WHERE event_type IN ('CryptoOperation', 'TlsObserved')) WHERE position <= 10"""),
    ),
    "behavior_vectors": Query(
        _vectors,
        with_events(
            "SELECT artifact_id, CAST(unnest(range(32)) AS INT) AS dimension, "
            "round(unnest(embedding), 6) AS value FROM vec",
            more=_VECTOR_SQL,
        ),
    ),
    "ingest_health": Query(
        lambda s, d: stats.ingest_health(_ingest_records(s, d)),
        with_events("""SELECT host_id, 'collector-' || (k % 3) AS collector,
  count(*) FILTER (k % 13 <> 0 AND k % 17 <> 1) AS events_captured,
  count(*) FILTER (k % 17 = 1) AS events_dropped, count(*) FILTER (k % 13 = 0) AS errors
FROM ev GROUP BY ALL"""),
    ),
    "fleet_status": Query(
        lambda s, d: fleet_columns(stats.fleet_status(_node_events(s, d))), _FLEET_SQL
    ),
    # ---- windows
    "deterministic_order": Query(
        lambda s, d: ordering.deterministic_order(
            session_events(s, d).select("artifact_id", *ordering.TIME_ORDER)
        ).select("artifact_id", "event_id", "ord"),
        with_events("SELECT artifact_id, event_id, ord FROM ev"),
    ),
    "timeline": Query(
        lambda s, d: stats.timeline(session_events(s, d)).withColumn(
            "timestamp_wall", F.unix_micros("timestamp_wall")
        ),
        with_events("""SELECT * FROM (SELECT artifact_id, num_id AS seq, epoch_us(ts) AS timestamp_wall,
  substr(event_id, 1, 8) AS event_id, event_type, process_name AS process, pid, confidence,
  event_type = 'CryptoOperation' AS is_threat,
  CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY num_id) AS INT) AS position
  FROM ev) WHERE position <= 50"""),
    ),
    "match_sequence": Query(_matches, _SEQ_EVENTS),
    "match_sequence_by_process": Query(_process_matches, _SEQ_PROCESS),
    "match_sequence_roles": Query(_role_matches, _SEQ_ROLES),
    # ---- diff
    "canonical_behaviors": Query(
        lambda s, d: diff.canonical_behaviors(session_events(s, d)),
        with_events(
            "SELECT DISTINCT artifact_id, process_name, behavior_type, target_resource, "
            "secondary_attribute FROM behavior",
            more=_BEHAVIOR_SQL,
        ),
    ),
    "behavior_changes": Query(
        lambda s, d: diff.behavior_changes(*_halves(s, d), _KEYS),
        with_events(
            f"SELECT artifact_id, 'added' AS change, * EXCLUDE (artifact_id), {_DESCRIPTION_SQL} "
            f"AS description FROM added UNION ALL SELECT artifact_id, 'removed', "
            f"* EXCLUDE (artifact_id), {_DESCRIPTION_SQL} FROM removed",
            more=_BEHAVIOR_SQL,
        ),
    ),
    "behavior_similarity": Query(
        lambda s, d: diff.behavior_similarity(*_halves(s, d), _KEYS).withColumn(
            "similarity", F.round("similarity", 6)
        ),
        with_events(
            """SELECT artifact_id, coalesce(c, 0) AS common, coalesce(o, 0) AS old_behaviors,
  coalesce(n, 0) AS new_behaviors, CASE WHEN coalesce(o, 0) + coalesce(n, 0) = 0 THEN 100.0::DOUBLE
    ELSE round(200.0::DOUBLE * coalesce(c, 0) / (coalesce(o, 0) + coalesce(n, 0)), 6) END AS similarity
FROM (SELECT DISTINCT artifact_id FROM ev)
LEFT JOIN (SELECT artifact_id, count(*) AS c FROM common GROUP BY 1) USING (artifact_id)
LEFT JOIN (SELECT artifact_id, count(*) AS o FROM old_b GROUP BY 1) USING (artifact_id)
LEFT JOIN (SELECT artifact_id, count(*) AS n FROM new_b GROUP BY 1) USING (artifact_id)""",
            more=_BEHAVIOR_SQL,
        ),
    ),
    "behavior_similarity_total": Query(
        lambda s, d: diff.behavior_similarity(*_halves(s, d)).withColumn(
            "similarity", F.round("similarity", 6)
        ),
        with_events(
            """SELECT (SELECT count(*) FROM (SELECT * FROM n2 INTERSECT SELECT * FROM o2)) AS common,
  (SELECT count(*) FROM o2) AS old_behaviors, (SELECT count(*) FROM n2) AS new_behaviors,
  round(200.0::DOUBLE * (SELECT count(*) FROM (SELECT * FROM n2 INTERSECT SELECT * FROM o2))
    / ((SELECT count(*) FROM o2) + (SELECT count(*) FROM n2)), 6) AS similarity""",
            more=_BEHAVIOR_SQL
            + ", o2 AS (SELECT DISTINCT * EXCLUDE (artifact_id) FROM old_b)"
            + ", n2 AS (SELECT DISTINCT * EXCLUDE (artifact_id) FROM new_b)",
        ),
    ),
    "high_risk_divergences": Query(
        lambda s, d: diff.high_risk_divergences(*_halves(s, d), _KEYS),
        with_events(
            """SELECT artifact_id, process_name, behavior_type, target_resource, secondary_attribute,
  'process ' || process_name || CASE behavior_type
    WHEN 'NetworkConnect' THEN ' connects to an outside address not seen before: '
    WHEN 'ProcessSpawn' THEN ' starts a program not seen before: '
    ELSE ' uses an algorithm not seen before: ' END || target_resource AS divergence
FROM added WHERE behavior_type IN ('NetworkConnect', 'ProcessSpawn', 'CryptoOperation')""",
            more=_BEHAVIOR_SQL,
        ),
    ),
    "changed_tls": Query(
        lambda s, d: diff.changed_tls(*_halves(s, d), _KEYS),
        with_events("""SELECT artifact_id, o AS old_value, n AS new_value, 'TLS Protocol' AS category
FROM (SELECT artifact_id,
  arg_min(tls_version, num_id) FILTER (ts < TIMESTAMP '2024-01-16') AS o,
  arg_min(tls_version, num_id) FILTER (ts >= TIMESTAMP '2024-01-16') AS n
  FROM ev WHERE event_type = 'TlsObserved' GROUP BY artifact_id) WHERE o <> n"""),
    ),
    # ---- functions
    "domain_entropy_and_dga": Query(
        lambda s, d: _hosts(s, d).select(
            "page_id",
            F.round(domain_entropy(F.lower("host")), 6).alias("entropy"),
            is_likely_dga(F.col("host")).alias("is_dga"),
        ),
        "WITH " + _HOSTS_SQL + ", " + _label_entropy_sql("hosts", "page_id", "host")
        + " SELECT page_id, round(h, 6) AS entropy, is_dga FROM dga",
    ),
    "sql_functions": Query(
        _sql_functions,
        "WITH " + _HOSTS_SQL + ", " + _label_entropy_sql("hosts", "page_id", "host")
        + " SELECT page_id, round(h, 6) AS entropy, is_dga, host AS name, "
        "CAST(page_id % 2 AS DOUBLE) AS cosine FROM dga JOIN hosts USING (page_id)",
    ),
    "ja3_fingerprints": Query(
        lambda s, d: _tls_rows(s, d).select("artifact_id", "event_id", "ja3_string", "ja3_hash"),
        with_events(
            "SELECT artifact_id, event_id, ja3_string, md5(ja3_string) AS ja3_hash FROM tls",
            more=_JA3_SQL,
        ),
    ),
    "malicious_fingerprints": Query(
        _known_fingerprints,
        with_events("""SELECT artifact_id, event_id, 'A0E9F5D64349FB13191BC781F81F42E1' AS ja3_hash,
  'Cobalt Strike Default Malleable C2' AS threat
FROM ev WHERE event_type = 'TlsObserved' AND k % 10 = 0"""),
    ),
    # ---- detection
    "risk_report": Query(
        lambda s, d: detect.risk_report(daily_events(s, d), RULES),
        with_events(
            f"SELECT artifact_id, risk_score, {_BAND_SQL}, alert_count, 5 AS rules_evaluated FROM risk",
            daily=True, more=f"{_SCAN_SQL}, {_RISK_SQL}",
        ),
    ),
    "risk_report_rule_files": Query(
        lambda s, d: detect.risk_report(daily_events(s, d), load_rules(RULE_FOLDER).rules),
        with_events(
            f"""SELECT artifact_id, CAST(least(100, s) AS INT) AS risk_score,
  CASE WHEN s >= 75 THEN 'CRITICAL' WHEN s >= 40 THEN 'ELEVATED' WHEN s > 0 THEN 'LOW RISK'
    ELSE 'BENIGN / CLEAN' END AS risk_band, CAST(n AS INT) AS alert_count, 8 AS rules_evaluated
FROM (SELECT c.artifact_id, coalesce(f.s, 0) + CASE WHEN dns > 0 THEN 75 ELSE 0 END
    + CASE WHEN tls > 0 THEN 100 ELSE 0 END + CASE WHEN started > 0 THEN 75 ELSE 0 END AS s,
  coalesce(f.n, 0) + CASE WHEN dns > 0 THEN 1 ELSE 0 END + CASE WHEN tls > 0 THEN 1 ELSE 0 END
    + CASE WHEN started > 0 THEN 1 ELSE 0 END AS n
  FROM (SELECT artifact_id, count(*) FILTER (event_type = 'DnsQuery') AS dns,
    count(*) FILTER (event_type = 'TlsObserved') AS tls,
    count(*) FILTER (event_type = 'ProcessStart') AS started FROM ev GROUP BY artifact_id) c
  LEFT JOIN (SELECT artifact_id, sum(score) AS s, count(*) AS n FROM fired GROUP BY 1) f
    USING (artifact_id))""",
            daily=True, more=_SCAN_SQL,
        ),
    ),
    "criterion_counts": Query(
        lambda s, d: detect.criterion_counts(daily_events(s, d), RULES).select(
            "artifact_id", "total_events",
            *[F.col("counts")[i].alias(n) for i, n in enumerate(
                ["writes", "cryptos", "externals", "sams", "spawns", "sockets"])],
        ),
        with_events("SELECT * FROM counts", daily=True, more=_SCAN_SQL),
    ),
    "evaluate_rules": Query(
        lambda s, d: detect.evaluate_rules(daily_events(s, d), RULES).select(
            "artifact_id", "rule_id", "severity", "score", F.col("mitre_tactic").alias("tactic"),
            F.col("mitre_technique").alias("technique"), "matched_events",
        ),
        with_events("SELECT * FROM fired", daily=True, more=_SCAN_SQL),
    ),
    "evaluate_rules_all_conditions": Query(
        lambda s, d: detect.evaluate_rules(daily_events(s, d), EXTRA_RULES).select(
            "artifact_id", "rule_id", "matched_events"
        ),
        with_events(
            """SELECT artifact_id, 'T-1' AS rule_id, w + q AS matched_events FROM c WHERE w >= 3
UNION ALL SELECT artifact_id, 'T-2', p FROM c WHERE p > 0
UNION ALL SELECT artifact_id, 'T-4', i FROM c WHERE i >= 2""",
            daily=True,
            more="""c AS (SELECT artifact_id,
  count(*) FILTER (event_type = 'FileWrite' AND path LIKE '/data/%') AS w,
  count(*) FILTER (event_type = 'DnsQuery' AND lower(dns_name) LIKE '%site%') AS q,
  count(*) FILTER (process_name LIKE 'proc4%') AS p,
  count(*) FILTER (event_type = 'NetworkConnect' AND NOT is_external) AS i
  FROM ev GROUP BY artifact_id)""",
        ),
    ),
    "alert_events": Query(
        lambda s, d: detect.alert_events(daily_events(s, d), RULES),
        with_events(
            """SELECT artifact_id, rule_id, criterion, seq, event_id FROM (
  SELECT artifact_id, num_id AS seq, substr(event_id, 1, 8) AS event_id,
    unnest(CASE WHEN event_type = 'FileWrite' THEN ['SEC-001']
      WHEN event_type = 'CryptoOperation' THEN ['SEC-001']
      WHEN event_type = 'NetworkConnect' AND is_external THEN ['SEC-002']
      WHEN event_type = 'FileOpen' AND lower(path) LIKE '%sam%' THEN ['SEC-003']
      WHEN event_type = 'ProcessSpawn' THEN ['SEC-004']
      WHEN event_type = 'SocketCreate' THEN ['SEC-005'] ELSE [] END) AS rule_id,
    CASE WHEN event_type = 'CryptoOperation' THEN 1 ELSE 0 END AS criterion FROM ev)
SEMI JOIN fired USING (artifact_id, rule_id)""",
            daily=True, more=_SCAN_SQL,
        ),
    ),
    "mitre_coverage": Query(
        lambda s, d: detect.mitre_coverage(detect.evaluate_rules(daily_events(s, d), RULES)),
        with_events(
            "SELECT tactic AS mitre_tactic, technique AS mitre_technique, count(*) AS alerts, "
            "count(DISTINCT artifact_id) AS sessions FROM fired GROUP BY ALL",
            daily=True, more=_SCAN_SQL,
        ),
    ),
    "rwx_memory_alerts": Query(
        lambda s, d: detect.rwx_memory_alerts(session_events(s, d)),
        with_events("""SELECT artifact_id, event_id, process_name, pid,
  'Code prepared in changed memory' AS suspected_technique, 'T1106 / T1055' AS mitre_id,
  'Process ''' || process_name || ''' made memory writable and executable: addr=0x'
    || printf('%X', address) || ' size=4096' AS description
FROM ev WHERE new_permissions = 'PAGE_EXECUTE_READWRITE'"""),
    ),
    "beacon_profiles": Query(_beacons(["artifact_id"]), _beacon_sql("artifact_id")),
    "beacon_profiles_by_destination": Query(
        _beacons(["artifact_id", "process", "destination"]),
        _beacon_sql("artifact_id, process, destination"),
    ),
    "dga_queries": Query(
        lambda s, d: detect.dga_queries(session_events(s, d)),
        with_events(
            "SELECT artifact_id, event_id, dns_name AS query_name FROM ev JOIN dga USING (event_id) "
            "WHERE is_dga",
            more="q AS (SELECT event_id, dns_name FROM ev WHERE event_type = 'DnsQuery'), "
            + _label_entropy_sql("q", "event_id", "dns_name"),
        ),
    ),
    "explain_incidents": Query(
        _explain,
        with_events(
            _explain_sql(),
            daily=True, more=f"{_SCAN_SQL}, {_RISK_SQL}",
        ),
    ),
    # ---- privacy
    "sanitize_events": Query(_sanitized("INTERNAL", False), _sanitized_sql(2, 1)),
    "sanitize_events_sensitive": Query(_sanitized("SENSITIVE", True), _sanitized_sql(3, 0)),
    # ---- search
    "search_similar": Query(
        _similar,
        f"""SELECT vec_id, round(s, 5) AS similarity, {_LABEL_SQL} FROM (
  SELECT a.vec_id, least(1.0, greatest(0.0, {_COSINE_SQL})) AS s
  FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b WHERE a.vec_id <> 0)
WHERE s >= 0.05""",
    ),
    "search_similar_many": Query(
        _similar_many,
        f"""SELECT vec_id, query_id, round(s, 5) AS similarity, {_LABEL_SQL} FROM (
  SELECT a.vec_id, b.vec_id AS query_id, least(1.0, greatest(0.0, {_COSINE_SQL})) AS s
  FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id IN
    (SELECT min(vec_id) FROM embeddings GROUP BY label)) b WHERE a.vec_id <> b.vec_id)
WHERE s >= 0.1""",
    ),
    "search_similar_sessions": Query(
        _similar_sessions,
        with_events(
            f"""SELECT artifact_id, round(s, 5) AS similarity, {_LABEL_SQL} FROM (
  SELECT a.artifact_id, least(1.0, greatest(0.0, {_COSINE_SQL})) AS s
  FROM vec a, (SELECT * FROM vec WHERE artifact_id = '1') b WHERE a.artifact_id <> '1')
WHERE s >= 0.75""",
            more=_VECTOR_SQL,
        ),
    ),
}
