"""Streaming queries. A feed of NDJSON files is written from the events, read as
a stream until the backlog is done, and the resulting table is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrilake.functions.fields import JSON_OPTIONS
from sentrilake.functions.predicates import pred
from sentrilake.plans.adapter import session_events
from sentrilake.plans.event_queries import _FLEET_SQL, _node_events, fleet_columns
from sentrilake.plans.query import EV, RESULT_ROW, Query, with_events
from sentrilake.session import shared_path
from sentrilake.sources.events import read_events_stream
from sentrilake.sources.rules import builtin_rules
from sentrilake.streaming import feed
from sentrilake.streaming.watch import RiskWatch

WATCH_BUFFER = 100


def _lines(events: DataFrame) -> DataFrame:
    record = F.struct(*[c for c in events.columns if c != "seq"])
    return events.select(
        F.to_json(record, JSON_OPTIONS).alias("value"),
        F.col("raw_evidence")["k"].cast("int").alias("k"),
    )


def _feed(spark: SparkSession, d: str, copies: int = 1, damaged: bool = False) -> str:
    """Write the events as NDJSON; ``damaged`` cuts every line with k % 13 = 0."""
    path = shared_path(spark, "feed")
    lines = _lines(session_events(spark, d))
    if damaged:
        short = F.substring("value", 1, 40)
        lines = lines.withColumn("value", F.when(F.col("k") % 13 == 0, short).otherwise(F.col("value")))
    for _ in range(copies):
        lines.select("value").write.mode("append").text(path)
    return path


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = shared_path(spark, "stream")
    feed.append_to_table(stream, path, shared_path(spark, "progress"), once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _find(spark: SparkSession, d: str) -> DataFrame:
    events = feed.accepted_events(read_events_stream(spark, _feed(spark, d)))
    return _run(spark, feed.stream_find(events, pred("type", "=", "NetworkConnect")))


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    events = feed.accepted_events(read_events_stream(spark, _feed(spark, d, copies=2)))
    unique = feed.drop_duplicate_events(events.drop("_corrupt"), "60 days")
    return _run(spark, unique.select("artifact_id", "event_id", "event_type"))


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    events = feed.accepted_events(read_events_stream(spark, _feed(spark, d)))
    scanned = _run(spark, feed.windowed_rule_scan(events, builtin_rules(), "6 hours"))
    return _window_columns(scanned)


def _sliding(spark: SparkSession, d: str) -> DataFrame:
    scanned = feed.windowed_rule_scan(session_events(spark, d), builtin_rules(), "12 hours", "6 hours")
    return _window_columns(scanned)


def _window_columns(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "host_id", F.unix_micros("window_start").alias("window_start"), "total_events",
        F.array_join("fired_rules", ",").alias("fired_rules"), "risk_score",
    )


def _counters(spark: SparkSession, d: str) -> DataFrame:
    """Ingest counters of a feed with damaged lines, a file per batch."""
    records = read_events_stream(spark, _feed(spark, d, damaged=True), max_files_per_trigger=1)
    counts = shared_path(spark, "counts")
    feed.accept_to_table(
        records, shared_path(spark, "stream"), counts, shared_path(spark, "progress"), once=True
    ).awaitTermination()
    return feed.ingest_totals(spark, counts)


def _fleet(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "nodes")
    _node_events(spark, d).write.parquet(path)
    schema = spark.read.parquet(path).schema
    status = feed.fleet_heartbeat(spark.readStream.schema(schema).parquet(path))
    out = shared_path(spark, "fleet")
    feed.updates_to_table(status, out, "node_id", shared_path(spark, "progress"), once=True).awaitTermination()
    return fleet_columns(feed.latest_rows(spark, out, "node_id"))


def _watch(spark: SparkSession, d: str, what: str) -> DataFrame:
    watch = RiskWatch(shared_path(spark, "watch"), buffer=WATCH_BUFFER)
    events = feed.accepted_events(read_events_stream(spark, _feed(spark, d)))
    watch.start(events, shared_path(spark, "progress"), once=True).awaitTermination()
    if what == "incidents":
        return watch.incidents(spark).select(
            "host_id", "total_events", F.array_join("fired_rules", ",").alias("fired_rules"),
            "risk_score",
        )
    return watch.snapshots(spark).select("host_id", "event_id", "event_type")


def _watch_batches(spark: SparkSession, d: str) -> DataFrame:
    """Events in three batches, by the number of the source row: the watch goes on with the files that each part adds."""
    path, progress = shared_path(spark, "feed"), shared_path(spark, "progress")
    lines = _lines(session_events(spark, d))
    watch = RiskWatch(shared_path(spark, "watch"), buffer=WATCH_BUFFER)
    for part in range(3):
        lines.where(F.col("k") % 3 == part).select("value").write.mode("append").text(path)
        events = feed.accepted_events(read_events_stream(spark, path))
        watch.start(events, progress, once=True).awaitTermination()
    return watch.incidents(spark).select(
        "batch", "host_id", "total_events", F.array_join("fired_rules", ",").alias("fired_rules"), "risk_score")


def _rules_sql(keys: str, source: str) -> str:
    """Fired rules and risk per group of ``source``."""
    return f"""SELECT {keys}, n AS total_events, concat_ws(',',
    CASE WHEN w > 0 AND c > 0 THEN 'SEC-001' END, CASE WHEN x > 0 THEN 'SEC-002' END,
    CASE WHEN s > 0 THEN 'SEC-003' END, CASE WHEN p > 0 THEN 'SEC-004' END,
    CASE WHEN o > 0 THEN 'SEC-005' END) AS fired_rules,
  CAST(least(100, CASE WHEN w > 0 AND c > 0 THEN 100 ELSE 0 END + CASE WHEN x > 0 THEN 75 ELSE 0 END
    + CASE WHEN s > 0 THEN 75 ELSE 0 END + CASE WHEN p > 0 THEN 40 ELSE 0 END
    + CASE WHEN o > 0 THEN 15 ELSE 0 END) AS INT) AS risk_score
FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (event_type = 'FileWrite') AS w,
  count(*) FILTER (event_type = 'CryptoOperation') AS c,
  count(*) FILTER (event_type = 'NetworkConnect' AND is_external) AS x,
  count(*) FILTER (event_type = 'FileOpen' AND lower(path) LIKE '%sam%') AS s,
  count(*) FILTER (event_type = 'ProcessSpawn') AS p,
  count(*) FILTER (event_type = 'SocketCreate') AS o FROM {source} GROUP BY {keys})"""


_SIX_HOURS = 6 * 3600 * 1_000_000
_LAST_SQL = f"""last_n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id
  ORDER BY ts DESC, num_id DESC, event_id DESC) AS rn FROM ev) WHERE rn <= {WATCH_BUFFER})"""
_INCIDENTS_SQL = f"incidents AS (SELECT * FROM ({_rules_sql('host_id', 'last_n')}) WHERE risk_score >= 75)"

STREAM_QUERIES: dict[str, Query] = {
    "stream_find": Query(
        _find,
        with_events(
            f"SELECT {RESULT_ROW.replace('num_id AS seq, ', '')} FROM ev "
            "WHERE event_type = 'NetworkConnect'"
        ),
    ),
    "stream_drop_duplicates": Query(
        _dedup, with_events("SELECT artifact_id, event_id, event_type FROM ev")
    ),
    # The stream gives the windows that end before the last event less the watermark.
    "stream_windowed_rule_scan": Query(
        _windowed,
        f"""WITH {EV}, win AS (SELECT *, epoch_us(ts) // {_SIX_HOURS} * {_SIX_HOURS} AS window_start FROM ev)
SELECT * FROM ({_rules_sql('host_id, window_start', 'win')})
WHERE window_start + {_SIX_HOURS} <= (SELECT epoch_us(max(ts)) - 600000000 FROM ev)""",
    ),
    "sliding_rule_scan": Query(
        _sliding,
        f"""WITH {EV}, win AS (SELECT *, unnest([epoch_us(ts) // {_SIX_HOURS} * {_SIX_HOURS},
  epoch_us(ts) // {_SIX_HOURS} * {_SIX_HOURS} - {_SIX_HOURS}]) AS window_start FROM ev)
{_rules_sql('host_id, window_start', 'win')}""",
    ),
    "stream_ingest_counters": Query(
        _counters,
        with_events("""SELECT count(*) AS received, count(*) FILTER (k % 13 <> 0) AS accepted,
  count(*) FILTER (k % 13 = 0) AS errors FROM ev"""),
    ),
    "stream_fleet_heartbeat": Query(_fleet, _FLEET_SQL),
    "stream_risk_watch": Query(
        lambda s, d: _watch(s, d, "incidents"),
        with_events("SELECT * FROM incidents", more=f"{_LAST_SQL}, {_INCIDENTS_SQL}"),
    ),
    "stream_risk_watch_batches": Query(
        _watch_batches,
        with_events(
            f"SELECT * FROM ({_rules_sql('batch, host_id', 'lasts')}) WHERE risk_score >= 75",
            more=f"""arrived AS (SELECT *, k % 3 AS part FROM ev),
active AS (SELECT DISTINCT host_id, part AS batch FROM arrived),
lasts AS (SELECT * FROM (SELECT a.batch, e.*, row_number() OVER (PARTITION BY a.host_id, a.batch
    ORDER BY ts DESC, num_id DESC, event_id DESC) AS rn
  FROM active a JOIN arrived e ON e.host_id = a.host_id AND e.part <= a.batch) WHERE rn <= {WATCH_BUFFER})""",
        ),
    ),
    "stream_risk_snapshots": Query(
        lambda s, d: _watch(s, d, "snapshots"),
        with_events(
            "SELECT host_id, event_id, event_type FROM last_n SEMI JOIN incidents USING (host_id)",
            more=f"{_LAST_SQL}, {_INCIDENTS_SQL}",
        ),
    ),
}
