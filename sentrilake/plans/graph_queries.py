"""Queries over the behaviour graph, the process forest and hash manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrilake.functions.fields import event_hash
from sentrilake.operators import forest, graph, integrity
from sentrilake.operators.ordering import dense_position
from sentrilake.plans.adapter import load, ordered_events, session_events
from sentrilake.plans.query import Query, with_events

_EXPLICIT = """explicit_e AS (
  SELECT artifact_id, parent_event_id AS src, event_id AS dst, 'PARENT' AS kind FROM ev
  WHERE parent_event_id IS NOT NULL
  UNION ALL SELECT artifact_id, causal_parent_id, event_id, 'CAUSAL' FROM ev
  WHERE causal_parent_id IS NOT NULL)"""
_TEMPORAL = """temporal_e AS (
  SELECT artifact_id, src, dst, 'TEMPORAL' AS kind FROM (SELECT artifact_id, event_id AS dst,
    lag(event_id) OVER (PARTITION BY artifact_id, pid ORDER BY ord) AS src FROM ev)
  WHERE src IS NOT NULL)"""
_RESOURCE = """resource_e AS (
  SELECT artifact_id, src, dst, 'RESOURCE' AS kind FROM (SELECT artifact_id, event_id AS dst,
    lag(event_id) OVER (PARTITION BY artifact_id, path ORDER BY ord) AS src FROM ev
    WHERE event_type IN ('FileOpen', 'FileRead', 'FileWrite')) WHERE src IS NOT NULL)"""
_DNS = """dns_e AS (
  SELECT a.artifact_id, a.event_id AS src, c.event_id AS dst, 'CAUSAL' AS kind
  FROM ev a JOIN ev c ON a.artifact_id = c.artifact_id AND a.dns_address = c.remote_address
    AND a.ord < c.ord
  WHERE a.event_type = 'DnsResponse' AND c.event_type = 'NetworkConnect')"""
_LINEAGE = """lineage_e AS (
  SELECT a.artifact_id, a.event_id AS src, c.event_id AS dst, 'PROCESS_LINEAGE' AS kind
  FROM ev a JOIN ev c ON a.artifact_id = c.artifact_id AND a.child_pid = c.pid
  WHERE a.event_type = 'ProcessSpawn' AND c.event_type = 'ProcessStart')"""
_ALL = f"""{_EXPLICIT}, {_TEMPORAL}, {_RESOURCE}, {_DNS}, {_LINEAGE},
edges AS (SELECT * FROM explicit_e UNION ALL SELECT * FROM temporal_e
  UNION ALL SELECT * FROM resource_e UNION ALL SELECT * FROM dns_e
  UNION ALL SELECT * FROM lineage_e)"""


def _seeds(events: DataFrame, last: bool) -> DataFrame:
    """The last connection, or the first event, of every session."""
    if last:
        events = events.filter(F.col("event_type") == "NetworkConnect")
    pick = F.max_by if last else F.min_by
    return events.groupBy("artifact_id").agg(pick("event_id", "ord").alias("event_id"))


_SEED_SQL = {
    True: "seeds AS (SELECT artifact_id, arg_max(event_id, ord) AS event_id FROM ev "
          "WHERE event_type = 'NetworkConnect' GROUP BY 1)",
    False: "seeds AS (SELECT artifact_id, arg_min(event_id, ord) AS event_id FROM ev GROUP BY 1)",
}


def _ancestors(spark: SparkSession, d: str) -> DataFrame:
    events = ordered_events(spark, d)
    return graph.ancestors(events, _seeds(events, last=True))


def _descendants(spark: SparkSession, d: str) -> DataFrame:
    events = ordered_events(spark, d)
    return graph.descendants(events, _seeds(events, last=False))


def _neighborhood(spark: SparkSession, d: str) -> DataFrame:
    events = ordered_events(spark, d)
    return graph.causal_neighborhood(events, _seeds(events, last=True), 3)


def _reach_sql(near: str, far: str, last: bool) -> str:
    return with_events(
        "SELECT artifact_id, seed_id, event_id FROM reach WHERE event_id <> seed_id",
        more=f"""RECURSIVE {_ALL}, {_SEED_SQL[last]},
inner_e AS (SELECT e.* FROM edges e SEMI JOIN ev n
  ON n.artifact_id = e.artifact_id AND n.event_id = e.{far}),
reach AS (
  SELECT artifact_id, event_id AS seed_id, event_id FROM seeds
  UNION SELECT r.artifact_id, r.seed_id, e.{far} FROM reach r JOIN inner_e e
    ON e.artifact_id = r.artifact_id AND e.{near} = r.event_id)""",
    )


_NEIGHBOR_SQL = with_events(
    """SELECT DISTINCT r.artifact_id, r.seed_id, r.event_id FROM reach r SEMI JOIN ev n
  ON n.artifact_id = r.artifact_id AND n.event_id = r.event_id WHERE r.event_id <> r.seed_id""",
    more=f"""RECURSIVE {_EXPLICIT}, {_DNS}, {_SEED_SQL[True]},
links AS (SELECT artifact_id, src AS a, dst AS b FROM explicit_e
  UNION ALL SELECT artifact_id, dst, src FROM explicit_e
  UNION ALL SELECT artifact_id, src, dst FROM dns_e
  UNION ALL SELECT artifact_id, dst, src FROM dns_e),
reach AS (
  SELECT artifact_id, event_id AS seed_id, event_id, 0 AS depth FROM seeds
  UNION SELECT r.artifact_id, r.seed_id, l.b, depth + 1 FROM reach r JOIN links l
    ON l.artifact_id = r.artifact_id AND l.a = r.event_id WHERE depth < 3)""",
)


def _edges_into(spark: SparkSession, d: str) -> DataFrame:
    events = ordered_events(spark, d)
    return graph.edges_into(events, _seeds(events, last=True))


def _added(spark: SparkSession, d: str) -> DataFrame:
    """Hand-made edges from the first to the last event, and from a missing one."""
    events = ordered_events(spark, d)
    ends = events.groupBy("artifact_id").agg(
        F.min_by("event_id", "ord").alias("src"), F.max_by("event_id", "ord").alias("dst")
    )
    extra = ends.unionByName(ends.withColumn("src", F.lit("missing"))).withColumn(
        "kind", F.lit("CAUSAL")
    )
    return graph.add_edge(graph.build_edges(events), extra, events)


_STATS_SQL = """stats AS (
  SELECT artifact_id, pid, count(*) AS events,
    count(*) FILTER (event_type IN ('FileOpen','FileRead','FileWrite','FileDelete')) AS files,
    count(*) FILTER (event_type IN ('NetworkConnect','DnsQuery','DnsResponse')) AS net,
    count(*) FILTER (event_type IN ('CryptoOperation','TlsObserved')) AS crypto,
    arg_max(exit_code, event_id) FILTER (event_type = 'ProcessExit') AS exit_code,
    any_value(process_name) AS process_name, any_value(ppid) AS ppid
  FROM ev GROUP BY artifact_id, pid)"""
_FOREST_SQL = f"""RECURSIVE {_STATS_SQL},
linked AS (SELECT s.*, p.pid AS up FROM stats s LEFT JOIN stats p
  ON p.artifact_id = s.artifact_id AND p.pid = s.ppid),
tree AS (
  SELECT artifact_id, pid, [pid] AS path, 0 AS depth, pid AS root_pid FROM linked WHERE up IS NULL
  UNION ALL SELECT l.artifact_id, l.pid, list_append(t.path, l.pid), t.depth + 1, t.root_pid
  FROM linked l JOIN tree t ON l.artifact_id = t.artifact_id AND l.up = t.pid)"""


def _forest(spark: SparkSession, d: str) -> DataFrame:
    out = forest.process_forest(session_events(spark, d))
    return out.select(
        "artifact_id", "pid", "depth", "root_pid", "events", "files", "net", "crypto", "exit_code",
        "process_name", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
    )


def _forest_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = forest.render_forest(forest.process_forest(session_events(spark, d)))
    return lines.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


# The payload as JSON, fields in schema order, nulls left out.
_JSON_SQL = """concat('{"category":"', event_type, '","payload":{', CASE event_type
  WHEN 'ProcessStart' THEN '"executable_path":"' || process_path || '","command_line":["'
    || process_path || '","--run"],' || coalesce('"parent_pid":' || ppid || ',', '')
    || '"environment_keys":["PATH","API_TOKEN","HOME"]'
  WHEN 'ProcessExit' THEN '"exit_code":' || exit_code
  WHEN 'ProcessSpawn' THEN '"child_pid":' || child_pid || ',"child_executable_path":"'
    || child_path || '"'
  WHEN 'FileOpen' THEN '"path":"' || path || '","normalized_path":"' || path
    || '","read":true,"write":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
  WHEN 'FileRead' THEN '"path":"' || path || '","bytes_read":' || (k * 10)
  WHEN 'FileWrite' THEN '"path":"' || path || '","bytes_written":' || (k * 100)
    || CASE WHEN k % 2 = 0 THEN ',"content_hash":"' || md5(path) || '"' ELSE '' END
  WHEN 'FileDelete' THEN '"path":"' || path || '","normalized_path":"' || path || '"'
  WHEN 'DnsQuery' THEN '"query_name":"' || dns_name || '","record_type":"A"'
  WHEN 'DnsResponse' THEN '"query_name":"' || dns_name || '","record_type":"A","addresses":["'
    || dns_address || '"]'
  WHEN 'NetworkConnect' THEN '"protocol":"TCP","remote_address":"' || remote_address
    || '","remote_port":' || remote_port
    || coalesce(',"remote_hostname":"' || remote_hostname || '"', '')
    || ',"is_external":' || CASE WHEN is_external THEN 'true' ELSE 'false' END
  WHEN 'SocketCreate' THEN '"protocol":"TCP","domain":"AF_INET","socket_type":"STREAM"'
  WHEN 'CryptoOperation' THEN '"category":"' || crypto_category || '","algorithm":"' || algorithm
    || '","provider":"' || provider || '"'
  WHEN 'TlsObserved' THEN '"version":"' || tls_version || '"'
    || coalesce(',"cipher_suite":"' || cipher_suite || '"', '')
  WHEN 'MemoryProtect' THEN '"address":' || address || ',"size_bytes":4096,"new_permissions":"'
    || new_permissions || '"' END, '}}')"""
_HASHED = f"""hashed AS (SELECT *, sha256(concat(event_id, event_type, process_name, {_JSON_SQL}))
  AS event_hash FROM ev)"""

_MEMBERS_SQL = """members AS (
  SELECT artifact_id, event_id, 'TEMPORAL' AS kind, CAST(pid AS VARCHAR) AS name, ord AS pos FROM ev
  UNION ALL SELECT artifact_id, event_id, 'RESOURCE', path, ord FROM ev
    WHERE event_type IN ('FileOpen', 'FileRead', 'FileWrite')
  UNION ALL SELECT artifact_id, event_id, 'DNS', coalesce(remote_address, dns_address), ord FROM ev
    WHERE event_type IN ('NetworkConnect', 'DnsResponse')
  UNION ALL SELECT artifact_id, event_id, 'LINEAGE', CAST(child_pid AS VARCHAR), 0 FROM ev
    WHERE event_type = 'ProcessSpawn'
  UNION ALL SELECT artifact_id, event_id, 'LINEAGE', CAST(pid AS VARCHAR), 1 FROM ev
    WHERE event_type = 'ProcessStart')"""
_LANES = ", '|', ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)
)
_GRAPH_HASH_SQL = with_events(
    f"SELECT artifact_id, sha256(concat({_LANES})) AS graph_hash FROM digests GROUP BY artifact_id",
    more=f"""{_HASHED}, {_MEMBERS_SQL}, digests AS (
  SELECT artifact_id, sha256(concat('node|', ord, '|', event_hash, '|',
    coalesce(parent_event_id, ''), '|', coalesce(causal_parent_id, ''))) AS h FROM hashed
  UNION ALL SELECT artifact_id, sha256(concat('link|', kind, '|', name, '|', pos, '|', event_id))
  FROM members)""",
)

ROWS_PER_BLOCK = 8


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return integrity.block_manifest(ordered_events(spark, d), event_hash(), "ord", ROWS_PER_BLOCK)


_MANIFEST_SQL = f"""manifest AS (
  SELECT artifact_id, ord // {ROWS_PER_BLOCK} AS block_index, count(*) AS rows,
    sha256(string_agg(event_hash, '' ORDER BY ord)) AS block_hash FROM hashed GROUP BY 1, 2)"""


def _merkle_sql(source: str, key: str, rounds: int = 24) -> str:
    """Levels of the hash tree as a chain of CTEs; a single node passes through."""
    parts = [
        f"level0 AS (SELECT {key}, block_index AS i, sha256('leaf:' || block_hash) AS h FROM {source})"
    ]
    for r in range(rounds):
        parts.append(
            f"""level{r + 1} AS MATERIALIZED (SELECT a.{key}, a.i // 2 AS i, CASE WHEN n.c = 1 THEN a.h
    ELSE sha256('node:' || a.h || coalesce(b.h, a.h)) END AS h
  FROM level{r} a LEFT JOIN level{r} b ON b.{key} = a.{key} AND b.i = a.i + 1
  JOIN (SELECT {key}, count(*) AS c FROM level{r} GROUP BY 1) n ON n.{key} = a.{key}
  WHERE a.i % 2 = 0)"""
        )
    return ", ".join(parts)


def _document_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    placed = dense_position(docs, ["lang"], ["doc_id"], "pos")
    return integrity.block_manifest(placed, F.sha2("text", 256), "pos", 4, ["lang"])


_DOC_MANIFEST_SQL = """placed AS (
  SELECT lang, sha256(text) AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents),
manifest AS (
  SELECT lang, pos // 4 AS block_index, sha256(string_agg(h, '' ORDER BY pos)) AS block_hash
  FROM placed GROUP BY 1, 2)"""


def _verify(spark: SparkSession, d: str) -> DataFrame:
    """Stored manifest against a table where some events were altered."""
    stored = _manifest(spark, d)
    changed = ordered_events(spark, d).withColumn(
        "event_type",
        F.when(F.col("raw_evidence")["k"] == "13", F.lit("Altered")).otherwise(F.col("event_type")),
    )
    now = integrity.block_manifest(changed, event_hash(), "ord", ROWS_PER_BLOCK)
    return integrity.verify_manifest(now, stored, integrity.merkle_root(stored))


GRAPH_QUERIES: dict[str, Query] = {
    "explicit_edges": Query(
        lambda s, d: graph.explicit_edges(session_events(s, d)),
        with_events("SELECT * FROM explicit_e", more=_EXPLICIT),
    ),
    "temporal_edges": Query(
        lambda s, d: graph.temporal_edges(ordered_events(s, d)),
        with_events("SELECT * FROM temporal_e", more=_TEMPORAL),
    ),
    "resource_edges": Query(
        lambda s, d: graph.resource_edges(ordered_events(s, d)),
        with_events("SELECT * FROM resource_e", more=_RESOURCE),
    ),
    "dns_edges": Query(
        lambda s, d: graph.dns_edges(ordered_events(s, d)),
        with_events("SELECT * FROM dns_e", more=_DNS),
    ),
    "lineage_edges": Query(
        lambda s, d: graph.lineage_edges(ordered_events(s, d)),
        with_events("SELECT * FROM lineage_e", more=_LINEAGE),
    ),
    "lineage_edges_strict": Query(
        lambda s, d: graph.lineage_edges(ordered_events(s, d), strict=True),
        with_events("""SELECT a.artifact_id, a.event_id AS src, arg_min(c.event_id, c.ord) AS dst,
  'PROCESS_LINEAGE' AS kind FROM ev a JOIN ev c ON a.artifact_id = c.artifact_id
  AND a.child_pid = c.pid AND c.ord > a.ord
WHERE a.event_type = 'ProcessSpawn' AND c.event_type = 'ProcessStart' GROUP BY 1, 2"""),
    ),
    "build_edges": Query(
        lambda s, d: graph.build_edges(ordered_events(s, d)),
        with_events("SELECT *, 1 AS weight FROM edges", more=_ALL),
    ),
    "add_edge": Query(
        _added,
        with_events(
            """SELECT *, 1 AS weight FROM edges UNION ALL
SELECT artifact_id, arg_min(event_id, ord), arg_max(event_id, ord), 'CAUSAL', 1 FROM ev GROUP BY 1""",
            more=_ALL,
        ),
    ),
    "graph_counts": Query(
        lambda s, d: graph.graph_counts(ordered_events(s, d)),
        with_events(
            """SELECT artifact_id, nodes, coalesce(n, 0) AS edges
FROM (SELECT artifact_id, count(*) AS nodes FROM ev GROUP BY 1)
LEFT JOIN (SELECT artifact_id, count(*) AS n FROM edges GROUP BY 1) USING (artifact_id)""",
            more=_ALL,
        ),
    ),
    "graph_hash": Query(lambda s, d: graph.graph_hash(ordered_events(s, d)), _GRAPH_HASH_SQL),
    "edge_spans": Query(
        lambda s, d: graph.edge_spans(ordered_events(s, d)),
        with_events(
            """SELECT artifact_id, 'DNS' AS kind, remote_address AS name, dst, count(*) AS sources
FROM dns_e JOIN (SELECT artifact_id, event_id AS dst, remote_address FROM ev WHERE event_type = 'NetworkConnect')
  USING (artifact_id, dst) GROUP BY ALL
UNION ALL SELECT artifact_id, 'LINEAGE', CAST(pid AS VARCHAR), dst, count(*)
FROM lineage_e JOIN (SELECT artifact_id, event_id AS dst, pid FROM ev WHERE event_type = 'ProcessStart')
  USING (artifact_id, dst) GROUP BY ALL""",
            more=f"{_DNS}, {_LINEAGE}",
        ),
    ),
    "edges_into": Query(
        _edges_into,
        with_events(
            "SELECT e.artifact_id, src, dst, kind, 1 AS weight FROM edges e SEMI JOIN seeds s "
            "ON s.artifact_id = e.artifact_id AND s.event_id = e.dst",
            more=f"{_ALL}, {_SEED_SQL[True]}",
        ),
    ),
    "ancestors": Query(_ancestors, _reach_sql("dst", "src", True)),
    "descendants": Query(_descendants, _reach_sql("src", "dst", False)),
    "causal_neighborhood": Query(_neighborhood, _NEIGHBOR_SQL),
    "process_stats": Query(
        lambda s, d: forest.process_stats(session_events(s, d)),
        with_events(
            "SELECT * EXCLUDE (ppid), ppid AS parent_pid, ppid AS last_ppid FROM stats",
            more=_STATS_SQL,
        ),
    ),
    "process_forest": Query(
        _forest,
        with_events(
            """SELECT s.artifact_id, s.pid, depth, root_pid, events, files, net, crypto, exit_code,
  process_name, array_to_string(path, '/') AS path FROM stats s JOIN tree USING (artifact_id, pid)""",
            more=_FOREST_SQL,
        ),
    ),
    "render_forest": Query(
        _forest_lines,
        with_events(
            """SELECT s.artifact_id, array_to_string(path, '/') AS path,
  repeat('  ', depth) || process_name || ' [pid: ' || s.pid || ', events: ' || events || ', files: '
  || files || ', net: ' || net || ', crypto: ' || crypto || ']'
  || coalesce(' (exit: ' || exit_code || ')', '') AS line
FROM stats s JOIN tree USING (artifact_id, pid)""",
            more=_FOREST_SQL,
        ),
    ),
    "event_hash": Query(
        lambda s, d: session_events(s, d).select("event_id", event_hash().alias("event_hash")),
        with_events("SELECT event_id, event_hash FROM hashed", more=_HASHED),
    ),
    "block_manifest": Query(
        _manifest, with_events("SELECT * FROM manifest", more=f"{_HASHED}, {_MANIFEST_SQL}")
    ),
    "merkle_root": Query(
        lambda s, d: integrity.merkle_root(_manifest(s, d)),
        with_events(
            "SELECT artifact_id, h AS merkle_root FROM level24",
            more=f"{_HASHED}, {_MANIFEST_SQL}, {_merkle_sql('manifest', 'artifact_id')}",
        ),
    ),
    "document_merkle_root": Query(
        # A small fold makes the small tables go through several rounds.
        lambda s, d: integrity.merkle_root(_document_manifest(s, d), ["lang"], fold=3),
        f"WITH {_DOC_MANIFEST_SQL}, {_merkle_sql('manifest', 'lang')} "
        "SELECT lang, h AS merkle_root FROM level24",
    ),
    "verify_manifest": Query(
        _verify,
        with_events(f"""SELECT artifact_id, count(DISTINCT ord // {ROWS_PER_BLOCK}) FILTER (k = 13)
    AS failed_blocks, count(*) FILTER (k = 13) = 0 AS root_matches,
  CASE WHEN count(*) FILTER (k = 13) = 0 THEN 'VERIFIED' ELSE 'REJECTED' END AS verdict
FROM ev GROUP BY artifact_id"""),
    ),
}
