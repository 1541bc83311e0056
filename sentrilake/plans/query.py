"""A registered query: the Spark job and, where one exists, its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sentrilake.plans.adapter import FLAT_EVENTS_SQL


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_FLAT = FLAT_EVENTS_SQL.format(table="events")

# ev: flat events, one session per user. ord: place in time order.
EV = f"""ev AS (
  SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY ts, num_id, event_id) - 1 AS ord
  FROM ({_FLAT}) f)"""
# Same with one session per user and day.
EV_DAILY = f"""ev AS (
  SELECT * EXCLUDE (artifact_id), session_day AS artifact_id FROM ({_FLAT}) f)"""

SUMMARY = """CASE event_type
  WHEN 'ProcessStart' THEN 'exec ' || process_path
  WHEN 'ProcessExit' THEN 'exit code ' || exit_code
  WHEN 'ProcessSpawn' THEN 'spawn pid:' || child_pid || ' (' || child_path || ')'
  WHEN 'FileOpen' THEN 'open ' || path
  WHEN 'FileRead' THEN 'read ' || (k * 10) || ' bytes from ' || path
  WHEN 'FileWrite' THEN 'write ' || (k * 100) || ' bytes to ' || path
  WHEN 'FileDelete' THEN 'delete ' || path
  WHEN 'DnsQuery' THEN 'query ' || dns_name
  WHEN 'DnsResponse' THEN 'resolved ' || dns_name || ' -> ["' || dns_address || '"]'
  WHEN 'NetworkConnect' THEN 'connect ' || remote_address || ':' || remote_port
  WHEN 'SocketCreate' THEN 'socket AF_INET/TCP'
  WHEN 'CryptoOperation' THEN
    CASE crypto_category WHEN 'HASH' THEN 'Hash' ELSE 'Encrypt' END
    || ' algo:' || algorithm || ' provider:' || provider
  WHEN 'TlsObserved' THEN 'TLS ' || tls_version || ' ciphersuite:'
    || coalesce('Some("' || cipher_suite || '")', 'None')
  WHEN 'MemoryProtect' THEN 'mprotect perm:' || new_permissions END"""

RESULT_ROW = f"""artifact_id, num_id AS seq, substr(event_id, 1, 8) AS event_id, event_type,
  process_name AS process, pid, {SUMMARY} AS summary, confidence"""


def with_events(body: str, daily: bool = False, more: str = "") -> str:
    """SQL with the event CTE and optional further CTEs in front of ``body``."""
    ctes = EV_DAILY if daily else EV
    recursive = "RECURSIVE " if "RECURSIVE" in more else ""
    more = more.replace("RECURSIVE ", "")
    return f"WITH {recursive}{ctes}{', ' + more if more else ''}\n{body}"
