"""Session summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.functions.fields import (
    crypto_label,
    destination,
    duration_ms,
    in_category,
    payload,
    pid,
    process_name,
)
from sentrilake.operators.ordering import first_per_session

KEY = "artifact_id"


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(KEY, "event_type").agg(F.count("*").alias("n"))


def category_counts(events: DataFrame) -> DataFrame:
    """Counts by event type as one map per session (22 entries at most)."""
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return event_type_counts(events).groupBy(KEY).agg(
        F.map_from_entries(pairs).alias("event_category_counts")
    )


def session_manifest(events: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Command, process, platform, time span and category counts per session.

    ``dropped`` (artifact_id, dropped_events) adds the recorder's loss count.
    The command is that of the first event of the session.
    """
    out = events.groupBy(KEY).agg(
        F.min_by("process_identity.command_line", "seq").alias("command"),
        F.min_by(pid(), F.col("seq")).alias("target_pid"),
        F.min_by("platform", "seq").alias("platform"),
        F.min("timestamp_wall").alias("start_time"),
        F.max("timestamp_wall").alias("end_time"),
        F.count("*").alias("total_events"),
        *[
            F.count_if(in_category("manifest", name)).alias(f"{name}_events")
            for name in ("process", "file", "network", "dns", "crypto")
        ],
    )
    out = out.withColumn("duration_ms", duration_ms(F.col("start_time"), F.col("end_time")))
    if dropped is None:
        return out.withColumn("dropped_events", F.lit(0).cast("long"))
    return out.join(dropped, KEY, "left").withColumn(
        "dropped_events", F.coalesce("dropped_events", F.lit(0)).cast("long")
    )


def inspect_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(KEY).agg(
        F.count("*").alias("total_events"),
        F.count_if(in_category("inspect", "file")).alias("filesystem_ops"),
        F.count_if(in_category("inspect", "network")).alias("network_flows"),
        F.count_if(in_category("inspect", "dns")).alias("dns_queries"),
        F.count_if(in_category("inspect", "crypto")).alias("crypto_ops"),
        duration_ms(F.min("timestamp_wall"), F.max("timestamp_wall")).alias("duration_ms"),
    )


def network_destinations(events: DataFrame, n: int = 10, by: str = "text") -> DataFrame:
    """First ``n`` destinations of each session in text order, or by count."""
    counted = (
        events.filter(F.col("event_type") == "NetworkConnect")
        .groupBy(KEY, destination().alias("destination"))
        .agg(F.count("*").alias("events"))
    )
    order = [F.col("destination")] if by == "text" else [F.desc("events"), F.col("destination")]
    return first_per_session(counted, n, order)


def crypto_operations(events: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` crypto and TLS descriptions of each session."""
    text = F.when(
        F.col("event_type") == "CryptoOperation",
        F.concat(crypto_label(), F.lit(" - "), payload("algorithm"), F.lit(" ("),
                 payload("provider"), F.lit(")")),
    ).otherwise(F.concat(F.lit("TLS - "), payload("version")))
    ops = events.filter(F.col("event_type").isin("CryptoOperation", "TlsObserved")).select(
        KEY, "seq", text.alias("operation")
    )
    return first_per_session(ops, n)


def timeline(events: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` events of each session; crypto operations are marked."""
    rows = events.select(
        KEY, "seq", "timestamp_wall", F.substring("event_id", 1, 8).alias("event_id"), "event_type",
        process_name().alias("process"), pid().alias("pid"), "confidence",
        (F.col("event_type") == "CryptoOperation").alias("is_threat"),
    )
    return first_per_session(rows, n)


def ingest_health(records: DataFrame) -> DataFrame:
    """Captured, dropped and bad records per host and collector.

    ``records`` has ``host_id``, ``collector``, ``is_error`` and ``is_dropped``.
    """
    return records.groupBy("host_id", "collector").agg(
        F.count_if(~F.col("is_error") & ~F.col("is_dropped")).alias("events_captured"),
        F.count_if("is_dropped").alias("events_dropped"),
        F.count_if("is_error").alias("errors"),
    )


def fleet_status(node_events: DataFrame) -> DataFrame:
    """Latest facts and incident count per node.

    ``node_events`` has ``node_id``, ``at``, ``kind`` (``register`` or
    ``incident``) and the host facts. Facts come from the latest registration.
    """
    registered = F.when(F.col("kind") == "register", F.col("at"))
    return node_events.groupBy("node_id").agg(
        F.max_by("hostname", registered).alias("hostname"),
        F.max_by("ip_address", registered).alias("ip_address"),
        F.max_by("os_name", registered).alias("os_name"),
        F.count_if(F.col("kind") == "incident").alias("incidents"),
        F.max("at").alias("last_heartbeat"),
        F.lit("ONLINE (HEALTHY)").alias("status"),
    )
