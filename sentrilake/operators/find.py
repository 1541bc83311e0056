"""Event search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrilake.functions.fields import pid, process_name, result_row, wall_text
from sentrilake.functions.predicates import pred


def find_events(events: DataFrame, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Matching events as display rows, in session order.

    A limit below 1 still gives one row. With a limit Spark keeps the first rows
    per task and merges them; without one nothing is sorted, the order columns
    are part of the result.
    """
    hits = events if where is None else events.filter(where)
    hits = hits.select("artifact_id", "seq", *result_row())
    if limit is None:
        return hits
    return hits.orderBy("artifact_id", "seq").limit(max(limit, 1))


def text_search(events: DataFrame, needle: str) -> DataFrame:
    """Events whose displayed row contains ``needle``, ignoring case."""
    row = F.concat(
        F.substring("event_id", 1, 8),
        F.col("event_type"),
        process_name(),
        pid().cast("string"),
        F.coalesce("confidence", F.lit("")),
        wall_text(),
    )
    return events.filter(F.lower(row).contains(needle.lower())).select(
        "artifact_id", "seq", *result_row()
    )


def find_all(events: DataFrame) -> DataFrame:
    return find_events(events)


def find_network_connections(events: DataFrame) -> DataFrame:
    return find_events(events, pred("type", "=", "NetworkConnect"))


def find_crypto_operations(events: DataFrame) -> DataFrame:
    return find_events(events, pred("type", "=", "CryptoOperation"))
