"""Stateless and windowed jobs over a live event feed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sentrilake.functions.fields import result_row
from sentrilake.operators.detect import count_criteria, fired_rules, risk_columns
from sentrilake.operators.stats import fleet_status
from sentrilake.session import remove_path
from sentrilake.sources.events import CORRUPT
from sentrilake.sources.rules import Rule


def accepted_events(records: DataFrame) -> DataFrame:
    """Records that were parsed and carry an id."""
    return records.filter(F.col(CORRUPT).isNull() & F.col("event_id").isNotNull()).drop(CORRUPT)


def observe_ingest(records: DataFrame, observation: str | Observation) -> DataFrame:
    """Count received, accepted and bad records as they pass.

    A backlog is limited by the source's rate options instead of dropping events,
    so nothing is refused here.
    """
    bad = F.col(CORRUPT).isNotNull() | F.col("event_id").isNull()
    return records.observe(
        observation,
        F.count(F.lit(1)).alias("received"),
        F.count_if(~bad).alias("accepted"),
        F.count_if(bad).alias("errors"),
    )


def accept_to_table(
    records: DataFrame, path: str, counts: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Accepted events to ``path`` and the ingest counters of every batch to ``counts``.

    Both are kept per batch number and overwritten if a batch is repeated, so the totals
    (``ingest_totals``) stay exact however many batches have run.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        accepted = accepted_events(observe_ingest(batch, seen))
        accepted.write.mode("overwrite").parquet(f"{path}/batch={number}")
        row = tuple(seen.get[name] for name in ("received", "accepted", "errors"))
        table = batch.sparkSession.createDataFrame([row], _COUNTERS)
        table.coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_totals(spark: SparkSession, counts: str) -> DataFrame:
    """received, accepted and errors over all batches of ``accept_to_table``."""
    return spark.read.schema(_COUNTERS).parquet(counts).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("received", "accepted", "errors")]
    )


_COUNTERS = "received long, accepted long, errors long"


def stream_find(events: DataFrame, where: Column | None = None) -> DataFrame:
    """Matching events as display rows; keeps no state."""
    hits = events if where is None else events.filter(where)
    return hits.select("artifact_id", *result_row())


def drop_duplicate_events(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Keep one copy of each delivered event, in batch or stream form."""
    key = ["artifact_id", "event_id"]
    if not events.isStreaming:
        return events.dropDuplicates(key)
    return events.withWatermark("timestamp_wall", watermark).dropDuplicatesWithinWatermark(key)


def windowed_rule_scan(
    events: DataFrame,
    rules: Sequence[Rule],
    window: str = "1 hour",
    slide: str | None = None,
    watermark: str = "10 minutes",
    key: str = "host_id",
) -> DataFrame:
    """Rule scan per host and event-time window, in batch or stream form.

    Criterion counts are plain partial aggregates, so a busy host is pre-counted
    in every task. A stream gives each window once, after the watermark passed.
    """
    if events.isStreaming:
        events = events.withWatermark("timestamp_wall", watermark)
    span = F.window("timestamp_wall", window, slide) if slide else F.window("timestamp_wall", window)
    counted = count_criteria(
        events.groupBy(key, span.alias("window")), [c for rule in rules for c in rule.criteria]
    )
    return counted.select(
        key,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "total_events",
        fired_rules(rules).alias("alerts"),
    ).select(
        key, "window_start", "window_end", "total_events",
        F.transform("alerts", lambda a: a["rule_id"]).alias("fired_rules"),
        *risk_columns(rules),
    )


def fleet_heartbeat(node_events: DataFrame) -> DataFrame:
    """``fleet_status`` kept current; one row of state per node."""
    return fleet_status(node_events)


def append_to_table(
    stream: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Write an append-mode stream to Parquet; ``once`` stops after the backlog."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def updates_to_table(
    stream: DataFrame, path: str, key: str, checkpoint: str, once: bool = False, compact_every: int = 16
) -> StreamingQuery:
    """Keep the current row of each key below ``path``, as a base and the changes since.

    ``delta/batch=k`` holds the rows that batch k changed. After every ``compact_every`` batches the newest base and the
    deltas behind it become ``base/batch=k``. A base counts once it is complete, so a reader sees the old or the new
    one, and what it replaces is removed one compaction later, when no reader of the older base is left. A repeated
    batch replaces its own folders, so a restart leaves no duplicates.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/delta/batch={number}")
        if (number + 1) % compact_every == 0:
            bases = [n for n in _complete(spark, f"{path}/base") if n < number]
            current = _newest(spark, path, key, max(bases, default=None), number, batch.schema)
            current.write.mode("overwrite").parquet(f"{path}/base/batch={number}")
            for old in sorted(bases)[:-1]:
                remove_path(spark, f"{path}/base/batch={old}")
            for old in _complete(spark, f"{path}/delta"):
                if old <= max(bases, default=-1):
                    remove_path(spark, f"{path}/delta/batch={old}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose folders below ``path`` are complete."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder)]
    done = [p for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in done)


def _newest(
    spark: SparkSession, path: str, key: str, base: int | None, upto: int | None, schema: StructType | None
) -> DataFrame:
    """Current row of each key from one base and the complete deltas behind it."""
    numbers = [n for n in _complete(spark, f"{path}/delta") if (base is None or n > base) and (upto is None or n <= upto)]
    parts = [(-1, f"{path}/base/batch={base}")] if base is not None else []
    parts += [(n, f"{path}/delta/batch={n}") for n in numbers]
    schema = schema or spark.read.parquet(parts[0][1]).schema
    tables = [spark.read.schema(schema).parquet(p).withColumn("_batch", F.lit(n)) for n, p in parts]
    rows = reduce(DataFrame.unionByName, tables)
    newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*schema.fieldNames()), "_batch").alias("_row"))
    return newest.select("_row.*")


def latest_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Current row of each key of a table of updates; reads the newest base and the deltas behind it."""
    return _newest(spark, path, key, max(_complete(spark, f"{path}/base"), default=None), None, None)
