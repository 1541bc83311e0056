"""Rolling risk watch: rescan the last N events of each host whenever it sends new ones.

The events that a host's next scan needs are keyed state of the stream. Every input task first keeps the newest N
events of each host it reads, so a host that sends a third of a batch is cut down in all of its tasks and hands on
at most N rows for each; its state is a list of at most 2 N entries. A host without new events is neither read
nor written, and the state store adds only what is new: a full list is trimmed once it has grown to twice its size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sentrilake.functions.fields import JSON_OPTIONS
from sentrilake.operators.detect import criterion_matches, fired_rules, risk_columns
from sentrilake.schema import EVENTS
from sentrilake.sources.rules import Rule, builtin_rules

BUFFER = 50_000
TRIGGER = 75
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: An event in the buffer: its place in time, the criteria it meets and the event itself.
ENTRY = StructType([
    StructField("wall", LongType()), StructField("monotonic", LongType()), StructField("event_id", StringType()),
    StructField("met", StringType()), StructField("event", StringType()),
])
_TIME = ["wall", "monotonic", "event_id"]
_OUT = "key string, kind string, total_events long, counts array<long>, event string"


def watch_entries(events: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    """``key`` and the entry of every event."""
    criteria = [c for rule in rules for c in rule.criteria]
    met = F.array_join(F.array_compact(F.array(*[F.when(criterion_matches(c), F.lit(str(i))) for i, c in enumerate(criteria)])), ",")
    return events.select(
        F.col(key).alias("key"),
        F.unix_micros("timestamp_wall").alias("wall"),
        F.coalesce(F.col("timestamp_monotonic_ns").cast("long"), F.lit(0)).alias("monotonic"),
        "event_id",
        (met if criteria else F.lit("")).alias("met"),
        F.to_json(F.struct(*events.columns), JSON_OPTIONS).alias("event"),
    )


def newest_per_task(entries: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` entries of each key among the rows of every task; no shuffle, works on streams."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
            kept = rows.sort_values(_TIME, ascending=False, kind="stable").groupby("key", dropna=False).head(n)
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept, schema=batch.schema, preserve_index=False)

    return entries.mapInArrow(trim, entries.schema)


class HostBuffer(StatefulProcessor):
    """Keeps a host's newest entries and reports their criteria, with the events if the host is at risk."""

    def __init__(self, rules: Sequence[Rule], n: int, trigger: int) -> None:
        self.n, self.trigger, self.rules, start = n, trigger, [], 0
        for rule in rules:
            end = start + len(rule.criteria)
            self.rules.append((start, end, [c.minimum for c in rule.criteria], rule.score))
            start = end
        self.criteria = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY)

    def close(self) -> None:
        pass

    def risk(self, counts: list[int]) -> int:
        fired = [score for a, b, least, score in self.rules
                 if sum(counts[a:b]) > 0 and all(x >= y for x, y in zip(counts[a:b], least))]
        return min(100, sum(fired))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            new += frame[ENTRY.names].itertuples(index=False, name=None)
            if len(new) > 4 * self.n:
                new = sorted(new, reverse=True)[: self.n]
        before = list(self.entries.get())
        newest = sorted([*before, *new], reverse=True)[: self.n]
        if len(before) + len(new) <= 2 * self.n:
            self.entries.appendList(new)
        else:
            self.entries.put(newest)
        met = Counter(x for entry in newest for x in entry[3].split(",") if x)
        counts = [met[str(i)] for i in range(self.criteria)]
        if self.risk(counts) >= self.trigger:
            rows = [("incident", len(newest), counts, None), *(("event", None, None, entry[4]) for entry in newest)]
            kind, total, numbers, event = zip(*rows)
            yield pd.DataFrame({
                "key": [key[0]] * len(rows), "kind": kind, "total_events": pd.array(total, "Int64"), "counts": numbers, "event": event,
            })


class RiskWatch:
    """The watch over a stream of events; what it finds lies below one folder on shared storage.

    ``found/batch=k`` holds the hosts that batch k brought to or kept above the trigger, and their
    buffered events. A batch is written once, and a repeated one overwrites its own folder, so a failure leaves the same files.
    """

    def __init__(
        self,
        path: str,
        rules: Sequence[Rule] | None = None,
        buffer: int = BUFFER,
        trigger: int = TRIGGER,
        key: str = "host_id",
    ) -> None:
        self.path = path.rstrip("/")
        self.rules = list(builtin_rules() if rules is None else rules)
        self.buffer = buffer
        self.trigger = trigger
        self.key = key

    def watched(self, events: DataFrame) -> DataFrame:
        """The stream of what each batch reports: key, kind (incident or event), total_events, counts, event."""
        entries = newest_per_task(watch_entries(events, self.rules, self.key), self.buffer)
        return entries.where("key IS NOT NULL").groupBy("key").transformWithStateInPandas(
            HostBuffer(self.rules, self.buffer, self.trigger), _OUT, "Update", "None")

    def start(self, events: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        spark = events.sparkSession

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/found/batch={number}")

        writer = self.watched(events).writeStream.outputMode("update").foreachBatch(save)
        writer = writer.option("checkpointLocation", checkpoint)
        # Keyed state needs the RocksDB store. A query keeps the setting it was started with.
        before = spark.conf.get(_PROVIDER)
        spark.conf.set(_PROVIDER, _ROCKSDB)
        try:
            return (writer.trigger(availableNow=True) if once else writer).start()
        finally:
            spark.conf.set(_PROVIDER, before)

    def _found(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = spark.read.schema(f"{_OUT}, batch int").parquet(f"{self.path}/found")
        return rows.where(F.col("kind") == kind)

    def incidents(self, spark: SparkSession) -> DataFrame:
        """``key``, total_events, fired_rules, risk and batch of every report."""
        rows = self._found(spark, "incident").withColumn("alerts", fired_rules(self.rules))
        return rows.select(
            F.col("key").alias(self.key), "total_events",
            F.transform("alerts", lambda a: a["rule_id"]).alias("fired_rules"),
            *risk_columns(self.rules), "batch",
        )

    def snapshots(self, spark: SparkSession, schema: StructType = EVENTS) -> DataFrame:
        """The buffered events of the reported hosts, with the batch."""
        event: Column = F.from_json("event", schema, JSON_OPTIONS)
        return self._found(spark, "event").select(event.alias("event"), "batch").select("event.*", "batch")
