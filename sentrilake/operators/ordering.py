"""Positions inside a session and neighbours of an event.

A session may hold a large share of all events, so no step here sorts a whole
session in one task. Positions come from a range partitioning that cuts inside a
session; every later step works on buckets of at most ``BUCKET`` positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrilake.session import cut

# Time order of a session; the id makes it total.
TIME_ORDER = ("timestamp_wall", "timestamp_monotonic_ns", "event_id")
# Rows of one session that a single window group may hold.
BUCKET = 200_000


def dense_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "ord"
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... along ``order``.

    ``order`` must be total within a key. The rows are range-partitioned on
    (keys, order) and written to the shared folder, so that the two reads below
    see the same partition bounds. A key that lies in one partition is numbered
    there. Only keys that cross a bound need an offset: at most two rows for
    every partition, which is why that table may be broadcast.
    """
    placed = cut(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    spread = W.partitionBy(*keys)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_parts", F.count("*").over(spread))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter((F.col("_parts") > 1) & (F.col("_offset") > 0))
        .select(*keys, "_part", "_offset")
    )
    local = W.partitionBy(*keys, "_part").orderBy("_row")
    return (
        placed.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_part"], "left")
        .withColumn(out, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long"))
        .drop("_part", "_row", "_local", "_offset")
    )


def deterministic_order(events: DataFrame, out: str = "ord") -> DataFrame:
    """Position of each event in the time order of its session."""
    return dense_position(events, ["artifact_id"], TIME_ORDER, out)


def bucket_of(position: Column, size: int = BUCKET) -> Column:
    return F.call_function("div", position, F.lit(size))


def adjacent_pairs(
    rows: DataFrame, keys: Sequence[str], ident: str, position: str = "ord", size: int = BUCKET
) -> DataFrame:
    """(keys, src, dst): each row of a key with the next row of the same key.

    ``position`` numbers the session densely, so a bucket holds at most ``size``
    rows. Pairs inside a bucket come from a window on (keys, bucket); pairs
    across buckets from the first and last row of every bucket, which the same
    shuffle delivers.
    """
    placed = rows.select(*keys, ident, position).withColumn("_b", bucket_of(F.col(position), size))
    inner = W.partitionBy(*keys, "_b").orderBy(position)
    linked = placed.withColumn("src", F.lag(ident).over(inner)).withColumn(
        "_next", F.lead(ident).over(inner)
    )
    # At most two rows of each bucket; the row before a bucket's first row is the
    # last row of an earlier bucket.
    ends = linked.filter(F.col("src").isNull() | F.col("_next").isNull())
    outer = W.partitionBy(*keys).orderBy(position)
    across = ends.withColumn("_before", F.lag(ident).over(outer)).filter(F.col("src").isNull())
    pairs = linked.select(*keys, "src", F.col(ident).alias("dst")).unionByName(
        across.select(*keys, F.col("_before").alias("src"), F.col(ident).alias("dst"))
    )
    return pairs.filter(F.col("src").isNotNull())


def first_per_session(
    events: DataFrame, n: int, order: Sequence[str] = ("seq",), keys: Sequence[str] = ("artifact_id",)
) -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1 in ``position``.

    Spark limits each group before the shuffle, so a large session sends at most
    ``n`` rows per task.
    """
    ranked = W.partitionBy(*keys).orderBy(*order)
    return events.withColumn("position", F.row_number().over(ranked)).filter(F.col("position") <= n)
