"""Periodic outbound connections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrilake.functions.fields import destination, payload, process_name
from sentrilake.functions.ruletext import snort_rule, suricata_rule

_MICROS = 1_000_000
_DAY = 86_400


def connection_gaps(connects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole seconds between consecutive connections of a key, zeros dropped.

    ``connects`` has the keys and ``at`` (microseconds). Two connections in the
    same clock second are less than a second apart, so their gap counts as zero;
    only the first and last connection of each clock second matter. That folds
    any burst into one row before the shuffle. The seconds of one day (86400 at
    most) share a window group, and day borders are closed separately.
    """
    seconds = connects.groupBy(*keys, F.floor(F.col("at") / _MICROS).alias("second")).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    days = seconds.withColumn("day", F.floor(F.col("second") / _DAY))
    inside = W.partitionBy(*keys, "day").orderBy("second")
    within = days.select(*keys, "first_at", F.lag("last_at").over(inside).alias("before"))
    ends = days.groupBy(*keys, "day").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    across = ends.select(
        *keys, "first_at", F.lag("last_at").over(W.partitionBy(*keys).orderBy("day")).alias("before")
    )
    gap = F.floor((F.col("first_at") - F.col("before")) / _MICROS)
    return within.unionByName(across).select(*keys, gap.alias("gap")).filter(F.col("gap") > 0)


def beacon_profiles(events: DataFrame, keys: Sequence[str] = ("artifact_id",)) -> DataFrame:
    """Interval statistics of the connections of each key.

    Keys may name ``process`` and ``destination`` besides event columns. Fewer
    than three connections or two positive gaps give no row. A beacon has a mean
    interval of 1 to 600 seconds and at most 35 % jitter.
    """
    connects = events.filter(F.col("event_type") == "NetworkConnect").select(
        *[c for c in events.columns if c in keys],
        process_name().alias("process"),
        destination().alias("destination"),
        payload("remote_address").alias("address"),
        F.unix_micros("timestamp_wall").alias("at"),
        "event_id",
    )
    order = F.struct("at", "event_id")
    head = connects.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.min_by("destination", order).alias("target"),
        F.min_by("address", order).alias("target_address"),
    )
    stats = (
        connection_gaps(connects, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("gaps"),
            F.avg("gap").alias("mean_interval_seconds"),
            F.stddev_pop("gap").alias("_spread"),
        )
        .filter(F.col("gaps") >= 2)
    )
    mean, jitter = F.col("mean_interval_seconds"), F.col("jitter_percentage")
    return (
        head.filter(F.col("sample_count") >= 3)
        .join(stats, list(keys))
        .withColumn("jitter_percentage", F.col("_spread") / mean * 100)
        .withColumn("is_beaconing", mean.between(1, 600) & (jitter <= 35))
        .withColumn("confidence", F.when(F.col("is_beaconing"), 0.90).otherwise(0.30))
        .withColumn("suricata_rule", suricata_rule(F.col("target_address"), mean))
        .withColumn("snort_rule", snort_rule(F.col("target_address"), mean, jitter))
        .drop("_spread", "gaps", "target_address")
    )
