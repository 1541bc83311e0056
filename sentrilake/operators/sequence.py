"""Runs of event types."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrilake.operators.ordering import BUCKET, bucket_of, dense_position


def match_sequence(
    rows: DataFrame,
    wanted: Sequence[str],
    keys: Sequence[str] = ("artifact_id",),
    order: Sequence[str] = ("seq",),
    label: str = "event_type",
    position: str | None = None,
    size: int = BUCKET,
) -> DataFrame:
    """Rows that lie in a contiguous run of ``wanted`` labels within a key.

    Every hit gives one row per element, with ``hit`` (position of its first
    row) and ``step``; overlapping hits are all given. Labels are compared
    without case. Fewer than two labels match nothing. ``position`` names a
    column that already numbers the rows of a key densely.

    Only the place of a row and the number of its label are ordered and shuffled; the rows themselves are joined to
    the hits. The key is cut into buckets, and rows near a border are repeated in the neighbour bucket. A
    row ends a run if the labels behind it are the wanted ones, and is a step of the runs that end up to k - 1 rows later, so
    two passes of k offsets over one window give all hits.
    """
    k = len(wanted)
    if k < 2:
        empty = rows.filter(F.lit(False))
        place = F.lit(0).cast("long") if position is None else F.col(position)
        return empty.withColumn("hit", place).withColumn("step", F.lit(0))
    if size < k:
        raise ValueError("size must hold a whole run")
    numbers = {name.lower(): i for i, name in enumerate(dict.fromkeys(x.lower() for x in wanted))}
    kind = F.lower(F.col(label))
    number = F.lit(-1)
    for name, i in numbers.items():
        number = F.when(kind == name, F.lit(i)).otherwise(number)
    if position is None:
        place = list(order)
        narrow = dense_position(rows.select(*keys, *order, number.alias("_label")), keys, order, "_pos")
    else:
        place = [position]
        narrow = rows.select(*keys, position, number.alias("_label")).withColumn("_pos", F.col(position))

    home = bucket_of(F.col("_pos"), size)
    offset = F.col("_pos") - home * size
    targets = F.array_compact(
        F.array(
            home,
            F.when((offset < k - 1) & (home > 0), home - 1),
            F.when(offset >= size - (k - 1), home + 1),
        )
    )
    spread = narrow.withColumn("_home", home).withColumn("_b", F.explode(targets))
    around = W.partitionBy(*keys, "_b").orderBy("_pos")
    ends = F.lit(True)
    for back, name in enumerate(reversed(wanted)):
        there = F.lag("_label", back).over(around) if back else F.col("_label")
        ends = ends & F.coalesce(there == numbers[name.lower()], F.lit(False))
    ended = spread.withColumn("_ends", ends)
    steps = [
        F.when(F.col("_ends") if step == k - 1 else F.lead("_ends", k - 1 - step).over(around), F.lit(step)) for step in range(k)
    ]
    hits = (
        ended.withColumn("_steps", F.array_compact(F.array(*steps)))
        .filter((F.col("_b") == F.col("_home")) & (F.size("_steps") > 0))
        .select(*keys, *place, "_pos", F.explode("_steps").alias("step"))
        .select(*keys, *place, (F.col("_pos") - F.col("step")).alias("hit"), "step")
    )
    # A null is a key value like any other.
    found = hits.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*keys, *place])], F.col("hit").alias("_hit"), F.col("step").alias("_step"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*keys, *place])])
    return rows.join(found, same).select(*rows.columns, F.col("_hit").alias("hit"), F.col("_step").alias("step"))
