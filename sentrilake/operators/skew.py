"""Equi joins that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 500_000


def slice_of(row_id: str, slices: Column) -> Column:
    """The slice of a row of the side that is cut."""
    return F.pmod(F.xxhash64(row_id), slices).cast("int")


def every_slice(slices: Column) -> Column:
    """Repeats a row of the other side for each slice."""
    return F.explode(F.sequence(F.lit(0), slices - 1))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: str,
    right_id: str,
    condition: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join on ``keys`` where a key with many rows on either side is split.

    A key with more than ``hot_rows`` rows of a side has that side cut into slices by a hash of
    its id; the other side's rows are repeated for each slice. Keys that are hot on both sides
    meet in a grid of slices. The result is the same as that of the plain join.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        slices = F.ceil(F.count("*") / hot_rows).cast("int")
        return rows.groupBy(*keys).agg(slices.alias(name)).filter(F.col(name) > 1)

    one = F.lit(1)
    hot = counted(left, "_l").join(counted(right, "_r"), list(keys), "full").select(
        *keys, F.coalesce("_l", one).alias("_l"), F.coalesce("_r", one).alias("_r")
    )
    in_left, in_right = F.coalesce("_l", one), F.coalesce("_r", one)
    cut_left = (
        left.join(hot, list(keys), "left")
        .withColumn("_left_slice", slice_of(left_id, in_left))
        .withColumn("_right_slice", every_slice(in_right))
        .drop("_l", "_r")
    )
    cut_right = (
        right.join(hot, list(keys), "left")
        .withColumn("_right_slice", slice_of(right_id, in_right))
        .withColumn("_left_slice", every_slice(in_left))
        .drop("_l", "_r")
    )
    joined = cut_left.join(cut_right, [*keys, "_left_slice", "_right_slice"])
    return (joined if condition is None else joined.filter(condition)).drop("_left_slice", "_right_slice")
