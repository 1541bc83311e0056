"""Hash manifests that show whether a table was changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrilake.session import cut

KEY = "artifact_id"
# Prefixes keep leaves and inner nodes apart.
LEAF, NODE = "leaf:", "node:"
# Levels of the tree folded in one shuffle; a group holds 2**FOLD hashes.
FOLD = 10


def block_manifest(
    rows: DataFrame,
    row_hash: Column,
    position: str,
    rows_per_block: int = 10_000,
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """One hash per block of ``rows_per_block`` consecutive rows.

    ``position`` numbers the rows of a key densely from 0, so a block never
    collects more than ``rows_per_block`` hashes.
    """
    hashed = rows.select(
        *keys,
        F.floor(F.col(position) / rows_per_block).cast("long").alias("block_index"),
        F.col(position).alias("_pos"),
        row_hash.alias("_hash"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_hash")))
    return hashed.groupBy(*keys, "block_index").agg(
        F.count("*").alias("rows"),
        F.sha2(F.array_join(F.transform(ordered, lambda r: r["_hash"]), ""), 256).alias("block_hash"),
    )


def _parent(nodes: Column) -> Column:
    """The next tree level; a node without a partner is paired with itself."""

    def pair(i: Column) -> Column:
        left = F.get(nodes, i * 2)
        right = F.coalesce(F.get(nodes, i * 2 + 1), left)
        return F.sha2(F.concat(F.lit(NODE), left, right), 256)

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1), pair)


def merkle_root(
    manifest: DataFrame, keys: Sequence[str] = (KEY,), fold: int = FOLD
) -> DataFrame:
    """Root of the hash tree over the blocks of each key, in block order.

    ``block_index`` must be 0, 1, 2, ... per key. Each round folds ``fold``
    levels of aligned subtrees, so a billion blocks take three rounds and no
    group holds more than 2**fold hashes. A key with one block has the prefixed
    hash of that block as its root.
    """
    counts = manifest.groupBy(*keys).agg(F.count("*").alias("_left"))
    level = manifest.select(
        *keys,
        F.col("block_index").alias("_i"),
        F.sha2(F.concat(F.lit(LEAF), F.col("block_hash")), 256).alias("_h"),
    )
    # Levels above the leaves: ceil(log2(blocks)), from the exact binary length.
    depth = F.when(F.col("_left") <= 1, 0).otherwise(F.length(F.bin(F.col("_left") - 1)))
    heights = cut(counts.select(*keys, depth.cast("int").alias("_levels")))
    remaining = heights.agg(F.max("_levels")).first()[0] or 0
    done = 0
    while done < remaining:
        parts = level.groupBy(*keys, F.floor(F.col("_i") / 2**fold).cast("long").alias("_i")).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda r: r["_h"]
            ).alias("_nodes")
        )
        parts = parts.join(heights, list(keys))
        for step in range(fold):
            parts = parts.withColumn(
                "_nodes",
                F.when(F.col("_levels") > done + step, _parent(F.col("_nodes"))).otherwise(
                    F.col("_nodes")
                ),
            )
        level = cut(parts.select(*keys, "_i", F.col("_nodes")[0].alias("_h")))
        done += fold
    return level.select(*keys, F.col("_h").alias("merkle_root"))


def failed_blocks(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """Blocks that are missing, extra or different."""
    on = [*keys, "block_index"]
    left = actual.select(*on, F.col("block_hash").alias("actual_hash"))
    right = expected.select(*on, F.col("block_hash").alias("expected_hash"))
    return left.join(right, on, "full").filter(
        ~F.col("actual_hash").eqNullSafe(F.col("expected_hash"))
    )


def verify_manifest(
    actual: DataFrame,
    expected: DataFrame,
    expected_roots: DataFrame,
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Verdict per key: every block equal and the tree root equal.

    ``actual`` is the manifest computed from the table now; ``expected`` and
    ``expected_roots`` were stored when it was written.
    """
    bad = failed_blocks(actual, expected, keys).groupBy(*keys).agg(F.count("*").alias("failed_blocks"))
    stored = expected_roots.select(*keys, F.col("merkle_root").alias("expected_root"))
    now = merkle_root(actual, keys)
    failed = F.coalesce("failed_blocks", F.lit(0))
    same_root = F.col("merkle_root").eqNullSafe(F.col("expected_root"))
    return (
        now.join(stored, list(keys), "full")
        .join(bad, list(keys), "left")
        .select(
            *keys,
            failed.alias("failed_blocks"),
            same_root.alias("root_matches"),
            F.when((failed == 0) & same_root, "VERIFIED").otherwise("REJECTED").alias("verdict"),
        )
    )
