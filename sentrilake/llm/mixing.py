"""Mixing sources to target weights by blocks of equal token count.

1. Targets. Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the
   total; no target exceeds ``most`` times its source, the excess is shared again.
2. Seats. Blocks of ``block`` words are given to the sources by the highest quotients
   target / (2 k + 1) (Sainte-Lague).
3. Selection. The documents of a source stand in a seeded order and are cut into blocks.
   All blocks are taken as often as the seats allow; of the rest the seats take blocks at a
   seeded offset and even distance, which is a uniform choice since the order is.

All of it is column arithmetic: no document is listed per block. Running sums go over
1024 hash ranges of a source, so that one source may hold most rows.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own; rows that repeat are documents of their own; an empty table gives an
empty result. Other columns are left out of the working rows by ``take_blocks`` and kept
by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
MOST = 3
SEED = "mix-1"
_WORD = "[^\\x20\\x09-\\x0D]+"
_RANGE_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``sizes`` (source, size) to one row per source: source_size, weight, target.

    One row per source goes through a single task; documents do not. A source is capped if the
    even price of those with a higher cap per weight does not reach its own cap."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(Window.unboundedPreceding, 0)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    per = (
        per.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
        # The price per weight unit if this and all later sources were uncapped.
        .withColumn("price", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("price") * F.col("weight") >= F.col("cap"))
    )
    # The first source that is not capped sets the price for all from there on.
    price = F.first(F.when(~F.col("capped"), F.col("price")), ignorenulls=True).over(everything)
    open_ = F.coalesce(F.max(~F.col("capped")).over(upto), F.lit(False))
    return per.withColumn("even", price).withColumn(
        "target", F.when(open_, F.col("even") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    ).select("source", "source_size", F.col("weight").cast("int").alias("weight"), "target")


def sainte_lague(targets: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Adds ``n_blocks`` (of the source) and ``seats``: blocks given by the highest quotients.

    The rounded share is within half the number of sources of the number of seats; the seats
    that are missing or too many are the next quotients, of which each source offers as many as
    its share of them can be."""
    whole = Window.partitionBy()
    base = (
        targets.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("all_seats", F.ceil(F.sum("source_size").over(whole) / block).cast("long"))
        .withColumn("all_targets", F.sum("target").over(whole))
        .withColumn("share", F.coalesce(F.col("target") * F.try_divide("all_seats", "all_targets"), F.lit(0.0)))
        .withColumn("rounded", F.floor(F.col("share") + 0.5).cast("long"))
        .withColumn("miss", F.col("all_seats") - F.sum("rounded").over(whole))
        .withColumn("offer", F.when(F.col("miss") == 0, 0).otherwise(
            F.ceil(2 * F.abs("miss") * F.try_divide("share", F.col("all_seats").cast("double"))) + 2).cast("long"))
    )
    step = F.explode(F.sequence(F.lit(1), "offer"))
    # k-th further seat, or k-th seat to give back
    moves = base.where("offer > 0 AND target > 0").select("source", "target", "rounded", "miss", step.alias("k"))
    seat = F.when(F.col("miss") > 0, F.col("rounded") + F.col("k") - 1).otherwise(F.col("rounded") - F.col("k"))
    moves = moves.withColumn("seat", seat).where("seat >= 0").withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1))
    best = Window.orderBy(F.when(F.col("miss") > 0, -F.col("quotient")).otherwise(F.col("quotient")),
                          F.col("source").asc_nulls_last(), "k")
    moved = moves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.abs("miss"))
    moved = moved.groupBy("source").agg(F.count("*").alias("n_moved"))
    joined = base.join(moved.withColumnRenamed("source", "moved_source"),
                       F.col("source").eqNullSafe(F.col("moved_source")), "left")
    seats = F.col("rounded") + F.signum("miss").cast("long") * F.coalesce("n_moved", F.lit(0))
    return joined.select("source", "source_size", "weight", "target", "n_blocks",
                         F.least(seats, F.col("n_blocks") * most).cast("long").alias("seats"))


def shard_quotas(seats: DataFrame, shards: int) -> DataFrame:
    """Integer quotas per shard: (source, shard, blocks). Seat k of a source has its quotient at
    (2 k + 1) / (2 seats) of the list of all seats, so a shard takes the seats of one stretch."""
    def below(shard):  # seats k with (2k+1) * shards < 2 * seats * shard
        return F.ceil((F.col("seats").cast("double") * 2 * shard / shards - 1) / 2)

    out = seats.where("seats > 0").select("source", "seats", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    blocks = F.greatest(below(F.col("shard") + 1), F.lit(0)) - F.greatest(below(F.col("shard")), F.lit(0))
    return out.select("source", "shard", blocks.cast("long").alias("blocks"))


def _placed(rows: DataFrame, seats: DataFrame, seed: str) -> DataFrame:
    """Rows (source, size, key columns) with their seats and ``begin``, their place in the source."""
    rows = rows.withColumn("seeded", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("range", F.substring("seeded", 1, _RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_begin", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    ranges = ranges.join(seats.withColumnRenamed("source", "seat_source"), F.col("source").eqNullSafe(F.col("seat_source")))
    # No null in the keys of the large join: a plain equality keeps it open to skew handling.
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    ranges = ranges.withColumn("place", F.concat("range", key)).drop("source", "seat_source", "range", "range_size")
    rows = rows.withColumn("place", F.concat("range", key)).drop("range")
    inside = Window.partitionBy("place").orderBy("seeded", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(ranges, "place")
    return joined.withColumn("begin", F.col("range_begin") + F.col("before")).drop("place", "before", "range_begin")


_EPOCHS = "floor(seats / greatest(n_blocks, 1L))"
_OFFSET = "conv(substring(md5('{seed}'), 1, 8), 16, 10) / 4294967296.0D"


def _chosen_before(i: str, seed: str) -> str:
    """Extra blocks chosen among the first ``i`` of a source; all of them are seats mod n_blocks."""
    return (f"floor(CAST({i} AS DOUBLE) * (seats - {_EPOCHS} * n_blocks) / greatest(n_blocks, 1L)"
            f" + {_OFFSET.format(seed=seed)})")


def _words_before(x: str, block: int, seed: str) -> str:
    i = f"({x} DIV {block})"
    f0, f1 = _chosen_before(i, seed), _chosen_before(f"({i} + 1)", seed)
    return f"({f0} * {block} + ({f1} - {f0}) * ({x} - {i} * {block}))"


def take_blocks(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) to doc_id, size, source_size, target, taken: the words the
    mix takes of each document, repeats counted."""
    sizes = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    seats = sainte_lague(source_targets(sizes, most), block, most)
    placed = _placed(sizes, seats, seed)
    taken = f"{_EPOCHS} * size + {_words_before('(begin + size)', block, seed)} - {_words_before('begin', block, seed)}"
    return placed.select("doc_id", "size", "source_size", "target", F.expr(taken).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Whole documents as often as the mix takes them: once per full round of their source, and
    once more if the block with their first word is chosen. Columns of ``docs`` are kept."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "source",
                       size_of(F.col("text")).alias("size"))
    seats = sainte_lague(source_targets(docs.select("source", size_of(F.col("text")).alias("size")), most), block, most)
    placed = _placed(rows, seats, seed)
    i = f"(begin DIV {block})"
    copies = f"CASE WHEN size > 0 THEN {_EPOCHS} + {_chosen_before(f'({i} + 1)', seed)} - {_chosen_before(i, seed)} ELSE 0 END"
    out = placed.withColumn("copies", F.expr(copies).cast("int")).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
