"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.llm.scratch import Scratch
from sentrilake.llm.worker import lean
from sentrilake.session import cut


def spanning(first: list[int], second: list[int]) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) for every other node of the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(first, second):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as stars, so that what goes on is linear in its nodes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100_000):
            part = batch.slice(at, 100_000)
            found = spanning(part[0].to_pylist(), part[1].to_pylist())
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "to"])


def connected_components(links: DataFrame, max_rounds: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """``links`` (two long columns, no nulls, any order, repeats allowed) to (node, component): the
    smallest node that is reachable, for every node with a link to another one.

    A round points every node's larger neighbours at its smallest one, then each node's smallest
    neighbours at one another. Sums are combined before the shuffle, and the joins are plain equalities,
    so that a node with very many links is split by adaptive execution. Rounds are written
    to the shared folder; their number grows with the logarithm of the longest path. With ``scratch``
    the rounds and the result are its tables, and a round is dropped once the next is written.
    """
    write = scratch.cut if scratch else cut
    a, b = links.columns[:2]
    stars = write(links.select(a, b).where(F.col(a) != F.col(b)).mapInArrow(lean(_contract), "node long, to long"))
    mark = _mark(stars)
    for _ in range(max_rounds):
        # node > to holds. Large star: neighbours above a node go to its smallest neighbour.
        both = stars.unionByName(stars.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("low")).select(
            F.col("node").alias("center"), F.least("low", "node").alias("low"))
        large = both.where("to > node").join(least, F.col("node") == F.col("center")).select(
            F.col("to").alias("node"), F.col("low").alias("to"))
        large = large.distinct()
        # Small star: neighbours below a node, and the node, go to the smallest.
        low = large.groupBy("node").agg(F.min("to").alias("low")).withColumnRenamed("node", "center")
        moved = large.join(low, F.col("node") == F.col("center")).select(F.col("to").alias("node"), F.col("low").alias("to"))
        small = moved.where("node != to").unionByName(low.select(F.col("center").alias("node"), F.col("low").alias("to")))
        earlier, stars = stars, write(small.distinct())
        if scratch:
            scratch.drop(earlier)
        new = _mark(stars)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select("node", F.col("to").alias("component"))


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(20,0)"))).first())
