"""Hard negatives by threshold joins that lower their thresholds until every window is full.

Every anchor looks for the best rows inside windows of scores: its positives are the best rows of its own label,
and the negatives of a positive the best rows of other labels within two percentages of the positive's score. A
threshold join finds all rows with at least a given score for each anchor. It starts high, where it is cheap, and is repeated
with a lower threshold for the anchors that have a window not yet full, down to the lowest score that a window admits.

The join works on blocks of rows. Dimensions are taken in the order of their energy in the rows at hand. By
Cauchy-Schwarz the rest of a row behind dimension k adds at most the product of the norms of both rests to a score; where
that stays below the threshold for every anchor of the block, the row's dimensions from k on are left out of the inverted
index. The lists are read dimension by dimension, partial scores are added up, and a pair goes as soon as its partial score
and the norms of its rests cannot reach the threshold. What is left is scored in full. Scores are whole
numbers, exact in double precision up to 2**53. In a task the threshold of an anchor also rises to what its windows hold
already.

Rows are dealt to shards of bounded size. Blocks of anchors, a stated query set, go to every shard, and a shard gives back
no more than a window's rows for each. No row is broadcast or collected.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite, take no part; rows
that share an id count as one, that with the smallest label and vector; a shorter vector counts as ending in zeros;
ties go to the smaller id; an anchor without another row of its label has no positives and no result; the windows of
negative positives are empty; an empty table gives no rows; other columns are left out. A squared norm of 2**53 or more
is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrilake.llm.scratch import Scratch
from sentrilake.session import cut

#: Rows of a block, of a shard, and anchors that one task compares with a block at once.
BLOCK_ROWS = 2048
SHARD_ROWS = 1 << 16
_ANCHORS = 256
#: Parts of the dimensions after which pairs that cannot reach their threshold go.
_STEPS = 4
#: First thresholds of positives by the largest possible score, of negatives by the best positive's.
_POSITIVE_STEPS = (0.6, 0.3)
_NEGATIVE_STEPS = (0.75, 0.6, 0.45)
_BLOCK = "shard int, kind int, n int, ids binary, labels binary, vectors binary, thresholds binary, windows binary"
_FOUND = "anchor_id long, found_id long, score long"


def participants(rows: DataFrame, vec_id: Column, label: Column, vector: Column) -> DataFrame:
    """vec_id, label, vector of the rows that take part, one for each id."""
    usable = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)
    first = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return first.select("vec_id", "row.label", "row.vector")


def _pack(rows: DataFrame, dims: int, shards: int | None) -> DataFrame:
    """Blocks of rows as bytes: each of one shard, or without ``shards`` of anchors with thresholds and windows."""
    size = BLOCK_ROWS if shards else _ANCHORS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() * 7919
        for batch in batches:
            task += 1
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = part["vector"]
                vectors = np.zeros((len(part), dims))
                lengths = lists.value_lengths().to_numpy()
                row = np.repeat(np.arange(len(part)), lengths)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                vectors[row, place] = lists.flatten().to_numpy()
                if (np.einsum("ij,ij->i", vectors, vectors) >= 2.0**53).any():
                    raise ValueError("scores of vectors this long are not exact in double precision")
                if shards:
                    more = [None, None]
                else:
                    windows = part["windows"].flatten().flatten().to_numpy().astype("<f8")
                    more = [part["threshold"].to_numpy().astype("<f8").tobytes(), windows.tobytes()]
                columns = [
                    (task + at // size) % shards if shards else 0, 0 if shards else 1, len(part), part["vec_id"].to_numpy().tobytes(),
                    part["label"].to_numpy().tobytes(), vectors.astype("<i4").tobytes(), *more,
                ]
                types = [pa.int32()] * 3 + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types)], [x.split()[0] for x in _BLOCK.split(", ")])

    return rows.mapInArrow(pack, _BLOCK)


def _norms(vectors: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of the rest of each row from each cut on."""
    squares = np.cumsum((vectors**2)[:, ::-1], axis=1)[:, ::-1]
    squares = np.concatenate([squares, np.zeros((len(vectors), 1))], axis=1)
    return np.sqrt(squares[:, cuts])


def candidates(rows: np.ndarray, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs with a score of at least the anchor's threshold."""
    order = np.argsort(-(rows**2).sum(axis=0), kind="stable")
    rows, anchors = rows[:, order], anchors[:, order]
    cuts = sorted({rows.shape[1] * k // _STEPS for k in range(_STEPS + 1)})
    row_rest, anchor_rest = _norms(rows, cuts), _norms(anchors, cuts)
    # A little slack for the rounding of the norms; what passes is scored exactly.
    least = thresholds - 1e-6 * (1 + row_rest[:, 0].max(initial=0) * anchor_rest[:, 0].max(initial=0))
    # The first cut from which on a row is left out of the lists; rows with the longest lists come first.
    covered = row_rest * anchor_rest.max(axis=0, initial=0) < least.min(initial=np.inf)
    ends = np.where(covered.any(axis=1), covered.argmax(axis=1), len(cuts) - 1)
    by_end = np.argsort(-ends, kind="stable")
    by_end = by_end[: int((ends > 0).sum()) if len(cuts) > 1 else len(rows)]
    rows, row_rest, ends = rows[by_end], row_rest[by_end], ends[by_end]
    scores, alive = np.zeros((len(rows), len(anchors))), np.ones((len(rows), len(anchors)), bool)
    for k, (begin, end) in enumerate(zip(cuts, cuts[1:])):
        listed = int((ends > k).sum())
        scores[:listed] += rows[:listed, begin:end] @ anchors[:, begin:end].T
        # A row whose list has ended keeps the rest it ended with.
        at = np.minimum(ends, k + 1)
        alive = scores + row_rest[np.arange(len(rows)), at][:, None] * anchor_rest[:, at].T >= least
        if 8 * alive.sum() <= alive.size:
            break
    r, c = np.nonzero(alive)
    exact = [np.einsum("ij,ij->i", rows[r[i : i + 65536]], anchors[c[i : i + 65536]]) for i in range(0, len(r), 65536)]
    exact = np.concatenate([np.zeros(0), *exact])
    keep = exact >= thresholds[c]
    return by_end[r[keep]], c[keep], exact[keep].astype(np.int64)


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Place of every entry among those of its group, which stand together."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else groups
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


class _Anchors:
    """The anchors of a block and the best rows of the shard so far for each of their windows."""

    def __init__(self, row: dict, most: int, same_label: bool):
        self.ids, self.labels = (np.frombuffer(row[x], np.int64) for x in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(row["n"], -1).astype(np.float64)
        self.thresholds = np.frombuffer(row["thresholds"], "<f8").copy()
        self.windows = np.frombuffer(row["windows"], "<f8").reshape(row["n"], -1, 2)
        self.most, self.same = most, same_label
        self.found = (np.zeros(0, np.int64),) * 3  # anchor, id, score

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        r, c, score = candidates(vectors, self.vectors, self.thresholds)
        keep = ((labels[r] == self.labels[c]) == self.same) & (ids[r] != self.ids[c])
        c, found, score = (np.concatenate(x) for x in zip(self.found, (c[keep], ids[r[keep]], score[keep])))
        order = np.lexsort((found, -score, c))
        c, found, score = c[order], found[order], score[order]
        wanted = np.zeros(len(c), bool)
        rise = np.full(len(self.ids), np.inf)
        for low, high in self.windows.transpose(1, 2, 0):
            inside = np.flatnonzero((score >= low[c]) & (score <= high[c]))
            rank = _ranks(c[inside])
            wanted[inside[rank < self.most]] = True
            # Below the last row of a full window, or below its lower end, there is nothing to find for it.
            reached = low.copy()
            last = inside[rank == self.most - 1]
            reached[c[last]] = score[last]
            rise = np.minimum(rise, np.where(low > high, np.inf, reached))
        self.found = c[wanted], found[wanted], score[wanted]
        self.thresholds = np.maximum(self.thresholds, rise)


def _join(blocks: DataFrame, anchors: DataFrame, shards: int, most: int, same_label: bool) -> DataFrame:
    """For every anchor and shard the best ``most`` rows of each window with at least the anchor's threshold."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i].as_py() for name in batch.schema.names}
                if row["shard"] != shard:
                    shard, rows = row["shard"], []
                if row["kind"] == 0:
                    rows.append(row)
                    continue
                block = _Anchors(row, most, same_label)
                for part in rows:
                    ids, labels = (np.frombuffer(part[x], np.int64) for x in ("ids", "labels"))
                    block.add(ids, labels, np.frombuffer(part["vectors"], "<i4").reshape(part["n"], -1).astype(np.float64))
                c, found, score = block.found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[c]), pa.array(found), pa.array(score)], ["anchor_id", "found_id", "score"])

    every = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = blocks.unionByName(every.select(*blocks.columns)).repartition(shards, "shard")
    return dealt.sortWithinPartitions("shard", "kind").mapInArrow(search, _FOUND)


def _search(blocks: DataFrame, anchors: DataFrame, steps: list[Column], dims: int, shards: int, most: int,
            same_label: bool, scratch: Scratch) -> DataFrame:
    """The best ``most`` rows for each window of the anchors (vec_id, label, vector, windows): anchor_id, window (from 0),
    rank, found_id, score. Thresholds are lowered step by step, the last one is what the windows ask for. Only
    anchors with a window that is neither full nor read to its lower end take part again."""
    lows = F.transform(F.filter("windows", lambda w: w[0] <= w[1]), lambda w: w[0])
    floor = F.array_min(lows)
    open_ = scratch.cut(anchors.where(floor.isNotNull()))
    done = []
    for step in [*steps, None]:
        threshold = floor if step is None else F.greatest(floor, step)
        asked = open_.withColumn("threshold", threshold.cast("double"))
        packed = scratch.cut(_pack(asked, dims, None))
        found = scratch.cut(_join(blocks, packed, shards, most, same_label))
        cells = asked.select(F.col("vec_id").alias("anchor"), "threshold", F.posexplode("windows").alias("window", "w"))
        cells = cells.where(F.col("w")[0] <= F.col("w")[1])
        hits = found.join(cells, (F.col("anchor") == F.col("anchor_id")) & F.col("score").between(F.col("w")[0], F.col("w")[1]))
        place = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "found_id"))
        best = hits.select("anchor_id", "window", place.alias("rank"), "found_id", "score").where(F.col("rank") <= most)
        if step is None:
            done.append(best)
            break
        best = scratch.cut(best)
        full = best.where(F.col("rank") == most).select(F.col("anchor_id").alias("full_id"), F.col("window").alias("full_window"))
        short = cells.join(full, (F.col("anchor") == F.col("full_id")) & (F.col("window") == F.col("full_window")), "left_anti")
        short = short.where(F.col("threshold") > F.col("w")[0]).select(F.col("anchor").alias("short_id")).distinct()
        still = scratch.cut(open_.join(short, F.col("vec_id") == F.col("short_id"), "left_semi"))
        again = still.select(F.col("vec_id").alias("again_id"))
        done.append(best.join(again, F.col("anchor_id") == F.col("again_id"), "left_anti"))
        if still.isEmpty():
            break
        open_ = still
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mine_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30,
                   most_percent: int = 90) -> DataFrame:
    """``rows`` as ``participants`` gives them, with whole components; ``is_anchor`` a condition on them. For each anchor and each of its
    first ``positives`` rows of the same label the first ``negatives`` rows of other labels whose score is within the
    percentages of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with Scratch(spark) as scratch:
        rows = scratch.cut(rows)
        n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        if not n:
            return spark.createDataFrame([], schema)
        dims = max(dims, 1)
        shards = max(2 * spark.sparkContext.defaultParallelism, -(-n // SHARD_ROWS))
        blocks = scratch.cut(_pack(rows, dims, shards))
        anchors = rows.where(is_anchor)
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        longest = scratch.cut(rows.agg(F.max(norm).alias("longest"))).first()[0]
        every = F.array(F.array(F.lit(float("-inf")), F.lit(float("inf"))))
        steps = [norm * longest * x for x in _POSITIVE_STEPS]
        best = scratch.cut(_search(blocks, anchors.withColumn("windows", every), steps, dims, shards, positives, True, scratch))
        low = F.expr(f"CAST(ceil(CAST(score AS DECIMAL(19)) * {least_percent} / 100) AS DOUBLE)")
        high = F.expr(f"CAST(floor(CAST(score AS DECIMAL(19)) * {most_percent} / 100) AS DOUBLE)")
        wanted = best.groupBy(F.col("anchor_id").alias("anchor")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "found_id", "score", low.alias("low"), high.alias("high")))).alias("positives"))
        joined = scratch.cut(anchors.join(wanted, F.col("vec_id") == F.col("anchor")).select(
            "vec_id", "label", "vector", "positives", F.transform("positives", lambda p: F.array(p["low"], p["high"])).alias("windows")))
        top = F.col("windows")[0][1] * 100 / most_percent
        found = _search(blocks, joined.drop("positives"), [top * x for x in _NEGATIVE_STEPS], dims, shards, negatives, False, scratch)
        of = joined.select("vec_id", F.posexplode("positives").alias("place", "positive"))
        out = found.join(of, (F.col("anchor_id") == F.col("vec_id")) & (F.col("window") == F.col("place")))
        return cut(out.select(
            "anchor_id", F.col("positive.found_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("found_id").alias("negative_id"), F.col("positive.score").alias("positive_score"),
            F.col("score").alias("negative_score")))
