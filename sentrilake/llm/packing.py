"""Best-fit packing of pieces into sequences, certified by lower bounds.

Every partition packs its own items by best-fit decreasing and computes a lower
bound of its bin count from dual-feasible functions. Where the two are equal the
packing is optimal and final. Partitions with a gap keep their well filled bins and
hand the items of the others over; those are dealt anew to fewer partitions and
packed again, until all are certified or the rounds end.

Defined results: a null text is an empty document, which still has its end id; rows
that repeat are packed each on its own; an empty table gives no rows; other columns
are not carried. Items longer than the capacity must be cut first (``cut_tokens``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.llm import tokens
from sentrilake.llm.slices import slices
from sentrilake.session import cut, release_driver

CAPACITY = 1024
#: Pieces that one task packs: enough to find partners, few enough for its memory.
PER_TASK = 20_000
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_tokens(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None,
               end_id: int = 2) -> DataFrame:
    """Pieces of the encoded documents, each document closed by ``end_id``. A longer one is cut
    into pieces of the capacity, the first piece holding the rest. One pass, no shuffle."""

    def encode(batches):
        encoder = tokens.encoder(tokenizer or tokens.default_tokenizer())
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for part in slices(batch):
                out = []
                found, ends = encoder.encode(part["text"], end)
                for doc, ids in zip(part["doc_id"].to_pylist(), np.split(found.astype("<u4"), ends[:-1])):
                    first = len(ids) % capacity or capacity
                    borders = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                    out += [
                        (doc, k, a, b - a, zlib.crc32(ids[a:b]))
                        for k, (a, b) in enumerate(zip(borders, borders[1:]))
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), _PIECE_TYPES)], _PIECE
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of three families of dual-feasible functions: total size, sizes below a
    limit left out while those above its complement take a whole bin, and rounding by k."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int(counts @ size) // capacity)
    # Limit t: above capacity - t counts as a whole bin, below t as nothing.
    weight, number = np.cumsum(counts * size), np.cumsum(counts)
    t = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - t]
    middle = weight[capacity - t] - weight[t - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 65):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int(counts @ value) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin numbers of items given in descending order of length. The fullest bin with room is
    found from one bit per free amount."""
    out = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0
    for i, n in enumerate(lengths.tolist()):
        fit = some >> n
        if fit:
            room = (fit & -fit).bit_length() - 1 + n
            bin_ = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, bin_, bins = capacity, bins, bins + 1
        out[i] = bin_
        if room > n:
            free[room - n].append(bin_)
            some |= 1 << (room - n)
    return out


def _pack_round(items: DataFrame, partitions: int, level: int, last: bool, capacity: int) -> DataFrame:
    """Packs each partition; ``sequence_id`` is null for items that go to the next round."""

    def pack(batches):
        from pyspark import TaskContext

        columns = [[] for _ in _PIECE]
        for batch in batches:
            for values, name in zip(columns, _PIECE):
                values.append(batch.column(name))
        if not columns[0]:
            return
        columns = [pa.concat_arrays(c) for c in columns]
        lengths = columns[3].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths).astype(np.int64)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(lengths[order])
        first = np.concatenate([[True], np.diff(bins[order]) > 0])
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offsets = np.empty(len(bins), np.int64)
        offsets[order] = ends - lengths[order] - base
        gap = len(filled) - lower_bound(lengths, capacity)
        handed = np.zeros(len(filled), bool)
        if gap and not last:
            # The emptiest bins hold the slack: as many as the gap asks for, and their like.
            handed[np.argsort(filled, kind="stable")[: max(4 * gap, len(filled) // 8)]] = True
        task = level * (1 << 24) + TaskContext.get().partitionId()
        for at in range(0, len(bins), 50_000):
            now = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [c[now] for c in columns]
                + [
                    pa.array(bins[now] + (task << 32), pa.int64(), mask=handed[bins[now]]),
                    pa.array(offsets[now], pa.int64()),
                ],
                [*_PIECE, "sequence_id", "offset"],
            )

    dealt = items.repartition(partitions, F.xxhash64(*_PIECE, F.lit(level)))
    ordered = dealt.sortWithinPartitions(F.desc("length"), *_PIECE)
    return ordered.mapInArrow(pack, f"{PIECES}, sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 3, per_task: int = PER_TASK) -> DataFrame:
    """Place ``pieces`` (doc_id, piece, start, length 1 to capacity, ids_crc32) in sequences: adds
    sequence_id and offset. A task packs about ``per_task`` pieces. Round by round an eighth of the
    partitions is used, since the items handed over are few; the last round keeps what it packs."""
    partitions = -(-pieces.count() // per_task) or 1
    done, items = [], pieces
    for level in range(rounds):
        last = level == rounds - 1
        packed = cut(_pack_round(items, partitions, level, last, capacity))
        done.append(packed.where("sequence_id IS NOT NULL"))
        items = packed.where("sequence_id IS NULL").drop("sequence_id", "offset")
        partitions = -(-partitions // 8)
    release_driver(pieces.sparkSession)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to sequences: one row per piece with its place."""
    return pack(cut(cut_tokens(docs, capacity, tokenizer)), capacity)
