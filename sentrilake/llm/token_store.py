"""Token-id files with Elias-Fano document borders.

A store is a set of shards in ascending doc_id order. A shard has two files:
``ids`` is the plain concatenation of all its documents' ids (16 bits each), and
``index`` holds the ends of the documents and their ids as Elias-Fano sequences,
with select samples, so that a document's offset is found without a 64-bit table.

Defined results: a null text is an empty document (only the end id); rows with
equal doc_id keep their own entries, ordered by text; a null doc_id comes first
and is read back as null; an empty table gives a store without documents. Other
columns are not stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrilake.llm import tokens
from sentrilake.llm.elias_fano import EliasFano, encode
from sentrilake.llm.files import open_input, open_output
from sentrilake.llm.slices import slices
from sentrilake.session import cut, shared_path

_INDEX = struct.Struct("<4sqqq")
_MAGIC = b"TST1"
_READ_IDS = 1 << 21


def write_store(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write a store to the shared folder.

    Returns the manifest: shard, n_docs, n_tokens, start (ids in all shards before), ids_path,
    index_path. One shuffle by ranges of (doc_id, hash of the text), so that a repeated doc_id
    is dealt out too.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "token-store")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = tokens.encoder(tokenizer or tokens.default_tokenizer())
        end = np.array([end_id], "<u2").tobytes()
        ids, lengths, nulls, path, out = [], [], 0, None, None
        for batch in batches:
            if out is None:
                out, path = open_output(folder, f"ids-{shard:05d}")
            for part in slices(batch):
                found, ends = encoder.encode(part["text"], end)
                lengths.append(np.diff(ends, prepend=0))
                nulls += part["doc_id"].null_count
                ids.append(part["doc_id"].drop_null().to_numpy())
                out.write(found.tobytes())
        if out is None:
            return
        out.close()
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        ends, names = encode(np.cumsum(lengths)), encode(ids)
        index, index_path = open_output(folder, f"index-{shard:05d}")
        index.write(_index_head(nulls, len(ends), len(names)) + ends + names)
        index.close()
        columns = [[shard], [len(lengths)], [int(lengths.sum())], [path], [index_path]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(),) * 2)],
            ["shard", "n_docs", "n_tokens", "ids_path", "index_path"],
        )

    schema = "shard long, n_docs long, n_tokens long, ids_path string, index_path string"
    manifest = cut(ranged.mapInArrow(write, schema))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _index_head(nulls: int, ends: int, names: int) -> bytes:
    return _INDEX.pack(_MAGIC, nulls, ends, names)


class ShardIndex:
    """Borders and names of a shard's documents."""

    def __init__(self, path: str):
        with open_input(path) as file:
            data = file.read()
        magic, self.nulls, ends, names = _INDEX.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError(f"{path} is no index of a token store")
        at = _INDEX.size
        self.ends = EliasFano(data[at : at + ends])
        self.names = EliasFano(data[at + ends : at + ends + names])

    def __len__(self) -> int:
        return len(self.ends)

    def borders(self, i: int, j: int) -> np.ndarray:
        """First id of document i, then the ends of documents i to j - 1."""
        start = self.ends.select(i - 1) if i else 0
        return np.concatenate([[start], self.ends.slice(i, j)])

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        known = self.names.slice(max(0, i - self.nulls), max(0, j - self.nulls))
        return [None] * (min(j, len(self)) - i - len(known)) + known.tolist()


def read_document(ids_path: str, index: ShardIndex, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard."""
    first, end = index.borders(i, i + 1)
    with open_input(ids_path) as file:
        file.seek(int(first) * 2)
        return np.frombuffer(file.read(int(end - first) * 2), "<u2")


def read_store(manifest: DataFrame) -> DataFrame:
    """Every document of the store: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit
    little-endian numbers). The files are read in pieces of bounded size."""
    spark = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index = ShardIndex(row["index_path"])
                with open_input(row["ids_path"]) as file:
                    for i in range(0, len(index), 1024):
                        j = min(len(index), i + 1024)
                        borders = index.borders(i, j)
                        sums = [_crc(file, a, b) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(index.doc_ids(i, j), pa.int64()),
                                pa.array(borders[:-1] + row["start"], pa.int64()),
                                pa.array(np.diff(borders), pa.int64()),
                                pa.array(sums, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return manifest.repartition(tasks).mapInArrow(read, schema)


def _crc(file, first: int, end: int) -> int:
    crc = 0
    file.seek(first * 2)
    while first < end:
        n = min(_READ_IDS, end - first)
        crc = zlib.crc32(np.frombuffer(file.read(n * 2), "<u2").astype("<u4").tobytes(), crc)
        first += n
    return crc
