"""Files as bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from sentrilake.session import cut

#: Files of more bytes are read in pieces by those who only need their head and counts.
WHOLE_BYTES = 4 << 20
HEAD_BYTES = 64
#: Most bytes of a piece, and the bytes that end one, in the order in which they are tried.
PIECE_BYTES = 1 << 20
_ENDS = ("\n", "\0", " ")
#: The text reader would unpack files of these names.
_UNPACKED = re.compile(r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$")


def _reader(spark: SparkSession, kind: str, glob: str | None) -> DataFrameReader:
    reader = spark.read.format(kind).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", glob) if glob else reader


def _piece_counts(end: str):
    """Rows (file, start, piece) in file order to one row per file and split: pieces, their bytes, counts of the byte
    values with the ends, and the first bytes of a file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, size, head, counts = None, 0, 0, b"", np.zeros(256, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"file": pa.array([key[0]]), "pieces": pa.array([pieces], pa.int64()), "size": pa.array([size], pa.int64()),
                 "head": pa.array([head[:HEAD_BYTES] if key[1] == 0 else None], pa.binary()),
                 "counts": pa.array([counts.tolist()], pa.list_(pa.int64()))}
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts, files = batch["start"].to_numpy(), batch["file"]
            new = (starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(new) + 1).tolist(), n]
            data = batch["piece"].cast(pa.large_binary())
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
            values = np.frombuffer(data.buffers()[2] or b"", np.uint8)
            for at, to in zip(borders[:-1], borders[1:]):
                if key != (files[at].as_py(), int(starts[at])):
                    if key:
                        yield row()
                    key, pieces, size, head, counts = (files[at].as_py(), int(starts[at])), 0, 0, b"", np.zeros(256, np.int64)
                counts += np.bincount(values[ends[at] : ends[to]], minlength=256)
                counts[ord(end)] += to - at
                pieces, size = pieces + to - at, size + int(ends[to] - ends[at])
                i = at
                while key[1] == 0 and len(head) < HEAD_BYTES and i < to:
                    head += data[i].as_py()[:HEAD_BYTES] + end.encode()
                    i += 1
        if key:
            yield row()

    return count


def _counted(spark: SparkSession, path: str, glob: str | None, above: int, end: str, files: set[str]) -> DataFrame:
    """file, head, counts of the files of more than ``above`` bytes whose pieces between two ``end`` are all short.

    The text reader splits a file and leaves out longer pieces, which shows in the sum of the lengths. It also
    leaves out a byte order mark and whether the last piece has an end; both show in that sum too.
    """
    lines = _reader(spark, "text", glob).option("lineSep", end).option("mapreduce.input.linerecordreader.line.maxlength", PIECE_BYTES)
    rows = lines.load(path).where((F.col("_metadata.file_size") > above) & F.col("_metadata.file_path").isin(*files))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    parts = cut(rows.mapInArrow(_piece_counts(end), "file string, pieces long, size long, head binary, counts array<long>"))
    each = parts.select("file", F.posexplode("counts").alias("byte", "n")).groupBy("file", "byte").agg(F.sum("n").alias("n"))
    counts = each.groupBy(F.col("file").alias("of")).agg(F.sort_array(F.collect_list(F.struct("byte", "n"))).alias("counts"))
    sums = parts.groupBy("file").agg(F.sum("pieces").alias("pieces"), F.sum("size").alias("size"), F.max("head").alias("head"))
    sizes = _reader(spark, "binaryFile", glob).load(path).select(F.col("_metadata.file_path").alias("of_file"), "length")
    more = F.col("length") - F.col("size") - F.col("pieces")  # -1: the last piece has no end; 3 more: the mark
    marked, ended = more >= 2, (more == 0) | (more == 3)
    mark = [(0xEF, marked), (0xBB, marked), (0xBF, marked), (ord(end), ~ended)]

    def exact(entry):
        byte = entry["byte"]
        changes = [F.when((byte == b) & holds, F.lit(-1 if b == ord(end) else 1)).otherwise(0) for b, holds in mark]
        return entry["n"] + sum(changes[1:], changes[0])

    found = sums.join(counts, F.col("file") == F.col("of")).join(sizes, F.col("file") == F.col("of_file")).where(more.isin(-1, 0, 2, 3))
    head = F.when(marked, F.substring(F.concat(F.lit(b"\xef\xbb\xbf"), "head"), 1, HEAD_BYTES)).otherwise(F.col("head"))
    return cut(found.select("file", head.alias("head"), F.transform("counts", exact).alias("counts")))


def read_binaries(spark: SparkSession, path: str, glob: str | None = None, whole_up_to: int | None = None) -> DataFrame:
    """(path, length, content) of every file below ``path``.

    With ``whole_up_to`` (at least 64) a longer file has no content but ``head``, its first 64 bytes, and ``counts``, how
    often each of the 256 byte values occurs. It is read in splits and pieces, so a task never holds more than some
    pieces. Only files that start like a PE file, whose sections lie anywhere, are named like packed ones, or have
    more than 1 MB without a line feed, without a zero and without a space have their content.
    """
    files = _reader(spark, "binaryFile", glob).load(path)
    if whole_up_to is None:
        return files.select("path", "length", "content")
    file, may_be_pe = F.col("_metadata.file_path"), F.startswith(F.col("head"), F.lit(b"MZ"))
    long_files = files.where(F.col("length") > whole_up_to).select(file.alias("file"), "path").collect()  # one row a long file
    left = {r["file"] for r in long_files if not _UNPACKED.search(r["path"])}
    whole = {r["file"] for r in long_files} - left
    none = [F.lit(None).cast("binary").alias("head"), F.lit(None).cast("array<long>").alias("counts")]
    out = files.where(F.col("length") <= whole_up_to).select("path", "length", "content", *none)
    for end in _ENDS:
        if left:
            found = _counted(spark, path, glob, whole_up_to, end, left)
            named = files.select("path", "length", file.alias("of")).join(found.where(~may_be_pe), F.col("of") == F.col("file"))
            out = out.unionByName(named.select("path", "length", F.lit(None).cast("binary").alias("content"), "head", "counts"))
            for name, with_content in found.select("file", may_be_pe).collect():
                left.remove(name)
                whole |= {name} if with_content else set()
    whole |= left
    if whole:
        out = out.unionByName(files.where(file.isin(*whole)).select("path", "length", "content", *none))
    return out
