"""Arrow batches in slices of bounded bytes.

A batch has up to 10 000 rows and, unless ``small_batches`` was called, 64 MB. As Python objects its texts take several times their bytes, so
tasks work on slices: a slice ends before the row that would take it above the limit, and a longer row is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20
SLICE_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``SLICE_BYTES``, so that neither the executor nor its Python workers
    hold more for a task than is worked on at once. A lower limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < set_to <= SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, by the bytes of a text or binary column or four times the entries of a list."""
    values = batch[column]
    if pa.types.is_list(values.type):
        length = pc.multiply(pc.list_value_length(values), 4)
    else:
        length = pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        end = int(np.searchsorted(ends, before + size, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES,
                rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices with their values as Python objects; a null is an empty one."""
    for batch in batches:
        values = batch[column]
        empty: list | str | bytes = [] if pa.types.is_list(values.type) else b"" if pa.types.is_binary(values.type) else ""
        for part in slices(batch, column, size, rows):
            yield part, [empty if x is None else x for x in part[column].to_pylist()]
