"""Quality rules by compression bands.

zstandard ratios (compressed bytes per byte) of the whole text and of its fixed chunks
must lie inside a band. Repetitive text falls below it, random or encoded text above.
Short texts compress worse, so both bands depend on the length. The last chunk is the final
``chunk_bytes``, or the whole text if that is shorter, so no byte is left unjudged.

The upper limits of chunks are halfway between prose and base64: 0.51 (99% of the sf0.1 documents) and
0.77 at 2048 bytes. Hex digits reach 0.52 to 0.54 there, which prose does as well: no ratio tells them apart.

Defined results: a null or empty text has no words, fails the base rules and has no ratio
(null); texts that repeat are judged alike; an empty table gives no rows.
``judge_quality`` returns doc_id and the figures only, ``keep_quality`` the kept rows with
all columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.llm.slices import slices
from sentrilake.llm.worker import lean


@dataclass(frozen=True)
class Bands:
    """Limits of the ratios. ``whole``: (bytes from which it holds, lowest, highest)."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.30, 0.95), (512, 0.28, 0.85), (2048, 0.25, 0.75), (8192, 0.22, 0.70), (32768, 0.20, 0.68),
    )
    chunk_bytes: int = 2048
    #: As ``whole``, by the bytes of a chunk. Only the one chunk of a short text has fewer than ``chunk_bytes``.
    chunk: tuple[tuple[int, float, float], ...] = (
        (0, 0.25, 0.95), (256, 0.25, 0.85), (384, 0.25, 0.79), (512, 0.25, 0.76), (768, 0.25, 0.72), (1024, 0.25, 0.69),
        (1536, 0.25, 0.66), (2048, 0.25, 0.64),
    )
    #: Largest share of a text's chunks that may lie outside the chunk band.
    odd_chunks: float = 0.2
    level: int = 3


#: Fewest words, and the largest percentage of words in repeated three-word windows.
LEAST_WORDS = 50
MOST_REPEATED = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIGURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(),
    "odd_chunks": pa.float64(),
}
_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, ratio double, odd_chunks double")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which stands at two places or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * len(number) + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def _band(bands: tuple[tuple[int, float, float], ...], size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if size >= least)


def _chunks(data: bytes, size: int) -> list[bytes]:
    """Fixed chunks, and the final ``size`` bytes where they do not end with the text."""
    full = [data[i : i + size] for i in range(0, len(data) - size + 1, size)]
    return full if full and len(data) % size == 0 else [*full, data[-size:]]


def _figures(data: bytes, compress, bands: Bands) -> tuple:
    words = data.split()
    n = len(words)
    codes = np.frombuffer(data, np.uint8)
    white = data.count(b" ") + sum(data.count(bytes([c])) for c in range(9, 14))
    chars = len(data) - int(((codes & 0xC0) == 0x80).sum()) - white
    symbols = int(_SYMBOL[codes].sum())
    seen: set[bytes] = set()
    copies = 0
    for line in data.split(b"\n"):
        if line in seen:
            copies += 1
        elif line.strip():
            seen.add(line)
    repeated = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    if not data:
        return n, chars, symbols, copies, repeated, failed, False, None, None
    ratio = len(compress(data)) / len(data)
    chunks = _chunks(data, bands.chunk_bytes)
    low, high = _band(bands.chunk, len(chunks[0]))
    odd = sum(not low <= len(compress(c)) / len(c) <= high for c in chunks) / len(chunks)
    low, high = _band(bands.whole, len(data))
    kept = not failed and low <= ratio <= high and odd <= bands.odd_chunks
    return n, chars, symbols, copies, repeated, failed, kept, ratio, odd


def _judge(texts: pa.Array, bands: Bands) -> list[tuple]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=bands.level).compress
    return [_figures(x or b"", compress, bands) for x in texts.cast(pa.binary()).to_pylist()]


def judge_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Figures and verdict of every row of ``docs`` (doc_id, text). One pass, no shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = [pa.array(c, t) for c, t in zip(zip(*_judge(part["text"], bands)), _FIGURES.values())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", *_FIGURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(judge), _SCHEMA)


def keep_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([x[6] for x in _judge(part["text"], bands)], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
