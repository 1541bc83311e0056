"""Memory of Python workers, which outlive their tasks and go on to those of other operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_KEPT: list[dict] = []


def keeps() -> dict:
    """A dict of what a worker keeps for the next task of its kind; a task that is ``lean`` empties it."""
    _KEPT.append({})
    return _KEPT[-1]


def forget() -> None:
    for kept in _KEPT:
        kept.clear()


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` for ``mapInArrow``, without what tasks of other kinds keep in the worker; what it took itself
    is given back at its end. Otherwise an executor holds the most that any operator needed, for each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from work(batches)
        finally:
            release()

    return run
