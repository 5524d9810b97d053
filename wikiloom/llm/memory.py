"""Memory that a Python worker gives back when a task ends, since the next task may be another job's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(
    function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], *free: Callable[[], None]
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that calls ``free`` and gives memory back after its last batch."""

    @wraps(function)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            for call in free:
                call()
            give_back()

    return run
