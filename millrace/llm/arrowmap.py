"""Helpers for operators that map Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import cache

import pyarrow as pa


@cache
def _libc() -> ctypes.CDLL | None:
    with suppress(OSError, AttributeError):
        return ctypes.CDLL("libc.so.6")
    return None


def thrifty(kept: int = 1 << 20) -> None:
    """Have this worker hand the memory of arrays of more than ``kept`` bytes back as soon as they go. glibc otherwise raises the size
    from which it does so to that of the largest array freed, and reused workers then keep their peak. What is handed back
    is cleared by the system when it is asked for again, which costs more than the work on many short-lived arrays."""
    libc = _libc()
    if libc:
        libc.mallopt(-3, kept)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, kept)  # M_TRIM_THRESHOLD


def release() -> None:
    """Hand back what Arrow's pool holds unused."""
    pa.default_memory_pool().release_unused()


def gathered(batches: Iterable[pa.RecordBatch], least: int = 8 << 20, most_rows: int = 200_000, kept: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of about ``least`` bytes from smaller batches, and from pieces of larger ones; an empty input gives none."""
    thrifty(kept)
    held, size, rows = [], 0, 0
    for whole in batches:
        step = max(1, whole.num_rows * least // max(whole.nbytes, 1))
        for at in range(0, whole.num_rows, step):
            b = whole.slice(at, step)
            held.append(b)
            size, rows = size + b.nbytes, rows + b.num_rows
            if size >= least or rows >= most_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
                release()
    if held:
        yield pa.Table.from_batches(held)


def batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches()
