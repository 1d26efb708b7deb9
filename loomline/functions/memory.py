"""Memory of Python workers: what bounds an Arrow batch, and what a task gives back at its end."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows and bytes of an Arrow batch. A batch is in memory twice on its way, so these bound a worker's memory as much as a kernel's blocks do.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with arrays of a megabyte or more outside the heap, where freeing them gives them back; then memory that the allocators keep is given back too: workers live on for other operators' tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed instead of growing with what is freed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
