"""Memory of Python workers, which live on and serve the tasks of later stages.

What a task took is freed at its end, but allocators keep it for the process: an
idle worker would go on holding the largest of its tasks beside the JVM.  ``lean``
hands it back.  Tables that serve later tasks of the same kind are kept by name and
dropped when a task of another kind begins.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: by kind of task: what its later tasks in this process find again
kept: dict[str, dict] = {}


def release() -> None:
    """Free memory goes back to the system, from Arrow's pool and from the C library's heap where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def begin(kind: str | None) -> None:
    """Only what tasks of ``kind`` use stays."""
    for other in kept.keys() - {kind}:
        del kept[other]


# The functions made below travel to the workers by value, and so would ``kept`` if they named it: they
# call ``begin``, which is found there by name and so has the worker's own tables.

def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str | None = None):
    """``run`` for mapInArrow, in a worker that keeps only what tasks of ``kind`` use."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(kind)
        try:
            yield from run(batches)
        finally:
            release()
    return task


def lean_group(run: Callable[[pa.Table], pa.Table]):
    """``run`` for applyInArrow, in a worker that keeps no tables; memory goes back after each group."""
    def group(table: pa.Table) -> pa.Table:
        begin(None)
        try:
            return run(table)
        finally:
            release()
    return group
