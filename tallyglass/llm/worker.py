"""Objects that last as long as a Python worker.

Task code travels by value, so the state of its modules begins anew in every task. What is costly to make is kept in
a module of its own that only exists in the worker.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from functools import wraps
from types import ModuleType
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_NAME = "_tallyglass_llm_worker"
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # of glibc's mallopt


def per_worker(key: Hashable, make: Callable[[], T], most: int = 8) -> T:
    """The object under ``key``, made on first use; at most ``most`` objects of a kind (``key[0]``) are kept."""
    kept = sys.modules.setdefault(_NAME, ModuleType(_NAME)).__dict__.setdefault("kept", {})
    if key not in kept:
        alike = [k for k in kept if k[0] == key[0]]
        for old in alike[: max(0, len(alike) - most + 1)]:
            del kept[old]
        kept[key] = make()
    return kept[key]


def reuse_memory() -> None:
    """Let this worker's arrays of up to 32 MB take the place of freed ones, instead of new pages from the system each time.

    ``tidy`` hands the pages back.
    """

    def ask() -> bool:
        try:
            libc = ctypes.CDLL(None)
            return bool(libc.mallopt(_MMAP_THRESHOLD, 32 << 20) and libc.mallopt(_TRIM_THRESHOLD, 256 << 20))
        except (OSError, AttributeError):  # another C library
            return False

    per_worker(("memory",), ask)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task`` for ``mapInArrow``, which hands freed memory back to the system when a partition is done.

    Workers are reused; without this an idle one keeps the pages of its largest arrays.
    """

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to hand back
            pass

    return run
