"""What Python workers remember from task to task.

Workers are reused, also by other operators. Whoever starts a task says what it remembers;
what others have left behind goes, and goes back to the system, so a worker holds the memory
of one operator at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_HELD: dict[str, Callable[[], None] | None] = {}


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Registers `owner`, whose memory `forget` drops if it has any, drops that of all others, and gives back what is free."""
    others = [k for k in _HELD if k != owner]
    for other in others:
        drop = _HELD.pop(other)
        if drop:
            drop()
    _HELD[owner] = forget
    if others:
        gc.collect()
    _give_back()


def _give_back() -> None:
    """Hands free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux with glibc keep what is free
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at the end of its task all memory that is registered here is dropped and given back: a worker that has nothing more to do keeps nothing."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for drop in _HELD.values():
            if drop:
                drop()
        gc.collect()
        _give_back()

    return tidied
