"""Batches of bounded size inside Arrow functions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa

# Characters of text, about, that become Python objects at once.
TEXT_AT_ONCE = 1 << 20


def text_parts(column: pa.Array, rows: int | None = None, most: int = TEXT_AT_ONCE) -> Iterator[list[str]]:
    """The texts in order, some at a time, null as empty: at most ``rows``, and not many characters unless one has them."""
    part: list[str] = []
    held = 0
    for value in column:
        text = value.as_py() or ""
        if part and (held + len(text) > most or len(part) == rows):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def release() -> None:
    """Return memory that this worker no longer uses; an executor's memory is that of all its workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
