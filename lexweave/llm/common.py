"""What the operators share: the word rule, the folds, text batches and worker caches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters outside these.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text that one numpy pass handles; arrays over them take about fifty times that.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none. Stays in the JVM."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def word_count(text: Column) -> Column:
    """The number of words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from. A null id belongs to no fold that teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _kept() -> dict:
    """What this Python worker keeps; a module of its own outlives the tasks."""
    module = sys.modules.setdefault("lexweave_llm_worker", ModuleType("lexweave_llm_worker"))
    return module.__dict__.setdefault("kept", {})


def worker_cache(key: str, make: Callable[[], object]):
    """An object kept by this Python worker, which keeps one at a time."""
    kept = _kept()
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def give_back(everything: bool = True) -> None:
    """Return memory that this worker no longer uses, and what it keeps, to the system.

    Workers outlive their stages, and an executor's memory is that of all of its workers.
    """
    if everything:
        _kept().clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def settle() -> None:
    """Drop what earlier stages made this worker keep."""
    if _kept():
        give_back()


def tidy(run: Callable) -> Callable:
    """An Arrow function over batches whose worker gives memory back before and after it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        yield from run(batches)
        give_back()

    return tidied


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each text begins, with the end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    # fill_null and cast leave whole buffers, but a slice may start inside them.
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, starts) of runs of whole texts."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, most):
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, so that joined columns can't clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


# Rows of ids that are small enough for every executor.
BROADCAST_ROWS = 500_000


def if_small(ids: DataFrame, rows: int) -> DataFrame:
    """Ids to be broadcast if their table, which has ``rows`` rows, is small; else they are joined as usual."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids
