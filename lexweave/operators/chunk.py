"""Documents → overlapping chunks that keep the document's columns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import strip
from .batches import release, text_parts


def chunk_id(source: Column, chunk_no: Column, content: Column) -> Column:
    """The same chunk always gets the same id."""
    return F.sha2(F.concat_ws("\n", source.cast("string"), chunk_no.cast("string"), content), 256)


def chunk_fixed(df: DataFrame, column: str, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Character windows; the last one is the first that reaches the end of the text.

    The text is cut once into pieces of one step, and a window joins the pieces it
    spans, so the work grows with the length of the text and not with its square.
    """
    step = cfg.size - cfg.overlap
    span = -(-cfg.size // step)
    windows = F.greatest(F.ceil((F.length(column) - cfg.overlap) / step), F.lit(1)).cast("int")
    rest = [c for c in df.columns if c != column]
    pieces = F.regexp_extract_all(column, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = df.select(*rest, pieces.alias("__pieces"), windows.alias("__windows"))

    def window(_: Column, i: Column) -> Column:
        return F.left(F.array_join(F.slice("__pieces", i + 1, span), ""), F.lit(cfg.size))

    joined = F.transform(F.slice("__pieces", F.lit(1), F.col("__windows")), window)
    return (
        cut.select(*rest, F.posexplode(joined).alias("chunk_no", "content"))
        .withColumn("content", strip("content"))
        .where(F.col("content") != "")
    )


def _pieces(text: str, separator: str) -> list[str]:
    """Split with the separator glued to the front of the piece that follows it."""
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return [p for p in (first, *(separator + o for o in others)) if p]


def _merge(pieces: list[str], cfg: ChunkConfig) -> Iterator[str]:
    """Fill chunks up to the size; each starts with the tail of the one before."""
    held: deque[str] = deque()
    width = 0
    for piece in pieces:
        if held and width + len(piece) > cfg.size:
            yield "".join(held).strip()
            while held and (width > cfg.overlap or width + len(piece) > cfg.size):
                width -= len(held.popleft())
        held.append(piece)
        width += len(piece)
    yield "".join(held).strip()


def split_text(text: str, cfg: ChunkConfig, level: int = 0) -> Iterator[str]:
    """Cut at the coarsest separator that occurs; pieces still too long go one finer."""
    seps = cfg.separators
    while level < len(seps) - 1 and seps[level] and seps[level] not in text:
        level += 1
    finer = level + 1 if seps[level] and level + 1 < len(seps) else None
    waiting: list[str] = []
    for piece in _pieces(text, seps[level]):
        if len(piece) < cfg.size:
            waiting.append(piece)
            continue
        yield from filter(None, _merge(waiting, cfg))
        waiting = []
        if finer is None:
            yield piece
        else:
            yield from split_text(piece, cfg, finer)
    yield from filter(None, _merge(waiting, cfg))


def chunk_recursive(df: DataFrame, column: str, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Separator-aware chunks; each row is cut by itself, so nothing is shuffled."""

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in text_parts(texts):
                yield pa.array([list(split_text(t, cfg)) if t else [] for t in part], pa.list_(pa.string()))
        release()

    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(cut(F.col(column))).alias("chunk_no", "content"))


def with_chunk_id(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.withColumn(
        "chunk_id", chunk_id(F.col(source), F.col("chunk_no"), F.col("content"))
    )
