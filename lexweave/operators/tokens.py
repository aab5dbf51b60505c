"""Vocabulary, token ids and tokenization."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import scratch_path
from .batches import text_parts

PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2
# Tokens that a driver and each Python worker can hold as one table.
DRIVER_TOKENS = 1_000_000
# Leading bits that tell counts apart in the histogram.
LEVEL_BITS = 7


class Tokenizer(Protocol):
    """What ``tokenize`` needs; any tokenizer library fits behind it."""

    def encode(self, texts: Sequence[str]) -> list[Sequence[int]]: ...


class WordTokenizer:
    """Whitespace tokens looked up in a vocabulary."""

    def __init__(self, ids: dict[str, int], unk_id: int = UNK_ID):
        self.ids = ids
        self.unk_id = unk_id

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        get, unk = self.ids.get, self.unk_id
        return [[get(t, unk) for t in text.split()] for text in texts]


def vocabulary(df: DataFrame, column: str, size: int = 30_000) -> DataFrame:
    """The most frequent tokens (ties by token) with ids by rank, for any size.

    The counts are stored once. How many tokens have which count is a histogram of a few
    thousand rows at most, with counts that agree in their leading bits taken together: it tells
    which counts can be in, and at which rank each starts. Only those tokens are sorted, each
    group of counts by itself.
    """
    if size <= 0:
        raise ValueError(f"a vocabulary has one token at least, not {size}")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "token-counts")
    df.select(F.explode(words(column)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")) \
        .write.parquet(path)
    counts = spark.read.schema("token string, n long").parquet(path)
    grouped = counts.withColumn("level", count_level(F.col("n")))
    levels = sorted(grouped.groupBy("level").agg(F.count(F.lit(1)).alias("tokens")).collect(), reverse=True)
    starts, at = [], 0
    for r in levels:
        if at >= size:
            break
        starts.append((r["level"], at))
        at += r["tokens"]
    offsets = spark.createDataFrame(starts, "level long, before long")
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.col("n").desc(), F.col("token").asc()))
    ranked = grouped.join(F.broadcast(offsets), "level").withColumn("place", F.col("before") + place)
    return ranked.where(F.col("place") <= size).select(
        "token", "n", (F.col("place") - 1 + FIRST_ID).cast("int").alias("token_id")
    )


def count_level(n: Column) -> Column:
    """A number that rises with a count and is shared by counts with the same length and leading bits."""
    bits = F.length(F.bin(n))
    shift = F.greatest(bits - LEVEL_BITS, F.lit(0))
    return bits.cast("long") * (1 << LEVEL_BITS) + F.call_function("shiftright", n, shift)


def load_tokenizer(vocab: DataFrame, most: int = DRIVER_TOKENS) -> WordTokenizer:
    """Bring a vocabulary to the driver; one of over ``most`` tokens is for ``lookup_ids``."""
    rows = vocab.select("token", "token_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} tokens: look them up with a join")
    return WordTokenizer({r["token"]: r["token_id"] for r in rows})


def lookup_ids(tokens: DataFrame, vocab: DataFrame, unk_id: int = UNK_ID) -> DataFrame:
    """Add ``token_id``. Spark broadcasts a small vocabulary and splits frequent tokens otherwise."""
    joined = tokens.join(vocab.select("token", "token_id"), "token", "left")
    return joined.withColumn("token_id", F.coalesce("token_id", F.lit(unk_id)))


def encoder(tokenizer: Tokenizer, max_len: int):
    """An Arrow function text → ids, cut to ``max_len``. Spark broadcasts a large tokenizer."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        none = pa.array([], pa.list_(pa.int32()))
        return pa.concat_arrays([none, *map(coded, text_parts(texts))])

    def coded(texts: list[str]) -> pa.Array:
        ids = [np.asarray(i[:max_len], dtype=np.int32) for i in tokenizer.encode(texts)]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return encode


def mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def tokenize(
    df: DataFrame, column: str, tokenizer: Tokenizer, max_len: int = 2048, keep: Sequence[str] = ()
) -> DataFrame:
    """Truncated, unpadded ids and mask; source columns go unless kept."""
    ids = encoder(tokenizer, max_len)(F.col(column))
    coded = df.select(*keep, ids.alias("input_ids"))
    return coded.withColumn("attention_mask", mask(F.col("input_ids")))


def drop_prompt_tokens(output_ids: Column, input_ids: Column) -> Column:
    """What a decoder added after its input."""
    extra = F.greatest(F.size(output_ids) - F.size(input_ids), F.lit(0))
    return F.slice(output_ids, F.size(input_ids) + 1, extra)
