"""Batches of equal-length id rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_key
from .ranking import SEGMENT, hash_position, with_position
from .tokens import PAD_ID, Tokenizer, encoder, mask

IGNORED = -100


def assign_batches(
    df: DataFrame,
    ids: list[str],
    size: int = 4,
    shuffle: bool = True,
    drop_last: bool = False,
    seed: int = 42,
    segment: int = SEGMENT,
) -> DataFrame:
    """Add ``batch_id``; every batch is full but the last, which ``drop_last`` leaves out."""
    if shuffle:
        keyed = df.withColumn("__order", seeded_key(seed, *ids))
        placed, rows = hash_position(keyed, "__pos", "__order", segment=segment)
    elif len(ids) == 1:
        keyed = df.withColumn("__order", F.col(ids[0]).cast("long"))
        placed = with_position(keyed, "__pos", "__order", segment=segment)
        rows = df.count() if drop_last else 0
    else:
        raise ValueError("keeping the row order needs one integer row id")
    out = placed.withColumn("batch_id", F.floor((F.col("__pos") - 1) / size).cast("long"))
    if drop_last:
        out = out.where(F.col("batch_id") < rows // size)
    return out.drop("__order", "__pos")


def _longest(c: Column) -> Column:
    return F.max(F.size(c)).over(Window.partitionBy("batch_id"))


def _pad(c: Column, length: Column, value: int) -> Column:
    return F.concat(c, F.array_repeat(F.lit(value), length - F.size(c)))


def pad_lengths(batches: DataFrame, column: str = "input_ids") -> DataFrame:
    """The longest row of each batch."""
    return batches.groupBy("batch_id").agg(F.max(F.size(column)).alias("pad_length"))


def _padded(batches: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Pad each column to its own longest row in the batch, in one pass by batch."""
    sized = batches.withColumns({f"__len_{c}": _longest(F.col(c)) for c in columns})
    filled = sized.withColumns(
        {c: _pad(F.col(c), F.col(f"__len_{c}"), v) for c, v in columns.items()}
    )
    return filled.drop(*(f"__len_{c}" for c in columns))


def collate_lm(batches: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Pad ids and mask; labels repeat the ids, with the pad id ignored."""
    out = _padded(batches, {"input_ids": pad_id, "attention_mask": 0})
    labels = F.transform(
        "input_ids", lambda i: F.when(i == pad_id, F.lit(IGNORED)).otherwise(i)
    )
    return out.withColumn("labels", labels)


def collate_seq2seq(batches: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Pad ids and mask to the longest input and labels to the longest label row."""
    return _padded(batches, {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORED})


def encode_dpo(
    pairs: DataFrame, tokenizer: Tokenizer, max_len: int = 512, max_prompt: int = 256
) -> DataFrame:
    """Three id columns for prompt, chosen and rejected. Prompt and answer are joined as text before tokenizing.

    Encode before batching, so that the shuffle by batch moves cut ids and not texts.
    """
    short, full = encoder(tokenizer, max_prompt), encoder(tokenizer, max_len)
    prompt = F.col("prompt")
    return pairs.withColumns(
        {
            "prompt_input_ids": short(prompt),
            "chosen_input_ids": full(F.concat(prompt, F.col("chosen"))),
            "rejected_input_ids": full(F.concat(prompt, F.col("rejected"))),
        }
    ).drop("prompt", "chosen", "rejected")


def collate_dpo(
    batches: DataFrame,
    tokenizer: Tokenizer | None = None,
    max_len: int = 512,
    max_prompt: int = 256,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Six padded columns, of encoded pairs or, with a tokenizer, of texts."""
    coded = batches if tokenizer is None else encode_dpo(batches, tokenizer, max_len, max_prompt)
    parts = ("prompt", "chosen", "rejected")
    masked = coded.withColumns(
        {f"{p}_attention_mask": mask(F.col(f"{p}_input_ids")) for p in parts}
    )
    pads = {f"{p}_input_ids": pad_id for p in parts} | {f"{p}_attention_mask": 0 for p in parts}
    return _padded(masked, pads)
