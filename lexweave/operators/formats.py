"""Instruction, preference, chat and text records from mapped columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnMap
from ..functions import render
from ..functions.text import text_or_empty


def role(df: DataFrame, name: str | None) -> Column:
    """The mapped column, or an empty text where the role or the column is absent."""
    return F.col(f"`{name}`") if name and name in df.columns else F.lit("")


def _fields(df: DataFrame, columns: ColumnMap) -> dict[str, Column]:
    return {
        "instruction": role(df, columns.instruction),
        "input": role(df, columns.input),
        "output": role(df, columns.output),
    }


def to_instruction(df: DataFrame, columns: ColumnMap) -> DataFrame:
    return df.select(*(text_or_empty(c).alias(n) for n, c in _fields(df, columns).items()))


def to_preference(df: DataFrame, columns: ColumnMap) -> DataFrame:
    names = {"prompt": columns.instruction, "chosen": columns.chosen, "rejected": columns.rejected}
    return df.select(*(text_or_empty(role(df, c)).alias(n) for n, c in names.items()))


def prepare_dpo(df: DataFrame, columns: ColumnMap) -> DataFrame:
    """Add prompt, chosen and rejected; the other columns ride along."""
    return df.withColumns(
        {
            "prompt": role(df, columns.instruction),
            "chosen": role(df, columns.chosen),
            "rejected": role(df, columns.rejected),
        }
    )


def with_messages(df: DataFrame, columns: ColumnMap, system: str | None = None) -> DataFrame:
    f = _fields(df, columns)
    return df.withColumn(
        "messages", render.chat_messages(f["instruction"], f["input"], f["output"], system)
    )


def to_chat(df: DataFrame, columns: ColumnMap, system: str | None = None) -> DataFrame:
    return with_messages(df, columns, system).select("messages")


def prepare_sft(
    df: DataFrame,
    columns: ColumnMap,
    template: str | None = None,
    template_no_input: str | None = None,
) -> DataFrame:
    """Add the training text: the template if there is one, else a plain join."""
    f = _fields(df, columns)
    if template:
        body = render.render_template(f, template, template_no_input)
    else:
        body = render.render_plain(f["instruction"], f["input"], f["output"])
    return df.withColumn("text", body)


def prepare_chat(
    df: DataFrame, columns: ColumnMap, system: str | None = None, renderer=render.render_roles
) -> DataFrame:
    """Add the chat text, by role lines unless another message renderer is given."""
    chat = with_messages(df, columns, system)
    return chat.withColumn("text", renderer(F.col("messages"))).drop("messages")
