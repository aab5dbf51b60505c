"""Cleaning of tabular text: strip, lowercase, whole-row dedup, length bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ColumnMap, PrepConfig
from ..functions import text


def _on_strings(df: DataFrame, change: Callable[[Column], Column], nulls_as_text: bool) -> DataFrame:
    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.coalesce(c, F.lit("nan")) if nulls_as_text else c

    return df.select(
        *(
            change(value(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def strip_text(df: DataFrame, stringify_nulls: bool = False) -> DataFrame:
    return _on_strings(df, text.strip, stringify_nulls)


def lowercase_text(df: DataFrame, stringify_nulls: bool = False) -> DataFrame:
    return _on_strings(df, F.lower, stringify_nulls)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct. Copies collapse on the map side, so a hot group stays small."""
    return df.dropDuplicates()


def _within(df: DataFrame, columns: ColumnMap, cfg: PrepConfig) -> Column:
    keep = F.lit(True)
    for name in columns.bounded():
        if name in df.columns:
            c = F.col(f"`{name}`").cast("string")
            if cfg.stringify_nulls:
                c = F.coalesce(c, F.lit("nan"))
            keep = keep & F.coalesce(
                F.length(c).between(cfg.min_length, cfg.max_length), F.lit(False)
            )
    return keep


def filter_length(df: DataFrame, columns: ColumnMap, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Inclusive character bounds on every bounded role that the table has."""
    return df.where(_within(df, columns, cfg))


def _normalized(df: DataFrame, cfg: PrepConfig) -> DataFrame:
    if cfg.strip:
        df = strip_text(df, cfg.stringify_nulls)
    if cfg.lowercase:
        df = lowercase_text(df, cfg.stringify_nulls)
    return df


def preprocess(
    df: DataFrame,
    columns: ColumnMap,
    cfg: PrepConfig = PrepConfig(),
    before: Observation | None = None,
    after: Observation | None = None,
) -> DataFrame:
    """Strip, lowercase, dedup, length filter.

    The length filter depends on row values only, so Catalyst moves it below the
    dedup shuffle. Pass observations to get row counts from the same job.
    """
    if before is not None:
        df = df.observe(before, F.count(F.lit(1)).alias("rows"))
    df = _normalized(df, cfg)
    if cfg.drop_duplicates:
        df = drop_duplicate_rows(df)
    df = filter_length(df, columns, cfg)
    if after is not None:
        df = df.observe(after, F.count(F.lit(1)).alias("rows"))
    return df


def prep_funnel(df: DataFrame, columns: ColumnMap, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Rows loaded, left after dedup, and kept, from one grouping of the rows."""
    rows = _normalized(df, cfg)
    copies = rows.groupBy(*(F.col(f"`{c}`") for c in rows.columns)).agg(
        F.count(F.lit(1)).alias("copies")
    )
    weight = F.lit(1) if cfg.drop_duplicates else F.col("copies")
    counts = copies.agg(
        F.sum("copies").alias("loaded"),
        F.sum(weight).cast("long").alias("deduplicated"),
        F.sum(F.when(_within(rows, columns, cfg), weight).otherwise(0)).cast("long").alias("kept"),
    )
    return counts.select(
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("loaded", "deduplicated", "kept"))
    )
