"""Exact duplicates by content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

# A group of copies is dealt over so many tasks when its rows learn who stays; what is
# still uneven after that is left to adaptive execution.
SALTS = 8


def exact_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the text and, inside it, by the text's bytes, so
    that a collision of hashes makes two groups. ``keep`` names which id of a group stays,
    the largest ("max") or smallest ("min"). Null texts count as empty. Rows that share an
    id and a text are one document stored twice: all are marked kept if that id stays. A null
    id stays only in a group without any other id. Other columns are ignored, so their names
    cannot clash; an empty table gives an empty result.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = df.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")
    ).select(
        "id", "body", F.unhex(F.md5("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("digest")
    )
    # Copies collapse inside each task, so a hot group moves one row per task.
    groups = (
        rows.groupBy("h", "digest", "body")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("h", "digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.select("id", "h", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return salted.join(groups, ["h", "digest", "salt"], "left").select(
        F.col("id").alias(id_column),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """One row for each text, that of the id that stays, with all its columns.

    Of rows stored twice, with one id and text, one stays. A row of that id with another text is
    judged by that text.
    """
    own, digest, times = unused(df, "exact_id", "exact_digest", "exact_times")
    kept = (
        exact_groups(df.select(id_column, text), id_column, text, keep).where("kept")
        .groupBy(F.col(id_column).alias(own), F.col("text_sha256").alias(digest)).agg(F.count(F.lit(1)).alias(times))
    )
    same = F.col(id_column).eqNullSafe(F.col(own)) & (F.sha2(F.coalesce(F.col(text), F.lit("")), 256) == F.col(digest))
    joined = df.join(kept, same)
    once = joined.where(F.col(times) == 1).select(*df.columns)
    return once.unionByName(joined.where(F.col(times) > 1).dropDuplicates([digest]).select(*df.columns))
