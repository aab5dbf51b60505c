"""Positions, running values and top-k that no single task has to hold.

A position or running value over a large group is computed in two levels: inside
ordered segments of bounded size, and over one summary row per segment. A segment
is a block of ``SEGMENT`` consecutive integer keys (unique in the group, so at most
that many rows), a prefix of a uniform hash key, or, for keys of any kind and
distribution, a range between sampled quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_key
from ..session import scratch_path

SEGMENT = 1_000_000
# Hex digits of a hash key that are counted first: at most 4,096 prefixes.
DIGITS = 3
# Blocks of integer keys that a table may have; keys further apart are cut at quantiles.
MOST_BLOCKS = 1024
# Group and segment in one struct: nulls in the group compare as equal, and the window,
# the summary and the join all use the same partitioning.
KEY = "__key"


@dataclass(frozen=True)
class Running:
    """A running min, max, sum or count; exclusive ones leave out the current row."""

    fn: str
    expr: Column
    inclusive: bool = True


# How a running value inside a segment and the value of all earlier segments combine.
_COMBINE = {
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
}
_AGG = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def segmented(df: DataFrame, by: list[str], segment: Column) -> DataFrame:
    """Mark each row with its group and segment; segments must rise with the order."""
    return df.withColumn(KEY, F.struct(*by, segment.alias("__segment")))


def running(df: DataFrame, by: list[str], order: list[Column], measures: dict[str, Running]) -> DataFrame:
    """Add running values per ``by`` group to a segmented table, which stays segmented."""
    names = {name: f"__{name}" for name in measures}
    totals = df.groupBy(KEY).agg(
        *(_AGG[m.fn](m.expr).alias(names[n]) for n, m in measures.items())
    )
    group = [F.col(KEY)[c] for c in by]
    earlier = (
        Window.partitionBy(*group)
        .orderBy(F.col(KEY)["__segment"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    merge = {n: F.sum if m.fn == "count" else _AGG[m.fn] for n, m in measures.items()}
    carried = totals.select(
        KEY,
        F.count(F.lit(1)).over(earlier).alias("__before"),
        *(merge[n](names[n]).over(earlier).alias(names[n]) for n in measures),
    )
    # Only later segments of a group have something to carry.
    carried = carried.where(F.col("__before") > 0).drop("__before")

    inside = Window.partitionBy(KEY).orderBy(*order)
    local = df.select(
        "*",
        *(
            _AGG[m.fn](m.expr)
            .over(inside.rowsBetween(Window.unboundedPreceding, 0 if m.inclusive else -1))
            .alias(n)
            for n, m in measures.items()
        ),
    )
    joined = local.join(carried, KEY, "left")
    return joined.select(
        *(F.col(f"`{c}`") for c in df.columns),
        *(_COMBINE[m.fn](F.col(n), F.col(names[n])).alias(n) for n, m in measures.items()),
    )


def block(c: Column | str, size: int = SEGMENT) -> Column:
    """Segment of an integer key: consecutive blocks of ``size`` keys."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size))


def hash_position(
    df: DataFrame, name: str, key: str, digits: int = DIGITS, segment: int = SEGMENT
) -> tuple[DataFrame, int]:
    """Position in the order of a uniform hash key, and the number of rows.

    Up to 16**digits counts come to the driver and go back as a broadcast table of
    offsets. Where a prefix would hold over ``segment`` rows, longer prefixes are
    counted and summed on the executors.
    """
    prefix = F.substring(key, 1, digits)
    counted = df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sum(r["n"] for r in counted)
    if rows > segment * 16**digits:
        longer = math.ceil(math.log(rows / segment, 16))
        marked = segmented(df, [], F.substring(key, 1, longer))
        placed = running(marked, [], [F.col(key)], {name: Running("count", F.lit(1))})
        return placed.drop(KEY), rows
    counted.sort()
    ends = accumulate(r["n"] for r in counted)
    offsets = df.sparkSession.createDataFrame(
        [(r["p"], end - r["n"]) for r, end in zip(counted, ends)], "__p string, __before long"
    )
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    placed = df.withColumn("__p", prefix).withColumn("__inside", inside)
    joined = placed.join(F.broadcast(offsets), "__p")
    return joined.select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name)), rows


def with_position(
    df: DataFrame,
    name: str,
    key: str,
    by: list[str] | None = None,
    digits: int = DIGITS,
    segment: int = SEGMENT,
) -> DataFrame:
    """1-based position by ``key``, which is unique within each group.

    A string key must be a uniform hex hash (see ``seeded_key``); a number may have any
    distribution (see ``key_segments``).
    """
    by = by or []
    if dict(df.dtypes)[key] != "string":
        marked = key_segments(df, by, key, segment)
    elif not by:
        return hash_position(df, name, key, digits, segment)[0]
    else:
        # A group may hold nearly all rows, so the prefix is long enough for all of them.
        rows = df.count()
        digits = max(digits, math.ceil(math.log(max(rows / segment, 1), 16)))
        marked = segmented(df, by, F.substring(key, 1, digits))
    if not by:
        return _placed(marked, name, [F.col(key)])
    return running(marked, by, [F.col(key)], {name: Running("count", F.lit(1))}).drop(KEY)


def key_segments(df: DataFrame, by: list[str], key: str, segment: int = SEGMENT) -> DataFrame:
    """Segments of a number key: blocks of consecutive keys, or ranges between quantiles.

    Blocks need no pass of their own. They are right for keys that lie close together; of
    hashed or otherwise scattered keys nearly each would be a block, so those are cut at
    quantiles of the rows. The least and greatest key tell.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or (high - low) / segment < MOST_BLOCKS:
        return segmented(df, by, block(key, segment))
    part = "__part"
    return segmented(range_segments(df, by, [key], part), by, F.col(part)).drop(part)


def _placed(marked: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Positions over all rows of a segmented table; one count per segment passes the driver."""
    part = F.coalesce(F.col(KEY)["__segment"].cast("long"), F.lit(-(1 << 63)))
    counts = sorted(marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends = accumulate(r["n"] for r in counts)
    rows = [(r["part"], end - r["n"]) for r, end in zip(counts, ends)]
    offsets = marked.sparkSession.createDataFrame(rows, "__p long, __before long")
    placed = marked.withColumn("__p", part).drop(KEY)
    placed = placed.withColumn("__inside", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    columns = [F.col(f"`{c}`") for c in marked.columns if c != KEY]
    return placed.join(F.broadcast(offsets), "__p").select(*columns, (F.col("__before") + F.col("__inside")).alias(name))


def range_segments(df: DataFrame, by: list[str], order: list[str], segment: str) -> DataFrame:
    """The rows as a stored table, cut at sampled quantiles of group and order into numbered segments.

    The numbers rise with the order, and a group of any size lies in as many segments as its
    share of the rows. Equal keys share a segment.
    """
    path = scratch_path(df.sparkSession, "segments")
    df.repartitionByRange(*by, *order).withColumn(segment, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.schema(df.withColumn(segment, F.lit(0)).schema).parquet(path)


def position_by_range(df: DataFrame, name: str, by: list[str], order: list[str]) -> DataFrame:
    """1-based position by keys of any kind and distribution, nulls first; equal keys in any order.

    """
    part = "__part"
    marked = segmented(range_segments(df, by, order, part), by, F.col(part)).drop(part)
    keys = [F.col(c) for c in order]
    if not by:
        return _placed(marked, name, keys)
    return running(marked, by, keys, {name: Running("count", F.lit(1))}).drop(KEY)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row ids in scan order. Call it right after a file scan, whose splits are fixed."""
    return df.withColumn(name, F.monotonically_increasing_id())


def global_rank(df: DataFrame, name: str, *ids: str, seed: int = 42) -> DataFrame:
    """Position in the seeded pseudo-random order of the ids."""
    keyed = df.withColumn("__order", seeded_key(seed, *ids))
    return with_position(keyed, name, "__order").drop("__order")


def top_per_group(
    df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first k rows of each group; Spark keeps k per task before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def sample_head(df: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first n rows; each task keeps n."""
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, *ids: str, seed: int = 42, position: str | None = None) -> DataFrame:
    """The same random order under any partitioning, with the row's place if it is named."""
    if position is None:
        return df.orderBy(seeded_key(seed, *ids))
    return global_rank(df, position, *ids, seed=seed).orderBy(position)
