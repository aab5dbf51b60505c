"""Exact-size train / validation / test split without moving the rows.

The cut between two splits is one key value. It is found by counting rows per key
prefix, level by level, which reads the id column alone and brings at most 4,096
counts to the driver per level. The rows are then labelled by comparing keys.
"""

from __future__ import annotations

import math
import os.path
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SplitConfig
from ..functions.text import seeded_key
from .ranking import KEY, SEGMENT, segmented

MIN_ROWS = 10
DIGITS = 3
# Hex digits of a seeded key, and of an integer id in order.
HASH_DIGITS = 32
ORDER_DIGITS = 16
SORT_ROWS = 100_000


def split_sizes(n: int, train: float, val: float, test: float) -> dict[str, int]:
    """Rows per split; splits that do not arise are left out."""
    if n < MIN_ROWS:
        return {"train": n}
    held = val + test
    if held > 0 and n * held < 2:
        k = max(1, int(n * 0.1))
        return {"train": n - k, "validation": k}
    n_train = math.floor(train * n)
    rest = n - n_train
    sizes = {"train": n_train, "validation": rest}
    if test > 0 and rest >= 2:
        n_val = math.floor(rest * (val / held))
        sizes |= {"validation": n_val, "test": rest - n_val}
    empty = [name for name, size in sizes.items() if size <= 0]
    if empty or train >= 1.0:
        raise ValueError(f"{n} rows at {train}/{val}/{test} leave {empty or ['validation']} empty")
    return sizes


def _counts(keys: DataFrame, prefixes: list[str]) -> dict[str, int]:
    """Rows per key prefix, one level below the given prefixes."""
    length = len(prefixes[0])
    if length:
        keys = keys.where(F.substring("key", 1, length).isin(prefixes))
    deeper = F.substring("key", 1, length + DIGITS).alias("prefix")
    found = keys.groupBy(deeper).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["prefix"]: r["n"] for r in sorted(found)}


def _descend(counts: dict[str, int], prefix: str, rank: int) -> tuple[str, int, int]:
    """The prefix that holds a 0-based rank, the rank inside it, and its rows."""
    for deeper, n in counts.items():
        if deeper.startswith(prefix):
            if rank < n:
                return deeper, rank, n
            rank -= n
    raise ValueError("the ids changed between two passes over them")


def _keys_at(
    keys: DataFrame, counts: dict[str, int], ranks: list[int], sort_rows: int, digits: int
) -> list[str]:
    """The keys at 0-based ranks; all ranks share each pass. A cut through equal keys is an error."""
    places = [_descend(counts, "", r) for r in ranks]
    while any(n > sort_rows for _, _, n in places) and len(places[0][0]) < digits:
        counts = _counts(keys, sorted({p for p, _, _ in places}))
        places = [_descend(counts, p, r) for p, r, _ in places]
    if not places:
        return []
    if any(n > sort_rows for _, _, n in places):
        raise ValueError("the row ids are not unique")
    prefix = F.substring("key", 1, len(places[0][0]))
    near = keys.select(prefix.alias("prefix"), "key").where(
        F.col("prefix").isin(sorted({p for p, _, _ in places}))
    )
    in_order = Window.partitionBy("prefix").orderBy("key")
    wanted = [(F.col("prefix") == p) & (F.col("place") == r) for p, r, _ in places]
    placed = near.withColumn("place", F.row_number().over(in_order) - 1).withColumn(
        "again", F.lag("key").over(in_order) == F.col("key")
    )
    rows = placed.where(reduce(Column.__or__, wanted)).collect()
    if any(r["again"] for r in rows):
        raise ValueError("the row ids are not unique")
    found = {(r["prefix"], r["place"]): r["key"] for r in rows}
    return [found[p, r] for p, r, _ in places]


def _ordered_key(cfg: SplitConfig, ids: list[str]) -> Column:
    if cfg.shuffle:
        return seeded_key(cfg.seed, *ids)
    if len(ids) != 1:
        raise ValueError("keeping the row order needs one integer row id")
    # The sign bit turned over puts negative ids before the others.
    unsigned = F.col(ids[0]).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.lpad(F.hex(unsigned), ORDER_DIGITS, "0")


def split(
    df: DataFrame, ids: list[str], cfg: SplitConfig = SplitConfig(), sort_rows: int = SORT_ROWS
) -> DataFrame:
    """Add a ``split`` column. ``ids`` name a unique key (``with_row_id`` makes one).

    Ids in order are counted from the digits on in which they differ.
    """
    if cfg.stratify:
        return _split_stratified(df, ids, cfg)
    key = _ordered_key(cfg, ids)
    keys = df.select(key.alias("key"))
    start, digits = "", HASH_DIGITS
    if not cfg.shuffle:
        ends_of = keys.agg(F.min("key"), F.max("key")).first()
        start, digits = os.path.commonprefix([k or "" for k in ends_of]), ORDER_DIGITS
    counts = _counts(keys, [start])
    sizes = split_sizes(sum(counts.values()), cfg.train, cfg.val, cfg.test)
    names = list(sizes)
    ends = list(accumulate(sizes[name] for name in names[:-1]))
    label = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, _keys_at(keys, counts, ends, sort_rows, digits)))):
        label = F.when(F.col("__order") < cut, F.lit(name)).otherwise(label)
    return df.withColumn("__order", key).withColumn("split", label).drop("__order")


def _split_stratified(df: DataFrame, ids: list[str], cfg: SplitConfig) -> DataFrame:
    """Every split takes its rows at even steps through the strata, one after the other.

    The sizes are those of ``split_sizes``, and a stratum's share differs from its
    proportion by less than one row. Rows of a stratum come in seeded order, so
    there is no row order to keep.
    """
    if not cfg.shuffle:
        raise ValueError("a stratified split does not keep the row order")
    placed, n = _through_strata(df, ids, cfg)
    sizes = split_sizes(n, cfg.train, cfg.val, cfg.test)
    names, left, label = list(sizes), n, None
    for name in names[:-1]:
        taken = f"cast(cast({{0}} AS decimal(18,0)) * {sizes[name]} div {left} AS bigint)"
        upto = F.expr(taken.format("__pos"))
        chosen = upto > F.expr(taken.format("(__pos - 1)"))
        placed = placed.withColumn(f"__{name}", chosen).withColumn("__pos", F.col("__pos") - upto)
        mine = F.col(f"__{name}")
        label = F.when(mine, name) if label is None else label.when(mine, name)
        left -= sizes[name]
    last = F.lit(names[-1])
    return placed.withColumn("split", last if label is None else label.otherwise(last)).select(
        *df.columns, "split"
    )


def _through_strata(df: DataFrame, ids: list[str], cfg: SplitConfig) -> tuple[DataFrame, int]:
    """1-based ``__pos`` by hash prefix of the stratum, stratum and seeded key; and the rows.

    Strata are cut by prefixes of the seeded key, so a hot one is spread over tasks. Rows
    before a piece are summed among the pieces of one hash prefix, and over the 4,096
    prefixes by the driver.
    """
    def bucket(stratum: Column) -> Column:
        return F.substring(F.md5(F.coalesce(stratum.cast("string"), F.lit(""))), 1, DIGITS)

    counted = df.groupBy(bucket(F.col(cfg.stratify)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["p"], r["n"]) for r in counted.collect())
    n = sum(c for _, c in counts)
    ends = accumulate(c for _, c in counts)
    offsets = df.sparkSession.createDataFrame(
        [(p, end - c) for (p, c), end in zip(counts, ends)], "__bucket string, __offset long"
    )
    digits = max(DIGITS, math.ceil(math.log(max(n, 1) / SEGMENT, 16)))
    keyed = df.withColumn("__order", seeded_key(cfg.seed, *ids))
    marked = segmented(keyed, [cfg.stratify], F.substring("__order", 1, digits))
    earlier = (
        Window.partitionBy("__bucket").orderBy(KEY).rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = marked.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"))
    pieces = pieces.withColumn("__bucket", bucket(F.col(KEY)[cfg.stratify]))
    before = F.col("__offset") + F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    starts = pieces.join(F.broadcast(offsets), "__bucket").select(KEY, before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(KEY).orderBy("__order"))
    rows = marked.withColumn("__inside", inside).join(starts, KEY)
    return rows.select(*df.columns, (F.col("__before") + F.col("__inside")).alias("__pos")), n


def union_splits(train: DataFrame, val: DataFrame | None, test: DataFrame | None) -> DataFrame:
    """Files given per split: no ratio split, each file is its split."""
    out = train.withColumn("split", F.lit("train"))
    for part, name in ((val, "validation"), (test, "test")):
        if part is not None:
            out = out.unionByName(part.withColumn("split", F.lit(name)), allowMissingColumns=True)
    return out


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def evaluation_split(df: DataFrame) -> DataFrame:
    """The test rows, or the validation rows where there is no test row."""
    has_test = not df.where(F.col("split") == "test").limit(1).isEmpty()
    return df.where(F.col("split") == ("test" if has_test else "validation"))
