"""Delimited files with line breaks inside quotes, read in splits.

Whether a line begins inside quotes depends on all quotes before it. One pass counts
them per split of a file; the sums of the splits before tell how each split begins. A
second pass joins the lines of each record, and the pieces of the records that lie over a
border are joined after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
# A row id is the split's number and the record's number in it.
RECORD_BITS = 33
# What a piece of text is: a record, the begin of one, a part of one begun in an earlier split, the begin of a header.
WHOLE, BEGUN, GOES_ON, HEADER = range(4)
# Encodings whose quotes and line breaks are the bytes of ASCII.
SPLITTABLE = ("utf-8", "us-ascii", "iso-8859-1")


@dataclass(frozen=True)
class Split:
    """Where a split stands: its number, whether it begins inside quotes, and the split in which that record began."""

    number: int
    inside: bool
    begun: int
    first: bool


def _lines(spark: SparkSession, path: str, encoding: str, tree: dict) -> DataFrame:
    lines = spark.read.options(lineSep="\n", **tree).text(path)
    line = F.col("value") if encoding == "utf-8" else F.decode(F.col("value").cast("binary"), encoding.upper())
    return lines.select(line.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _stray(line: Column, sep: str) -> Column:
    r"""Whether a line has a quote that neither opens nor closes a field, nor is doubled."""
    bare = F.regexp_replace(line, QUOTE * 2, "")
    mark = "[" + ("\\" + sep if sep in "\\^]-[|" else sep) + "]"
    return bare.rlike(f'(?<!^)(?<!{mark}){QUOTE}(?!{mark}|\\r?$)')


def splits_of(spark: SparkSession, path: str, sep: str, encoding: str, tree: dict) -> dict[tuple[str, int], Split] | None:
    """The splits with lines, by file and start; None where quotes stand in unquoted fields.

    One row per split passes the driver, which holds the list of splits anyway.
    """
    lines = _lines(spark, path, encoding, tree)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    found = lines.groupBy("file", "at").agg(
        F.count_if(quotes % 2 == 1).alias("odd"), F.max(_stray(F.col("value"), sep)).alias("stray")
    ).collect()
    if any(r["stray"] for r in found):
        return None
    out, inside, begun, file = {}, False, 0, None
    for number, r in enumerate(sorted(found, key=lambda r: (r["file"], r["at"]))):
        first = r["file"] != file
        if first:
            file, inside = r["file"], False
        out[r["file"], r["at"]] = Split(number, inside, begun, first)
        # The last record goes on beyond the split: here it began, unless the split is inside one throughout.
        if not inside or r["odd"]:
            begun = number
        inside ^= r["odd"] % 2 == 1
    return out


class Joiner:
    """Joins the lines of one split to records; only an unfinished record is held back."""

    def __init__(self, file: str, split: Split, header: bool):
        self.file, self.split, self.skip = file, split, header and split.first
        self.inside, self.n = split.inside, 0  # of the lines held back: whether a record began before them
        self.lines: list[pa.Array] = []
        self.odd: list[np.ndarray] = []

    def add(self, lines: pa.Array, odd: np.ndarray, last: bool = False) -> pa.RecordBatch | None:
        self.lines.append(lines)
        self.odd.append(odd)
        if not last and not odd.any() and (self.inside or len(self.lines) > 1):
            return None  # nothing ends in these lines
        lines, odd = pa.concat_arrays(self.lines), np.concatenate(self.odd)
        after = (np.cumsum(odd) + self.inside) % 2
        ends = np.flatnonzero(after == 0)
        upto = len(lines) if last else int(ends[-1]) + 1 if len(ends) else 0
        self.lines, self.odd = ([lines.slice(upto)], [odd[upto:]]) if upto < len(lines) else ([], [])
        if not upto:
            return None
        before = np.concatenate(([self.inside], after[: upto - 1]))
        starts = np.flatnonzero(before == 0)
        edges = np.unique(np.concatenate(([0], starts, [upto]))).astype(np.int32)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), lines.slice(0, upto)), "\n")
        kind = np.full(len(text), WHOLE)
        number, n = np.full(len(text), self.split.number), self.n + np.arange(len(text))
        if after[upto - 1]:
            kind[-1] = HEADER if self.skip and not self.n and len(text) == 1 else BEGUN
        if self.inside:
            kind[0], number[0], n[0] = GOES_ON, self.split.begun, self.split.number
        first = int(self.skip and not self.n and kind[0] == WHOLE)
        self.inside, self.n = False, self.n + len(text)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * len(text), pa.string()), *map(pa.array, (number, n, kind)), text],
            names=["file", "number", "n", "kind", "record"],
        ).slice(first)


def records(
    spark: SparkSession, path: str, sep: str, encoding: str = "utf-8", header: bool = True, tree: dict | None = None
) -> DataFrame | None:
    """``file, row_id, record``: the records' text; ids rise with file and place, and a header is left out.

    None where the quotes don't say where records end (see ``splits_of``).
    """
    tree = tree or {}
    splits = splits_of(spark, path, sep, encoding, tree)
    if splits is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = key = None
        none = pa.array([], pa.string()), np.zeros(0, np.int64)
        for batch in batches:
            lines = batch.column(0).fill_null("")
            odd = pc.count_substring(lines, QUOTE).to_numpy() % 2
            place = pc.binary_join_element_wise(batch.column(1), pc.cast(batch.column(2), pa.string()), " ").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(place[1:] != place[:-1]) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(lines)]):
                if i == j:
                    continue
                at = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if at != key:
                    if joiner and (out := joiner.add(*none, last=True)):
                        yield out
                    key, joiner = at, Joiner(at[0], splits[at], header)
                if out := joiner.add(lines.slice(i, j - i), odd[i:j]):
                    yield out
        if joiner and (out := joiner.add(*none, last=True)):
            yield out

    found = _lines(spark, path, encoding, tree).mapInArrow(run, "file string, number long, n long, kind long, record string")
    first = F.shiftleft("number", RECORD_BITS)
    whole = found.where(F.col("kind") == WHOLE).select("file", (first + F.col("n")).alias("row_id"), "record")
    # The piece in which a record begins comes first, then those of the later splits by number.
    place = F.when(F.col("kind") == GOES_ON, F.col("n")).otherwise(F.lit(-1).cast("long"))
    over = found.where(F.col("kind") != WHOLE).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "record"))).alias("parts"), F.max("kind").alias("kind")
    ).where(F.col("kind") != HEADER)
    joined = over.select(
        "file", (first + F.lit((1 << RECORD_BITS) - 1)).alias("row_id"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
    )
    ended = F.regexp_replace("record", "\r$", "").alias("record")
    return whole.unionByName(joined).select("file", "row_id", ended).where(F.col("record") != "")


def parsed(found: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """The records' fields as columns, with ``__file`` and ``__row_id``."""
    # Fields go by their place while they are parsed, so names may be anything.
    places = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    value = F.from_csv("record", places, options)
    named = found.select(F.col("file").alias("__file"), F.col("row_id").alias("__row_id"), value.alias("v"))
    fields = [F.col("v")[f"_{i}"].alias(f.name) for i, f in enumerate(schema.fields)]
    return named.select("__file", "__row_id", *fields)
