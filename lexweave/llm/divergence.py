"""How far the sources of a language are from each other, over a cube of blocks.

The groups (language, source) of a language are dealt into blocks, and so are its terms. A
cell of the cube is (group block, group block, term block): it gets the slices of its two
group blocks, works out the terms' parts of the divergence of every two groups, and the
parts are added up along the term axis. A slice is replicated to the cells that need it, and no
task holds more than two group blocks of one term block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import text_slices, tidy

# Characters that no term has: ASCII other than letters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
SCALE = 1_000_000_000
GROUPS_IN_BLOCK = 64
TERMS_IN_BLOCK = 4096
TOP = 10
COUNT_BYTES = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a run of texts, lower-cased, and the text that each is in."""
    inside = _LETTER[data]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.concatenate(([False], inside[:-1]))
    begins, closes = inside & ~before, ~inside & before
    begins[starts], closes[starts] = inside[starts], before[starts]
    begin, end = np.flatnonzero(begins), np.flatnonzero(closes)
    if len(data) and inside[-1]:
        end = np.append(end, len(data))
    lengths = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(lengths), pa.py_buffer(_FOLD[data[inside]])]
    )
    return terms, np.searchsorted(offsets, begin, "right") - 1


def counted(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): how often a group has a term, and in how many documents.

    A group also has a row without a term. Counts are added up in each task first.
    """
    rows = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for i, data, offsets in text_slices(batch.column(2), COUNT_BYTES):
                terms, text_of = terms_of(data, offsets)
                coded = terms.dictionary_encode()
                k = max(len(coded.dictionary), 1)
                seen, times = np.unique(text_of * k + coded.indices.to_numpy(), return_counts=True)
                of = pair[i : i + len(offsets) - 1]
                key, inverse, docs = np.unique(of[seen // k] * k + seen % k, return_inverse=True, return_counts=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, inverse, times)
                groups = np.unique(of)
                none = np.zeros(len(groups), np.int64)
                group = np.concatenate((key // k, groups))
                term = pa.concat_arrays([coded.dictionary.take(pa.array(key % k)), pa.nulls(len(groups), pa.large_binary())])
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(group // len(sources.dictionary))),
                        sources.dictionary.take(pa.array(group % len(sources.dictionary))),
                        term.cast(pa.binary()), pa.array(np.concatenate((n, none))), pa.array(np.concatenate((docs, none))),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    found = rows.mapInArrow(tidy(run), "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exact beyond 64 bits; 1 where nothing is kept."""
    top, below = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)")
    exact = (top - top % below) / below  # a whole number, so the quotient isn't rounded
    return F.when(kept == 0, F.lit(1)).otherwise(1 + exact).cast("long")


def cell_parts(rows: pd.DataFrame, i: int, j: int) -> tuple[list, list, list]:
    """(group, other group, value) of one cell: the sum over its terms for pairs between blocks i and j.

    Rows without a term name the groups, their share of an unseen term and the number of
    terms in the block; terms that no group of the cell has are added at once.
    """
    marks = rows[rows["term"].isna()].sort_values("source")
    full = rows[rows["term"].notna()]
    names, block, base = marks["source"].to_numpy(), marks["block"].to_numpy(), marks["p"].to_numpy(np.int64)
    column, seen = pd.factorize(full["term"])
    shares = np.repeat(base[:, None], len(seen), axis=1)
    shares[pd.Index(names).get_indexer(full["source"]), column] = full["p"].to_numpy(np.int64)
    unseen = int(marks["terms"].iloc[0]) - len(seen)
    right = np.flatnonzero(block == j)
    a, b, value = [], [], []
    for k in np.flatnonzero(block == i):
        others = right[right > k] if i == j else right
        if not len(others):
            continue
        d, t = shares[k] - shares[others], shares[k] + shares[others]
        d0, t0 = base[k] - base[others], base[k] + base[others]
        a += [names[k]] * len(others)
        b += names[others].tolist()
        value += ((d * d // t).sum(axis=1) + unseen * (d0 * d0 // t0)).tolist()
    return a, b, value


def divergences(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS,
    top: int = TOP, groups_in_block: int = GROUPS_IN_BLOCK, terms_in_block: int = TERMS_IN_BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others, and its marked terms.

    Terms are runs of ASCII letters and other characters beyond ASCII; A-Z are lower-cased.
    A language keeps the terms that at least ``least_docs`` of its rows have. With n of a group's
    N kept terms, of V different ones, a term has the share 1 + floor(10^9 (n + 2) / (N + 2 V)).
    Two shares p and q differ by floor((p - q)^2 / (p + q)). Part ``pair`` has the sum over all
    kept terms for each other source; part ``term`` has the ``top`` terms that the
    group has more of than its language, by their difference to it. Ranks follow the value,
    largest first, then the item.

    Null text, lang and source are empty ones, and empty ones are groups like others. A
    group without terms takes part with its share of unseen ones; where nothing is kept all
    pairs have value 0. Repeated rows count as often as they are there. No rows give no
    rows. Other columns are ignored. Arithmetic is in integers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "term-counts")
    counted(df, lang, source, text).write.parquet(path)
    counts = spark.read.schema("lang string, source string, term string, n long, docs long").parquet(path)

    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")) \
        .where(F.col("docs") >= least_docs).drop("docs")
    mine = counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    in_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    blocks = counts.where("term IS NULL").groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / groups_in_block).cast("int").alias("blocks"))
    groups = (
        counts.where("term IS NULL").select("lang", "source").join(blocks, "lang").join(in_lang, "lang", "left")
        .join(mine.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .select(
            "lang", "source", "blocks", F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block"),
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_total", "total")),
        )
        .withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / terms_in_block).cast("int")))
    )
    # One row per group and language: written once, so that all that follows sees the same.
    path = scratch_path(spark, "groups")
    groups.write.parquet(path)
    groups = spark.read.schema(groups.schema).parquet(path)

    shares = mine.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    placed = shares.withColumn("term_block", F.pmod(F.xxhash64("term"), "term_blocks").cast("int"))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    marked = shares.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), "item",
        F.expr("((p - q) * (p - q)) div (p + q)").alias("value"),
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sizes = kept.join(groups.select("lang", "term_blocks").distinct(), "lang").groupBy(
        "lang", F.pmod(F.xxhash64("term"), "term_blocks").cast("int").alias("term_block")
    ).agg(F.count(F.lit(1)).alias("terms"))
    marks = (
        groups.withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
        .join(sizes, ["lang", "term_block"], "left")
        .select(
            "lang", "term_block", "blocks", "block", "source", F.lit(None).cast("string").alias("term"),
            share(F.lit(0), F.col("total"), F.col("v")).alias("p"), F.coalesce("terms", F.lit(0)).alias("terms"),
        )
    )
    slices = marks.unionByName(placed.select(
        "lang", "term_block", "blocks", "block", "source", "term", "p", F.lit(0).cast("long").alias("terms")
    ))
    cells = slices.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "term_block",
        "block", "source", "term", "p", "terms",
    )

    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        lang, i, j, _ = (k.as_py() for k in key)
        a, b, value = cell_parts(rows.to_pandas(), i, j)
        return pa.table({
            "lang": pa.array([lang] * len(a), pa.string()), "source": pa.array(a, pa.string()),
            "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64()),
        })

    parts = cells.groupBy("lang", "i", "j", "term_block").applyInArrow(cell, "lang string, source string, item string, value long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = summed.withColumn("way", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        "lang", F.when(F.col("way"), F.col("source")).otherwise(F.col("item")).alias("source"), F.lit("pair").alias("part"),
        F.when(F.col("way"), F.col("item")).otherwise(F.col("source")).alias("item"), "value",
    )
    pairs = both.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(marked)


def divergences_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    return rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
           row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
c AS (SELECT lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term,
             count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {least_docs}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, l.v, l.total AS lang_total,
                 sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
          FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + {SCALE}::HUGEINT * (n + 2) // (total + 2 * v)::HUGEINT AS p,
             1 + {SCALE}::HUGEINT * (lang_n + 2)::HUGEINT // (lang_total + 2 * v)::HUGEINT AS q FROM every),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {top}"""
