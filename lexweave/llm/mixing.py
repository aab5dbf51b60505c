"""Mixing sources to target weights with equal-token blocks and Sainte-Laguë quotas."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import WORD, settle, unused, word_count

# The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


@dataclass(frozen=True)
class MixConfig:
    """``share`` of all words is dealt out; a source gives ``most`` times its words at most.

    A block has ``block_words`` words, or a hundredth of its source if that is less, so a
    small source makes its own blocks finer and no others. A shard has ``shard_words`` words, or so many that there are ``most_shards``
    shards besides one for each source: their quotas are found on the driver.
    """

    share: float = 1.5
    most: int = 2
    seed: int = 17
    block_words: int = 1024
    shard_words: int = 1 << 20
    most_shards: int = 100_000


def source_targets(sizes: list[int], weights: list[float], share: float, most: int) -> list[float]:
    """Words each source is to give: by weight, no more than ``most`` times its size.

    What a source can't take is dealt again by weight until none is over its limit.
    """
    total, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    targets = [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if total * weights[i] > most * sizes[i] * weight]
        if not full:
            for i in open_:
                targets[i] = total * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            total -= most * sizes[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def sainte_lague(votes: np.ndarray, limits: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the first, limits hold.

    The quotient that the last seat needs is found by halving, so that the work doesn't
    grow with the seats.
    """
    votes, limits = np.asarray(votes, np.float64), np.asarray(limits, np.int64)
    limits = np.where(votes > 0, limits, 0)
    seats = int(min(seats, limits.sum()))

    def given(quotient: float) -> np.ndarray:
        """Seats whose quotient is at least this."""
        return np.minimum(limits, np.maximum(0, np.floor((votes / quotient + 1) / 2)).astype(np.int64))

    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = votes[votes > 0].min() / (2.0 * limits.max() + 1) / 2, votes.max() * 2
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    got = given(high)
    left = seats - int(got.sum())
    if left > 0:  # seats tied at the last quotient
        quotients = np.where(got < limits, votes / (2 * got + 1), -1.0)
        got[np.argsort(-quotients, kind="stable")[:left]] += 1
    return got


def taken_of_shard(sizes: np.ndarray, blocks: int, quota: int, rng: np.random.Generator):
    """Words taken of each document of a shard, and its picked pieces beyond whole passes.

    The documents lie end to end and are cut into equal blocks. A quota over the number of
    blocks takes all of them once, and the rest are blocks drawn by the seed.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = int(ends[-1])
    passes, extra = divmod(quota, blocks)
    picked = np.zeros(blocks, bool)
    picked[rng.permutation(blocks)[:extra]] = True
    cuts = np.arange(blocks + 1, dtype=np.int64) * words // blocks
    edges = np.flatnonzero(np.diff(np.concatenate(([0], picked.view(np.int8), [0]))))
    begin, end = cuts[edges[::2]], cuts[edges[1::2]]  # runs of picked blocks, as words of the shard
    before = np.concatenate(([0], np.cumsum(end - begin)))

    def upto(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begin, x, "right")
        inside = np.where(k > 0, np.minimum(x, end[k - 1]) - begin[k - 1], 0) if len(begin) else 0
        return before[np.maximum(k - 1, 0)] + inside

    taken = passes * sizes + upto(ends) - upto(starts)
    pieces = []
    for s, e in zip(starts, ends):
        i, j = np.searchsorted(end, s, "right"), np.searchsorted(begin, e, "left")
        pieces.append(
            [int(x) for a, b in zip(begin[i:j], end[i:j]) for x in (max(a, s) - s, min(b, e) - s)]
        )
    return passes, taken, pieces


PLAN = "id long, source string, size long, source_size long, target double, taken long, passes int, pieces array<long>"


def mix(
    df: DataFrame, size: Column, id_column: str = "doc_id", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cfg: MixConfig = MixConfig(),
) -> DataFrame:
    """One row per row of ``df``: id, source, size, source_size, target, taken, passes, pieces.

    ``size`` counts a row's words. Of a row the mix takes all words ``passes`` times and
    then the words [a, b) of ``pieces`` (a, b, a, b, ...). Sources are ordered by code
    point with null last and take ``weights`` in turn. A null or empty text has size 0 and
    nothing is taken of it; a table without words takes nothing. Rows that repeat an id
    are rows of their own; those of one source and size can't be told apart and are numbered,
    so that rows without ids or with one id are dealt over the shards like others. The
    order in a shard is by a seeded hash of id, size and number, so reruns agree however the
    rows are dealt. Only the columns named are read.

    The sources are a short list (one weight each was chosen by someone) and go through the
    driver, as do the shards, whose number is bounded.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "mix-sizes")
    # Ids and sizes only: the texts are read once, whatever follows.
    df.select(F.col(id_column).alias("id"), F.col(source).alias("source"), size.cast("long").alias("size")) \
        .write.parquet(path)
    rows = spark.read.schema("id long, source string, size long").parquet(path)

    totals = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    names = sorted((r["source"] for r in totals if r["source"] is not None)) + [None] * any(
        r["source"] is None for r in totals
    )
    by_name = {r["source"]: r["n"] for r in totals}
    sizes = [by_name[n] for n in names]
    wanted = source_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], cfg.share, cfg.most)
    words = sum(sizes)
    block = {n: max(1, min(cfg.block_words, s // 100)) for n, s in zip(names, sizes)}
    shard_words = max(cfg.shard_words, -(-words // cfg.most_shards))
    info = spark.createDataFrame(
        [(n, s, t, max(1, -(-s // shard_words))) for n, s, t in zip(names, sizes, wanted)],
        "of string, source_size long, target double, shards long",
    )
    # Equal rows are counted in each task first, so those of one id don't meet in one.
    numbered = rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("times")).select(
        "id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("number")
    )
    placed = numbered.join(info, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(cfg.seed), "id", "size", "number"), F.col("shards"))
    )
    filled = placed.where("size > 0")
    found = filled.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()
    quotas = shard_quotas(
        sorted(((r["source"], r["shard"], r["n"]) for r in found), key=lambda r: (r[0] is None, r[0] or "", r[1])),
        dict(zip(names, zip(sizes, wanted))), block, cfg.most,
    )
    quota = spark.createDataFrame(
        quotas, "of string, of_shard long, blocks long, quota long"
    ) if quotas else spark.createDataFrame([], "of string, of_shard long, blocks long, quota long")
    ready = filled.drop("of").join(
        quota, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard"))
    ).withColumn("place", F.xxhash64(F.lit(cfg.seed + 1), "id", "size", "number"))
    seed = cfg.seed

    def select(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["place", "id", "size", "number"], kind="stable")
        name = shard["source"].iloc[0]
        key = [seed, int(shard["shard"].iloc[0]), *(name.encode() if isinstance(name, str) else [256])]
        passes, taken, pieces = taken_of_shard(
            shard["size"].to_numpy(np.int64), int(shard["blocks"].iloc[0]), int(shard["quota"].iloc[0]),
            np.random.default_rng(key),
        )
        return shard[["id", "source", "size", "source_size", "target"]].assign(
            taken=taken, passes=np.int32(passes), pieces=pieces
        )

    empty = placed.where("size = 0").select(
        "id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"),
        F.lit(0).alias("passes"), F.array().cast("array<bigint>").alias("pieces"),
    )
    # A shard is bounded in words, and so in rows that have words.
    return ready.groupBy("source", "shard").applyInPandas(select, PLAN).unionByName(empty)


def shard_quotas(
    shards: list[tuple[str | None, int, int]], sources: dict[str | None, tuple[int, float]],
    block: dict[str | None, int], most: int,
) -> list[tuple[str | None, int, int, int]]:
    """(source, shard, blocks, quota) for each shard with words.

    ``block`` has the words of a source's blocks. Words go to the sources first, as seats of the
    finest block, and then, as blocks of a source, to its shards.
    """
    names = list(dict.fromkeys(s for s, _, _ in shards))
    blocks = {s: [max(1, round(n / block[s])) for name, _, n in shards if name == s] for s in names}
    finest = min((block[s] for s in names), default=1)
    votes = np.array([sources[s][1] / sources[s][0] * sum(blocks[s]) * block[s] / finest for s in names])
    limits = np.array([most * sum(blocks[s]) * block[s] // finest for s in names])
    seats = sainte_lague(votes, limits, round(votes.sum())) if names else []
    seats = [round(int(n) * finest / block[s]) for s, n in zip(names, seats)]
    out, at = [], {s: iter(range(len(blocks[s]))) for s in names}
    given = {s: sainte_lague(np.array(blocks[s]), most * np.array(blocks[s]), int(n)) for s, n in zip(names, seats)}
    for name, shard, _ in shards:
        k = next(at[name])
        out.append((name, int(shard), int(blocks[name][k]), int(given[name][k])))
    return out


def mixed_texts(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cfg: MixConfig = MixConfig(),
) -> DataFrame:
    """The mix itself: the rows it takes words of, with the text it takes.

    A text is its whole passes, then its picked pieces, each cut from the text as it
    stands, joined by line breaks. Rows are found again by id and size; rows that
    repeat an id with texts of one size take one of their plans each.
    """
    key, words, whole, parts = unused(df, "mix_id", "mix_size", "mix_passes", "mix_pieces")
    plan = mix(df, word_count(F.col(text)), id_column, source, weights, cfg)
    plan = plan.where("taken > 0").select(
        F.col("id").alias(key), F.col("size").alias(words), F.col("passes").alias(whole), F.col("pieces").alias(parts)
    ).dropDuplicates([key, words])
    joined = df.join(
        plan, F.col(id_column).eqNullSafe(F.col(key)) & (word_count(F.col(text)) == F.col(words))
    )
    names = df.columns

    @F.pandas_udf("string")
    def cut(texts: pd.Series, passes: pd.Series, pieces: pd.Series) -> pd.Series:
        import re

        settle()
        word = re.compile(WORD)
        out = []
        for body, whole, parts in zip(texts, passes, pieces):
            got = [body] * whole
            if len(parts):
                spans = [m.span() for m in word.finditer(body)]
                got += [body[spans[a][0] : spans[b - 1][1]] for a, b in zip(parts[::2], parts[1::2])]
            out.append("\n".join(got))
        return pd.Series(out, dtype=object)

    return joined.withColumn(text, cut(F.col(text), whole, parts)).select(*names)
