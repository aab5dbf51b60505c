"""Language by rank order: a text's most frequent n-grams against a profile of each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, unused, worker_cache

# Stands for a run of characters that are no letters; it is itself no letter.
BLANK = 1
UNDECIDED = "und"


@dataclass(frozen=True)
class ProfileConfig:
    """``per_language`` documents teach a language, those with the lowest hash of their id.

    ``ranks`` n-grams make a profile. The sample stays at or below 1,000, the most that
    Spark selects before its shuffle.
    """

    per_language: int = 1000
    ranks: int = 300


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def gram_keys(text: str, letters: np.ndarray) -> np.ndarray:
    """All 1-, 2- and 3-grams of the letters of a text and the blanks beside them.

    Three characters of 21 bits make a key; a shorter gram has zeros before it.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    # One blank before each word and one at the end.
    first = is_letter & ~np.concatenate(([False], is_letter[:-1]))
    at = np.flatnonzero(is_letter)
    place = np.arange(len(at)) + np.cumsum(first)[at]
    line = np.full(int(place[-1]) + 2, BLANK, np.int64)
    line[place] = points[at]
    a, b, c = line[:-2], line[1:-1], line[2:]
    pairs = line[:-1] << 21 | line[1:]
    return np.concatenate((points[at].astype(np.int64), pairs, (a << 42 | b << 21 | c)[b != BLANK]))


def ranked(keys: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent keys in order; ties go to the smaller key."""
    found, counts = np.unique(keys, return_counts=True)
    if len(found) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        likely = counts >= least
        found, counts = found[likely], counts[likely]
    return found[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """Rank of each known n-gram in each language; ``ranks`` where a language lacks it."""

    def __init__(self, grams: dict[str, list[int]], ranks: int):
        self.names = sorted(grams)
        self.ranks = ranks
        self.known = np.unique(np.array([g for n in self.names for g in grams[n]], np.int64))
        self.places = np.full((len(self.names), len(self.known) + 1), ranks, np.int32)
        for row, name in enumerate(self.names):
            self.places[row, np.searchsorted(self.known, grams[name])] = np.arange(len(grams[name]))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of each language to the ranked n-grams of a text."""
        at = np.searchsorted(self.known, top)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == top, at, len(self.known))
        places = self.places[:, at]
        apart = np.abs(places - np.arange(len(top), dtype=np.int32))
        return np.where(places == self.ranks, self.ranks, apart).sum(axis=1)

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        """The nearest language and how near it is, from 0 to 1; ties go to the first name."""
        keys = gram_keys(text, letters) if text else ()
        if not len(keys) or not self.names:
            return UNDECIDED, 0.0
        top = ranked(keys, self.ranks)
        far = self.distances(top)
        best = int(far.argmin())
        return self.names[best], float(1 - far[best] / (self.ranks * len(top)))


def learn(df: DataFrame, lang: str = "lang", id_column: str = "doc_id", text: str = "text",
          cfg: ProfileConfig = ProfileConfig()) -> Profiles:
    """Profiles of all languages in ``df``; null languages and null texts teach nothing.

    Rows of one id are all taught from or none is. Only the profiles reach the driver:
    ``ranks`` keys for each language.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (
        rows.select("lang", "id").withColumn("n", F.row_number().over(lowest))
        .where(F.col("n") <= cfg.per_language).select("lang", "id").distinct()
    )

    # At most per_language rows for each language; over half a million the texts go to them instead.
    chosen = if_small(chosen, chosen.count())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = worker_cache("letters", _letters)
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                keys = [gram_keys(t, letters) for t in texts]
                found, counts = np.unique(np.concatenate(keys), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": found, "n": counts})

    counts = (
        rows.join(chosen, ["lang", "id"]).select("lang", "text")
        .mapInPandas(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= cfg.ranks)
    grams: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "place", "gram").collect()):
        grams.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(grams, cfg.ranks)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred and score for every row.

    A text that is null or has no letter is ``und`` with score 0, as is every text when
    nothing was learnt. Whole texts are read, one at a time, so memory follows the longest.
    """
    body, = unused(df.select(*keep), "body")
    rows = df.select(*keep, F.col(text).alias(body))
    schema = rows.drop(body).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = worker_cache("letters", _letters)
        for batch in batches:
            found = [profiles.predict(t.as_py(), letters) for t in batch.column(batch.num_columns - 1)]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return rows.mapInArrow(run, schema)
