"""Substring duplicates against all earlier documents, as factors of a relative parse.

Every document is a reference block for those with larger ids. The index holds a run of
few words (an anchor) out of every window, chosen by the window's words alone, so equal
windows have equal anchors. Where an anchor occurs in two different texts, the windows
around it are looked up. Each document is then cut greedily into factors: runs of words
copied from one place in an earlier document. Windows across the boundary of two factors
are in the index as well, so they are checked by themselves. What goes are the words under
windows found in the index; the factors name where they come from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import mix64
from .words import WordReader, Words, constants, shared_groups, sums_by_text

WINDOW = 13
ANCHOR = 5
# A null id counts as later than all others; no row may have this one.
LAST = (1 << 63) - 1


def signatures(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text's sequence of words."""
    place = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
    placed = mix64(words.hashes + mix64(place.astype(np.uint64) + np.uint64(1 << 40)))
    c = constants(2, 31)
    n = words.counts.astype(np.uint64)
    return mix64(sums_by_text(placed, words.first) + n), mix64(sums_by_text(placed * c[0] ^ (placed >> np.uint64(7)) * c[1], words.first) + n)


def window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows by their first word, the word at which the anchor of each begins, anchors' hashes."""
    grams, _ = words.runs(anchor, 3)
    at = np.flatnonzero(words.room() >= window)
    span = window - anchor + 1
    if not len(at):
        return at, at, grams
    # The last window of a text ends with the text, so no window looks past it.
    lowest = sliding_window_view(grams, span).argmin(axis=1)
    return at, at + lowest[at], grams


def _documents(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id (a null one as LAST), a 64-bit mark that tells the texts of one id apart, and text."""
    return df.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")
    )


DESCRIBED = "id long, mark long, n_words long, a long, b long"


def _described(docs: DataFrame) -> DataFrame:
    """id, mark, n_words and the signature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = WordReader()
        for batch in batches:
            for i, words in read.texts(batch.column(2)):
                a, b = signatures(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(a)), batch.column(1).slice(i, len(a)), pa.array(words.counts),
                        pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                    ],
                    names=["id", "mark", "n_words", "a", "b"],
                )

    return docs.mapInArrow(run, DESCRIBED)


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, signature) for the texts of each task; copies inside a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = WordReader(), set()
        for batch in batches:
            for _, words in read.texts(batch.column(2)):
                sign = signatures(words)[0].view(np.int64)
                fresh = np.array([s not in seen and not seen.add(s) for s in sign.tolist()], bool)
                _, place, grams = window_anchors(words, window, anchor)
                place = np.unique(place)
                text = np.searchsorted(words.first, place, "right") - 1
                keep = fresh[text]
                if keep.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams[place[keep]].view(np.int64)), pa.array(sign[text[keep]])], names=["h", "a"]
                    )

    return docs.mapInArrow(run, "h long, a long")


def _shared(keys: DataFrame) -> DataFrame:
    """Members of keys that two members have at least; one shuffle, any size of key."""
    ordered = keys.repartition("h").sortWithinPartitions("h", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, member, _ in shared_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(member)], names=["h", "a"])

    return ordered.mapInArrow(run, "h long, a long")


def _windows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The windows around shared anchors: hash, document (id and mark) and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = WordReader()
        for batch in batches:
            ids, marks, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, words in read.texts(batch.column(2)):
                n = len(words.counts)
                known = np.unique(shared.slice(i, n).flatten().to_numpy(zero_copy_only=False))
                at, place, grams = window_anchors(words, window, anchor)
                hit = np.isin(grams[place].view(np.int64), known)
                at = at[hit]
                if not len(at):
                    continue
                whole, _ = words.runs(window, 5)
                text = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(whole[at].view(np.int64)),
                        pa.array(ids[i + text]), pa.array(marks[i + text]), pa.array((at - words.first[text]).astype(np.int32)),
                    ],
                    names=["h", "id", "mark", "place"],
                )

    return docs.mapInArrow(run, "h long, id long, mark long, place int")


def _sources(windows: DataFrame) -> DataFrame:
    """For each window that an earlier document has: the first such document and the place."""
    ordered = windows.repartition("h").sortWithinPartitions("h", "id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = source = source_place = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, ids, mark, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            heads, places = ids[starts], place[starts]
            if key is not None and h[0] == key:
                heads[0], places[0] = source, source_place
            key, source, source_place = h[-1], heads[-1], places[-1]
            head, head_place = np.repeat(heads, sizes), np.repeat(places, sizes)
            later = ids > head
            if later.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[later]) for x in (ids, mark, place, head, head_place)],
                    names=["id", "mark", "place", "source", "source_place"],
                )

    return ordered.mapInArrow(run, "id long, mark long, place int, source long, source_place int")


def parse(places: np.ndarray, sources: np.ndarray, source_places: np.ndarray, window: int) -> np.ndarray:
    """Factors (start, words, source, its start) of one document, from its windows in order.

    A factor goes on while the next window is the next one of the same source. A window
    over the boundary of two factors begins a factor of its own if it has a source.
    """
    if not len(places):
        return np.empty((0, 4), np.int64)
    breaks = (np.diff(places) != 1) | (np.diff(sources) != 0) | (np.diff(source_places) != 1)
    starts = np.concatenate(([0], np.flatnonzero(breaks) + 1))
    lengths = np.diff(np.append(starts, len(places))) + window - 1
    return np.stack((places[starts], lengths, sources[starts], source_places[starts]), axis=1)


def windows_of(found: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, sources and source places of one text's windows, in order and once each."""
    place, source, source_place = (found.field(j).to_numpy() for j in range(3))
    place, once = np.unique(place.astype(np.int64), return_index=True)
    return place, source[once], source_place[once].astype(np.int64)


def indexed(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows by (id, mark, n_words, a, b); texts with the first row of each; shared windows by row.

    Equal texts are one text, that of their first row. ``found`` lists its windows that
    earlier documents have.
    """
    spark = df.sparkSession
    docs = _documents(df, id_column, text)
    path = scratch_path(spark, "substring-texts")
    _described(docs).write.parquet(path)
    described = spark.read.schema(DESCRIBED).parquet(path)
    texts = described.groupBy("a", "b", "n_words").agg(F.min(F.struct("id", "mark")).alias("first"))
    # Anchors of two different texts, gathered for the first document of each text. Of one id
    # there may be several rows with these words, in which only blanks differ.
    rows = described.join(texts, ["a", "b", "n_words"]).where("id = first.id").select("a", "id", "mark").distinct()
    near = _shared(_anchors(docs, window, anchor)).join(rows, "a").groupBy("id", "mark").agg(
        F.collect_list("h").alias("shared")
    )
    asked = docs.join(near, ["id", "mark"]).select("id", "mark", "text", "shared")
    found = _sources(_windows(asked, window, anchor)).groupBy("id", "mark").agg(
        F.collect_list(F.struct("place", "source", "source_place")).alias("found")
    )
    return described, texts, found


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, kept_text, kept_sha256, factors.

    A word goes if a window over it, ``window`` words long, also starts in a document with a
    smaller id. Words are taken unchanged; kept words are joined by one blank. Null and
    empty texts have no word; a text shorter than a window keeps all. Rows with one id never
    remove each other's words, and different texts of one id have nothing to do with each
    other. A null id counts as later than all others. ``factors`` has
    (start, words, source, source_start) of the copied runs; for a text that an
    earlier document has word by word it is one factor. Windows are compared by 64 bits of
    hash, whole texts by 128. Other columns are ignored.
    """
    described, texts, found = indexed(df, id_column, text, window, anchor)
    docs = _documents(df, id_column, text)
    first = described.join(texts, ["a", "b", "n_words"]).where("first.id < id AND n_words > 0")
    # What is known of a row: the document it copies whole, or the windows it shares.
    copies = first.groupBy("id", "mark").agg(F.min("first.id").alias("whole"))
    facts = copies.join(found, ["id", "mark"], "full")
    # The texts by id and mark are the same shuffle as for the windows, so they move once.
    joined = docs.join(facts, ["id", "mark"], "left").select("id", "text", "whole", "found")
    schema = (
        f"{id_column} long, n_words long, n_removed long, kept_text string, kept_sha256 string, "
        "factors array<array<long>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [i if i != LAST else None for i in batch.column(0).to_pylist()]
            copied, found = batch.column(2).to_pylist(), batch.column(3)
            out = []
            for k, (name, body) in enumerate(zip(ids, batch.column(1).cast(pa.binary()).to_pylist())):
                words = (body or b"").split()
                cut = np.empty((0, 4), np.int64)
                if len(words) >= window:
                    if copied[k] is not None:
                        cut = np.array([[0, len(words), copied[k], 0]])
                    elif found[k].is_valid:
                        cut = parse(*windows_of(found[k].values), window)
                keep = np.ones(len(words), bool)
                for start, n, *_ in cut.tolist():
                    keep[start : start + n] = False
                kept = b" ".join(words if keep.all() else compress(words, keep))
                out.append((name, len(words), int((~keep).sum()), kept, hashlib.sha256(kept).hexdigest(), cut))
            if out:
                names, n, gone, kept, digest, cuts = zip(*out)
                flat = np.concatenate(cuts).astype(np.int64)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 4), pa.array(flat.ravel()))
                outer = np.concatenate(([0], np.cumsum([len(c) for c in cuts])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest),
                        pa.ListArray.from_arrays(pa.array(outer.astype(np.int32)), inner),
                    ],
                    names=[id_column, "n_words", "n_removed", "kept_text", "kept_sha256", "factors"],
                )

    return joined.mapInArrow(run, schema)
