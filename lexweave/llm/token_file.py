"""Token ids in blocks of byte-aligned variable length, and back.

A block holds the ids of consecutive documents. Its table lists the block's ids from the
most to the least frequent; a token is stored as its place in the table, in one to four
bytes. Control bytes, kept apart from the data, hold four lengths of two bits each.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import give_back, text_slices, tidy, worker_cache

BLOCK_TOKENS = 1 << 20
# Words whose ids a worker remembers; those that were not met again make room for others.
CACHED_WORDS = 500_000
# Bytes of text whose words are made distinct together.
ENCODED_AT_ONCE = 8 << 20

# Longer words are not remembered.
LONG_WORD = 64

# Bytes by kind: white space, punctuation that begins a word right after a Latin letter or a
# digit (which saves knowing each word with and without it), letters and digits.
_BLANK, _MARK, _ALNUM = (np.zeros(256, bool) for _ in range(3))
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK[list(b".,!#$%&*")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def odd_blanks(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins; it joins the runs of white space around it."""
    at = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if not len(at):
        return at
    b, c = (np.append(data, np.zeros(3, np.uint8))[at + k] for k in (1, 2))
    a = data[at]
    wide = (a == 0xE2) & (
        (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    )
    return at[(a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | wide | (a == 0xE3) & (b == 0x80) & (c == 0x80)]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: white space and what follows it. Every byte is in one word.

    A text with white space beyond ASCII is one word.
    """
    blank, letter = _BLANK[data], _ALNUM[data]
    # Two-byte Latin letters; the two that are signs are left out.
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & ~blank[:-1] | _MARK[data[1:]] & letter[:-1]
    cut[2:] |= _MARK[data[2:]] & latin[:-1]
    for k in np.unique(np.searchsorted(offsets, odd_blanks(data), "right") - 1).tolist():
        cut[offsets[k] : offsets[k + 1]] = False
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class CachedEncoder:
    """Byte-level BPE of the tokenizers library, asked once for each word.

    The split pattern of these vocabularies never joins a character to white space after
    it, nor a letter or digit to punctuation other than an apostrophe, so a text's ids are
    those of its words with the white space before them.
    """

    def __init__(self, path: str):
        # Tasks already use all cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words, as little-endian 32-bit integers."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        got = list(map(self.known.get, words))
        gaps = [k for k, ids in enumerate(got) if ids is None]
        new = []
        for k in gaps:
            got[k] = self.older.get(words[k])
            if got[k] is None:
                new.append(k)
        if new:
            found = self.tokenizer.encode_batch_fast([words[k].decode() for k in new], add_special_tokens=False)
            for k, e in zip(new, found):
                got[k] = array("I", e.ids).tobytes()
        if gaps:
            asked = [words[k] for k in gaps]
            self.known.update(zip(asked, map(got.__getitem__, gaps)))
            for word in asked:
                if len(word) > LONG_WORD:
                    del self.known[word]
        return got

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ids of each text) for runs of texts of bounded size."""
        for i, data, offsets in text_slices(texts, ENCODED_AT_ONCE):
            start = word_starts(data, offsets)
            bounds = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, bounds, pa.py_buffer(data)])
            coded = words.dictionary_encode()
            ids = self._ids(coded.dictionary.to_pylist())
            each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            pool, which = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
            n = each[which]
            ends = np.cumsum(n)
            first = np.cumsum(each) - each
            # The ids of each word lie together in the pool; texts take them word by word.
            at = np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            total = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
            yield i, pool[at], np.diff(total)

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out = []
        for _, ids, counts in self.column(pa.array(texts, pa.string())):
            out += [p.tobytes() for p in np.split(ids, np.cumsum(counts)[:-1])]
        return out


def encoder(path: str) -> CachedEncoder:
    return worker_cache(f"bpe-{path}", lambda: CachedEncoder(path))


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Table, control bytes and data of a block."""
    if len(ids) and ids.max() < 1 << 22:
        counts = np.bincount(ids)
        found = np.flatnonzero(counts)
        order = found[np.argsort(-counts[found], kind="stable")]
        rank = np.empty(len(counts), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        places = rank[ids]
    else:
        found, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        by_count = np.argsort(-counts, kind="stable")
        order = found[by_count]
        places = np.argsort(by_count).astype(np.uint32)[inverse]
    longer = [places >= 1 << (8 * k) for k in (1, 2, 3)]
    lengths = (longer[0].view(np.uint8) + longer[1].view(np.uint8) + longer[2].view(np.uint8)).astype(np.uint8)
    quads = np.zeros((len(ids) + 3) // 4 * 4, np.uint8)
    quads[: len(ids)] = lengths
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(lengths.astype(np.int64) + 1)
    starts = ends - lengths - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[starts] = places & 255
    for k, more in enumerate(longer, 1):
        data[starts[more] + k] = places[more] >> (8 * k) & 255
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


# The four lengths that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def unpack(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of a block, all at once."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    held = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths.astype(np.int64) + 1) - lengths - 1
    places = held[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths >= k)
        places[more] |= held[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(table, "<u4")[places]


BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("id_table", T.BinaryType()),
    T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType()),
])


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending id order.

    The blocks are rows of Parquet files, written by Spark's committer, so a lost executor
    leaves none half done. ``part`` numbers ranges of ids, ``block`` the blocks in one, and
    ``before`` counts the tokens of its earlier blocks.
    Null texts count as empty; null ids come first; rows that repeat an id are ordered by
    text and all are written. An empty table gives a table without rows.
    """
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        block = before = waiting = 0

        def out():
            table, control, data = pack(np.concatenate(held))
            row = {
                "part": part, "block": block, "before": before, "n_tokens": sum(sizes), "doc_ids": list(names), "counts": list(sizes),
                "id_table": table, "control": control, "data": data,
            }
            for kept in (held, names, sizes):
                kept.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("counts", pa.list_(pa.int64())), ("id_table", pa.binary()), ("control", pa.binary()), ("data", pa.binary()),
        ])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, tokens, counts in encode.column(batch.column(1)):
                tokens = np.insert(tokens, np.cumsum(counts), end_id)
                counts = counts + 1
                ends, done = np.cumsum(counts), 0
                while done < len(counts):
                    # A block takes whole texts until it is large enough.
                    at = ends[done] - counts[done]
                    upto = min(int(np.searchsorted(ends, at + BLOCK_TOKENS - waiting)) + 1, len(counts))
                    held.append(tokens[at : ends[upto - 1]])
                    names += ids[i + done : i + upto]
                    sizes += counts[done:upto].tolist()
                    waiting += int(ends[upto - 1] - at)
                    done = upto
                    if waiting >= BLOCK_TOKENS:
                        yield out()
                        block, before, waiting = block + 1, before + waiting, 0
        if names:
            yield out()
        give_back(everything=False)  # the words known so far serve the next task

    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of the documents in a folder of blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One number for each range of ids; the ranges are as many as the tasks that wrote them.
    sums = sorted(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, at = [], 0
    for part, n in sums:
        starts.append((part, at))
        at += n
    first = spark.createDataFrame(starts, "part int, part_start long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time: they are large
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(row["id_table"], row["control"], row["data"], row["n_tokens"])
                ends = np.cumsum(row["counts"])
                parts = [ids[e - n : e] for e, n in zip(ends, row["counts"])]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["part_start"] + row["before"] + ends - row["counts"], pa.int64()),
                    "n_tokens": pa.array(row["counts"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.join(first, "part").mapInArrow(tidy(run), schema)


def token_file(df: DataFrame, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts to a fresh folder and read them back."""
    spark = df.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(df, path, tokenizer, end_id, id_column, text)
    return read_tokens(spark, path)
