"""SentencePiece ids of texts, and texts of ids, in numpy over words of equal length.

A text is cut into words (a run of blanks and what follows it), since no piece has a blank
after another character. The words that a worker has not met are encoded together: those
of one length form a matrix of characters, and all its rows advance at once. Substrings are
hashed and looked up in the sorted hashes of the pieces.

Two recursions are here because models come in two kinds. A unigram model takes the best sum
of scores: ``viterbi`` finds it, with the best piece that ends at each place as backpointer. A
BPE model joins the best pair again and again, and its ids are in general not those of the
best sum: ``merge`` does that, with the best pair of each row as a maximum over the row.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, mix64, slices, unused, worker_cache

SPACE = "▁"
CACHED_WORDS = 100_000
# Bytes of the texts whose new words are encoded together; a longer text goes alone.
BYTES_AT_ONCE = 1_000_000
# Longer words go one by one through a queue, since a matrix row is searched for each merge.
LONG_WORD = 64
NONE = -np.inf
NOWHERE = -2

_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _prefixes(points: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2 ... characters of each row; two of them give that of a substring."""
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    marks = mix64(points + np.uint64(1))
    for k in range(points.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + marks[:, k]
    return out


class Pieces:
    """The pieces of a model and their scores; ``kind`` is "bpe" or "unigram"."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.kind, self.unknown = kind, model.unk_id()
        self.bytes_of: list[bytes] = []
        texts, ids, scores = [], [], []
        self.byte_ids = np.full(256, self.unknown, np.int64)
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i):
                self.bytes_of.append(b"")
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                texts.append(piece)
                ids.append(i)
                scores.append(model.get_score(i))
        self.longest = max(map(len, texts), default=1)
        keys = np.zeros(len(texts), np.uint64)
        lengths = np.array([len(t) for t in texts])
        for n in np.unique(lengths):
            some = np.flatnonzero(lengths == n)
            keys[some] = _prefixes(_matrix([texts[k] for k in some]))[:, -1]
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array(ids, np.int64)[order]
        self.scores = np.array(scores, np.float64)[order]
        powers = np.full(max(self.longest, LONG_WORD) + 1, _BASE)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        self.by_text = dict(zip(texts, zip(scores, ids)))
        # Worse than any sum of pieces, so that an unknown character is the last choice.
        self.worst = (min(scores, default=0.0) - 10.0)

    def find(self, before: np.ndarray, upto: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The place among the keys, or -1, of substrings, by the prefixes before and up to them."""
        key = upto - before * self.powers[size]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece: those of its bytes."""
        return [int(self.byte_ids[b]) for b in char.encode("utf-8", "surrogatepass")]


def _matrix(words: Sequence[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    data = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, "<u4").reshape(len(words), -1).astype(np.uint64)


def _joined(words: Sequence[str], pieces: Pieces, row: np.ndarray, start: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Ids of each word as little-endian 32-bit integers.

    Symbols come in order of row and start, with their place among the keys; those without one
    are single characters and become the ids of their bytes.
    """
    data = pieces.ids[at].astype("<i4").tobytes()
    cuts = (4 * np.searchsorted(row, np.arange(len(words) + 1))).tolist()
    out = [data[i:j] for i, j in zip(cuts, cuts[1:])]
    for k in np.unique(row[at < 0]).tolist():
        some = slice(cuts[k] // 4, cuts[k + 1] // 4)
        ids = ([int(pieces.ids[p])] if p >= 0 else pieces.fallback(words[k][i]) for i, p in zip(start[some].tolist(), at[some].tolist()))
        out[k] = np.array(list(chain.from_iterable(ids)), "<i4").tobytes()
    return out


def viterbi(words: Sequence[str], pieces: Pieces) -> list[bytes]:
    """Ids with the best sum of scores for words of one length; ties go to the longer piece."""
    prefix = _prefixes(_matrix(words))
    rows, n = len(words), prefix.shape[1] - 1
    best = np.full((rows, n + 1), NONE)
    best[:, 0] = 0
    back, chosen = np.zeros((rows, n + 1), np.int64), np.full((rows, n + 1), -1, np.int64)
    for end in range(1, n + 1):
        lengths = range(1, min(end, pieces.longest) + 1)
        sums = np.empty((len(lengths), rows))
        found = np.empty((len(lengths), rows), np.int64)
        for k, size in enumerate(lengths):
            at = found[k] = pieces.find(prefix[:, end - size], prefix[:, end], size)
            score = np.where(at >= 0, pieces.scores[at], pieces.worst if size == 1 else NONE)
            sums[k] = best[:, end - size] + score
        pick = len(lengths) - 1 - sums[::-1].argmax(axis=0)
        row = np.arange(rows)
        best[:, end], back[:, end], chosen[:, end] = sums[pick, row], pick + 1, found[pick, row]
    begins = np.full((rows, n), NOWHERE)
    row, end = np.arange(rows), np.full(rows, n)
    while len(row):
        start = end - back[row, end]
        begins[row, start] = chosen[row, end]
        row, end = row[start > 0], start[start > 0]
    row, start = np.nonzero(begins > NOWHERE)
    return _joined(words, pieces, row, start, begins[row, start])


def merge(words: Sequence[str], pieces: Pieces) -> list[bytes]:
    """Ids after joining the best pair of each word until none is left, for words of one length.

    Of equally good pairs the leftmost is joined.
    """
    prefix = _prefixes(_matrix(words))
    rows, n = len(words), prefix.shape[1] - 1
    ends = np.tile(np.arange(1, n + 1), (rows, 1))  # where the symbol that begins here ends; 0: none does
    before = np.tile(np.arange(-1, n - 1), (rows, 1))
    # What joining the symbol that begins here with the next one is worth.
    value = np.full((rows, n), NONE)
    at = pieces.find(prefix[:, :-2], prefix[:, 2:], 2)
    value[:, :-1] = np.where(at >= 0, pieces.scores[at], NONE)
    busy = np.arange(rows)
    while n > 1 and len(busy):
        start = value[busy].argmax(axis=1)
        some = value[busy, start] > NONE
        busy, start = busy[some], start[some]
        middle = ends[busy, start]
        last = ends[busy, middle]
        ends[busy, start], ends[busy, middle] = last, 0
        value[busy, middle] = NONE
        inner = last < n
        before[busy[inner], last[inner]] = start[inner]
        value[busy[~inner], start[~inner]] = NONE
        left = before[busy, start]
        row = np.concatenate((busy[inner], busy[left >= 0]))
        first = np.concatenate((start[inner], left[left >= 0]))
        last = ends[row, ends[row, first]]
        at = pieces.find(prefix[row, first], prefix[row, last], last - first)
        value[row, first] = np.where(at >= 0, pieces.scores[at], NONE)
    row, start = np.nonzero(ends)
    last = ends[row, start]
    return _joined(words, pieces, row, start, pieces.find(prefix[row, start], prefix[row, last], last - start))


def merge_long(word: str, pieces: Pieces) -> bytes:
    """The same for one word of any length, by a queue of pairs."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue: list[tuple[float, int, int, int]] = []

    def offer(start: int) -> None:
        middle = end[start]
        if middle < n and end[middle] - start <= pieces.longest:
            known = pieces.by_text.get(word[start : end[middle]])
            if known:
                heapq.heappush(queue, (-known[0], start, middle, end[middle]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, start, middle, last = heapq.heappop(queue)
        if end[start] != middle or not end[middle] or end[middle] != last:
            continue
        end[start], end[middle] = last, 0
        if last < n:
            before[last] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    known = ((pieces.by_text.get(word[i:j]), word[i:j]) for i, j in enumerate(end) if j)
    ids = chain.from_iterable([found[1]] if found else pieces.fallback(text) for found, text in known)
    return np.array(list(ids), "<i4").tobytes()


def encode_words(words: Sequence[str], pieces: Pieces) -> list[bytes]:
    """Ids of words in the order given; those of one length are encoded together."""
    step = viterbi if pieces.kind == "unigram" else merge
    out = [b""] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        some = np.flatnonzero(lengths == n).tolist()
        if n > LONG_WORD and pieces.kind == "bpe":
            got = [merge_long(words[k], pieces) for k in some]
        else:
            got = step([words[k] for k in some], pieces)
        for k, ids in zip(some, got):
            out[k] = ids
    return out


class Encoder:
    """Ids of whole texts; words met before are remembered, up to a bound."""

    def __init__(self, path: str, kind: str = "bpe"):
        self.pieces = Pieces(path, kind)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        cut = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = list(chain.from_iterable(cut))
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known = self.known
        got = list(map(known.get, words))
        gaps = [k for k, ids in enumerate(got) if ids is None]
        missing = {words[k] for k in gaps}
        met = missing & self.older.keys()
        known.update((w, self.older[w]) for w in met)
        new = list(missing - met)
        known.update(zip(new, encode_words(new, self.pieces)))
        for k in gaps:
            got[k] = known[words[k]]
        parts = iter(got)
        return [np.frombuffer(b"".join(islice(parts, len(c))), "<i4") for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes in order, without the blank put before the text."""
        data = b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


def text_starts(texts: pa.Array) -> np.ndarray:
    """Where each text would begin among the bytes of all, with the end; the bytes are not copied."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def encoder(path: str, kind: str) -> Encoder:
    return worker_cache(f"pieces-{kind}-{path}", lambda: Encoder(path, kind))


def encode(
    df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kind: str = "bpe"
) -> DataFrame:
    """``keep`` with ids, n_ids, ids_crc32 and round_trip for every row.

    ``round_trip`` says whether the ids decode to the text; a text that holds the mark for a
    blank itself comes back with a blank there. Null and empty texts have no ids. ``ids_crc32`` is
    over the ids as little-endian 32-bit integers. Each text is encoded whole.
    """
    body, = unused(df.select(*keep), "body")
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body))
    schema = rows.drop(body).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "long").add("ids_crc32", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model, kind)
        for batch in batches:
            for i, j in slices(text_starts(batch.column(batch.num_columns - 1)), BYTES_AT_ONCE):
                part = batch.slice(i, j - i)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = code(texts)
                sizes = np.array([len(f) for f in found], np.int64)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1], ids, pa.array(sizes), pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64()),
                        pa.array([code.decode(f) == t for f, t in zip(found, texts)]),
                    ],
                    names=[*part.schema.names[:-1], "ids", "n_ids", "ids_crc32", "round_trip"],
                )
        give_back(everything=False)

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", into: str = "text", kind: str = "bpe") -> DataFrame:
    """The text of each row's ids as a new column; null ids give null."""

    @F.pandas_udf("string")
    def texts(column):
        code = encoder(model, kind)
        return column.map(lambda x: None if x is None else code.decode(np.asarray(x, np.int64)))

    return df.withColumn(into, texts(F.col(ids)))
