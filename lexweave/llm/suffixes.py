"""Byte strings that occur twice, by suffix arrays of shards, and the documents without them.

Equal texts become one text with a count. Every window of ``length`` bytes has an anchor, a
short gram chosen by the window's bytes alone, so equal windows have equal anchors at the
same place. Anchors that occur once settle their windows. The windows of each other anchor
move, as one fragment of text, to the shard of that anchor. A shard sorts its suffixes by
Larsson-Sadakane refinement and compares sorted neighbours by Kasai's rule. The fragments of
a very common anchor are dealt over several shards, whose sorted windows are then merged
by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import mix64, text_bytes, text_slices
from .words import constants

LENGTH = 400
GRAM = 32
# Bytes that are sorted together; the arrays over them take about a hundred times that.
SHARD_BYTES = 1 << 18
# Fragments of one anchor in a shard; beyond that they are dealt over several.
MOST_FRAGMENTS = 2048
# Kasai's rule is applied to every STRIDE-th place at once.
STRIDE = 16
_LOW = np.uint64(0xFFFFFFFF)
_AHEAD = np.arange(0, 64, 8)


def gram_keys(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each byte on."""
    out = constants(256, 11)[data]
    width = 1
    for c in constants(gram.bit_length() - 1, 12):
        out[:-width] = out[:-width] * c + out[width:]
        width *= 2
    return mix64(out)


def lowest(values: np.ndarray, span: int) -> np.ndarray:
    """The least of the ``span`` values from each place on, from minima inside blocks of that size."""
    n = len(values)
    blocks = -(-n // span) + 1
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash of the anchor, first window, windows) for runs of windows with one anchor.

    Places count from the start of their text. Texts shorter than a window have none.
    """
    last = offsets[1:] - length
    has = np.flatnonzero(last >= offsets[:-1])
    if not len(has):
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = gram_keys(data, gram)
    places = (grams & ~_LOW) | np.arange(len(data), dtype=np.uint64)
    anchor = (lowest(places, length - gram + 1) & _LOW).astype(np.int64)
    sizes = last[has] - offsets[:-1][has] + 1
    text = np.repeat(has, sizes)
    at = np.arange(len(text)) + np.repeat(offsets[:-1][has] - (np.cumsum(sizes) - sizes), sizes)
    mine = anchor[at]
    starts = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (text[1:] != text[:-1]))))
    runs = np.diff(np.append(starts, len(at)))
    text = text[starts]
    return text, grams[mine[starts]].view(np.int64), at[starts] - offsets[text], runs


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number that sorts like them; zeros follow the end."""
    out = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        out[:-width] = out[:-width] << np.uint64(8 * width) | out[width:]
    return out[: len(data)]


def _edges(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, with the end."""
    out = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=out[1:-1])
    return out


def suffix_array(words: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Suffixes in order, equal ones by place, by Larsson-Sadakane refinement.

    ``words`` are the packed bytes and ``room`` the bytes left in the suffix's own text,
    which ends it: a shorter suffix comes before those it begins. The order by the first h
    bytes becomes that by 3h (2h where three ranks don't fit a number), since the ranks of what
    follows are known; only groups of suffixes that are still equal and go on are sorted again.
    """
    n, h = len(words), 7
    key = words & ~np.uint64(255)
    short = np.flatnonzero(room < h)
    key[short] &= ~((np.uint64(1) << (np.uint64(64) - room[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1))
    key |= np.minimum(room, h).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    edge = _edges(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(edge[:-1], np.arange(n), 0))
    left = np.flatnonzero(~(edge[:-1] & edge[1:]))
    width = n.bit_length()
    times = 3 if 3 * width < 64 else 2
    while True:
        suffix = order[left]
        rest = room[suffix]
        # Equal suffixes that end within h bytes are equal to the end.
        going = np.flatnonzero(rest >= h)
        if not len(going):
            return order
        left, suffix, rest = left.take(going), suffix.take(going), rest.take(going)
        key = rank.take(suffix)
        for k in range(1, times):
            key <<= width
            key |= (rank.take(suffix + k * h, mode="clip") + 1) * (rest > k * h)
        # Groups stay in place, so the keys are nearly sorted, and a stable sort is faster.
        by = np.argsort(key, kind="stable")
        suffix = suffix.take(by)
        order[left] = suffix
        edge = _edges(key.take(by))
        rank[suffix] = np.maximum.accumulate(np.where(edge[:-1], left, 0))
        left = left.take(np.flatnonzero(~(edge[:-1] & edge[1:])))
        h *= times


def common_prefixes(words: np.ndarray, room: np.ndarray, order: np.ndarray, most: int, least: int = 0) -> np.ndarray:
    """For each suffix, the bytes (``most`` at most) that it shares with the one before it in the order.

    Kasai's rule: the suffix one byte on shares one byte less at least. So in each run of
    suffixes every STRIDE-th is compared from its start and each next one from where the rule says,
    all of one remainder at a time: eight bytes, then sixty-four a step. Suffixes of less than
    ``least`` bytes are left out, and get 0.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    shared = np.zeros(n, np.int64)
    wanted = room >= least
    begins = np.flatnonzero(wanted & ~np.concatenate(([False], wanted[:-1])))
    wanted = np.flatnonzero(wanted)
    turn = ((wanted - begins[np.searchsorted(begins, wanted, "right") - 1]) % STRIDE).astype(np.uint16)
    wanted = wanted[np.argsort(turn, kind="stable")]
    other = before[wanted]
    limit = np.where(other >= 0, np.minimum(np.minimum(room[wanted], room[other]), most), 0)
    ends = np.cumsum(np.bincount(turn, minlength=STRIDE))
    for k in range(STRIDE):
        mine = slice(ends[k - 1] if k else 0, ends[k])
        at, to, most_here = wanted[mine], other[mine], limit[mine]
        have = np.minimum(np.maximum(shared[at - 1] - 1, 0) if k else 0, most_here)
        going, ahead = np.flatnonzero(have < most_here), np.zeros(1, np.int64)
        while len(going):
            i, j = (at[going] + have[going])[:, None] + ahead, (to[going] + have[going])[:, None] + ahead
            differ = words.take(i, mode="clip") ^ words.take(j, mode="clip")
            block = (differ != 0).argmax(axis=1)
            x = differ[np.arange(len(going)), block]
            same = 8 * block + sum((x < np.uint64(1) << np.uint64(8 * b)).astype(np.int64) for b in range(1, 8))
            same[x == 0] = 8 * len(ahead)
            have[going] = np.minimum(have[going] + same, most_here[going])
            going = going[(x == 0) & (have[going] < most_here[going])]
            ahead = _AHEAD
        shared[at] = have
    return shared


def repeated(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which ``length``-byte strings of a shard another place has, and one of each kind.

    ``ends`` are where the fragments end. The first result marks starts; the second lists
    one start of each different string.
    """
    sizes = np.diff(np.concatenate(([0], ends)))
    room = np.repeat(ends, sizes) - np.arange(len(data))
    words = packed(data)
    order = suffix_array(words, room)
    shared = common_prefixes(words, room, order, length, length)
    again = shared >= length
    twice = again.copy()
    place = np.flatnonzero(again[order])
    twice[order[place - 1]] = True
    return twice, np.flatnonzero((room >= length) & ~again)


def fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """106 bits for the string at each place, as complex numbers, which sort by both halves."""
    out = np.empty(len(at), np.complex128)
    # Blocks of 2^k bytes, doubled; a length is a sum of them.
    for part, seed in (("real", 21), ("imag", 22)):
        block, width, done = constants(256, seed)[data], 1, 0
        total = np.zeros(len(at), np.uint64)
        c = constants(64, seed + 10)
        for k in range(length.bit_length()):
            if length >> k & 1:
                total = total * c[k + 32] + block[at + done]
                done += width
            wider = block.copy()
            wider[:-width] = block[:-width] * c[k] + block[width:] if width < len(block) else block[:-width]
            block, width = mix64(wider), width * 2
        setattr(out, part, (mix64(total) >> np.uint64(11)).astype(np.float64))
    return out


def merged_counts(sorted_parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different strings of sorted lists and how many lists have each; lists merge in pairs."""
    level = [(part, np.ones(len(part), np.int64)) for part in sorted_parts]
    while len(level) > 1:
        nxt = []
        for (a, n), (b, m) in zip(level[::2], level[1::2]):
            at = np.searchsorted(a, b)
            found = np.flatnonzero(at < len(a))
            found = found[a[at[found]] == b[found]]
            n[at[found]] += m[found]
            new = np.ones(len(b), bool)
            new[found] = False
            nxt.append((np.insert(a, at[new], b[new]), np.insert(n, at[new], m[new])))
        if len(level) % 2:
            nxt.append(level[-1])
        level = nxt
    return level[0]


_SPANS = "h binary, start long, stop long, anchor long, bucket int, part int, prints binary, places binary, once binary"
_PLACE = np.dtype([("h", "S17"), ("at", "<i8")])


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {
        "h": pa.binary(), "start": pa.int64(), "stop": pa.int64(), "anchor": pa.int64(), "bucket": pa.int32(),
        "part": pa.int32(), "prints": pa.binary(), "places": pa.binary(), "once": pa.binary(),
    }
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types)
    )


def _shard(rows: list[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated runs of one shard's windows, and the sorted windows of anchors that other shards have too."""
    table = pa.Table.from_batches(rows)
    column = table.column("fragment").combine_chunks()
    data, offsets = text_bytes(column)
    ends = offsets[1:]
    twice, kinds = repeated(data, ends, length)
    h = table.column("h").to_pylist()
    first = table.column("at").to_numpy()
    start = np.flatnonzero(twice & ~np.concatenate(([False], twice[:-1])))
    stop = np.flatnonzero(twice & ~np.concatenate((twice[1:], [False])))
    # A window never starts in the last bytes of a fragment, so no run goes on into the next one.
    of = np.searchsorted(ends, start, "right")
    move = first[of] - offsets[of]
    if len(start):
        yield _batch(h=[h[k] for k in of], start=start + move, stop=stop + move + length)
    parts = table.column("parts").to_numpy()
    split = kinds[parts[np.searchsorted(ends, kinds, "right")] > 1]
    if not len(split):
        return
    of = np.searchsorted(ends, split, "right")
    prints = fingerprints(data, split, length)
    bucket = prints.real.astype(np.int64) % parts[of]
    key, part = table.column("anchor").to_numpy()[of], table.column("part").to_numpy()[of]
    order = np.lexsort((prints.imag, prints.real, bucket, part, key))
    places = np.empty(len(split), _PLACE)
    places["h"], places["at"] = np.array([h[k] + b"." for k in range(len(h))], "S17")[of], split - offsets[of] + first[of]
    cut = np.flatnonzero(np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (bucket, part, key)], axis=0))))
    for i in range(len(cut)):
        mine = order[cut[i] : cut[i + 1] if i + 1 < len(cut) else None]
        k = mine[0]
        yield _batch(
            anchor=[int(key[k])], bucket=[int(bucket[k])], part=[int(part[k])], prints=[prints[mine].tobytes()],
            places=[places[mine].tobytes()], once=[(~twice[split[mine]]).tobytes()],
        )


def _sorted_shards(fragments: DataFrame, length: int) -> DataFrame:
    ordered = fragments.repartition("anchor", "part").sortWithinPartitions("anchor", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy() ^ batch.column(1).to_numpy()
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("fragment")))
            edges = np.flatnonzero(np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1])))
            last, done = key[-1], 0
            for edge in edges.tolist():
                # A shard ends only between anchors, once it is large enough.
                if size + offsets[edge] - offsets[done] >= SHARD_BYTES:
                    held.append(batch.slice(done, edge - done))
                    yield from _shard(held, length)
                    held, size, done = [], 0, edge
            held.append(batch.slice(done))
            size += int(offsets[-1] - offsets[done])
        if held:
            yield from _shard(held, length)

    return ordered.mapInArrow(run, _SPANS)


def _merged(windows: DataFrame, length: int) -> DataFrame:
    """Runs of windows that another shard of their anchor has, by binary search in the others' sorted windows."""
    ordered = windows.select("anchor", "bucket", "part", "prints", "places", "once") \
        .repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket", "part")

    def settle(rows: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(p, np.complex128) for p, _, _ in rows]
        kinds, counts = merged_counts(parts)
        for prints, (_, places, once) in zip(parts, rows):
            hit = (counts[np.searchsorted(kinds, prints)] > 1) & np.frombuffer(once, bool)
            found = np.sort(np.frombuffer(places, _PLACE)[hit], order=("h", "at"))
            if len(found):
                h, at = found["h"], found["at"]
                begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1))))
                end = np.append(begin[1:], len(at)) - 1
                yield _batch(h=[x[:16] for x in h[begin].tolist()], start=at[begin], stop=at[end] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and row[:2] != last:
                    yield from settle(held)
                    held = []
                last = row[:2]
                held.append(row[3:])
        if held:
            yield from settle(held)

    return ordered.mapInArrow(run, _SPANS)


def copies_inside(data, offsets, text, key, at, n, length) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have the bytes of an earlier run of their text, and which have a copy in it."""
    spare, known = np.zeros(len(text), bool), np.zeros(len(text), bool)
    _, inverse, counts = np.unique(np.stack((text, key, n)), axis=1, return_inverse=True, return_counts=True)
    first: dict[tuple, int] = {}
    for k in np.flatnonzero(counts[inverse.ravel()] > 1).tolist():
        start = offsets[text[k]] + at[k]
        mark = (text[k], hashlib.sha256(data[start : start + n[k] + length - 1]).digest())
        if first.setdefault(mark, k) != k:
            spare[k] = known[k] = known[first[mark]] = True
    return spare, known


def _places(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, anchor, at, windows) for the runs of windows of each text.

    Runs of one text with equal bytes are one run; what they cover is repeated, and given as
    spans, without an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in text_slices(batch.column(1)):
                text, key, at, n = anchors(data, offsets, length, gram)
                if not len(text):
                    continue
                spare, known = copies_inside(data, offsets, text, key, at, n, length)
                k = np.flatnonzero(known)
                begin = np.flatnonzero(np.concatenate(([True], (text[k][1:] != text[k][:-1]) | (k[1:] != k[:-1] + 1)))) if len(k) else k
                end = np.append(begin[1:], len(k))[: len(begin)] - 1
                of = np.concatenate((text[~spare], text[k[begin]]))
                spans = at[k[end]] + n[k[end]] + length - 1 - at[k[begin]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of + i)),
                        pa.array(np.concatenate((key[~spare], np.zeros(len(begin), np.int64))), mask=np.arange(len(of)) >= (~spare).sum()),
                        pa.array(np.concatenate((at[~spare], at[k[begin]]))), pa.array(np.concatenate((n[~spare], spans))),
                    ],
                    names=["h", "anchor", "at", "windows"],
                )

    return texts.select("h", "body").mapInArrow(run, "h binary, anchor long, at long, windows long")


def _cut(found: DataFrame, length: int) -> DataFrame:
    """(h, kept, n_removed, n_spans, kept_sha256, spans) of texts with something to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, body, copies, runs in zip(*(c.to_pylist() for c in batch.columns)):
                body = body.encode() if isinstance(body, str) else body
                if copies > 1 and len(body) >= length:
                    spans = [[0, len(body)]]
                else:
                    spans = []
                    for run in sorted((r["start"], r["stop"]) for r in runs or ()):
                        if spans and run[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], run[1])
                        else:
                            spans.append(list(run))
                if not spans:
                    continue
                edges = [0, *(x for s in spans for x in s), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((h, kept, len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t)
                        for c, t in zip(
                            zip(*out),
                            (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))),
                        )
                    ],
                    names=["h", "kept", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    return found.select("h", F.col("body").cast("binary").alias("body"), "copies", "runs").mapInArrow(
        run, "h binary, kept binary, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )


def remove_repeated_strings(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    most_fragments: int = MOST_FRAGMENTS,
) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a string of ``length`` bytes
    over it also starts at another place of any row, its own included; strings never cross
    rows, and are judged on the input. ``kept`` has the bytes that stay (they need not be
    UTF-8), ``spans`` the removed runs (start, stop). Rows are told apart as rows, so ids may
    be null or repeat, and of equal rows each one is the others' copy. Texts shorter than ``length``
    keep all. An empty table gives an empty result; other columns are ignored.

    Equal texts are found by 128 bits of hash. Strings are compared byte by byte inside a
    shard and by 106 bits between the shards of an anchor that has more than
    ``most_fragments`` places.
    """
    if length < 2 * gram or gram & (gram - 1):
        raise ValueError("gram must be a power of two, and length twice that at least")
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), body.alias("body"), F.unhex(F.md5(body)).alias("h"))
    texts = rows.groupBy("h").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))

    path = scratch_path(spark, "anchors")
    _places(texts, length, gram).write.parquet(path)
    places = spark.read.schema("h binary, anchor long, at long, windows long").parquet(path)
    inside = places.where("anchor IS NULL").select("h", F.col("at").alias("start"), (F.col("at") + F.col("windows")).alias("stop"))
    places = places.where("anchor IS NOT NULL")
    shared = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "anchor", F.ceil(F.col("n") / F.lit(most_fragments)).cast("int").alias("parts")
    )
    asked = places.join(shared, "anchor").groupBy("h").agg(F.collect_list(F.struct("anchor", "parts", "at", "windows")).alias("asked"))
    # Of a text only the fragments move on, so each is cut out before the rows multiply.
    cut = F.transform("asked", lambda x: F.struct(
        x["anchor"].alias("anchor"), x["parts"].alias("parts"), x["at"].alias("at"),
        F.substring(F.col("bytes"), (x["at"] + 1).cast("int"), (x["windows"] + (length - 1)).cast("int")).alias("fragment"),
    ))
    fragments = texts.join(asked, "h").select("h", "asked", F.col("body").cast("binary").alias("bytes")) \
        .select("h", F.inline(cut)).select(
            "anchor", F.pmod(F.xxhash64("h", "at"), "parts").cast("int").alias("part"), "parts", "h", "at", "fragment"
        )
    path = scratch_path(spark, "repeats")
    _sorted_shards(fragments, length).write.parquet(path)
    found = spark.read.schema(_SPANS).parquet(path)
    spans = found.where("h IS NOT NULL").select("h", "start", "stop").unionByName(
        _merged(found.where("anchor IS NOT NULL"), length).select("h", "start", "stop")
    ).unionByName(inside)
    runs = spans.groupBy("h").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    cuts = _cut(texts.join(runs, "h", "left").where((F.col("copies") > 1) | F.col("runs").isNotNull()), length)
    whole = rows.select("id", "h", F.col("body").cast("binary").alias("bytes"), F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
    return whole.join(cuts, "h", "left").select(
        F.col("id").alias(id_column), F.col("n_bytes").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("kept", "bytes").alias("kept"), "spans",
    )
