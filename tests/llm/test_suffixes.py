"""Repeated strings against brute force, and the pieces they are found with."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import queries, suffixes

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def got(df, **parameters):
    return sorted(tuple(r[f] for f in FIELDS) for r in suffixes.remove_repeated_strings(df, **parameters).collect())


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({n: F.lit(1) for n in ("id", "h", "body", "copies", "anchor", "part", "kept", "spans", "runs", "bytes")})


def corpus(seed, n=70):
    draw = random.Random(seed)
    letters = "abcdeé ü"
    passage = "".join(draw.choice(letters) for _ in range(60))
    rows = []
    for i in range(n):
        body = "".join(draw.choice(letters) for _ in range(draw.randrange(90)))
        kind = draw.randrange(7)
        if kind == 0 and rows:
            body = draw.choice(rows)[1]
        elif kind == 1 and rows:
            at = draw.randrange(60)
            body += draw.choice(rows)[1][at : at + 40]
        elif kind == 2:
            at = draw.randrange(30)
            body = body[:20] + passage[at:] + body[20:]
        elif kind == 3:
            body = draw.choice(["ab", "x", "abc d"]) * draw.randrange(40)
        rows.append((i, body))
    return rows


EDGES = [(900, None), (900, ""), (None, "é" * 50), (None, "no copy of this"), (901, "short"), (901, "short"), (902, "z" * 400)]


@pytest.mark.parametrize("seed, most", [(1, 2), (3, 2), (3, 2048)])
def test_repeats_match_brute_force(spark, seed, most):
    rows = corpus(seed) + EDGES
    df = documents(spark, rows).repartition(5)
    found = suffixes.remove_repeated_strings(df, length=24, gram=8, most_fragments=most).select(*FIELDS).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, brute.repeated_strings(rows, 24)))


def test_registered_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_suffix_dedup"](spark, SF).collect())) == sorted(brute.repeated_strings(rows))


def test_kept_bytes_and_spans(spark):
    rows = [(1, "a" * 30 + "x" + "b" * 9), (2, "b" * 9 + "y" + "a" * 30)]
    for r in suffixes.remove_repeated_strings(documents(spark, rows), length=16, gram=8).collect():
        body = dict(rows)[r["doc_id"]].encode()
        kept = bytearray(body)
        for a, b in sorted(r["spans"] or [], reverse=True):
            del kept[a:b]
        assert bytes(kept) == bytes(r["kept"]) and len(body) - len(kept) == r["n_removed"] == 30


def test_empty_table_and_sizes(spark):
    assert got(documents(spark, [])) == []
    with pytest.raises(ValueError):
        suffixes.remove_repeated_strings(documents(spark, []), length=24, gram=10)


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_small_shards(spark, shard, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    rows = corpus(9)
    assert got(documents(spark, rows), length=24, gram=8) == sorted(brute.repeated_strings(rows, 24))


def test_suffix_array_and_common_prefixes():
    draw = random.Random(4)
    parts = ["".join(draw.choice("ab\0") for _ in range(draw.randrange(1, 60))).encode() for _ in range(30)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    room = np.repeat(ends, [len(p) for p in parts]) - np.arange(len(data))
    words = suffixes.packed(data)
    order = suffixes.suffix_array(words, room)
    suffix = [bytes(data[i : i + room[i]]) for i in range(len(data))]
    assert [suffix[i] for i in order] == sorted(suffix)
    shared = suffixes.common_prefixes(words, room, order, 20)
    for a, b in zip(order, order[1:]):
        n = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert shared[b] == min(n, 20)


def shard_of(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = [len(p) for p in parts]
    return data, np.cumsum(sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    draw = random.Random(6)
    part = bytes(draw.randrange(256) for _ in range(700))
    data, _, room = shard_of([part] * 20 + [bytes(draw.randrange(256) for _ in range(700)) for _ in range(20)])
    words, sort, sizes = suffixes.packed(data), np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, *rest, **named: sizes.append(len(a)) or sort(a, *rest, **named))
    order = suffixes.suffix_array(words, room)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (bytes(data[i : i + room[i]]), i))
    # Half of the suffixes are alone after the first sort; those of the copies are equal to their ends.
    assert sum(sizes) < 3 * len(data)


@pytest.mark.parametrize("n, times", [(1 << 20, 3), ((1 << 21) + 5, 2)])
def test_suffixes_of_large_shards(n, times):
    data = np.random.default_rng(3).integers(97, 99, n).astype(np.uint8)
    room = np.minimum(16 - np.arange(n) % 16, n - np.arange(n))
    whole = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(16, np.uint8))), 16)[:n]
    whole = np.where(np.arange(16) < room[:, None], whole, 0).astype(np.uint8).view(">u8")
    assert (3 if 3 * n.bit_length() < 64 else 2) == times
    assert np.array_equal(suffixes.suffix_array(suffixes.packed(data), room), np.lexsort((whole[:, 1], whole[:, 0])))


def test_common_prefixes_of_long_suffixes_only():
    draw = random.Random(8)
    parts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 40))) * draw.randrange(1, 9) for _ in range(60)]
    data, _, room = shard_of(parts)
    words = suffixes.packed(data)
    order = suffixes.suffix_array(words, room)
    every = suffixes.common_prefixes(words, room, order, 90)
    assert every.max() > 64
    for least in (30, 90, 1000):
        some = suffixes.common_prefixes(words, room, order, 90, least)
        assert np.array_equal(some, np.where(room >= least, every, 0))


def test_sorted_lists_merge_by_search():
    parts = [np.array(p, np.complex128) for p in ([1, 3], [2, 3, 4], [3], [], [1 + 1j])]
    kinds, counts = suffixes.merged_counts(parts)
    assert dict(zip(kinds.tolist(), counts.tolist())) == {1: 1, 1 + 1j: 1, 2: 1, 3: 3, 4: 1}
