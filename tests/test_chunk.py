"""Chunking against twins written from the splitting rules, not from the module."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave import ChunkConfig
from lexweave.operators import chunk


def twin_merge(splits, size, overlap):
    docs, current, total = [], [], 0
    for s in splits:
        if total + len(s) > size and current:
            docs.append("".join(current).strip())
            while total > overlap or (total + len(s) > size and total > 0):
                total -= len(current[0])
                current = current[1:]
        current.append(s)
        total += len(s)
    docs.append("".join(current).strip())
    return [d for d in docs if d]


def twin(text, size, overlap, seps):
    sep, rest = seps[-1], []
    for i, s in enumerate(seps):
        if s == "" or s in text:
            sep, rest = s, seps[i + 1 :]
            break
    if sep:
        found = text.split(sep)
        splits = [p for p in [found[0]] + [sep + p for p in found[1:]] if p]
    else:
        splits = list(text)
    out, good = [], []
    for s in splits:
        if len(s) < size:
            good.append(s)
            continue
        if good:
            out += twin_merge(good, size, overlap)
            good = []
        out += twin(s, size, overlap, rest) if rest else [s]
    return out + (twin_merge(good, size, overlap) if good else [])


SEPS = ["\n\n", "\n", " ", ""]


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet="abc é\n\U0001f600", max_size=120),
    st.integers(1, 12),
    st.data(),
    st.sampled_from([SEPS, ["\n", " "], [" ", ""], [""], ["a", "\n\n", " "]]),
)
def test_recursive_chunks_equal_the_twin(text, size, data, seps):
    overlap = data.draw(st.integers(0, size - 1))
    got = list(chunk.split_text(text, ChunkConfig(size, overlap, tuple(seps)))) if text else []
    assert got == (twin(text, size, overlap, seps) if text else [])


def test_blank_lines_are_preferred():
    text = "one two\n\nthree four\nfive\n\n" + "six " * 10
    got = list(chunk.split_text(text, ChunkConfig(20, 5)))
    assert got == twin(text, 20, 5, SEPS)
    assert got[0] == "one two" and max(map(len, got)) <= 20


def test_chunks_keep_metadata_and_have_stable_ids(spark):
    rows = [(1, "fr", "a b c d"), (2, "en", ""), (3, "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    cut = chunk.with_chunk_id(chunk.chunk_recursive(df, "text", ChunkConfig(3, 0)), "doc_id")
    got = sorted((r["doc_id"], r["lang"], r["chunk_no"], r["content"]) for r in cut.collect())
    assert got == [(1, "fr", 0, "a b"), (1, "fr", 1, "c"), (1, "fr", 2, "d"), (3, "de", 0, "x")]
    one = cut.where("doc_id = 3").first()["chunk_id"]
    assert one == hashlib.sha256(b"3\n0\nx").hexdigest()


@pytest.mark.parametrize("size, overlap", [(5, 2), (5, 0), (5, 4), (1, 0), (7, 3)])
def test_fixed_chunks_equal_the_character_floor(spark, size, overlap):
    texts = ["", "a", "abcde", "abcdef", "ab\ncdefghijk", "\U0001f600" * 9, "x  y" * 6, "    "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = chunk.chunk_fixed(df, "t", ChunkConfig(size, overlap)).orderBy("i", "chunk_no").collect()
    for i, text in enumerate(texts):
        got = [r["content"] for r in rows if r["i"] == i]
        want = twin(text, size, overlap, [""]) if size > 1 else [c for c in text if c.strip()]
        assert got == want, text


def test_fixed_chunks_are_native(spark, plan):
    df = spark.createDataFrame([("a",)], "t string")
    shown = plan(chunk.chunk_fixed(df, "t"))
    assert "Python" not in shown and "Exchange" not in shown


def test_overlap_must_be_smaller_than_the_size():
    with pytest.raises(ValueError):
        ChunkConfig(10, 10)
