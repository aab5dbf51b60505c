import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexweave.llm.token_file import CachedEncoder, pack, token_file, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


CACHED = CachedEncoder(PATH)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text("aB1's\xe9.,!#)_$\n\t \r\v\f\x1c\x85\xa0\u2003\u3000\u65e5<|>e", max_size=30), max_size=8))
def test_words_encode_like_whole_texts(texts):
    plain = Tokenizer.from_file(PATH) if not hasattr(CACHED, "_plain") else CACHED._plain
    CACHED._plain = plain
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert CACHED(texts) == want


def test_words_met_again_are_not_encoded_again():
    """A worker's texts have about this many different words; they come again in later runs."""
    asked = []

    class Counted:
        def encode_batch_fast(self, words, add_special_tokens):
            asked.append(len(words))
            return [SimpleNamespace(ids=[1])] * len(words)

    code = CachedEncoder(PATH)
    code.tokenizer = Counted()
    for run in [0, 1, 2, 0, 1, 2]:
        assert code._ids([b"%d %d" % (run, k) for k in range(150_000)]) == [b"\x01\0\0\0"] * 150_000
    assert sum(asked) == 450_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60), st.integers(1, 70_000))
def test_blocks_round_trip(ids, spread):
    ids = np.concatenate((np.array(ids, np.uint32), np.arange(spread, dtype=np.uint32)))
    assert (unpack(*pack(ids), len(ids)) == ids).all()


def test_frequent_ids_take_one_byte():
    ids = np.array([50_000] * 1000 + list(range(300)), np.uint32)
    _, control, data = pack(ids)
    assert len(control) == 325 and len(data) == 1300 + 45


def test_documents_in_order_with_edges(spark, plain):
    rows = [(5, "b b"), (-3, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no id"), (9, "x " * 40_000), (7, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, part int")
    got = [tuple(r) for r in token_file(df.repartition(3), PATH).collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_no_documents(spark):
    assert token_file(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
