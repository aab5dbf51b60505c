"""What Arrow functions hold at once does not grow with the rows of a batch."""

import numpy as np
import pandas as pd
import pyarrow as pa

from lexweave import ChunkConfig
from lexweave.operators import batches, chunk, embed, search, tokens

LARGE = [(i, "word " * 50_000) for i in range(40)] + [(40, None), (41, "")]


def test_texts_come_in_parts():
    texts = pa.array(["a" * 10, None, "b" * 25, "c", "d"])
    assert list(batches.text_parts(texts, 2, 20)) == [["a" * 10, ""], ["b" * 25], ["c", "d"]]
    assert list(batches.text_parts(texts.slice(3), 1, 20)) == [["c"], ["d"]]
    assert list(batches.text_parts(texts.slice(0, 0))) == []


def test_embedders_get_bounded_texts(spark):
    df = spark.createDataFrame(LARGE, "id long, text string").coalesce(1)
    held = lambda: lambda texts: np.full((len(texts), 1), sum(map(len, texts)))
    rows = embed.embed(df, "text", held, "held", batch=4096).collect()
    assert len(rows) == len(LARGE) and max(r["embedding"][0] for r in rows) <= batches.TEXT_AT_ONCE


def test_tokenizers_get_bounded_texts(spark):
    class Held:
        def encode(self, texts):
            return [[sum(map(len, texts)), len(t)] for t in texts]

    df = spark.createDataFrame(LARGE, "id long, text string").coalesce(1)
    rows = tokens.tokenize(df, "text", Held(), keep=["id"]).collect()
    assert {r["id"]: r["input_ids"][1] for r in rows} == {i: len(t or "") for i, t in LARGE}
    assert max(r["input_ids"][0] for r in rows) <= batches.TEXT_AT_ONCE


def test_chunks_of_many_parts_stay_with_their_rows(spark):
    df = spark.createDataFrame(LARGE, "id long, text string").coalesce(1)
    got = chunk.chunk_recursive(df, "text", ChunkConfig(100_000, 0)).collect()
    want = [(i, n, c) for i, t in LARGE if t for n, c in enumerate(chunk.split_text(t, ChunkConfig(100_000, 0)))]
    assert sorted((r["id"], r["chunk_no"], r["content"]) for r in got) == want


def test_remembered_tokens_are_few():
    model = embed.HashEmbedder(16)
    model([" ".join(map(str, range(200_000)))])
    assert model.bucket.cache_info().currsize <= 1 << 16


def test_vectors_are_scored_in_parts(monkeypatch):
    seen, real = [], search._distances
    monkeypatch.setattr(search, "_distances", lambda rows, *more: seen.append(rows.size) or real(rows, *more))
    vectors = np.arange(20_000 * 256, dtype=np.float32) % 97
    lists = pa.ListArray.from_arrays(pa.array(np.arange(20_001, dtype=np.int32) * 256), pa.array(vectors))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), lists], names=["item", "embedding"])
    asked = vectors[:512].reshape(2, 256).astype(float)
    best = search._best_hits(iter([batch]), asked, 3, "l2", None)
    assert max(seen) <= search.NUMBERS_AT_ONCE and len(best) == 6
    assert isinstance(best, pd.DataFrame) and best.groupby("q")["score"].min().tolist() == [0.0, 0.0]
