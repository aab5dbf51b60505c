"""Text → vector, with the model behind a small protocol."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import release, text_parts

# An embedder maps a list of texts to a float matrix, one row per text.
Embedder = Callable[[Sequence[str]], np.ndarray]


# Tokens whose bucket a worker remembers; each takes a few hundred bytes.
REMEMBERED = 1 << 16


def token_bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % dim


class HashEmbedder:
    """Token counts by hash bucket; whole numbers, so scores are exact in any order.

    The tokens of a batch are made distinct first, so each is hashed once.
    """

    def __init__(self, dim: int = 256):
        self.dim = dim
        self.bucket = lru_cache(maxsize=REMEMBERED)(lambda token: token_bucket(token, dim))

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        tokens = [text.lower().split() for text in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        coded = pa.array(chain.from_iterable(tokens), pa.string(), size=int(sizes.sum())).dictionary_encode()
        buckets = np.fromiter(map(self.bucket, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        cells = np.repeat(np.arange(len(texts)) * self.dim, sizes) + buckets[coded.indices.to_numpy()]
        counts = np.bincount(cells, minlength=len(texts) * self.dim)
        return counts.reshape(len(texts), self.dim).astype(np.float32)


def _loaded() -> dict[str, Embedder]:
    """The embedders of this Python worker; a module of its own outlives the tasks."""
    return sys.modules.setdefault("lexweave_embedders", ModuleType("lexweave_embedders")).__dict__


def embed(
    df: DataFrame,
    column: str,
    make: Callable[[], Embedder],
    name: str,
    batch: int = 32,
    into: str = "embedding",
) -> DataFrame:
    """Add vectors. ``make`` runs once per Python worker for a name and definition.

    Only the texts go to Python and only the vectors come back.
    """
    key = f"{name}-{hashlib.md5(cloudpickle.dumps(make)).hexdigest()}"

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        loaded = _loaded()
        if key not in loaded:
            loaded[key] = make()
        model = loaded[key]
        for column in batches:
            for texts in text_parts(column, batch):
                matrix = np.asarray(model(texts)).astype(np.float32, copy=False)
                offsets = np.arange(len(texts) + 1, dtype=np.int32) * matrix.shape[1]
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
        release()

    return df.withColumn(into, vectors(F.col(f"`{column}`")))


def hash_embed(df: DataFrame, column: str, dim: int = 256, into: str = "embedding") -> DataFrame:
    """Token counts by hash bucket. As column expressions the same took four times as long."""
    return embed(df, column, lambda: HashEmbedder(dim), f"hash-{dim}", batch=4096, into=into)
