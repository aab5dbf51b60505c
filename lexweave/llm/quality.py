"""Quality of a text by a small convolutional network over its bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, text_slices

PAD = 256
# Blocks of a text that one pass of the network handles; longer texts go through in parts.
BLOCKS_AT_ONCE = 1 << 17


@dataclass(frozen=True)
class NetConfig:
    """A filter sees ``2 * stride`` bytes and moves on by ``stride``, so chunks overlap by half.

    ``per_class`` labelled texts of each class teach the network, those with the lowest
    hash of their id, as far as they have at most ``train_chars`` characters. These bounds
    hold for learning alone; scores read whole texts.
    """

    stride: int = 8
    width: int = 8
    filters: int = 32
    per_class: int = 1000
    train_chars: int = 16_384
    epochs: int = 14
    batch: int = 32
    rate: float = 0.004
    seed: int = 5


def blocked(data: np.ndarray, offsets: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of ``stride`` bytes, and the first row of each; an empty text has one row."""
    sizes = np.diff(offsets)
    rows = np.maximum(1, -(-sizes // stride))
    first = np.cumsum(rows) - rows
    line = np.full(int(rows.sum()) * stride, PAD, np.uint16)
    line[np.arange(len(data)) + np.repeat(first * stride - offsets[:-1], sizes)] = data
    return line.reshape(-1, stride), first


class ByteNet:
    """Bytes to vectors, filters over overlapping chunks, the largest of each, one probability."""

    def __init__(self, cfg: NetConfig):
        rng = np.random.default_rng(cfg.seed)
        deep = cfg.stride * cfg.width
        self.cfg = cfg
        self.weights = {
            "bytes": rng.normal(0, 0.5, (PAD + 1, cfg.width)),
            "left": rng.normal(0, deep**-0.5, (deep, cfg.filters)),
            "right": rng.normal(0, deep**-0.5, (deep, cfg.filters)),
            "bias": np.zeros(cfg.filters),
            "out": rng.normal(0, cfg.filters**-0.5, cfg.filters),
            "shift": np.zeros(1),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def responses(self, blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter over each block and its successor in the same text."""
        w = self.weights
        seen = w["bytes"][blocks].reshape(len(blocks), -1)
        both = seen @ np.concatenate((w["left"], w["right"]), axis=1)
        here, after = both[:, : self.cfg.filters], both[:, self.cfg.filters :]
        after[first] = 0
        here[:-1] += after[1:]
        return here, seen

    def pooled(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text."""
        if len(blocks) <= BLOCKS_AT_ONCE:
            return np.maximum.reduceat(self.responses(blocks, first)[0], first, axis=0)
        # A single long text: parts share a block, so that no chunk is missed.
        best = np.full((1, self.cfg.filters), -np.inf, np.float32)
        for i in range(0, len(blocks), BLOCKS_AT_ONCE):
            part = self.responses(blocks[i : i + BLOCKS_AT_ONCE + 1], np.array([0]))[0]
            inner = part[:-1] if i + BLOCKS_AT_ONCE < len(blocks) else part
            best = np.maximum(best, inner.max(axis=0))
        return best

    def combined(self, top: np.ndarray) -> np.ndarray:
        w = self.weights
        hidden = np.tanh(top + w["bias"])
        return 1 / (1 + np.exp(-(hidden @ w["out"] + w["shift"][0]).astype(np.float64)))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, data, offsets in text_slices(column, BLOCKS_AT_ONCE * self.cfg.stride // 2):
            blocks, first = blocked(data, offsets, self.cfg.stride)
            out[i : i + len(first)] = self.combined(self.pooled(blocks, first))
        return out

    def gradients(self, blocks: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        cfg, w = self.cfg, self.weights
        here, seen = self.responses(blocks, first)
        ends = np.append(first[1:], len(blocks))
        best = np.stack([a + here[a:b].argmax(axis=0) for a, b in zip(first, ends)])  # text x filter
        hidden = np.tanh(np.take_along_axis(here, best, axis=0) + w["bias"])
        chance = 1 / (1 + np.exp(-(hidden @ w["out"] + w["shift"][0])))
        off = ((chance - labels) / len(labels)).astype(np.float32)
        back = off[:, None] * w["out"] * (1 - hidden**2)
        follows = best + 1
        inside = follows < ends[:, None]
        follows = np.where(inside, follows, 0)
        next_seen = seen[follows] * inside[..., None]
        grads = {
            "left": np.einsum("df,dfi->if", back, seen[best], optimize=True),
            "right": np.einsum("df,dfi->if", back, next_seen, optimize=True),
            "bias": back.sum(axis=0), "out": hidden.T @ off, "shift": np.array([off.sum()], np.float32),
            "bytes": np.zeros_like(w["bytes"]),
        }
        shape = (*best.shape, cfg.stride, cfg.width)
        np.add.at(grads["bytes"], blocks[best], (back[..., None] * w["left"].T).reshape(shape))
        np.add.at(grads["bytes"], blocks[follows], (back[..., None] * w["right"].T * inside[..., None]).reshape(shape))
        return grads

    def fit(self, texts: list[bytes], labels: np.ndarray) -> None:
        """Adam over shuffled batches; the same texts give the same network."""
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed + 1)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(cfg.epochs):
            order = rng.permutation(len(texts))
            rate = cfg.rate * (1 - epoch / cfg.epochs)
            for i in range(0, len(order), cfg.batch):
                some = order[i : i + cfg.batch]
                sizes = np.array([len(texts[k]) for k in some])
                data = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
                blocks, first = blocked(data, np.concatenate(([0], np.cumsum(sizes))), cfg.stride)
                step += 1
                for k, g in self.gradients(blocks, first, labels[some]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    fixed = np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7
                    self.weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / fixed


def learn(
    df: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text",
    cfg: NetConfig = NetConfig(),
) -> ByteNet | None:
    """A network taught by a bounded sample; None unless both classes are there.

    The texts of the sample, 2 * per_class * train_chars characters at most, come to the
    driver. Rows with a null id, label or text teach nothing. Of an id that repeats the
    least text teaches, once for each of its labels.
    """
    marked = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y")).where(
        "id IS NOT NULL AND y IN (0, 1)"
    )
    lowest = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    chosen = marked.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= cfg.per_class)
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= cfg.train_chars)
    )
    # At most 2 * per_class rows, so they go to the texts; of each one text comes back.
    taught = rows.join(F.broadcast(chosen.select("id", "y").distinct()), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = sorted(taught.collect(), key=lambda r: (r["id"], r["y"]))
    marks = np.array([r["y"] for r in sample], np.float32)
    if len(set(marks.tolist())) < 2:
        return None
    net = ByteNet(cfg)
    net.fit([r["text"].encode() for r in sample], marks)
    return net


def score(df: DataFrame, net: ByteNet | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with the score of every row: the chance that its label is 1.

    Null counts as empty; an empty text has the score of a text without bytes. Without a
    network every score is 0.5. Texts longer than a pass are read in overlapping parts.
    """
    if net is None:
        return df.select(*keep, F.lit(0.5).alias("score"))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for some in texts:
            yield pa.array(net.scores(some), pa.float64())
        give_back()

    # Texts go to Python, and only their scores come back.
    return df.select(*keep, scored(F.col(text)).alias("score"))
