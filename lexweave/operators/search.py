"""Nearest vectors for many queries at once.

The corpus is scanned where it lies. Each task scores its rows against a block of
queries as one matrix product and keeps k hits per query, so that k rows per task
and query reach the shuffle instead of every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import RetrievalConfig
from ..functions.vectors import cosine
from ..session import scratch_path
from .ranking import top_per_group

# Queries per pass: a block of 4,096 vectors of 1,024 doubles is 32 MB.
QUERY_BLOCK = 4096
SCORES_AT_ONCE = 4_000_000
NUMBERS_AT_ONCE = 1_000_000
# Passes that one plan unites; more are run one after the other.
PASSES = 16
# Hits that may be broadcast: at about 100 bytes each, 100 MB.
BROADCAST_ROWS = 1_000_000
DECIMALS = 9


def _matrix(vectors: pa.Array) -> np.ndarray:
    if vectors.null_count:
        raise ValueError("a vector is missing")
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError("vectors differ in length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Rounded, so that equal distances tie whatever the order of summation."""
    products = rows @ queries.T
    row_sq = np.einsum("ij,ij->i", rows, rows)[:, None]
    query_sq = np.einsum("ij,ij->i", queries, queries)[None, :]
    if metric == "l2":
        found = np.maximum(row_sq + query_sq - 2 * products, 0.0)
    else:
        norms = np.sqrt(row_sq * query_sq)
        cos = np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)
        # unit_l2 is the squared L2 distance of the two vectors scaled to length 1.
        found = 1 - cos if metric == "cosine" else 2 - 2 * cos
    return np.round(found, DECIMALS)


def _probed(
    rows: np.ndarray, cells: np.ndarray, queries: np.ndarray, probes: np.ndarray, metric: str
) -> np.ndarray:
    """Distances of each cell's rows to the queries that ask for it; the others stay infinite."""
    scores = np.full((len(rows), len(queries)), np.inf)
    for cell in np.unique(cells):
        mine, asked = np.flatnonzero(cells == cell), np.flatnonzero(probes[:, cell])
        if len(asked):
            scores[np.ix_(mine, asked)] = _distances(rows[mine], queries[asked], metric)
    return scores


def _trim(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.sort_values(["q", "score", "item"]).drop_duplicates(["q", "item"])
    return ordered.groupby("q", sort=False).head(k)


def _best_hits(
    batches: Iterator[pa.RecordBatch],
    queries: np.ndarray,
    k: int,
    metric: str,
    max_distance: float | None,
    probes: np.ndarray | None = None,
) -> pd.DataFrame:
    """The k best items per query of one task. Columns: item, vector and, with probes, cell."""
    best = pd.DataFrame({"q": np.zeros(0, int), "score": np.zeros(0), "item": []})
    bound = np.full(len(queries), np.inf if max_distance is None else max_distance)
    # As many rows as keep both their scores and their vectors small.
    step = max(1, min(SCORES_AT_ONCE // max(len(queries), 1), NUMBERS_AT_ONCE // max(queries.shape[-1], 1)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            rows = batch.slice(start, step)
            # Copies of an item would crowd others out of the k.
            items = rows.column(0).to_pandas()
            if items.duplicated().any():
                kept = ~items.duplicated().to_numpy()
                rows, items = rows.filter(pa.array(kept)), items[kept]
            items = items.to_numpy()
            if probes is None:
                scores = _distances(_matrix(rows.column(1)), queries, metric)
            else:
                scores = _probed(_matrix(rows.column(1)), rows.column(2).to_numpy(), queries, probes, metric)
            kth = np.partition(scores, min(k, len(scores)) - 1, axis=0)[min(k, len(scores)) - 1]
            row, query = np.nonzero((scores <= np.minimum(bound, kth)) & np.isfinite(scores))
            if not len(row):
                continue
            new = pd.DataFrame({"q": query, "score": scores[row, query], "item": items[row]})
            best = _trim(new if best.empty else pd.concat([best, new]), k)
            full = best.groupby("q")["score"].agg(["size", "max"])
            full = full[full["size"] >= k]
            bound[full.index] = full["max"]
    return best


def _block(
    rows: pa.Table, queries: DataFrame, corpus: DataFrame, k: int, names: tuple[str, str, str],
    metric: str, max_distance: float | None, probe,
) -> DataFrame:
    """Hits of one query block, k per task and query."""
    query_id, item_id, vector = names
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField(item_id, corpus.schema[item_id].dataType),
        ]
    )
    if not len(rows):
        return corpus.sparkSession.createDataFrame([], schema)
    ids = rows.column(0).combine_chunks()
    matrix = _matrix(rows.column(1).combine_chunks())
    item_type = to_arrow_type(corpus.schema[item_id].dataType)
    probes = probe(matrix) if probe else None
    columns = [item_id, vector] + (["cell"] if probe else [])
    if probe:
        wanted = np.flatnonzero(probes.any(axis=0)).tolist()
        # On a table written by cell these are partition filters.
        corpus = corpus.where(F.col("cell").isin(wanted))
    shipped = corpus.sparkSession.sparkContext.broadcast((ids, matrix, probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, probes = shipped.value
        hits = _best_hits(batches, matrix, k, metric, max_distance, probes)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(hits["q"].to_numpy(dtype=np.int64))),
                pa.array(hits["score"].to_numpy(dtype=np.float64)),
                pa.array(hits["item"].tolist(), type=item_type),
            ],
            names=[query_id, "score", item_id],
        )

    return corpus.select(*columns).mapInArrow(run, schema)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    *,
    query_id: str,
    item_id: str,
    vector: str = "embedding",
    metric: str = "l2",
    max_distance: float | None = None,
    block: int = QUERY_BLOCK,
    unique_items: bool = True,
    probe=None,
) -> DataFrame:
    """``query_id, rank, score, item_id``: the k nearest items, nearest first, ties by id.

    A query set over ``block`` rows is worked off in blocks of about that size, one
    corpus scan each, so what is shipped to the executors stays bounded. Beyond
    ``PASSES`` blocks the hits of each pass go to a table in the shared folder.
    With ``unique_items=False`` rows of the same id are copies, and count as one item.
    """
    if metric not in ("l2", "cosine", "unit_l2"):
        raise ValueError(f"unknown metric {metric!r}")
    asked = queries.select(query_id, vector)
    names = (query_id, item_id, vector)

    def passed(rows: pa.Table) -> DataFrame:
        return _block(rows, queries, corpus, k, names, metric, max_distance, probe)

    first = asked.limit(block + 1).toArrow()
    if len(first) <= block:
        hits = passed(first)
    else:
        blocks = math.ceil(asked.count() / block)
        number = F.pmod(F.xxhash64(query_id), F.lit(blocks))
        parts = (passed(asked.where(number == b).toArrow()) for b in range(blocks))
        if blocks <= PASSES:
            hits = reduce(DataFrame.unionAll, parts)
        else:
            path = scratch_path(corpus.sparkSession, "hits")
            for part in parts:
                part.write.mode("append").parquet(path)
            hits = corpus.sparkSession.read.parquet(path)
    if not unique_items:
        hits = hits.groupBy(query_id, item_id).agg(F.min("score").alias("score"))
    ranked = top_per_group(hits, [query_id], [F.col("score"), F.col(item_id)], k)
    return ranked.select(query_id, "rank", "score", item_id)


def attach_sources(
    hits: DataFrame, chunks: DataFrame, item_id: str, most: int | None = None,
    unique_items: bool = True,
) -> DataFrame:
    """Join the hits back to content and metadata.

    ``most`` is a bound on the hits (queries times k). Few hits are broadcast, so that
    the chunks are not shuffled; without a bound Spark decides. Of copies of a chunk one
    is taken, and copies collapse in each task before the shuffle.
    """
    few = most is not None and most <= BROADCAST_ROWS
    joined = chunks.join(F.broadcast(hits) if few else hits, item_id)
    if unique_items:
        return joined
    values = [c for c in chunks.columns if c != item_id]
    one = F.first(F.struct(*values)).alias("__chunk")
    return joined.groupBy(*hits.columns).agg(one).select(*hits.columns, "__chunk.*")


def _mmr_picks(found: Column, k: int, weight: float) -> Column:
    """Ranks of the greedy relevance-versus-novelty picks among an array of candidates."""

    def likeness_to(place: Column) -> Column:
        chosen = F.element_at(found, place)
        return F.transform(found, lambda c: cosine(c["vector"], chosen["vector"]))

    def step(state: Column, _: Column) -> Column:
        left = F.filter(
            F.sequence(F.lit(1), F.size(found)), lambda i: ~F.array_contains(state["picked"], i)
        )

        def gain(i: Column) -> Column:
            near = F.element_at(state["near"], i)
            value = weight * F.element_at(found, i)["likeness"] - (1 - weight) * near
            return F.struct(F.round(value, DECIMALS).alias("gain"), (-i).alias("place"))

        place = -F.array_max(F.transform(left, gain))["place"]
        return F.when(F.size(left) == 0, state).otherwise(
            F.struct(
                F.concat(state["picked"], F.array(place)).alias("picked"),
                F.zip_with(state["near"], likeness_to(place), lambda a, b: F.greatest(a, b)).alias("near"),
            )
        )

    first = F.struct(
        F.array(F.lit(1)).alias("picked"), likeness_to(F.lit(1)).alias("near")
    )
    rounds = F.sequence(F.lit(2), F.lit(k)) if k > 1 else F.array().cast("array<int>")
    return F.aggregate(rounds, first, step, lambda s: s["picked"])


def mmr(
    queries: DataFrame,
    corpus: DataFrame,
    cfg: RetrievalConfig = RetrievalConfig(),
    *,
    query_id: str,
    item_id: str,
    vector: str = "embedding",
    unique_items: bool = True,
) -> DataFrame:
    """The fetch_k most similar items, re-ranked for diversity within one row per query."""
    fetched = nearest(
        queries, corpus, cfg.fetch_k, query_id=query_id, item_id=item_id, vector=vector,
        metric="cosine", max_distance=cfg.max_distance, unique_items=unique_items,
    )
    vectors = corpus.select(item_id, F.col(vector).alias("vector"))
    most = queries.count() * cfg.fetch_k
    candidate = F.struct(
        "rank", (1 - F.col("score")).alias("likeness"), F.col(item_id).alias("item"), "vector"
    )
    rows = attach_sources(fetched, vectors, item_id, most, unique_items).groupBy(query_id)
    found = rows.agg(F.array_sort(F.collect_list(candidate)).alias("found"))
    picked = found.select(
        query_id, "found", F.posexplode(_mmr_picks(F.col("found"), cfg.k, cfg.lambda_mult))
    )
    hit = F.element_at("found", F.col("col"))
    return picked.select(
        query_id,
        (F.col("pos") + 1).alias("rank"),
        F.round(1 - hit["likeness"], DECIMALS).alias("score"),
        hit["item"].alias(item_id),
    )


def train_cells(
    corpus: DataFrame, vector: str = "embedding", cells: int = 16, seed: int = 42
) -> np.ndarray:
    """Centres of an inverted-file index, from k-means on the whole corpus."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = corpus.select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(points)
    return np.array(model.clusterCenters())


def assign_cells(corpus: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Add ``cell``, the nearest centre; write the table partitioned by it."""
    schema = T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType())])
    at = corpus.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                near = _distances(_matrix(rows.column(at)), centres, "l2").argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(near.astype(np.int32))],
                    names=[*rows.schema.names, "cell"],
                )

    return corpus.mapInArrow(run, schema)


def nearest_in_cells(
    queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int = 4, nprobe: int = 4, **names
) -> DataFrame:
    """Approximate search: each query is scored against its ``nprobe`` nearest cells only.

    The filter on ``cell`` prunes partitions of a table written by cell. A cell of any
    size is scored split by split, like the whole corpus in ``nearest``.
    """

    def probe(matrix: np.ndarray) -> np.ndarray:
        order = _distances(matrix, centres, "l2").argsort(axis=1, kind="stable")[:, :nprobe]
        wanted = np.zeros((len(matrix), len(centres)), dtype=bool)
        np.put_along_axis(wanted, order, True, axis=1)
        return wanted

    return nearest(queries, indexed, k, probe=probe, **names)
