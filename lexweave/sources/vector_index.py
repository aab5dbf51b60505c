"""A stored inverted-file index: vectors by cell, with the centres and the probes they need.

``<path>/centres`` has the cells' centres, trained once; ``<path>/rows/ingest=<id>/cell=<n>``
the vectors, so that a search reads the folders of the cells it asks and an addition adds a
folder; ``<path>/probes`` how many cells a query asks, as measured.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import assign_cells, nearest, nearest_in_cells, train_cells

# Rows that centres are trained on, and queries that probes are measured with, at most. Every row is indexed.
TRAINING_ROWS = 200_000
CALIBRATION_QUERIES = 1000
RECALL = 0.95
INGEST = "ingest"


def _places(path: str) -> tuple[str, str, str]:
    path = path.rstrip("/")
    return f"{path}/centres", f"{path}/rows", f"{path}/probes"


def sampled(df: DataFrame, item_id: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id, so the same ones each time."""
    rows = df.count()
    return df if rows <= most else df.where(F.pmod(F.xxhash64(F.lit(7), item_id), F.lit(-(-rows // most))) == 0)


def create_index(
    corpus: DataFrame, path: str, *, item_id: str, vector: str = "embedding", cells: int = 16, seed: int = 42,
    ingest: str | None = None,
) -> None:
    """Train centres on a bounded sample of the corpus, store them, and index every row."""
    centres = train_cells(sampled(corpus.select(item_id, vector), item_id, TRAINING_ROWS), vector, cells, seed)
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark = corpus.sparkSession
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(_places(path)[0])
    add_to_index(corpus, path, item_id=item_id, vector=vector, ingest=ingest)


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(_places(path)[0]).orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def add_to_index(
    rows: DataFrame, path: str, *, item_id: str, vector: str = "embedding", ingest: str | None = None
) -> None:
    """Index more rows with the centres that are there.

    Adding under one ingest id again replaces it; rows may bring their ids in a column ``ingest``.
    """
    centres = centres_of(rows.sparkSession, path)
    if INGEST in rows.columns and ingest is None:
        placed = assign_cells(rows.select(item_id, vector, INGEST), centres, vector)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(INGEST, "cell").parquet(_places(path)[1])
        return
    placed = assign_cells(rows.select(item_id, vector), centres, vector)
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{_places(path)[1]}/{INGEST}={ingest or uuid.uuid4().hex}")


def indexed_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_places(path)[1]).withColumn(INGEST, F.col(INGEST).cast("string"))


def indexed_ingests(spark: SparkSession, path: str) -> list[str]:
    """The additions an index has; none where there is no index."""
    try:
        rows = indexed_rows(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r[INGEST] for r in rows.select(INGEST).distinct().collect()]


def recall_by_probes(queries: DataFrame, path: str, k: int = 4, *, query_id: str, item_id: str, **names) -> list[float]:
    """The share of the k truly nearest items that 1, 2, 3 ... probed cells contain.

    One exact search says it for every number: an item is found once its cell is asked.
    """
    spark = queries.sparkSession
    centres, rows = centres_of(spark, path), indexed_rows(spark, path)
    asked = queries.withColumnRenamed(query_id, "query_id")
    hits = nearest(asked, rows, k, query_id="query_id", item_id=item_id, unique_items=False, **names)
    cells = rows.select(item_id, "cell").dropDuplicates([item_id])
    near = nearest(
        asked, spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, embedding array<double>")
        .withColumnRenamed("embedding", names.get("vector", "embedding")),
        len(centres), query_id="query_id", item_id="cell", **names,
    ).select("query_id", "cell", F.col("rank").alias("probe"))
    at = hits.join(cells, item_id).join(near, ["query_id", "cell"]).groupBy("probe").count().collect()
    found = np.zeros(len(centres) + 1)
    for r in at:
        found[r["probe"]] = r["count"]
    return (np.cumsum(found)[1:] / max(found.sum(), 1)).tolist()


def calibrate(queries: DataFrame, path: str, k: int = 4, target: float = RECALL, *, query_id: str, **names) -> int:
    """Store and return the fewest probes whose recall over sampled queries reaches the target."""
    recall = recall_by_probes(sampled(queries, query_id, CALIBRATION_QUERIES), path, k, query_id=query_id, **names)
    probes = next((i + 1 for i, r in enumerate(recall) if r >= target), len(recall))
    row = [(probes, k, float(recall[probes - 1]))]
    queries.sparkSession.createDataFrame(row, "probes int, k int, recall double").coalesce(1) \
        .write.mode("overwrite").parquet(_places(path)[2])
    return probes


def probes_of(spark: SparkSession, path: str) -> int | None:
    """The calibrated number of probes, or None before calibration."""
    try:
        return spark.read.parquet(_places(path)[2]).first()["probes"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def search_index(queries: DataFrame, path: str, k: int = 4, nprobe: int | None = None, **names) -> DataFrame:
    """``query_id, rank, score, item_id`` from the cells that the queries ask, and no others.

    Without ``nprobe`` the calibrated number is used, and before calibration every cell,
    which makes the search exact. Items that were added twice are one hit.
    """
    spark = queries.sparkSession
    centres = centres_of(spark, path)
    nprobe = nprobe or probes_of(spark, path) or len(centres)
    return nearest_in_cells(queries, indexed_rows(spark, path), centres, k, nprobe, unique_items=False, **names)
