"""Named vector collections: Parquet under ``root/collection=<name>/ingest=<id>``."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig, RetrievalConfig
from ..operators.chunk import chunk_recursive, with_chunk_id
from ..operators.embed import hash_embed
from ..operators.search import attach_sources, mmr, nearest
from . import vector_index
from .readers import load_documents

SCHEMA = (
    "chunk_id string, source string, chunk_no int, content string, "
    "metadata map<string,string>, embedding array<float>, ingest string"
)


def collection_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/collection={name}"


def open_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a collection; none where it does not exist yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(collection_path(root, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def add_chunks(
    chunks: DataFrame,
    root: str,
    name: str,
    mode: str = "append",
    ingest: str | None = None,
    embedder=hash_embed,
) -> int:
    """Embed chunks (chunk_id, source, chunk_no, content, metadata) and add them.

    ``append`` keeps copies of chunks added before; ``upsert`` adds new ids only. An
    ingest id names one addition: adding under it again replaces that addition, so a
    repeated attempt never doubles rows. Returns the rows written, counted on the way.
    """
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", "source", "chunk_no", "content", "metadata")
    ingest = ingest or uuid.uuid4().hex
    if mode == "upsert":
        held = open_collection(spark, root, name).where(F.col("ingest") != ingest)
        rows = rows.dropDuplicates(["chunk_id"]).join(held.select("chunk_id"), "chunk_id", "left_anti")
    elif mode != "append":
        raise ValueError(f"unknown mode {mode!r}")
    written = Observation()
    counted = embedder(rows, "content").observe(written, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").parquet(f"{collection_path(root, name)}/ingest={ingest}")
    return written.get["rows"]


def _text_chunks(df: DataFrame, source: Column, cfg: ChunkConfig) -> DataFrame:
    cut = chunk_recursive(
        df.select(source.alias("source"), "metadata", "content"), "content", cfg
    )
    return with_chunk_id(cut, "source")


def add_texts(
    texts: DataFrame, root: str, name: str, mode: str = "append", ingest: str | None = None
) -> DataFrame:
    """Add texts (content, optional metadata) as they are; returns their ids."""
    metadata = (
        F.col("metadata") if "metadata" in texts.columns
        else F.lit(None).cast("map<string,string>")
    )
    source = F.coalesce(F.try_element_at(metadata, F.lit("source")), F.lit("text"))
    rows = texts.select(
        source.alias("source"), F.lit(0).alias("chunk_no"), "content",
        metadata.alias("metadata"),
    )
    rows = with_chunk_id(rows, "source")
    add_chunks(rows, root, name, mode, ingest)
    return rows.select("chunk_id")


def ingest(
    spark: SparkSession,
    path: str,
    root: str,
    name: str,
    file_type: str = "txt",
    cfg: ChunkConfig = ChunkConfig(),
    mode: str = "append",
) -> int:
    """Load a file or directory, split, embed, add; returns the number of chunks."""
    return add_chunks(document_chunks(load_documents(spark, path, file_type), cfg), root, name, mode)


def document_chunks(documents: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of documents given as content and metadata; metadata is inherited."""
    place = F.concat_ws(
        "#", F.col("metadata")["source"], F.try_element_at("metadata", F.lit("row"))
    )
    return _text_chunks(documents, place, cfg)


def index_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/index={name}"


def index_collection(spark: SparkSession, root: str, name: str, cells: int = 16, k: int = 4) -> list[str]:
    """Bring the stored index of a collection up to date; returns the additions it took in.

    The first call trains the cells and measures how many of them a query has to ask, with the
    collection's own vectors as queries. Later calls place new additions in the cells there are.
    """
    path, store = index_path(root, name), open_collection(spark, root, name)
    there = vector_index.indexed_ingests(spark, path)
    new = [r["ingest"] for r in store.select("ingest").distinct().collect() if r["ingest"] not in there]
    if not new:
        return []
    rows = store.where(F.col("ingest").isin(new)).select("chunk_id", "embedding", "ingest")
    if there:
        vector_index.add_to_index(rows, path, item_id="chunk_id")
    else:
        vector_index.create_index(rows, path, item_id="chunk_id", cells=cells)
        asked = rows.dropDuplicates(["chunk_id"]).withColumnRenamed("chunk_id", "query_id")
        vector_index.calibrate(asked, path, k, query_id="query_id", item_id="chunk_id", metric="unit_l2")
    return sorted(new)


def search(
    spark: SparkSession,
    root: str,
    name: str,
    questions: DataFrame,
    cfg: RetrievalConfig = RetrievalConfig(),
    embedder=hash_embed,
    indexed: bool = False,
) -> DataFrame:
    """Hits for questions (query_id, question): content, metadata and score by rank.

    A chunk that was added several times is one hit. ``indexed`` asks the stored index
    (``index_collection``) instead of all vectors, and may miss some.
    """
    store = open_collection(spark, root, name)
    queries = embedder(questions, "question")
    vectors = store.select("chunk_id", "embedding")
    if cfg.search_type == "mmr":
        hits = mmr(
            queries, vectors, cfg, query_id="query_id", item_id="chunk_id", unique_items=False
        )
    elif cfg.search_type == "similarity" and indexed:
        hits = vector_index.search_index(
            queries, index_path(root, name), cfg.k, query_id="query_id", item_id="chunk_id",
            metric="unit_l2", max_distance=cfg.max_distance,
        )
    elif cfg.search_type == "similarity":
        hits = nearest(
            queries, vectors, cfg.k, query_id="query_id", item_id="chunk_id",
            metric="unit_l2", max_distance=cfg.max_distance, unique_items=False,
        )
    else:
        raise ValueError(f"unknown search type {cfg.search_type!r}")
    found = store.select("chunk_id", "content", "metadata")
    return attach_sources(hits, found, "chunk_id", questions.count() * cfg.k, False)


def clear_collection(spark: SparkSession, root: str, name: str) -> None:
    """Drop the rows of one collection; others stay."""
    empty = spark.createDataFrame([], SCHEMA).write.partitionBy("ingest").mode("overwrite")
    empty.option("partitionOverwriteMode", "static").parquet(collection_path(root, name))
