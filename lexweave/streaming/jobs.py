"""Structured Streaming versions of ingest, history, cleaning and metric logging.

Each job works off what has arrived and stops (``availableNow``); progress is kept
in its checkpoint folder, so a restarted job goes on where it ended. A micro-batch writes
what it adds to a folder of its own, named by the stream and its number, and what all
streams have added is merged when it is read. So a repeated micro-batch replaces itself,
streams with one target add up, and no job keeps state that grows with its stream.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkConfig, ColumnMap, PrepConfig
from ..operators.prep import filter_length, lowercase_text, strip_text
from ..operators.traces import PART, join_parts
from ..sources.collections import add_chunks, document_chunks


def arriving(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """New files below a path, with the schema of a batch table."""
    return spark.readStream.schema(like.schema).format(fmt).load(path)


def _start(stream: DataFrame, checkpoint: str, write) -> StreamingQuery:
    """Call ``write(batch, stream id, number)`` for each micro-batch.

    The id is the one that Spark keeps in the checkpoint folder: a restarted stream has
    it again, and a fresh checkpoint has another, also at the same path.
    """

    def each(batch: DataFrame, number: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write(batch, stream_id, number)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )


def _add(rows: DataFrame, out: str, stream_id: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/stream={stream_id}/batch={number}")


def stream_ingest(
    documents: DataFrame,
    root: str,
    name: str,
    checkpoint: str,
    cfg: ChunkConfig = ChunkConfig(),
    mode: str = "append",
) -> StreamingQuery:
    """Chunk, embed and add arriving documents (content, metadata).

    The stream and the micro-batch number make the ingest id, so a repeated micro-batch
    replaces itself and no other stream's rows.
    """

    def write(batch: DataFrame, stream_id: str, number: int) -> None:
        add_chunks(document_chunks(batch, cfg), root, name, mode, f"batch-{stream_id}-{number}")

    return _start(documents, checkpoint, write)


def stream_prep(
    rows: DataFrame,
    out: str,
    checkpoint: str,
    columns: ColumnMap,
    cfg: PrepConfig = PrepConfig(),
    event_time: str | None = None,
    lateness: str = "1 day",
) -> StreamingQuery:
    """Clean arriving rows; ``clean_rows`` reads them.

    Copies of earlier rows are dropped. The hashes of the rows written so far are a table beside
    them, which each micro-batch is compared with, so nothing has to be remembered by the stream.
    With an event time only copies within ``lateness`` are dropped, and Spark keeps their hashes
    that long.
    """
    if cfg.strip:
        rows = strip_text(rows, cfg.stringify_nulls)
    if cfg.lowercase:
        rows = lowercase_text(rows, cfg.stringify_nulls)
    rows = filter_length(rows, columns, cfg)
    if cfg.drop_duplicates and event_time:
        content = [c for c in rows.columns if c != event_time]
        rows = rows.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(content)

    def write(batch: DataFrame, stream_id: str, number: int) -> None:
        if cfg.drop_duplicates and not event_time:
            batch = _unseen(batch, out, stream_id, number)
        _add(batch, out, stream_id, number)

    return _start(rows, checkpoint, write)


SEEN = "h binary, stream string, batch long, bucket string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table below ``out``; without rows where nothing is written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _unseen(batch: DataFrame, out: str, stream_id: str, number: int) -> DataFrame:
    """The different rows of a micro-batch that no other one has written.

    The table of hashes lies in buckets by their first byte. It is not shuffled where the
    micro-batch is small enough to be broadcast to it, and is read only where the
    micro-batch has hashes. It names the rows that were written, so a repeated micro-batch
    writes its own again. Hashes have 128 bits.
    """
    spark, path = batch.sparkSession, f"{out.rstrip('/')}/_seen"
    own = f"{path}/stream={stream_id}/batch={number}"
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in batch.columns)), {"ignoreNullFields": "false"})
    marked = batch.dropDuplicates().withColumn("__h", F.unhex(F.md5(whole)))
    asked = marked.select(F.col("__h").alias("h"), F.hex(F.substring("__h", 1, 1)).alias("bucket"))
    others = (F.col("stream") != stream_id) | (F.col("batch") != number)
    known = _table(spark, path, SEEN).where(others).join(asked, ["bucket", "h"], "left_semi").select("h").distinct()
    asked.join(known, "h", "left_anti").select("h", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)
    fresh = spark.read.schema("h binary, bucket string").parquet(own).select(F.col("h").alias("__h"))
    return marked.join(fresh, "__h", "left_semi").drop("__h")


def clean_rows(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """All rows that cleaning streams have written to ``out``."""
    return spark.read.schema(like.schema).option("recursiveFileLookup", True).parquet(out)


def stream_history(
    messages: DataFrame, out: str, checkpoint: str, run: str = "conv_id", part: int = PART
) -> StreamingQuery:
    """Messages (run, turn, role, text) as they arrive; ``current_history`` gives the conversations.

    A micro-batch adds one row per conversation and range of ``part`` turns.
    """
    entry = F.struct("turn", "role", F.col("text").alias("content"))

    def write(batch: DataFrame, stream_id: str, number: int) -> None:
        listed = batch.groupBy(run, F.floor(F.col("turn") / part).alias("part")).agg(
            F.collect_list(entry).alias("messages")
        )
        _add(listed, out, stream_id, number)

    return _start(messages, checkpoint, write)


def current_history(spark: SparkSession, out: str, run: str = "conv_id") -> DataFrame:
    """The whole message list of each conversation, from what all streams have added, by turn."""
    ordered = F.array_sort(F.flatten(F.collect_list("messages")))
    parts = spark.read.parquet(out).groupBy(run, "part").agg(ordered.alias("listed"))
    message = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    return join_parts(parts.select(run, "part", F.transform("listed", message).alias("messages")), run)


def clear_history(spark: SparkSession, out: str) -> None:
    """Forget all turns so far; what the streams add later starts new conversations."""
    try:
        like = spark.read.parquet(out).schema
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    empty = spark.createDataFrame([], like)
    empty.write.partitionBy("stream", "batch").mode("overwrite").option("partitionOverwriteMode", "static").parquet(out)
    _add(empty.drop("stream", "batch"), out, "none", 0)  # keeps the columns known


def metric_windows(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Count and sum of each run's metric per tumbling window."""
    return log.groupBy("run_id", "metric", F.window("ts", window).alias("w")).agg(
        F.count("value").alias("points"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")
    ).select("run_id", "metric", F.col("w.start").alias("window_start"), "points", "total")


def stream_metrics(log: DataFrame, out: str, checkpoint: str, window: str = "1 hour") -> StreamingQuery:
    """Counts and sums of metric windows as points arrive, late ones too; ``current_windows`` adds them up."""

    def write(batch: DataFrame, stream_id: str, number: int) -> None:
        _add(metric_windows(batch.withColumn("ts", F.col("ts").cast("timestamp")), window), out, stream_id, number)

    return _start(log, checkpoint, write)


def current_windows(spark: SparkSession, out: str) -> DataFrame:
    """The metric windows over all points that any stream has seen."""
    return spark.read.parquet(out).groupBy("run_id", "metric", "window_start").agg(
        F.sum("points").alias("points"), F.sum("total").cast("decimal(28,4)").alias("total")
    )
