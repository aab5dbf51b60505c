"""Streaming jobs over the given tables as arriving files, run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ColumnMap
from ..functions.render import render_roles
from ..session import scratch_path
from ..sources import collections
from ..streaming import jobs
from .chunk_sql import recursive_chunks
from .registry import query
from .tables import LOG, RAW, conversations, metric_log, raw, sql_strip, table


def _arriving(spark, df, label):
    """A table written as files, and those files as a stream."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return jobs.arriving(spark, path, df)


def _run(start, *args, **options):
    job = start(*args, **options)
    job.awaitTermination()


@query(f"""WITH RECURSIVE {recursive_chunks('documents', 'doc_id', 'text')}
SELECT doc_id::VARCHAR AS source, chunk_no::INTEGER AS chunk_no, content FROM cut""")
def stream_ingest(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select(
        F.col("text").alias("content"),
        F.create_map(F.lit("source"), F.col("doc_id").cast("string")).alias("metadata"),
    )
    root = scratch_path(spark, "store")
    _run(
        jobs.stream_ingest, _arriving(spark, docs, "arriving"), root, "documents",
        scratch_path(spark, "progress"),
    )
    return collections.open_collection(spark, root, "documents").select(
        "source", "chunk_no", "content"
    )


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY ALL""")
def stream_history(spark, d):
    out = scratch_path(spark, "history")
    _run(
        jobs.stream_history, _arriving(spark, conversations(spark, d), "arriving"), out,
        scratch_path(spark, "progress"),
    )
    rows = jobs.current_history(spark, out)
    return rows.select("conv_id", render_roles(F.col("messages")).alias("text"))


@query(f"""WITH {RAW} SELECT DISTINCT {sql_strip('instruction')} AS instruction,
  {sql_strip('output')} AS output FROM raw
WHERE length({sql_strip('instruction')}) BETWEEN 10 AND 10000
  AND length({sql_strip('output')}) BETWEEN 10 AND 10000""")
def stream_prep(spark, d):
    rows = raw(spark, d).drop("input")
    out = scratch_path(spark, "clean")
    _run(
        jobs.stream_prep, _arriving(spark, rows, "arriving"), out,
        scratch_path(spark, "progress"), ColumnMap(),
    )
    return jobs.clean_rows(spark, out, rows)


@query(f"""WITH {LOG} SELECT run_id, metric, strftime(ts, '%Y-%m-%d %H') AS hour,
  count(*) AS points, sum(value::DECIMAL(18, 4))::DOUBLE AS total FROM metric_log GROUP BY ALL""")
def stream_metrics(spark, d):
    out = scratch_path(spark, "windows")
    _run(
        jobs.stream_metrics, _arriving(spark, metric_log(spark, d), "arriving"), out,
        scratch_path(spark, "progress"),
    )
    return jobs.current_windows(spark, out).select(
        "run_id", "metric", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "points",
        F.col("total").cast("double").alias("total"),
    )
