"""Positions, batches, samples and shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import preview as preview_of
from ..operators import collate, ranking
from .preparation import LINE_IDS, LINE_KEY
from .registry import query
from .tables import table


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  row_number() OVER (ORDER BY md5('42:' || {LINE_KEY})) AS pos FROM lineitem""")
def global_rank(spark, d):
    lines = table(spark, d, "lineitem", *LINE_IDS)
    return ranking.global_rank(lines, "pos", *LINE_IDS)


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos
FROM events""")
def group_position(spark, d):
    events = table(spark, d, "events", "event_id", "user_id")
    return ranking.with_position(events, "pos", "event_id", by=["user_id"])


# A number that is spread over 60 bits, as hashed ids are.
_SCATTERED = "('0x' || substr(md5(event_id::VARCHAR), 1, 15))::BIGINT"


@query(f"""SELECT event_id, row_number() OVER (ORDER BY {_SCATTERED}) AS pos,
  row_number() OVER (PARTITION BY user_id ORDER BY {_SCATTERED}) AS user_pos,
  (row_number() OVER (ORDER BY {_SCATTERED}) - 1) // 32 AS batch_id FROM events""")
def scattered_positions(spark, d):
    """Positions and ordered batches by hashed integer ids, over all rows and per user."""
    key = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 10).cast("long")
    events = table(spark, d, "events", "event_id", "user_id").withColumn("key", key)
    placed = ranking.with_position(events, "pos", "key")
    placed = ranking.with_position(placed, "user_pos", "key", by=["user_id"])
    return collate.assign_batches(placed, ["key"], 32, shuffle=False).drop("key", "user_id")


@query("SELECT o_orderkey, 1::BIGINT AS rows_of_id FROM orders")
def row_ids(spark, d):
    # Straight from the scan, whose order is fixed.
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return ranking.with_row_id(orders).groupBy("row_id").agg(
        F.min("o_orderkey").alias("o_orderkey"), F.count(F.lit(1)).alias("rows_of_id")
    ).drop("row_id")


@query("""SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS short,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS long
FROM documents""")
def preview(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select(
        "doc_id", preview_of("text", 50).alias("short"), preview_of("text", 200).alias("long")
    )


@query("SELECT doc_id, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def sample_head(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars")
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return ranking.sample_head(docs, order).select("doc_id", "lang")


@query("""SELECT event_id, event_type, row_number() OVER (ORDER BY md5('42:' || event_id)) AS place
FROM events""")
def shuffled(spark, d):
    events = table(spark, d, "events", "event_id", "event_type")
    return ranking.shuffled(events, "event_id", position="place")


@query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 3""")
def top_per_group(spark, d):
    events = table(spark, d, "events", "user_id", "event_type", "event_id", "value")
    order = [F.col("value").desc(), F.col("event_id")]
    return ranking.top_per_group(events, ["user_id", "event_type"], order, 3).drop("rank")
