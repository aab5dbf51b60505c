"""The given tables and the working tables derived from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions import text
from ..functions.text import WHITESPACE
from ..operators.chunk import chunk_fixed, with_chunk_id
from ..operators.embed import hash_embed
from ..operators.joins import lookup_join
from ..operators.ranking import with_position
from ..operators.tokens import vocabulary
from ..operators.traces import fold_context, next_turn_pairs
from ..session import scratch_path, spread

DIM = 256
VOCAB = 5000
ROLES = ["system", "user", "assistant"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table; naming the columns keeps the scan to them.

    Long texts are spread over the cores before the text work, where the file has
    fewer splits than that.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if name in ("documents", "pages") and {"text", "html"} & set(df.columns) else df


def raw(spark, d) -> DataFrame:
    """Documents as instruction rows, without an id so that copies are equal rows."""
    return table(spark, d, "documents", "lang", "text").select(
        F.concat(F.lit("Write a text in "), "lang").alias("instruction"),
        F.lit(None).cast("string").alias("input"),
        F.col("text").alias("output"),
    )


def conversations(spark, d) -> DataFrame:
    return table(spark, d, "conversations")


def instructions(spark, d) -> DataFrame:
    """User turns with the assistant turn that follows and the conversation's system text."""
    turns = conversations(spark, d)
    systems = turns.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("input")
    )
    pairs = next_turn_pairs(turns, "conv_id")
    return lookup_join(pairs, systems, "conv_id").select(
        "conv_id", "turn", "instruction", "input", "output"
    )


def preferences(spark, d, complete: bool = False) -> DataFrame:
    """The n-th good text of a source and language beside its n-th bad one, under the request for such a text.

    Where there are more of one kind, the other text is null and the row goes by the one there is;
    ``complete`` leaves such rows out, by their ids.
    """
    docs = table(spark, d, "documents", "doc_id", "source", "lang")
    rated = docs.join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    placed = with_position(rated, "n", "doc_id", by=["source", "lang", "quality"])
    # Two rows per place at most: a good one and a bad one.
    pairs = placed.groupBy("source", "lang", "n").agg(
        F.max(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("doc_id"),
        F.max(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("bad_id"),
    )
    # The texts come last, so that ids alone are ranked and paired.
    texts = table(spark, d, "documents", "doc_id", "text")
    chosen = texts.withColumnRenamed("text", "chosen")
    rejected = texts.select(F.col("doc_id").alias("bad_id"), F.col("text").alias("rejected"))
    asked = F.concat(F.lit("Write a text in "), "lang", F.lit(" as found in "), "source", F.lit("."))
    how = "inner" if complete else "left"
    return pairs.join(chosen, "doc_id", how).join(rejected, "bad_id", how).select(
        F.coalesce("doc_id", "bad_id").alias("doc_id"), asked.alias("prompt"), "chosen", "rejected"
    )


def chunks(spark, d, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Cleaned documents in character windows with ids."""
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    cut = chunk_fixed(docs.withColumn("text", text.clean("text")), "text", cfg)
    return with_chunk_id(cut, "doc_id")


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def question_vectors(spark, d) -> DataFrame:
    return hash_embed(questions(spark, d), "question", DIM)


def chunk_vectors(spark, d) -> DataFrame:
    return hash_embed(chunks(spark, d).select("chunk_id", "content"), "content", DIM).drop("content")


def stored_chunks(spark, d) -> DataFrame:
    """The chunks with their vectors as a stored table: cut and hashed once, however often it is read."""
    rows = hash_embed(chunks(spark, d), "content", DIM)
    path = scratch_path(spark, "chunks")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding")


def label_centres(spark, d) -> DataFrame:
    """The mean vector of each label: as many queries as labels, over all vectors."""
    cells = table(spark, d, "embeddings", "label", "embedding").select(
        "label", F.posexplode("embedding").alias("pos", "x")
    )
    means = cells.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda c: c["m"]).alias("embedding"))


def metric_log(spark, d) -> DataFrame:
    """Events as a run log; event ids rise with time, so they serve as steps."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("metric"),
        F.col("event_id").alias("step"),
        "ts",
        "value",
    )


def run_list(spark, d) -> DataFrame:
    return metric_log(spark, d).groupBy("run_id").agg(
        F.concat(F.lit("run-"), F.col("run_id")).alias("run_name"),
        F.when(F.max((F.col("metric") == "error").cast("int")) == 1, "FAILED")
        .otherwise("FINISHED").alias("status"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("start_time"),
    )


def agent_states(spark, d) -> DataFrame:
    """Conversations as agent states: the roles are the agents."""
    turns = conversations(spark, d)
    task = turns.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("task"), F.count(F.lit(1)).alias("iteration")
    )
    return task.join(fold_context(turns, "conv_id", ROLES), "conv_id")


def word_ids(spark, d) -> DataFrame:
    return vocabulary(table(spark, d, "documents", "text"), "text", VOCAB)


def joined(c, sep: str = " "):
    """An array as one text, for flat results."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), sep)


# SQL twins of the tables above, to be put behind WITH.

_WS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
_CHARS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def sql_strip(e: str) -> str:
    return f"trim({e}, {_CHARS})"


def sql_clean(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{_WS}]+', ' ', 'g'))"


def sql_bucket(e: str, dim: int = DIM) -> str:
    return f"(('0x' || substr(md5({e}), 1, 7))::BIGINT % {dim})"


RAW = """raw AS (
  SELECT 'Write a text in ' || lang AS instruction, NULL::VARCHAR AS input, text AS output
  FROM documents)"""
INSTR = """systems AS (
  SELECT conv_id, arg_min(text, turn) AS input FROM conversations
  WHERE role = 'system' GROUP BY conv_id),
instr AS (
  SELECT u.conv_id, u.turn, u.text AS instruction, s.input, a.text AS output
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN systems s ON s.conv_id = u.conv_id
  WHERE u.role = 'user')"""
PREF = """rated AS (
  SELECT d.doc_id, source, lang, text, quality,
         row_number() OVER (PARTITION BY source, lang, quality ORDER BY d.doc_id) AS n
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
pref AS (
  SELECT coalesce(g.doc_id, b.doc_id) AS doc_id, g.text AS chosen, b.text AS rejected,
    'Write a text in ' || coalesce(g.lang, b.lang) || ' as found in ' || coalesce(g.source, b.source) || '.' AS prompt
  FROM (FROM rated WHERE quality = 1) g FULL JOIN (FROM rated WHERE quality = 0) b
    ON g.source = b.source AND g.lang = b.lang AND g.n = b.n)"""
CHUNKS = f"""cleaned AS (
  SELECT doc_id, lang, {sql_clean('text')} AS text FROM documents),
starts AS (
  SELECT doc_id, lang, text, unnest(range(0, greatest(length(text) - 201, 0) + 1, 800)) AS s
  FROM cleaned),
cut AS (
  SELECT doc_id, lang, s // 800 AS chunk_no, {sql_strip('substr(text, s + 1, 1000)')} AS content
  FROM starts),
chunks AS (
  SELECT *, sha256(concat_ws(chr(10), doc_id, chunk_no, content)) AS chunk_id
  FROM cut WHERE content <> '')"""
# Squared L2 distance of unit token-count vectors, four nearest chunks per question.
HITS = f"""{CHUNKS},
chunk_tokens AS (
  SELECT chunk_id, unnest(string_split({sql_clean('lower(content)')}, ' ')) AS token FROM chunks),
chunk_counts AS (
  SELECT chunk_id, {sql_bucket('token')} AS bucket, count(*)::DOUBLE AS c
  FROM chunk_tokens GROUP BY ALL),
question_tokens AS (
  SELECT item_id AS query_id, unnest(string_split({sql_clean('lower(text)')}, ' ')) AS token
  FROM benchmark),
question_counts AS (
  SELECT query_id, {sql_bucket('token')} AS bucket, count(*)::DOUBLE AS c
  FROM question_tokens GROUP BY ALL),
chunk_norms AS (SELECT chunk_id, sum(c * c) AS n FROM chunk_counts GROUP BY 1),
question_norms AS (SELECT query_id, sum(c * c) AS n FROM question_counts GROUP BY 1),
dots AS (
  SELECT query_id, chunk_id, sum(q.c * k.c) AS dot
  FROM question_counts q JOIN chunk_counts k ON q.bucket = k.bucket GROUP BY ALL),
scored AS (
  SELECT query_id, chunk_id, round(2 - 2 * (dot / sqrt(k.n * q.n)), 9) AS score
  FROM dots JOIN chunk_norms k USING (chunk_id) JOIN question_norms q USING (query_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank
  FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= 4)"""
CENTRES = """cells AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos
  FROM embeddings),
centres AS (
  SELECT label, list(m ORDER BY pos) AS centre
  FROM (SELECT label, pos, round(avg(x), 6) AS m FROM cells GROUP BY ALL) GROUP BY label)"""
LOG = """metric_log AS (
  SELECT user_id AS run_id, event_type AS metric, event_id AS step, ts, value FROM events)"""
RUNS = f"""{LOG},
run_list AS (
  SELECT run_id, 'run-' || run_id AS run_name,
         CASE WHEN bool_or(metric = 'error') THEN 'FAILED' ELSE 'FINISHED' END AS status,
         strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time
  FROM metric_log GROUP BY run_id)"""
STATES = """spoken AS (
  SELECT conv_id, role, min(turn) AS first, arg_max(text, turn) AS value
  FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY ALL),
tasks AS (
  SELECT conv_id, arg_min(text, turn) AS task, count(*) AS iteration
  FROM conversations GROUP BY conv_id)"""
VOCABULARY = f"""words AS (
  SELECT unnest(string_split({sql_clean('text')}, ' ')) AS token FROM documents),
vocab AS (
  SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS token_id
  FROM words WHERE token <> '' GROUP BY token
  QUALIFY row_number() OVER (ORDER BY count(*) DESC, token) <= {VOCAB})"""
