"""Sources and sinks: given tables are written to the scratch folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DatasetConfig, ReadConfig, RetrievalConfig
from ..operators.split import split
from ..sources import collections, readers, writers
from ..session import scratch_path
from .chunk_sql import recursive_chunks
from .registry import query
from .tables import INSTR, HITS, chunk_vectors, chunks, instructions, questions, table, DIM
from ..operators.embed import hash_embed


def _write_csv(df, label, **options):
    path = scratch_path(df.sparkSession, label)
    df.write.options(**{"header": True, "quote": '"', "escape": '"', **options}).csv(path)
    return path


def _documents(spark, d):
    """Texts with quotes, separators and line breaks."""
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    quoted = F.concat(F.lit('"'), "lang", F.lit('",\t'), "text")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", quoted.alias("text"))


_DOCUMENTS = """SELECT doc_id::VARCHAR AS doc_id, lang, '"' || lang || '",' || chr(9) || text AS text
FROM documents"""


@query(_DOCUMENTS)
def read_csv_table(spark, d):
    return readers.read_table(spark, _write_csv(_documents(spark, d), "csv"))


@query(_DOCUMENTS)
def read_tsv_table(spark, d):
    path = _write_csv(_documents(spark, d), "tsv", sep="\t")
    return readers.read_table(spark, path, ReadConfig(fmt="tsv"))


@query(_DOCUMENTS)
def read_headerless_table(spark, d):
    path = _write_csv(_documents(spark, d), "headerless", header=False)
    return readers.read_table(spark, path, ReadConfig(header=False, names=("doc_id", "lang", "text")))


@query(_DOCUMENTS)
def read_encoded_table(spark, d):
    path = _write_csv(_documents(spark, d), "encoded", encoding="UTF-16")
    return readers.read_table(spark, path, ReadConfig(encoding="UTF-16"))


@query(_DOCUMENTS)
def read_jsonl_table(spark, d):
    path = scratch_path(spark, "jsonl")
    _documents(spark, d).write.json(path)
    return readers.read_table(spark, path, ReadConfig(fmt="jsonl")).select("doc_id", "lang", "text")


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def missing_values(spark, d):
    """A text that stands for a missing value is read as one."""
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    marked = F.when(F.col("o_orderstatus") == "F", F.lit("NA")).otherwise(F.col("o_orderstatus"))
    path = _write_csv(orders.withColumn("o_orderstatus", marked), "missing")
    return readers.read_table(spark, path, ReadConfig(na_values=readers.NA_VALUES, multiline=False))


def _page_files(spark, d):
    """One text file per page, named by its id; the writer ends it with a line break."""
    path = scratch_path(spark, "pages")
    writers.write_texts(table(spark, d, "pages", "page_id", "html"), path, "page_id", "html")
    return path


@query("SELECT page_id::VARCHAR AS page_id, html || chr(10) AS content FROM pages")
def read_text_docs(spark, d):
    docs = readers.load_documents(spark, _page_files(spark, d), "txt")
    page = F.regexp_extract(F.col("metadata")["source"], "page_id=([0-9]+)", 1)
    return docs.select(page.alias("page_id"), "content")


@query("""SELECT 'o_orderkey: ' || o_orderkey || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10)
  || 'o_orderpriority: ' || o_orderpriority AS content, o_orderstatus AS status,
  (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::VARCHAR AS row FROM orders""")
def read_csv_docs(spark, d):
    """Each row with its file, named by what the file holds, and its place in the file."""
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    # One file per status, sorted, so that a row's place in its file is known.
    files = orders.withColumn("status", F.col("o_orderstatus")).repartition("status").sortWithinPartitions("status", "o_orderkey")
    path = scratch_path(spark, "csvdocs")
    files.write.partitionBy("status").options(header=True, quote='"', escape='"').csv(path)
    docs = readers.load_documents(spark, path, "csv")
    status = F.regexp_extract(F.col("metadata")["source"], "status=([A-Z])/", 1)
    return docs.select("content", status.alias("status"), F.col("metadata")["row"].alias("row"))


@query("SELECT page_id::VARCHAR AS page_id, octet_length(encode(html))::BIGINT + 1 AS length FROM pages")
def attach_images(spark, d):
    """Page files stand in for image files; they are joined by path and not decoded."""
    images = readers.read_images(spark, _page_files(spark, d))
    name = F.regexp_extract("path", "page_id=([0-9]+)", 1)
    images = images.select(F.concat(F.lit("p/"), name).alias("path"), "length")
    refs = table(spark, d, "pages", "page_id").select(
        F.col("page_id").cast("string").alias("page_id"),
        F.array(F.concat(F.lit("p/"), F.col("page_id").cast("string"))).alias("images"),
    )
    return readers.attach_images(refs, images).select("page_id", "length")


@query(f"""WITH {INSTR}, kept AS (
  SELECT DISTINCT instruction, input, output FROM instr
  WHERE length(instruction) BETWEEN 10 AND 10000 AND length(output) BETWEEN 10 AND 10000),
named AS (SELECT *, sha256(to_json([instruction, coalesce(input, chr(0)), output])::VARCHAR) AS row_id FROM kept),
ordered AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id)) AS pos, count(*) OVER () AS n FROM named),
sized AS (SELECT *, floor(0.8::DOUBLE * n)::BIGINT AS a FROM ordered)
SELECT instruction, input, output, CASE WHEN pos <= a THEN 'train'
  WHEN pos <= a + floor((n - a) * 0.5::DOUBLE)::BIGINT THEN 'validation' ELSE 'test' END AS split FROM sized""")
def load_dataset(spark, d):
    path = _write_csv(instructions(spark, d).select("instruction", "input", "output"), "dataset")
    return readers.load_dataset(spark, DatasetConfig(train_file=path))


@query("""WITH ordered AS (
  SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS pos, count(*) OVER () AS n
  FROM documents),
sized AS (SELECT *, floor(0.8::DOUBLE * n)::BIGINT AS a FROM ordered)
SELECT doc_id, lang, CASE WHEN pos <= a THEN 'train'
  WHEN pos <= a + floor((n - a) * 0.5::DOUBLE)::BIGINT THEN 'validation' ELSE 'test' END AS split FROM sized""")
def write_dataset(spark, d):
    """Written by split; each split read back from its folder alone."""
    path = scratch_path(spark, "splits")
    writers.write_dataset(split(table(spark, d, "documents", "doc_id", "lang"), ["doc_id"]), path)
    written = spark.read.parquet(path)
    parts = (written.where(F.col("split") == name) for name in ("train", "validation", "test"))
    return reduce(DataFrame.unionByName, parts)


def _texts(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select(
        F.col("text").alias("content"),
        F.create_map(F.lit("source"), F.concat(F.lit("doc-"), "doc_id")).alias("metadata"),
    )


@query("""SELECT sha256('doc-' || doc_id || chr(10) || '0' || chr(10) || text) AS chunk_id,
  'doc-' || doc_id AS source, text AS content, 2::BIGINT AS appended, 1::BIGINT AS upserted FROM documents""")
def add_texts(spark, d):
    """Texts added twice: copies are kept by append and left out by upsert."""
    root = scratch_path(spark, "store")
    texts = _texts(spark, d)
    for mode in ("append", "upsert"):
        for _ in range(2):
            collections.add_texts(texts, root, mode, mode)

    def counted(name):
        rows = collections.open_collection(spark, root, name)
        return rows.groupBy("chunk_id", "source", "content").agg(F.count(F.lit(1)).alias(name))

    append = counted("append").withColumnRenamed("append", "appended")
    upsert = counted("upsert").withColumnRenamed("upsert", "upserted")
    return append.join(upsert, ["chunk_id", "source", "content"])


@query("""SELECT 'cleared' AS collection, 0::BIGINT AS rows UNION ALL
SELECT 'kept', count(*) FROM documents UNION ALL SELECT 'added_again', count(*) FROM documents""")
def clear_collection(spark, d):
    root = scratch_path(spark, "store")
    for name in ("cleared", "kept", "added_again"):
        collections.add_texts(_texts(spark, d), root, name)
    collections.clear_collection(spark, root, "cleared")
    collections.clear_collection(spark, root, "added_again")
    collections.add_texts(_texts(spark, d), root, "added_again")

    def counted(name):
        rows = collections.open_collection(spark, root, name)
        return rows.agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("rows"))

    return counted("cleared").union(counted("kept")).union(counted("added_again"))


@query(f"""WITH RECURSIVE page AS (SELECT page_id, html || chr(10) AS body FROM pages),
{recursive_chunks('page', 'page_id', 'body')}
SELECT page_id::VARCHAR AS page_id, chunk_no::INTEGER AS chunk_no, content FROM cut""")
def ingest_documents(spark, d):
    """Page files loaded, cut, embedded and stored; one row per stored chunk."""
    root = scratch_path(spark, "store")
    collections.ingest(spark, _page_files(spark, d), root, "pages")
    stored = collections.open_collection(spark, root, "pages")
    page = F.regexp_extract("source", "page_id=([0-9]+)", 1)
    return stored.select(page.alias("page_id"), "chunk_no", "content")


@query(f"""WITH {HITS} SELECT query_id, rank, round(score, 6) AS score, content, lang
FROM hits JOIN chunks USING (chunk_id)""")
def search_collection(spark, d):
    """The stored form of similarity search."""
    root = scratch_path(spark, "store")
    rows = chunks(spark, d).select(
        "chunk_id", F.col("doc_id").cast("string").alias("source"), "chunk_no", "content",
        F.create_map(F.lit("lang"), "lang").alias("metadata"),
    )
    embedder = lambda df, column: hash_embed(df, column, DIM)
    collections.add_chunks(rows, root, "documents", embedder=embedder)
    hits = collections.search(
        spark, root, "documents", questions(spark, d), RetrievalConfig(), embedder
    )
    return hits.select(
        "query_id", "rank", F.round("score", 6).alias("score"), "content",
        F.col("metadata")["lang"].alias("lang"),
    )
