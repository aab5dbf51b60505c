"""Cleaning, formats and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ColumnMap, PrepConfig, SplitConfig
from ..functions import render, text
from ..operators import formats, prep
from ..operators.split import split, split_counts
from .registry import query
from .tables import (
    INSTR, PREF, RAW, instructions, joined, preferences, raw, sql_clean, sql_strip, table,
)

COLUMNS = ColumnMap()
PAIRS = ColumnMap.preference()
SYSTEM = "You are a careful assistant."


@query(f"""SELECT doc_id, lang, {sql_strip("chr(160) || chr(9) || text || chr(12288) || chr(10)")} AS text
FROM documents""")
def strip_text(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    padded = F.concat(F.lit("\xa0\t"), "text", F.lit("　\n"))
    return prep.strip_text(docs.withColumn("text", padded))


@query("SELECT doc_id, lower(lang) AS lang, lower(source) AS source, lower(text) AS text FROM documents")
def lowercase_text(spark, d):
    return prep.lowercase_text(table(spark, d, "documents", "doc_id", "lang", "source", "text"))


@query(f"SELECT page_id, {sql_clean('html')} AS html FROM pages")
def clean_text(spark, d):
    pages = table(spark, d, "pages", "page_id", "html")
    return pages.withColumn("html", text.clean("html"))


@query(f"""WITH {RAW} SELECT * FROM raw
WHERE length(instruction) BETWEEN 10 AND 10000 AND length(output) BETWEEN 10 AND 10000""")
def filter_length(spark, d):
    return prep.filter_length(raw(spark, d), COLUMNS)


@query(f"WITH {RAW} SELECT DISTINCT * FROM raw")
def drop_duplicate_rows(spark, d):
    return prep.drop_duplicate_rows(raw(spark, d))


@query(f"""WITH {RAW} SELECT DISTINCT {sql_strip('instruction')} AS instruction, input,
  {sql_strip('output')} AS output FROM raw
WHERE length({sql_strip('instruction')}) BETWEEN 10 AND 10000
  AND length({sql_strip('output')}) BETWEEN 10 AND 10000""")
def preprocess(spark, d):
    return prep.preprocess(raw(spark, d), COLUMNS)


@query(f"""WITH {RAW} SELECT DISTINCT lower({sql_strip('instruction')}) AS instruction,
  'nan' AS input, lower({sql_strip('output')}) AS output FROM raw
WHERE length(lower({sql_strip('output')})) BETWEEN 10 AND 5000""")
def preprocess_lowercase(spark, d):
    cfg = PrepConfig(lowercase=True, max_length=5000, stringify_nulls=True)
    return prep.preprocess(raw(spark, d), COLUMNS, cfg)


@query(f"""WITH {RAW}, kept AS (SELECT DISTINCT * FROM raw)
SELECT (SELECT count(*) FROM raw) AS loaded, count(*) AS deduplicated,
       count(*) FILTER (WHERE length(instruction) BETWEEN 10 AND 10000
                          AND length(output) BETWEEN 10 AND 10000) AS kept
FROM kept""")
def prep_funnel(spark, d):
    return prep.prep_funnel(raw(spark, d), COLUMNS, PrepConfig(strip=False))


@query(f"""WITH {INSTR} SELECT instruction, coalesce(input, '') AS input, output FROM instr""")
def to_instruction(spark, d):
    return formats.to_instruction(instructions(spark, d), COLUMNS)


@query("SELECT text AS instruction, '' AS input, '' AS output FROM documents")
def absent_columns(spark, d):
    docs = table(spark, d, "documents", "text").withColumnRenamed("text", "instruction")
    return formats.to_instruction(docs, COLUMNS)


@query(f"WITH {PREF} SELECT prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected FROM pref")
def to_preference(spark, d):
    return formats.to_preference(preferences(spark, d), PAIRS)


@query(f"""WITH {INSTR} SELECT conv_id, turn, 3 AS messages,
  'system: {SYSTEM}' || chr(10) || 'user: ' || instruction
    || CASE WHEN coalesce(input, '') = '' THEN '' ELSE chr(10) || chr(10) || input END
    || chr(10) || 'assistant: ' || output AS chat
FROM instr""")
def to_chat(spark, d):
    chat = formats.with_messages(instructions(spark, d), COLUMNS, SYSTEM)
    return chat.select(
        "conv_id", "turn", F.size("messages").alias("messages"),
        render.render_roles(F.col("messages")).alias("chat"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_template(template: str) -> str:
    out = _sql_text(template)
    for name in ("instruction", "input", "output"):
        out = out.replace("{" + name + "}", f"' || coalesce({name}, '') || '")
    return out


@query(f"""WITH {INSTR} SELECT conv_id, turn, CASE WHEN coalesce(input, '') = ''
  THEN {_sql_template(render.INSTRUCTION_TEMPLATE_NO_INPUT)}
  ELSE {_sql_template(render.INSTRUCTION_TEMPLATE)} END AS text FROM instr""")
def render_template(spark, d):
    rows = formats.prepare_sft(
        instructions(spark, d), COLUMNS,
        render.INSTRUCTION_TEMPLATE, render.INSTRUCTION_TEMPLATE_NO_INPUT,
    )
    return rows.select("conv_id", "turn", "text")


@query(f"""WITH {INSTR} SELECT conv_id, turn, instruction || chr(10) || chr(10)
  || CASE WHEN coalesce(input, '') = '' THEN '' ELSE input || chr(10) || chr(10) END
  || output AS text FROM instr""")
def render_plain(spark, d):
    rows = formats.prepare_sft(instructions(spark, d), COLUMNS)
    return rows.select("conv_id", "turn", "text")


@query(f"""WITH {PREF} SELECT doc_id, prompt, chosen, rejected FROM pref""")
def prepare_dpo(spark, d):
    return formats.prepare_dpo(preferences(spark, d), PAIRS)


@query(f"""WITH {INSTR} SELECT conv_id, turn, 'user: ' || instruction
    || CASE WHEN coalesce(input, '') = '' THEN '' ELSE chr(10) || chr(10) || input END
    || chr(10) || 'assistant: ' || output AS text FROM instr""")
def prepare_chat(spark, d):
    return formats.prepare_chat(instructions(spark, d), COLUMNS).select("conv_id", "turn", "text")


def _sql_split(source: str, key: str, sizes: str) -> str:
    return f"""WITH ordered AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || {key})) AS pos, count(*) OVER () AS n
  FROM {source}),
sized AS (SELECT *, {sizes} FROM ordered)
SELECT * EXCLUDE (pos, n, n_train, n_val), CASE WHEN pos <= n_train THEN 'train'
  WHEN pos <= n_train + n_val THEN 'validation' ELSE 'test' END AS split FROM sized"""


def _sql_sizes(train: float, val: float, test: float) -> str:
    n_train = f"floor({train}::DOUBLE * n)::BIGINT"
    rest = f"(n - {n_train})"
    share = f"({val}::DOUBLE / ({val}::DOUBLE + {test}::DOUBLE))"
    n_val = f"floor({rest} * {share})::BIGINT" if test > 0 else rest
    return f"{n_train} AS n_train, {n_val} AS n_val"


LINES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)"""
LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"


def _lines(spark, d):
    return table(spark, d, "lineitem", *LINE_IDS, "l_quantity")


@query(_sql_split(LINES, LINE_KEY, _sql_sizes(0.8, 0.1, 0.1)))
def split_default(spark, d):
    return split(_lines(spark, d), LINE_IDS)


@query(_sql_split("(SELECT doc_id, lang, n_chars FROM documents)", "doc_id", _sql_sizes(0.9, 0.05, 0.05)))
def split_instruction(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars")
    return split(docs, ["doc_id"], SplitConfig(0.9, 0.05, 0.05))


@query(_sql_split("(SELECT event_id, event_type FROM events)", "event_id", _sql_sizes(0.9, 0.1, 0.0)))
def split_preference(spark, d):
    events = table(spark, d, "events", "event_id", "event_type")
    return split(events, ["event_id"], SplitConfig(0.9, 0.1, 0.0))


@query("""WITH ordered AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos, count(*) OVER () AS n FROM orders),
sized AS (SELECT *, floor(0.8::DOUBLE * n)::BIGINT AS n_train FROM ordered)
SELECT o_orderkey, CASE WHEN pos <= n_train THEN 'train'
  WHEN pos <= n_train + floor((n - n_train) * 0.5::DOUBLE)::BIGINT THEN 'validation'
  ELSE 'test' END AS split FROM sized""")
def split_in_order(spark, d):
    return split(table(spark, d, "orders", "o_orderkey"), ["o_orderkey"], SplitConfig(shuffle=False))


@query("""WITH ordered AS (
  SELECT event_id, event_type, count(*) OVER () AS n, row_number() OVER (
    ORDER BY substr(md5(event_type), 1, 3), event_type, md5('42:' || event_id)) AS pos
  FROM events),
sized AS (SELECT *, floor(0.8::DOUBLE * n)::BIGINT AS n_train FROM ordered),
trained AS (SELECT *, pos - pos * n_train // n AS later, n - n_train AS n_later,
  floor((n - n_train) * 0.5::DOUBLE)::BIGINT AS n_val,
  pos * n_train // n > (pos - 1) * n_train // n AS in_train FROM sized)
SELECT event_id, event_type, CASE WHEN in_train THEN 'train'
  WHEN later * n_val // n_later > (later - 1) * n_val // n_later THEN 'validation'
  ELSE 'test' END AS split FROM trained""")
def split_stratified(spark, d):
    events = table(spark, d, "events", "event_id", "event_type")
    return split(events, ["event_id"], SplitConfig(stratify="event_type"))


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem),
s AS (SELECT n, floor(0.8::DOUBLE * n)::BIGINT AS a FROM n),
t AS (SELECT n, a, floor((n - a) * 0.5::DOUBLE)::BIGINT AS b FROM s)
SELECT 'train' AS split, a AS rows FROM t UNION ALL
SELECT 'validation', b FROM t UNION ALL SELECT 'test', n - a - b FROM t""")
def split_sizes(spark, d):
    return split_counts(split(_lines(spark, d), LINE_IDS))


@query(f"""WITH {PREF} SELECT doc_id, 'PROMPT ' || prompt || ' {{chosen}} ' || coalesce(chosen, '') AS text FROM pref""")
def literal_braces(spark, d):
    rows = preferences(spark, d)
    body = render.fill(
        "PROMPT {prompt} {{chosen}} {chosen}",
        {"prompt": F.col("prompt"), "chosen": F.col("chosen")},
    )
    return rows.select("doc_id", body.alias("text"))
