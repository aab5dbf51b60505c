"""Vocabulary, tokenization and padded batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import collate, tokens
from ..session import scratch_path
from .registry import query
from .tables import (
    INSTR, PREF, VOCABULARY, instructions, joined, preferences, sql_clean, table, word_ids,
)


@query(f"WITH {VOCABULARY} SELECT token, n, token_id FROM vocab")
def vocabulary(spark, d):
    return word_ids(spark, d)


@query(f"""WITH {VOCABULARY}, tokens AS (
  SELECT item_id, unnest(t) AS token, unnest(range(len(t))) AS pos
  FROM (SELECT item_id, string_split({sql_clean('text')}, ' ') AS t FROM benchmark))
SELECT item_id, pos, token, coalesce(token_id, 1) AS token_id FROM tokens LEFT JOIN vocab USING (token)""")
def token_ids(spark, d):
    items = table(spark, d, "benchmark").select(
        "item_id", F.posexplode(words("text")).alias("pos", "token")
    )
    return tokens.lookup_ids(items, word_ids(spark, d))


def _sql_ids(source: str, key: str, text: str, limit: int, name: str) -> str:
    """Ids per row as a list, cut to the limit, rows without tokens included."""
    return f"""{name}_tokens AS (
  SELECT {key}, unnest(t) AS token, unnest(range(len(t))) AS pos
  FROM (SELECT {key}, string_split({sql_clean(text)}, ' ') AS t FROM {source})),
{name} AS (
  SELECT {key}, list(coalesce(token_id, 1) ORDER BY pos) AS ids
  FROM {name}_tokens LEFT JOIN vocab USING (token)
  WHERE pos < {limit} GROUP BY ALL)"""


@query(f"""WITH {VOCABULARY}, {_sql_ids('documents', 'doc_id', 'text', 2048, 'coded')}
SELECT doc_id, array_to_string(ids, ' ') AS input_ids, len(ids) AS attended FROM coded""")
def tokenize_words(spark, d):
    tokenizer = tokens.load_tokenizer(word_ids(spark, d))
    docs = table(spark, d, "documents", "doc_id", "text")
    coded = tokens.tokenize(docs, "text", tokenizer, keep=["doc_id"])
    return coded.select(
        "doc_id", joined("input_ids").alias("input_ids"), F.size("attention_mask").alias("attended")
    )


@query(f"""WITH {INSTR}, {VOCABULARY},
{_sql_ids('instr', 'conv_id, turn', "instruction || ' ' || output", 100000000, 'whole')},
{_sql_ids('instr', 'conv_id, turn', 'instruction', 100000000, 'asked')}
SELECT conv_id, turn, array_to_string(list_slice(b.ids, len(a.ids) + 1, len(b.ids)), ' ') AS added
FROM whole b JOIN asked a USING (conv_id, turn)""")
def drop_prompt_tokens(spark, d):
    tokenizer = tokens.load_tokenizer(word_ids(spark, d))
    rows = instructions(spark, d)
    encode = tokens.encoder(tokenizer, 2**31 - 1)
    coded = rows.select(
        "conv_id", "turn",
        encode(F.concat_ws(" ", "instruction", "output")).alias("out"),
        encode("instruction").alias("inp"),
    )
    added = tokens.drop_prompt_tokens(F.col("out"), F.col("inp"))
    return coded.select("conv_id", "turn", joined(added).alias("added"))


_BATCHED = """SELECT {cols},
  (row_number() OVER (ORDER BY md5('42:' || {key})) - 1) // {size} AS batch_id FROM {source}"""


@query(_BATCHED.format(cols="o_orderkey", key="o_orderkey", size=64, source="orders"))
def assign_batches(spark, d):
    return collate.assign_batches(table(spark, d, "orders", "o_orderkey"), ["o_orderkey"], 64)


@query(f"""WITH b AS ({_BATCHED.format(cols='l_orderkey, l_linenumber, l_partkey, l_suppkey',
  key="l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey", size=7,
  source='lineitem')})
SELECT * FROM b WHERE batch_id < (SELECT count(*) // 7 FROM lineitem)""")
def assign_full_batches(spark, d):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return collate.assign_batches(table(spark, d, "lineitem", *ids), ids, 7, drop_last=True)


@query("""SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 32 AS batch_id FROM events""")
def assign_ordered_batches(spark, d):
    events = table(spark, d, "events", "event_id")
    return collate.assign_batches(events, ["event_id"], 32, shuffle=False)


def _coded_documents(spark, d, max_len=2048):
    tokenizer = tokens.load_tokenizer(word_ids(spark, d))
    coded = tokens.tokenize(table(spark, d, "documents", "doc_id", "text"), "text", tokenizer, max_len, keep=["doc_id"])
    # Batches are dealt by the ids alone and joined to the coded rows: no text moves.
    numbers = collate.assign_batches(table(spark, d, "documents", "doc_id"), ["doc_id"], 4)
    return coded.join(numbers, "doc_id")


_DOC_BATCHES = f"""{VOCABULARY}, {_sql_ids('documents', 'doc_id', 'text', 2048, 'coded')},
batches AS ({_BATCHED.format(cols='doc_id, ids', key='doc_id', size=4, source='coded')}),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM batches)"""


def _sql_pad(ids: str, m: str, value: int) -> str:
    return f"array_to_string(list_concat({ids}, list_transform(range({m} - len({ids})), lambda x: {value})), ' ')"


@query(f"WITH {_DOC_BATCHES} SELECT DISTINCT batch_id, m AS pad_length FROM sized")
def pad_lengths(spark, d):
    return collate.pad_lengths(_coded_documents(spark, d))


@query(f"""WITH {_DOC_BATCHES} SELECT doc_id, batch_id, {_sql_pad('ids', 'm', 0)} AS input_ids,
  {_sql_pad('list_transform(ids, lambda x: 1)', 'm', 0)} AS attention_mask,
  {_sql_pad('ids', 'm', -100)} AS labels FROM sized""")
def collate_lm(spark, d):
    out = collate.collate_lm(_coded_documents(spark, d))
    return out.select(
        "doc_id", "batch_id",
        *(joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")),
    )


@query(f"""WITH {INSTR}, {VOCABULARY},
{_sql_ids('instr', 'conv_id, turn', 'instruction', 2048, 'asked')},
{_sql_ids('instr', 'conv_id, turn', 'output', 2048, 'answered')},
rows AS (SELECT conv_id, turn, a.ids, b.ids AS labels,
  (row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn)) - 1) // 4 AS batch_id
  FROM asked a JOIN answered b USING (conv_id, turn)),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS m,
  max(len(labels)) OVER (PARTITION BY batch_id) AS ml FROM rows)
SELECT conv_id, turn, batch_id, {_sql_pad('ids', 'm', 0)} AS input_ids,
  {_sql_pad('list_transform(ids, lambda x: 1)', 'm', 0)} AS attention_mask,
  {_sql_pad('labels', 'ml', -100)} AS labels FROM sized""")
def collate_seq2seq(spark, d):
    tokenizer = tokens.load_tokenizer(word_ids(spark, d))
    encode = tokens.encoder(tokenizer, 2048)
    coded = instructions(spark, d).select(
        "conv_id", "turn", encode("instruction").alias("input_ids"), encode("output").alias("labels")
    )
    coded = collate.assign_batches(coded, ["conv_id", "turn"], 4)
    coded = coded.withColumn("attention_mask", tokens.mask(F.col("input_ids")))
    out = collate.collate_seq2seq(coded)
    return out.select(
        "conv_id", "turn", "batch_id",
        *(joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")),
    )


_DPO_PARTS = ("prompt", "chosen", "rejected")


@query(f"""WITH {PREF}, pairs AS (FROM pref WHERE chosen IS NOT NULL AND rejected IS NOT NULL), {VOCABULARY},
{_sql_ids('pairs', 'doc_id', 'prompt', 256, 'p_ids')},
{_sql_ids('pairs', 'doc_id', 'prompt || chosen', 512, 'c_ids')},
{_sql_ids('pairs', 'doc_id', 'prompt || rejected', 512, 'r_ids')},
rows AS (SELECT doc_id, p.ids AS prompt, c.ids AS chosen, r.ids AS rejected,
  (row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1) // 2 AS batch_id
  FROM p_ids p JOIN c_ids c USING (doc_id) JOIN r_ids r USING (doc_id)),
sized AS (SELECT *, max(len(prompt)) OVER b AS m_prompt, max(len(chosen)) OVER b AS m_chosen,
  max(len(rejected)) OVER b AS m_rejected
  FROM rows WHERE batch_id < (SELECT count(*) // 2 FROM rows) WINDOW b AS (PARTITION BY batch_id))
SELECT doc_id, batch_id, {', '.join(
    f"{_sql_pad(p, 'm_' + p, 0)} AS {p}_input_ids, "
    f"{_sql_pad(f'list_transform({p}, lambda x: 1)', 'm_' + p, 0)} AS {p}_attention_mask"
    for p in _DPO_PARTS)} FROM sized""")
def collate_dpo(spark, d):
    tokenizer = tokens.load_tokenizer(word_ids(spark, d))
    pairs = preferences(spark, d, complete=True)
    # Coded once: the passes that deal out batches read cut ids.
    path = scratch_path(spark, "coded")
    collate.encode_dpo(pairs, tokenizer).write.parquet(path)
    coded = spark.read.parquet(path)
    numbers = collate.assign_batches(coded.select("doc_id"), ["doc_id"], 2, drop_last=True)
    out = collate.collate_dpo(coded.join(numbers, "doc_id"))
    columns = [f"{p}_{kind}" for p in _DPO_PARTS for kind in ("input_ids", "attention_mask")]
    return out.select("doc_id", "batch_id", *(joined(c).alias(c) for c in columns))
