"""Generation, request rows and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SplitConfig
from ..functions.text import preview
from ..operators import evaluate, traces
from ..operators.split import split
from .registry import query
from .tables import INSTR, conversations, instructions, questions, table

# Recorded responses: a model that repeats the prompt, but hits the expected text of short ones.
_KEY = "md5(instruction)"
_PAIRS = f"""{INSTR},
keyed AS (SELECT *, {_KEY} AS prompt_id FROM instr),
recorded AS (
  SELECT prompt_id, min(CASE WHEN length(instruction) < 100 THEN output ELSE 'Re: ' || instruction END)
    AS generated FROM keyed GROUP BY prompt_id)"""


def _keyed(spark, d):
    return instructions(spark, d).withColumn("prompt_id", F.md5("instruction"))


def _recorded(spark, d):
    said = F.when(F.length("instruction") < 100, F.col("output")).otherwise(F.concat(F.lit("Re: "), "instruction"))
    return _keyed(spark, d).select("prompt_id", said.alias("generated"))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, output AS expected, generated
FROM keyed LEFT JOIN recorded USING (prompt_id)""")
def attach_generations(spark, d):
    rows = evaluate.attach_generations(_keyed(spark, d), _recorded(spark, d), "prompt_id")
    return rows.select("conv_id", "turn", F.col("output").alias("expected"), "generated")


def _sql_short(c: str) -> str:
    return f"CASE WHEN length({c}) > 50 THEN substr({c}, 1, 50) || '...' ELSE {c} END AS {c}"


@query(f"""WITH {_PAIRS}, placed AS (
  SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn)) AS pos
  FROM keyed),
held AS (SELECT * FROM placed WHERE pos > floor(0.8::DOUBLE * n)
  + floor((n - floor(0.8::DOUBLE * n)) * 0.5::DOUBLE) ORDER BY conv_id, turn LIMIT 10),
rows AS (SELECT prompt_id, instruction AS prompt, output AS expected, generated
  FROM held LEFT JOIN recorded USING (prompt_id))
SELECT prompt_id, {_sql_short('prompt')}, {_sql_short('expected')}, {_sql_short('generated')} FROM rows""")
def evaluate_dataset(spark, d):
    rows = split(_keyed(spark, d), ["conv_id", "turn"], SplitConfig())
    return evaluate.evaluate_dataset(
        rows, _recorded(spark, d), "prompt_id", [F.col("conv_id"), F.col("turn")]
    )


@query(f"""WITH {_PAIRS}, pairs AS (
  SELECT coalesce(input, '') <> '' AS has_input, output AS expected, generated
  FROM keyed LEFT JOIN recorded USING (prompt_id))
SELECT has_input, count(*) AS rows, count(*) FILTER (WHERE generated = expected) AS exact,
  round(avg(length(generated)::DOUBLE / length(expected)), 6) AS length_ratio
FROM pairs GROUP BY has_input""")
def evaluation_scores(spark, d):
    pairs = evaluate.attach_generations(_keyed(spark, d), _recorded(spark, d), "prompt_id").select(
        (F.coalesce("input", F.lit("")) != "").alias("has_input"),
        F.col("output").alias("expected"), "generated",
    )
    return evaluate.evaluation_scores(pairs, ["has_input"])


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 64 ELSE 512 END::BIGINT AS max_new_tokens,
  coalesce(CASE WHEN value > 10 THEN 0.0 END, 0.7)::DOUBLE AS temperature, 0.9::DOUBLE AS top_p,
  50::BIGINT AS top_k, true AS do_sample, 1.0::DOUBLE AS repetition_penalty FROM events""")
def resolve_generation(spark, d):
    """Some rows bring their own settings."""
    rows = table(spark, d, "events", "event_id", "event_type", "value").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.lit(64)).alias("max_new_tokens"),
        F.when(F.col("value") > 10, F.lit(0.0)).alias("temperature"),
    )
    out = evaluate.resolve_generation(rows, 512, 0.7)
    return out.withColumns({c: F.col(c).cast("long") for c in ("max_new_tokens", "top_k")})


def _requests(spark, d, style):
    turns = traces.assemble(conversations(spark, d), "conv_id")
    last = F.element_at("messages", -1)["content"]
    rows = evaluate.resolve_generation(turns.withColumn("prompt", last), 512, 0.7)
    return evaluate.request_rows(rows, "some-model", style).select("conv_id", "request")


_OPTIONS = "json_object('num_predict', 512, 'temperature', 0.7, 'top_p', 0.9, 'top_k', 50)"
_CONV = """conv AS (SELECT conv_id, arg_max(text, turn) AS prompt,
  list({role: role, content: text} ORDER BY turn) AS messages,
  string_agg('<|' || role || '|>' || chr(10) || text || '</s>', chr(10) ORDER BY turn)
    || chr(10) || '<|assistant|>' AS tagged
  FROM conversations GROUP BY ALL)"""


@query(f"""WITH {_CONV} SELECT conv_id, json_object('inputs', tagged, 'parameters', json_object(
  'max_new_tokens', 512, 'temperature', 0.7, 'top_p', 0.9, 'return_full_text', false))::VARCHAR AS request
FROM conv""")
def request_rows_tagged(spark, d):
    return _requests(spark, d, "tagged")


@query(f"""WITH {_CONV} SELECT conv_id, json_object('model', 'some-model', 'prompt', prompt,
  'stream', false, 'options', {_OPTIONS})::VARCHAR AS request FROM conv""")
def request_rows_prompt(spark, d):
    return _requests(spark, d, "prompt")


@query(f"""WITH {_CONV} SELECT conv_id, json_object('model', 'some-model', 'messages', messages,
  'stream', false, 'options', {_OPTIONS})::VARCHAR AS request FROM conv""")
def request_rows_chat(spark, d):
    return _requests(spark, d, "messages")


@query("""SELECT item_id AS query_id, regexp_extract(rtrim(text, chr(10) || ' '), '[^\\n]*$') AS response,
  NULL::VARCHAR AS error FROM benchmark""")
def generate_responses(spark, d):
    asked = questions(spark, d).withColumnRenamed("question", "prompt")
    return evaluate.generate(asked, evaluate.make_generator("echo")).drop("prompt")


@query("""SELECT item_id AS query_id,
  CASE WHEN length(text) > 200 THEN 'Error: ' || length(text) || ' characters are too many'
    ELSE length(text)::VARCHAR END AS response,
  CASE WHEN length(text) > 200 THEN length(text) || ' characters are too many' END AS error
FROM benchmark""")
def error_rows(spark, d):
    """A generator that fails on long prompts; the other prompts are answered."""

    def make():
        def answer(prompts):
            long = [p for p in prompts if len(p) > 200]
            if long:
                raise ValueError(f"{len(long[0])} characters are too many")
            return [str(len(p)) for p in prompts]

        return answer

    asked = questions(spark, d).withColumnRenamed("question", "prompt")
    return evaluate.generate(asked, make).drop("prompt")
