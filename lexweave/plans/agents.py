"""Conversations, chat renderings and agent states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render
from ..functions.text import words
from ..operators import traces
from .registry import query
from .tables import ROLES, STATES, agent_states, conversations, joined, sql_clean, table

PREFIXES = {"system": "[S] ", "user": "[U] ", "assistant": "[A] "}
SUFFIXES = {"system": " [/S]\n", "user": " [/U]\n", "assistant": "\n"}


def _messages(spark, d, **options):
    return traces.assemble(conversations(spark, d), "conv_id", **options)


def _chat(spark, d, renderer):
    return _messages(spark, d).select("conv_id", renderer(F.col("messages")).alias("text"))


def _sql_chat(line: str, sep: str, tail: str = "") -> str:
    return f"""SELECT conv_id,
  string_agg({line}, {sep} ORDER BY turn) || {tail or "''"} AS text
FROM conversations GROUP BY ALL"""


@query(_sql_chat("CASE role WHEN 'assistant' THEN role ELSE 'user' END || ': ' || text", "chr(10)"))
def assemble_conversations(spark, d):
    whole = _messages(spark, d, two_roles=True)
    return whole.select("conv_id", render.render_roles(F.col("messages")).alias("text"))


@query(_sql_chat("role || ': ' || text", "chr(10)"))
def render_roles(spark, d):
    return _chat(spark, d, render.render_roles)


@query(_sql_chat("CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' "
                 "ELSE 'Assistant: ' END || text", "chr(10) || chr(10)",
                 "chr(10) || chr(10) || 'Assistant:'"))
def render_system_user(spark, d):
    return _chat(spark, d, render.render_system_user)


@query(_sql_chat("'<|' || role || '|>' || chr(10) || text || '</s>'", "chr(10)",
                 "chr(10) || '<|assistant|>'"))
def render_tagged(spark, d):
    return _chat(spark, d, render.render_tagged)


@query("""SELECT conv_id, '<s>' || string_agg(
  CASE role WHEN 'system' THEN '[S] ' || text || ' [/S]' || chr(10)
            WHEN 'user' THEN '[U] ' || text || ' [/U]' || chr(10)
            ELSE '[A] ' || text || chr(10) END, '' ORDER BY turn) || '[A] ' AS text
FROM conversations GROUP BY ALL""")
def render_named(spark, d):
    return _chat(
        spark, d, lambda m: render.render_named(m, PREFIXES, SUFFIXES, start="<s>", cue="[A] ")
    )


@query("""SELECT conv_id, turn, 'User: ' || text || chr(10) || 'Assistant:' AS text
FROM conversations WHERE role = 'user'""")
def render_single_turn(spark, d):
    users = conversations(spark, d).where(F.col("role") == "user")
    return users.select("conv_id", "turn", render.render_single_turn(F.col("text")).alias("text"))


@query("""SELECT conv_id,
  string_agg(CASE role WHEN 'user' THEN '<image> ' || text ELSE text END, chr(10) ORDER BY turn) AS text,
  coalesce(string_agg(conv_id || '/' || turn || '.png', ' ' ORDER BY turn)
    FILTER (WHERE role = 'user'), '') AS images
FROM conversations GROUP BY ALL""")
def flatten_multipart(spark, d):
    """User turns carry an image before their text."""
    kind = "struct<type:string,text:string,image:string>"
    said = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).alias("image")).cast(kind)
    path = F.concat_ws("", "conv_id", F.lit("/"), "turn", F.lit(".png"))
    shown = F.struct(F.lit("image").alias("type"), F.lit(None).alias("text"), path.alias("image"))
    parts = F.when(F.col("role") == "user", F.array(shown.cast(kind), said)).otherwise(F.array(said))
    turns = conversations(spark, d).withColumn("parts", parts)
    entry = F.struct("turn", "role", "parts")
    grouped = turns.groupBy("conv_id", F.floor(F.col("turn") / traces.PART).alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("messages")
    )
    flat = render.flatten_parts(F.col("messages"))
    return traces.join_parts(grouped, "conv_id").select(
        "conv_id",
        F.array_join(F.transform(flat, lambda m: m["content"]), "\n").alias("text"),
        F.array_join(render.image_paths(F.col("messages")), " ").alias("images"),
    )


@query("""SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE text <> ''), '') AS output
FROM conversations GROUP BY conv_id""")
def final_output(spark, d):
    return traces.final_output(conversations(spark, d), "conv_id")


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end
FROM conversations QUALIFY from_end <= 5""")
def recent_messages(spark, d):
    recent = traces.recent_messages(conversations(spark, d), "conv_id")
    return recent.select("conv_id", "turn", "role", "from_end")


@query(f"""WITH counted AS (
  SELECT conv_id, turn, role, sum(len(string_split({sql_clean('text')}, ' '))) OVER (
    PARTITION BY conv_id ORDER BY turn DESC) AS tokens_to_end FROM conversations)
SELECT conv_id, turn, role, tokens_to_end::BIGINT AS tokens_to_end FROM counted WHERE tokens_to_end <= 200""")
def buffer_window(spark, d):
    kept = traces.buffer_window(
        conversations(spark, d), "conv_id", F.size(words("text")), limit=200
    )
    return kept.select("conv_id", "turn", "role", "tokens_to_end")


@query(f"""WITH {STATES} SELECT conv_id,
  string_agg(role || '_output: ' || value, chr(10) ORDER BY first) AS context FROM spoken GROUP BY 1""")
def fold_context(spark, d):
    folded = traces.fold_context(conversations(spark, d), "conv_id", ROLES)
    return folded.select("conv_id", render.context_lines(F.col("context")).alias("context"))


@query(f"""WITH {STATES}, told AS (
  SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat,
         max(text) FILTER (WHERE role = 'assistant') IS NOT NULL AS known FROM conversations GROUP BY conv_id),
listed AS (SELECT conv_id, string_agg(role || '_output: ' || CASE WHEN role = 'assistant' THEN 'step of ' || conv_id ELSE value END,
  chr(10) ORDER BY first) AS context FROM spoken GROUP BY conv_id)
SELECT conv_id, chat || chr(10) || 'assistant: [assistant]: step of ' || conv_id AS messages,
  context || CASE WHEN known THEN '' ELSE chr(10) || 'assistant_output: step of ' || conv_id END AS context,
  'step of ' || conv_id AS final_output
FROM told JOIN listed USING (conv_id)""")
def agent_step(spark, d):
    """One more step of the agent named assistant, after each conversation."""
    states = agent_states(spark, d).join(_messages(spark, d), "conv_id")
    stepped = traces.agent_step(states, "assistant", F.concat(F.lit("step of "), F.col("conv_id").cast("string")))
    return stepped.select(
        "conv_id", render.render_roles(F.col("messages")).alias("messages"),
        render.context_lines(F.col("context")).alias("context"), "final_output",
    )


@query(f"""WITH {STATES} SELECT conv_id, 'Task: ' || any_value(task) || chr(10) || chr(10) || 'Context:'
  || chr(10) || string_agg(role || '_output: ' || value, chr(10) ORDER BY first) AS prompt
FROM spoken JOIN tasks USING (conv_id) GROUP BY conv_id""")
def render_context(spark, d):
    prompt = render.render_task(F.col("task"), F.col("context"))
    return agent_states(spark, d).select("conv_id", prompt.alias("prompt"))


@query(f"""WITH {STATES} SELECT conv_id, 'Task: ' || any_value(task) || chr(10) || chr(10) || 'Progress:'
  || chr(10) || string_agg(role || '_output: ' || CASE WHEN length(value) > 200
    THEN substr(value, 1, 200) || '...' ELSE value END, chr(10) ORDER BY first) AS prompt
FROM spoken JOIN tasks USING (conv_id) GROUP BY conv_id""")
def progress_summary(spark, d):
    prompt = render.render_progress(F.col("task"), F.col("context"))
    return agent_states(spark, d).select("conv_id", prompt.alias("prompt"))


@query("""SELECT DISTINCT source, lang, 'You are Reader of ' || lang || '.' || chr(10) || 'Your goal: Summarize '
  || source || chr(10) || 'Background: {source}' || chr(10) || chr(10)
  || 'Complete your assigned task based on the conversation history and any provided context.' AS prompt
FROM documents""")
def agent_prompts(spark, d):
    agents = table(spark, d, "documents", "source", "lang").distinct()
    prompt = render.agent_prompt(
        F.concat(F.lit("Reader of "), "lang"), F.concat(F.lit("Summarize "), "source"),
        F.lit("{source}"),
    )
    return agents.select("source", "lang", prompt.alias("prompt"))


@query("""SELECT conv_id, turn, 'You are a manager coordinating a team of agents: system, user, assistant.'
  || chr(10) || 'Decide which agent should handle the next part of the task, or say ''done'' if the task is complete.'
  || chr(10) || 'Respond with just the agent name or ''done''.' || chr(10) || chr(10) || text AS prompt
FROM conversations""")
def manager_prompts(spark, d):
    prompt = F.concat(render.manager_prompt(ROLES), F.lit("\n\n"), F.col("text"))
    return conversations(spark, d).select("conv_id", "turn", prompt.alias("prompt"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
  ELSE 'end' END AS next_agent FROM conversations""")
def parse_decision(spark, d):
    said = F.concat(F.lit("  "), F.upper("role"), F.lit(" "))
    choice = traces.parse_decision(said, ["User", "Assistant"])
    return conversations(spark, d).select("conv_id", "turn", choice.alias("next_agent"))


@query(f"""WITH {STATES}, seen AS (SELECT conv_id, list(role) AS roles, count(*) AS n FROM spoken GROUP BY 1)
SELECT conv_id, CASE WHEN iteration > 5 OR n >= 3 THEN 'end'
  WHEN NOT list_contains(roles, 'system') THEN 'system'
  WHEN NOT list_contains(roles, 'user') THEN 'user'
  WHEN NOT list_contains(roles, 'assistant') THEN 'assistant' ELSE 'end' END AS next_agent
FROM tasks JOIN seen USING (conv_id)""")
def route_next(spark, d):
    choice = traces.route_next(F.col("context"), F.col("iteration"), ROLES)
    return agent_states(spark, d).select("conv_id", choice.alias("next_agent"))
