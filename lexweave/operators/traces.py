"""Conversation and agent-state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .ranking import KEY, Running, block, running, segmented, top_per_group

# Messages sorted together before the parts of a run are joined in order.
PART = 1000
END = "end"


def assemble(
    df: DataFrame,
    run: str,
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    two_roles: bool = False,
    part: int = PART,
) -> DataFrame:
    """The whole ordered message list of each run: run, messages.

    The turn is unique in its run. Turns are gathered and sorted in parts of ``part``, which
    spreads a long run over tasks; the sorted parts are then joined in order. ``two_roles``
    maps every role but assistant to user.
    """
    who = F.col(role)
    if two_roles:
        who = F.when(who == "assistant", who).otherwise(F.lit("user"))
    entry = F.struct(turn, who.alias("role"), F.col(content).alias("content"))
    listed = F.array_sort(F.collect_list(entry))
    messages = F.transform(
        listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    )
    parts = df.groupBy(run, block(turn, part).alias("part")).agg(messages.alias("messages"))
    return join_parts(parts, run)


def join_parts(parts: DataFrame, run: str) -> DataFrame:
    """Numbered parts of message lists (run, part, messages) → one list per run."""
    listed = F.array_sort(F.collect_list(F.struct("part", "messages")))
    whole = F.flatten(F.transform(listed, lambda p: p["messages"]))
    return parts.groupBy(run).agg(whole.alias("messages"))


def final_output(df: DataFrame, run: str, turn: str = "turn", content: str = "text") -> DataFrame:
    """The last message with content; empty where there is none."""
    last = F.max_by(content, F.when(F.col(content) != "", F.col(turn)))
    return df.groupBy(run).agg(F.coalesce(last, F.lit("")).alias("output"))


def fold_context(
    df: DataFrame, run: str, agents: list[str], turn: str = "turn", agent: str = "role",
    content: str = "text",
) -> DataFrame:
    """``{agent}_output`` → the agent's latest text, in the order agents first spoke.

    The list per run has one entry per roster agent at most, and none where no agent spoke.
    """
    known = F.when(F.col(agent).isin(agents), F.col(agent))
    spoken = df.groupBy(run, known.alias(agent)).agg(
        F.min(turn).alias("first"), F.max_by(content, turn).alias("value")
    )
    entry = F.struct("first", F.concat(agent, F.lit("_output")).alias("key"), "value")
    listed = F.array_sort(F.collect_list(F.when(F.col(agent).isNotNull(), entry)))
    context = F.transform(
        listed, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )
    return spoken.groupBy(run).agg(context.alias("context"))


def agent_step(state: DataFrame, agent: Column | str, response: Column | str) -> DataFrame:
    """The states after one agent's response: messages, context and final_output, other columns as they were.

    ``messages`` (role, content) gains ``[agent]: response`` as an assistant message; the
    context entry ``{agent}_output`` gets the response, in its old place if it was there;
    the response is the final output. A null list counts as empty, a null response as no text.
    """
    agent = F.lit(agent) if isinstance(agent, str) else agent
    said = F.coalesce(F.col(response) if isinstance(response, str) else response, F.lit(""))
    message = F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("["), agent, F.lit("]: "), said).alias("content"))
    entry = F.struct(F.concat(agent, F.lit("_output")).alias("key"), said.alias("value"))
    listed = lambda name, one: F.coalesce(F.col(name), F.array().cast(f"array<struct<{one}>>"))
    context = listed("context", "key:string,value:string")
    there = F.exists(context, lambda e: e["key"] == entry["key"])
    replaced = F.transform(context, lambda e: F.when(e["key"] == entry["key"], entry).otherwise(e))
    return state.withColumns({
        "messages": F.concat(listed("messages", "role:string,content:string"), F.array(message)),
        "context": F.when(there, replaced).otherwise(F.concat(context, F.array(entry))),
        "final_output": said,
    })


def recent_messages(
    df: DataFrame, run: str, n: int = 5, turn: str = "turn"
) -> DataFrame:
    """The last n messages of each run; Spark keeps n per task before the shuffle."""
    return top_per_group(df, [run], [F.col(turn).desc()], n, "from_end")


def buffer_window(
    df: DataFrame, run: str, tokens: Column, limit: int = 2000, turn: str = "turn", part: int = PART
) -> DataFrame:
    """The longest tail of each run whose tokens fit the limit."""
    sized = df.withColumn("__tokens", tokens)
    marked = segmented(sized, [run], block(-F.col(turn), part))
    to_end = {"tokens_to_end": Running("sum", F.col("__tokens"))}
    total = running(marked, [run], [F.col(turn).desc()], to_end)
    return total.where(F.col("tokens_to_end") <= limit).drop("__tokens", KEY)


def parse_decision(text: Column, agents: list[str]) -> Column:
    """The agent a manager named, in the roster's spelling; anything else ends the run."""
    said = F.lower(strip(text))
    choice = F.lit(END)
    for name in reversed(agents):
        if name.lower() != "done":
            choice = F.when(said == name.lower(), F.lit(name)).otherwise(choice)
    return choice


def route_next(context: Column, iteration: Column, agents: list[str], max_iter: int = 5) -> Column:
    """The first roster agent without output yet, or the end.

    ``iteration`` counts from 1. All context entries count towards the end test,
    also those the run started with. A null context has no entries.
    """
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.transform(context, lambda e: e["key"]), none)
    waiting = [F.when(~F.array_contains(keys, f"{a}_output"), F.lit(a)) for a in agents]
    over = (iteration > max_iter) | (F.size(keys) >= len(agents))
    return F.when(over, F.lit(END)).otherwise(F.coalesce(*waiting, F.lit(END)))


def next_turn_pairs(
    df: DataFrame, run: str, asker: str = "user", answerer: str = "assistant"
) -> DataFrame:
    """Each asker turn beside the answerer's turn right after it.

    The join is on run and turn, which are unique together, so no run is too long.
    """
    asked = df.where(F.col("role") == asker).select(
        run, "turn", F.col("text").alias("instruction")
    )
    answered = df.where(F.col("role") == answerer).select(
        run, (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, [run, "turn"])
