"""Prompt, chat and context rendering as column expressions.

Messages are ``array<struct<role,content>>``. Templates are parsed once on the
driver, so text inside the data that looks like a field is never filled again.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, preview, text_or_empty

# Prompt texts.
INSTRUCTION_TEMPLATE = """\
Below is an instruction that describes a task. Write a response that appropriately completes the request.

### Instruction:
{instruction}

### Input:
{input}

### Response:
{output}
"""
INSTRUCTION_TEMPLATE_NO_INPUT = """\
Below is an instruction that describes a task. Write a response that appropriately completes the request.

### Instruction:
{instruction}

### Response:
{output}
"""
QA_TEMPLATE = """\
Use the following pieces of context to answer the question at the end.
If you don't know the answer, just say that you don't know, don't try to make up an answer.

Context:
{context}

Question: {question}

Answer:"""
AGENT_TEMPLATE = """\
You are {role}.
Your goal: {goal}
Background: {backstory}

Complete your assigned task based on the conversation history and any provided context."""
MANAGER_TEMPLATE = """\
You are a manager coordinating a team of agents: {roster}.
Decide which agent should handle the next part of the task, or say 'done' if the task is complete.
Respond with just the agent name or 'done'."""
SYSTEM_USER_LABELS = {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}
TAG_LABELS = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
TAG_END = "</s>"
IMAGE_MARK = "<image>"


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Single-pass substitution of ``{name}`` fields; ``{{`` and ``}}`` are literal braces."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise ValueError(f"the template asks for {name!r}; given are {sorted(fields)}")
            parts.append(text_or_empty(fields[name]))
    return F.concat(*parts) if parts else F.lit("")


def render_template(
    fields: dict[str, Column], template: str, template_no_input: str | None = None
) -> Column:
    """The no-input variant serves rows whose input is missing or empty."""
    full = fill(template, fields)
    if not template_no_input:
        return full
    without = fill(template_no_input, fields)
    return F.when(is_blank(fields.get("input", F.lit(None))), without).otherwise(full)


def render_plain(instruction: Column, input_: Column, output: Column) -> Column:
    head, tail = text_or_empty(instruction), text_or_empty(output)
    gap = F.lit("\n\n")
    return F.when(is_blank(input_), F.concat(head, gap, tail)).otherwise(
        F.concat(head, gap, input_, gap, tail)
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(
    instruction: Column, input_: Column, output: Column, system: str | None = None
) -> Column:
    asked = text_or_empty(instruction)
    user = F.when(is_blank(input_), asked).otherwise(F.concat(asked, F.lit("\n\n"), input_))
    turns = [message("system", F.lit(system))] if system else []
    turns += [message("user", user), message("assistant", text_or_empty(output))]
    return F.array(*turns)


def render_roles(messages: Column) -> Column:
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), text_or_empty(m["content"])))
    return F.array_join(lines, "\n")


def _labelled(messages: Column, labels: dict[str, str], end: str = "") -> Column:
    """One text per message of a known role; other roles are left out."""

    def one(m: Column) -> Column:
        prefix = None
        for role, label in labels.items():
            hit = m["role"] == role
            prefix = F.when(hit, F.lit(label)) if prefix is None else prefix.when(hit, F.lit(label))
        return F.concat(prefix, text_or_empty(m["content"]), F.lit(end))

    known = F.filter(messages, lambda m: m["role"].isin(*labels))
    return F.transform(known, one)


def _with_cue(texts: Column, cue: str, sep: str) -> Column:
    return F.array_join(F.concat(texts, F.array(F.lit(cue))), sep)


def render_system_user(messages: Column) -> Column:
    return _with_cue(_labelled(messages, SYSTEM_USER_LABELS), "Assistant:", "\n\n")


def render_tagged(messages: Column) -> Column:
    return _with_cue(_labelled(messages, TAG_LABELS, TAG_END), "<|assistant|>", "\n")


def render_single_turn(user: Column) -> Column:
    return F.concat(F.lit("User: "), text_or_empty(user), F.lit("\nAssistant:"))


def render_named(
    messages: Column,
    prefixes: dict[str, str],
    suffixes: dict[str, str],
    start: str = "",
    cue: str = "",
) -> Column:
    """A chat template given as per-role prefix and suffix; roles it lacks are left out."""

    def one(m: Column) -> Column:
        text = None
        for role, prefix in prefixes.items():
            piece = F.concat(F.lit(prefix), text_or_empty(m["content"]), F.lit(suffixes.get(role, "")))
            hit = m["role"] == role
            text = F.when(hit, piece) if text is None else text.when(hit, piece)
        return text

    known = F.filter(messages, lambda m: m["role"].isin(*prefixes))
    return F.concat(F.lit(start), F.array_join(F.transform(known, one), ""), F.lit(cue))


def flatten_parts(messages: Column) -> Column:
    """Messages whose content is a list of text and image parts → plain messages."""

    def text(part: Column) -> Column:
        return F.when(part["type"] == "image", F.lit(IMAGE_MARK)).otherwise(
            F.coalesce(part["text"], F.lit(""))
        )

    def one(m: Column) -> Column:
        shown = F.filter(m["parts"], lambda p: p["type"].isin("image", "text"))
        content = F.array_join(F.transform(shown, text), " ")
        return F.struct(m["role"].alias("role"), content.alias("content"))

    return F.transform(messages, one)


def image_paths(messages: Column) -> Column:
    """Image references of all messages in reading order."""

    def images(m: Column) -> Column:
        pictured = F.filter(m["parts"], lambda p: p["type"] == "image")
        return F.transform(pictured, lambda p: p["image"])

    return F.flatten(F.transform(messages, images))


def render_qa(context: Column, question: Column, template: str = QA_TEMPLATE) -> Column:
    return fill(template, {"context": context, "question": question})


def context_lines(entries: Column) -> Column:
    """``key: value`` lines of an ``array<struct<key,value>>``, in its order."""
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), text_or_empty(e["value"])))
    return F.array_join(lines, "\n")


def render_task(task: Column, entries: Column) -> Column:
    head = F.concat(F.lit("Task: "), task)
    lines = context_lines(entries)
    return F.when(is_blank(lines), head).otherwise(
        F.concat(head, F.lit("\n\nContext:\n"), lines)
    )


def progress_lines(entries: Column, limit: int = 200) -> Column:
    lines = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit(": "), preview(e["value"], limit))
    )
    return F.array_join(lines, "\n")


def render_progress(task: Column, entries: Column) -> Column:
    return F.concat(F.lit("Task: "), task, F.lit("\n\nProgress:\n"), progress_lines(entries))


def agent_prompt(role: Column, goal: Column, backstory: Column) -> Column:
    return fill(AGENT_TEMPLATE, {"role": role, "goal": goal, "backstory": backstory})


def manager_prompt(agents: list[str]) -> Column:
    return fill(MANAGER_TEMPLATE, {"roster": F.lit(", ".join(agents))})
