"""Batch generation, request rows and evaluation tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import render_tagged
from ..functions.text import preview
from .joins import lookup_join
from .ranking import sample_head
from .split import evaluation_split

# A generator maps a list of prompts to a list of responses.
Generator = Callable[[Sequence[str]], Sequence[str]]

# Sampling settings where neither the row nor the configuration has one.
GENERATION_DEFAULTS = {"top_p": 0.9, "top_k": 50, "do_sample": True, "repetition_penalty": 1.0}
PREVIEW = 50

_factories: dict[str, Callable[..., Generator]] = {}


def register_generator(name: str):
    """Decorator that makes a generator factory known under a name."""

    def keep(factory: Callable[..., Generator]):
        _factories[name] = factory
        return factory

    return keep


def make_generator(name: str, **options) -> Callable[[], Generator]:
    if name not in _factories:
        raise ValueError(f"no generator {name!r}; registered are {sorted(_factories)}")
    factory = _factories[name]
    return lambda: factory(**options)


@register_generator("echo")
def _echo() -> Generator:
    """An offline stand-in that answers with the prompt's last line."""
    return lambda prompts: [p.rstrip().rsplit("\n", 1)[-1] for p in prompts]


@register_generator("digest")
def _digest() -> Generator:
    """An offline stand-in whose answer depends on the whole prompt."""
    return lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def generate(
    df: DataFrame, make: Callable[[], Generator], prompt: str = "prompt", batch: int = 32
) -> DataFrame:
    """Add ``response`` and ``error``. The client is made once per task.

    A failing batch is retried prompt by prompt; a failing prompt gets an error
    text as its response and the run goes on. A row without a prompt gets no response.
    """
    added = [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *added])

    def answer(client: Generator, prompts: list[str]) -> list[tuple[str, str | None]]:
        try:
            answers = list(client(prompts))
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} responses to {len(prompts)} prompts")
            return [(a, None) for a in answers]
        except Exception as e:
            if len(prompts) == 1:
                return [(f"Error: {e}", str(e))]
            return [pair for p in prompts for pair in answer(client, [p])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for rows in batches:
            prompts = rows.column(rows.schema.get_field_index(prompt)).to_pylist()
            given = [p for p in prompts if p is not None]
            answers = (
                pair
                for i in range(0, len(given), batch)
                for pair in answer(client, given[i : i + batch])
            )
            pairs = [(None, None) if p is None else next(answers) for p in prompts]
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array([a for a, _ in pairs], pa.string()),
                    pa.array([e for _, e in pairs], pa.string()),
                ],
                names=[*rows.schema.names, "response", "error"],
            )

    return df.mapInArrow(run, schema)


def attach_generations(
    prompts: DataFrame, responses: DataFrame, key: str
) -> DataFrame:
    """Recorded responses laid beside their prompts; one response per key is kept."""
    one = responses.groupBy(key).agg(F.min("generated").alias("generated"))
    return lookup_join(prompts, one, key)


def resolve_generation(df: DataFrame, max_new_tokens: int, temperature: float) -> DataFrame:
    """The row's own setting where it has one, else the default."""
    defaults = {
        "max_new_tokens": max_new_tokens, "temperature": temperature, **GENERATION_DEFAULTS
    }

    def value(name: str, default) -> Column:
        return F.coalesce(name, F.lit(default)) if name in df.columns else F.lit(default)

    return df.withColumns({n: value(n, d) for n, d in defaults.items()})


def request_rows(df: DataFrame, model_id: str, style: str) -> DataFrame:
    """The request body per row as JSON, from resolved settings; nothing is sent.

    Styles: ``tagged`` (messages rendered into one text), ``prompt`` and ``messages``.
    """
    if style == "tagged":
        body = F.struct(
            render_tagged(F.col("messages")).alias("inputs"),
            F.struct(
                "max_new_tokens", "temperature", "top_p", F.lit(False).alias("return_full_text")
            ).alias("parameters"),
        )
    elif style in ("prompt", "messages"):
        body = F.struct(
            F.lit(model_id).alias("model"),
            F.col(style),
            F.lit(False).alias("stream"),
            F.struct(
                F.col("max_new_tokens").alias("num_predict"), "temperature", "top_p", "top_k"
            ).alias("options"),
        )
    else:
        raise ValueError(f"unknown request style {style!r}")
    return df.withColumn("request", F.to_json(body))


def evaluation_table(df: DataFrame) -> DataFrame:
    """Prompt, expected and generated text, shortened for display."""
    return df.withColumns({c: preview(c, PREVIEW) for c in ("prompt", "expected", "generated")})


def evaluate_dataset(
    dataset: DataFrame,
    responses: DataFrame,
    key: str,
    order: list[Column],
    n: int = 10,
    instruction: str = "instruction",
    output: str = "output",
) -> DataFrame:
    """The first n held-out rows beside their recorded generations."""
    rows = sample_head(evaluation_split(dataset), order, n)
    shown = rows.select(
        key, F.col(instruction).alias("prompt"), F.col(output).alias("expected")
    )
    return evaluation_table(attach_generations(shown, responses, key))


def evaluation_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Our additions to the evaluation table: exact-match rate and length ratio."""
    ratio = F.length("generated") / F.nullif(F.length("expected"), F.lit(0))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("generated") == F.col("expected")).cast("long")).alias("exact"),
        F.round(F.avg(ratio), 6).alias("length_ratio"),
    )
