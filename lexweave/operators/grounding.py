"""Prompts grounded in retrieved chunks, and answers with their sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import QA_TEMPLATE, fill, render_qa

# Fixed value: the question put to a model that improves an earlier answer.
REFINE_TEMPLATE = """\
The original question is: {question}
We have an existing answer: {answer}
Refine it, only if needed, with the context below.

{context}

Refined answer:"""


def _joined_by_rank(hits: DataFrame, query_id: str, text: str) -> DataFrame:
    """The texts of a query's hits, k at most, joined by blank lines in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda h: h["t"]), "\n\n")
    return hits.groupBy(query_id).agg(joined.alias("context"))


def stuff_prompt(
    hits: DataFrame,
    questions: DataFrame,
    query_id: str,
    content: str = "content",
    question: str = "question",
    template: str = QA_TEMPLATE,
) -> DataFrame:
    """One prompt per question; a question without hits gets an empty context."""
    context = _joined_by_rank(hits, query_id, content)
    rows = questions.join(context, query_id, "left")
    return rows.select(
        query_id, render_qa(F.col("context"), F.col(question), template).alias("prompt")
    )


def map_prompts(
    hits: DataFrame, questions: DataFrame, query_id: str, template: str = QA_TEMPLATE
) -> DataFrame:
    """One prompt per hit, the first step of map-reduce and map-rerank."""
    rows = hits.join(questions, query_id)
    prompt = render_qa(F.col("content"), F.col("question"), template)
    return rows.select(query_id, "rank", prompt.alias("prompt"))


def reduce_prompts(
    answers: DataFrame, questions: DataFrame, query_id: str, template: str = QA_TEMPLATE
) -> DataFrame:
    """The per-hit answers become the context of one prompt per question."""
    return stuff_prompt(answers, questions, query_id, content="answer", template=template)


def rerank_answers(answers: DataFrame, query_id: str, rating: str = "rating") -> DataFrame:
    """The per-hit answer that its generator rated highest, the earlier hit on ties."""
    best = F.max_by("answer", F.struct(F.col(rating), -F.col("rank")))
    return answers.groupBy(query_id).agg(best.alias("answer"))


def refine(
    hits: DataFrame,
    questions: DataFrame,
    query_id: str,
    generate: Callable[[DataFrame], DataFrame],
    k: int = 4,
    template: str = QA_TEMPLATE,
) -> DataFrame:
    """Answer from the first hit, then improve the answer hit by hit.

    The k pieces of a question travel in its row, so the k rounds are one pass without
    a join. ``generate`` adds a ``response`` to rows with a ``prompt``, null for null.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content")))
    pieces = hits.where(F.col("rank") <= k).groupBy(query_id).agg(ordered.alias("pieces"))
    rows = questions.join(pieces, query_id, "left").select(
        query_id, "question", "pieces", F.lit("").alias("answer")
    )
    for place in range(k):
        context = F.get("pieces", place)["content"]
        fields = {"question": F.col("question"), "answer": F.col("answer"), "context": context}
        first = render_qa(context, F.col("question"), template)
        prompt = first if place == 0 else fill(REFINE_TEMPLATE, fields)
        asked = rows.withColumn("prompt", F.when(context.isNotNull(), prompt))
        rows = generate(asked).select(
            query_id, "question", "pieces", F.coalesce("response", "answer").alias("answer")
        )
    return rows.select(query_id, "question", "answer")


def answer_rows(
    hits: DataFrame, answers: DataFrame, query_id: str, metadata: list[str]
) -> DataFrame:
    """The answer beside its source documents in rank order."""
    source = F.struct("rank", "content", F.struct(*metadata).alias("metadata"))
    grouped = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(source)).alias("found"))
    documents = F.transform(
        F.coalesce("found", F.array()),
        lambda s: F.struct(s["content"].alias("content"), s["metadata"].alias("metadata")),
    )
    return answers.join(grouped, query_id, "left").select(
        query_id, F.coalesce("answer", F.lit("")).alias("answer"),
        documents.alias("source_documents"),
    )
