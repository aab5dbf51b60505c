"""Chunks, embeddings, search and grounded prompts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.render import QA_TEMPLATE
from ..functions import render, text, vectors as vec
from ..operators import chunk, embed, evaluate, grounding, search
from ..operators.grounding import REFINE_TEMPLATE
from ..session import scratch_path
from ..sources import vector_index
from .chunk_sql import recursive_chunks
from .registry import query
from .tables import (
    CENTRES, CHUNKS, DIM, HITS, INSTR, chunk_vectors, chunks, instructions, joined, label_centres,
    question_vectors, questions, stored_chunks, table, vectors,
)


@query(f"WITH {CHUNKS} SELECT doc_id, lang, chunk_no, content, chunk_id FROM chunks")
def chunk_fixed(spark, d):
    return chunks(spark, d)


@query(f"""WITH RECURSIVE {recursive_chunks('documents', 'doc_id', 'text')}
SELECT doc_id, lang, chunk_no::INTEGER AS chunk_no, content, sha256(concat_ws(chr(10), doc_id, chunk_no, content)) AS chunk_id
FROM cut JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def chunk_recursive(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    return chunk.with_chunk_id(chunk.chunk_recursive(docs, "text"), "doc_id")


@query(f"""WITH {HITS} SELECT chunk_id, bucket, c::BIGINT AS n FROM chunk_counts""")
def hash_embed(spark, d):
    cells = chunk_vectors(spark, d).select(
        "chunk_id", F.posexplode("embedding").alias("bucket", "c")
    )
    return cells.where(F.col("c") > 0).select(
        "chunk_id", F.col("bucket").cast("long").alias("bucket"), F.col("c").cast("long").alias("n")
    )


def _text_sizes():
    """An embedder that any user could bring: two numbers per text."""
    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=float)


@query("SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents")
def embed_texts(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    rows = embed.embed(docs, "text", _text_sizes, "sizes").select("doc_id", "embedding")
    value = lambda i: F.element_at("embedding", i).cast("long")
    return rows.select("doc_id", value(1).alias("chars"), value(2).alias("spaces"))


def _centre_hits(spark, d, k=4, metric="l2", **options):
    return search.nearest(
        label_centres(spark, d), vectors(spark, d), k,
        query_id="label", item_id="vec_id", metric=metric, **options,
    )


def _sql_centre_hits(distance: str, k: int = 4, where: str = "true") -> str:
    return f"""WITH {CENTRES},
scored AS (
  SELECT c.label, vec_id, round({distance}, 9) AS score
  FROM centres c, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e)
SELECT label, rank, round(score, 6) AS score, vec_id FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS rank
  FROM scored WHERE {where}) WHERE rank <= {k}"""


_L2 = "list_sum(list_transform(list_zip(centre, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_COS = "1 - list_dot_product(centre, v) / sqrt(list_dot_product(centre, centre) * list_dot_product(v, v))"


@query(_sql_centre_hits(_L2))
def top_k_l2(spark, d):
    return _centre_hits(spark, d).withColumn("score", F.round("score", 6))


@query(_sql_centre_hits(_COS, 10))
def top_k_cosine(spark, d):
    return _centre_hits(spark, d, 10, "cosine").withColumn("score", F.round("score", 6))


@query(_sql_centre_hits(_COS, 20, "score <= 0.75"))
def threshold_filter(spark, d):
    hits = _centre_hits(spark, d, 20, "cosine", max_distance=0.75)
    return hits.withColumn("score", F.round("score", 6))


@query(f"""WITH {CENTRES} SELECT vec_id, round({_L2}, 6) AS l2,
  round(1 - ({_COS}), 6) AS cosine
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) e JOIN centres USING (label)""")
def centre_distances(spark, d):
    """Each vector against its own label's centre, with column functions alone."""
    centres = label_centres(spark, d).withColumnRenamed("embedding", "centre")
    rows = table(spark, d, "embeddings").join(F.broadcast(centres), "label")
    return rows.select(
        "vec_id",
        F.round(vec.squared_l2("centre", "embedding"), 6).alias("l2"),
        F.round(vec.cosine("centre", "embedding"), 6).alias("cosine"),
    )


def _hits(spark, d, store=None):
    return search.nearest(
        question_vectors(spark, d), chunk_vectors(spark, d) if store is None else store,
        query_id="query_id", item_id="chunk_id", metric="unit_l2",
    )


def _sourced(spark, d):
    """Hits with their chunks: the chunks are stored once, and read for vectors and for content."""
    store = stored_chunks(spark, d)
    most = questions(spark, d).count() * 4
    return search.attach_sources(_hits(spark, d, store), store.drop("embedding"), "chunk_id", most)


@query(f"WITH {HITS} SELECT query_id, rank, round(score, 6) AS score, chunk_id FROM hits")
def similarity_search(spark, d):
    return _hits(spark, d).withColumn("score", F.round("score", 6))


@query(f"""WITH {HITS} SELECT query_id, rank, round(score, 6) AS score, doc_id, lang, chunk_no, content
FROM hits JOIN chunks USING (chunk_id)""")
def attach_sources(spark, d):
    return _sourced(spark, d).select(
        "query_id", "rank", F.round("score", 6).alias("score"), "doc_id", "lang", "chunk_no", "content"
    )


@query(f"""WITH {HITS} SELECT query_id, rank, doc_id,
  CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS content
FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 3""")
def top_sources(spark, d):
    shown = _sourced(spark, d).where(F.col("rank") <= 3)
    return shown.select("query_id", "rank", "doc_id", text.preview("content", 100).alias("content"))


def _sql_mmr(
    head: str, scored: str, asked: str, item: str, k: int = 4, fetch_k: int = 20, weight: float = 0.5
) -> str:
    """One step per pick: likeness to the query against likeness to what is picked.

    ``scored`` gives the query, the item, its vector v and the distance score.
    """
    cos = (
        "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
    )
    steps = [
        "near1 AS (SELECT c.label, c.place, c.likeness, c.vec_id, c.v, "
        + cos.format(a="c.v", b="p.v")
        + " AS near FROM cand c JOIN cand p ON p.label = c.label AND p.place = 1 WHERE c.place > 1)",
        "pick1 AS (SELECT label, 1 AS rank, likeness, vec_id, v FROM cand WHERE place = 1)",
    ]
    for i in range(2, k + 1):
        steps.append(
            f"pick{i} AS (SELECT label, {i} AS rank, likeness, vec_id, v, place FROM near{i-1} "
            f"QUALIFY row_number() OVER (PARTITION BY label ORDER BY "
            f"round({weight} * likeness - {1 - weight} * near, 9) DESC, place) = 1)"
        )
        steps.append(
            f"near{i} AS (SELECT c.label, c.place, c.likeness, c.vec_id, c.v, greatest(c.near, "
            + cos.format(a="c.v", b="p.v")
            + f") AS near FROM near{i-1} c JOIN pick{i} p ON p.label = c.label AND p.place <> c.place)"
        )
    picks = " UNION ALL ".join(
        f"SELECT label, rank, round(1 - likeness, 6) AS score, vec_id FROM pick{i}"
        for i in range(1, k + 1)
    )
    found = f"""{head}, likened AS ({scored}),
cand AS (
  SELECT label, vec_id, v, 1 - score AS likeness,
    row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS place
  FROM likened QUALIFY place <= {fetch_k}),
{', '.join(steps)} {picks}"""
    return found.replace("label", asked).replace("vec_id", item)


@query(_sql_mmr(f"WITH {CENTRES}", f"""
  SELECT label, vec_id, v, round({_COS}, 9) AS score FROM centres,
    (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e""", "label", "vec_id"))
def mmr_search(spark, d):
    hits = search.mmr(
        label_centres(spark, d), vectors(spark, d), query_id="label", item_id="vec_id"
    )
    return hits.withColumn("score", F.round("score", 6))


@query(_sql_mmr(f"""WITH {HITS}, near AS (
  SELECT query_id, chunk_id, round(1 - dot / sqrt(k.n * q.n), 9) AS score
  FROM dots JOIN chunk_norms k USING (chunk_id) JOIN question_norms q USING (query_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= 20),
dense AS (
  SELECT chunk_id, list(coalesce(c, 0)::DOUBLE ORDER BY b) AS v
  FROM (SELECT DISTINCT chunk_id FROM near) n CROSS JOIN (SELECT unnest(range({DIM})) AS b) r
  LEFT JOIN (SELECT chunk_id, bucket AS b, c FROM chunk_counts) USING (chunk_id, b) GROUP BY chunk_id)""",
    "SELECT query_id, chunk_id, v, score FROM near JOIN dense USING (chunk_id)", "query_id", "chunk_id"))
def mmr_text_search(spark, d):
    hits = search.mmr(
        question_vectors(spark, d), chunk_vectors(spark, d), RetrievalConfig("mmr"),
        query_id="query_id", item_id="chunk_id",
    )
    return hits.withColumn("score", F.round("score", 6))


def _vector_index(spark, d):
    """The vectors of a table in a fresh index: half of them at first, half added later."""
    path = scratch_path(spark, "index")
    corpus = vectors(spark, d)
    early = F.col("vec_id") % 2 == 0
    vector_index.create_index(corpus.where(early), path, item_id="vec_id")
    vector_index.add_to_index(corpus.where(~early), path, item_id="vec_id")
    return path


_NAMES = {"query_id": "query_id", "item_id": "vec_id"}


def _vector_queries(spark, d):
    return vectors(spark, d).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


@query()
def ivf_search(spark, d):
    path, asked = _vector_index(spark, d), _vector_queries(spark, d)
    vector_index.calibrate(asked, path, **_NAMES)
    return vector_index.search_index(asked, path, **_NAMES)


@query(_sql_centre_hits(_L2))
def ivf_full_probe(spark, d):
    """Asking every cell of the stored index is the exact search."""
    hits = vector_index.search_index(
        label_centres(spark, d), _vector_index(spark, d), query_id="label", item_id="vec_id"
    )
    return hits.withColumn("score", F.round("score", 6))


@query("""SELECT 4 AS k, count(*) AS queries, 4 * count(*) AS hits, true AS recall_reached
FROM embeddings WHERE vec_id % 100 = 0""")
def ivf_recall(spark, d):
    """What the calibrated search finds of the four truly nearest, over all queries."""
    path, asked = _vector_index(spark, d), _vector_queries(spark, d)
    vector_index.calibrate(asked, path, **_NAMES)
    found = vector_index.search_index(asked, path, **_NAMES).select("query_id", "vec_id", F.lit(1).alias("got"))
    exact = search.nearest(asked, vectors(spark, d), **_NAMES).join(found, ["query_id", "vec_id"], "left")
    return exact.agg(
        F.lit(4).alias("k"), F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("hits"),
        (F.count("got") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
    )


def _sql_qa(context: str, question: str) -> str:
    body = "'" + QA_TEMPLATE.replace("'", "''") + "'"
    return body.replace("{context}", f"' || coalesce({context}, '') || '").replace(
        "{question}", f"' || coalesce({question}, '') || '"
    )


@query(f"""WITH {INSTR} SELECT conv_id, turn, {_sql_qa('output', 'instruction')} AS prompt FROM instr""")
def render_qa(spark, d):
    prompt = render.render_qa(F.col("output"), F.col("instruction"))
    return instructions(spark, d).select("conv_id", "turn", prompt.alias("prompt"))


@query(f"""WITH {HITS}, contexts AS (
  SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id)
SELECT item_id AS query_id, {_sql_qa('context', 'text')} AS prompt
FROM benchmark LEFT JOIN contexts ON item_id = query_id""")
def stuff_prompt(spark, d):
    return grounding.stuff_prompt(_sourced(spark, d), questions(spark, d), "query_id")


@query(f"""WITH {HITS} SELECT query_id, rank, {_sql_qa('content', 'text')} AS prompt
FROM hits JOIN chunks USING (chunk_id) JOIN benchmark ON item_id = query_id""")
def map_prompts(spark, d):
    return grounding.map_prompts(_sourced(spark, d), questions(spark, d), "query_id")


# A recorded answer per hit, the chunk itself, with a recorded rating that depends on all of it.
_ANSWERS = f"""{HITS}, answers AS (
  SELECT query_id, rank, content AS answer, ('0x' || substr(md5(content), 1, 4))::INTEGER % 101 AS rating
  FROM hits JOIN chunks USING (chunk_id))"""


def _answers(spark, d):
    rating = F.conv(F.substring(F.md5("content"), 1, 4), 16, 10).cast("int") % 101
    return _sourced(spark, d).select(
        "query_id", "rank", F.col("content").alias("answer"), rating.alias("rating")
    )


@query(f"""WITH {_ANSWERS}, contexts AS (
  SELECT query_id, string_agg(answer, chr(10) || chr(10) ORDER BY rank) AS context
  FROM answers GROUP BY query_id)
SELECT item_id AS query_id, {_sql_qa('context', 'text')} AS prompt
FROM benchmark LEFT JOIN contexts ON item_id = query_id""")
def reduce_prompts(spark, d):
    return grounding.reduce_prompts(_answers(spark, d), questions(spark, d), "query_id")


@query(f"""WITH {_ANSWERS} SELECT query_id, answer FROM answers
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rating DESC, rank) = 1""")
def rerank_answers(spark, d):
    return grounding.rerank_answers(_answers(spark, d), "query_id")


@query(f"""WITH {HITS} SELECT query_id, 'A:' || string_agg(doc_id || '/' || chunk_no, ' ' ORDER BY rank)
  AS answer FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id""")
def answer_rows(spark, d):
    hits = _sourced(spark, d)
    answers = questions(spark, d).select("query_id", F.lit("A:").alias("answer"))
    rows = grounding.answer_rows(hits, answers, "query_id", ["doc_id", "chunk_no"])
    places = F.transform(
        "source_documents",
        lambda s: F.concat_ws("/", s["metadata"]["doc_id"], s["metadata"]["chunk_no"]),
    )
    return rows.select("query_id", F.concat("answer", F.array_join(places, " ")).alias("answer"))


def _sql_refined(context: str, question: str, answer: str) -> str:
    body = "'" + REFINE_TEMPLATE.replace("'", "''") + "'"
    for name, value in (("context", context), ("question", question), ("answer", answer)):
        body = body.replace("{" + name + "}", f"' || coalesce({value}, '') || '")
    return body


# Four rounds: an answer is the digest of its prompt, and each prompt holds the answer before.
_REFINED = f"""{HITS}, pieces AS (
  SELECT item_id AS query_id, text AS question,
    max(content) FILTER (WHERE rank = 1) AS c1, max(content) FILTER (WHERE rank = 2) AS c2,
    max(content) FILTER (WHERE rank = 3) AS c3, max(content) FILTER (WHERE rank = 4) AS c4
  FROM benchmark LEFT JOIN (SELECT query_id, rank, content FROM hits JOIN chunks USING (chunk_id)) h
    ON item_id = query_id GROUP BY item_id, text),
round1 AS (SELECT *, CASE WHEN c1 IS NULL THEN '' ELSE md5({_sql_qa('c1', 'question')}) END AS a1 FROM pieces)"""
for _n in (2, 3, 4):
    _REFINED += f""",
round{_n} AS (SELECT *, CASE WHEN c{_n} IS NULL THEN a{_n - 1}
  ELSE md5({_sql_refined(f'c{_n}', 'question', f'a{_n - 1}')}) END AS a{_n} FROM round{_n - 1})"""


@query(f"WITH {_REFINED} SELECT query_id, a4 AS answer FROM round4")
def refine_answers(spark, d):
    digest = evaluate.make_generator("digest")
    return grounding.refine(
        _sourced(spark, d), questions(spark, d), "query_id", lambda df: evaluate.generate(df, digest)
    ).select("query_id", "answer")
