import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave import RetrievalConfig
from lexweave.functions import vectors as vec
from lexweave.operators import embed, grounding, search

RNG = np.random.default_rng(5)
ITEMS = np.round(RNG.normal(size=(60, 6)), 3)
ITEMS[40:50] = ITEMS[3]  # copies
QUERIES = np.round(RNG.normal(size=(9, 6)), 3)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(ITEMS)]
    return spark.createDataFrame(rows, "item long, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(QUERIES)], "q int, embedding array<double>")


def brute(metric, k, limit=np.inf, queries=QUERIES):
    out = set()
    for q, v in enumerate(queries):
        if metric == "l2":
            d = ((ITEMS - v) ** 2).sum(axis=1)
        else:
            d = 1 - ITEMS @ v / np.sqrt((ITEMS**2).sum(axis=1) * (v @ v))
            d = d if metric == "cosine" else 2 * d
        best = sorted((round(float(x), 9), i) for i, x in enumerate(d) if round(float(x), 9) <= limit)
        out |= {(q, r + 1, round(x, 6), i) for r, (x, i) in enumerate(best[:k])}
    return out


def found(df):
    return {(r["q"], r["rank"], round(r["score"], 6), r["item"]) for r in df.collect()}


NAMES = {"query_id": "q", "item_id": "item"}


@pytest.mark.parametrize("metric", ["l2", "cosine", "unit_l2"])
@pytest.mark.parametrize("k", [1, 4, 100])
def test_nearest_equals_brute_force(corpus, queries, metric, k):
    assert found(search.nearest(queries, corpus, k, metric=metric, **NAMES)) == brute(metric, k)


def test_copies_tie_by_id_under_any_partitioning(corpus, queries, spark):
    asked = spark.createDataFrame([(0, ITEMS[3].tolist())], "q int, embedding array<double>")
    for n in (1, 7):
        rows = search.nearest(asked, corpus.repartition(n), 4, **NAMES).orderBy("rank").collect()
        assert [r["item"] for r in rows] == [3, 40, 41, 42]


def test_threshold_applies_before_ranking(corpus, queries):
    got = found(search.nearest(queries, corpus, 5, max_distance=4.0, **NAMES))
    assert got == brute("l2", 5, 4.0) and len(got) < 45


@pytest.mark.parametrize("passes", [16, 1])
def test_many_queries_are_worked_off_in_blocks(corpus, queries, monkeypatch, passes):
    monkeypatch.setattr(search, "PASSES", passes)
    assert found(search.nearest(queries, corpus, 3, block=4, **NAMES)) == brute("l2", 3)


def test_no_queries_no_hits(corpus, queries):
    assert search.nearest(queries.limit(0), corpus, 3, **NAMES).count() == 0


@pytest.mark.parametrize("scores_at_once", [20, 4_000_000])
def test_copies_of_an_item_count_once(corpus, queries, monkeypatch, scores_at_once):
    monkeypatch.setattr(search, "SCORES_AT_ONCE", scores_at_once)
    copied = corpus.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("item") % 3 * 20))).drop("n")
    options = {"unique_items": False, **NAMES}
    for n in (1, 6):
        spread = copied.repartition(n)
        hits = search.nearest(queries, spread, 4, **options)
        assert found(hits) == brute("l2", 4)
        sourced = search.attach_sources(hits, spread.withColumn("x", F.col("item") * 2), "item", 36, False)
        assert found(sourced) == brute("l2", 4)
        assert all(r["x"] == 2 * r["item"] for r in sourced.collect())
    cfg = RetrievalConfig("mmr", k=3, fetch_k=8)
    assert found(search.mmr(queries, copied, cfg, **options)) == found(search.mmr(queries, corpus, cfg, **NAMES))


def test_small_score_blocks_give_the_same_hits(corpus, queries, monkeypatch):
    rows = corpus.coalesce(1).toArrow().combine_chunks().to_batches()
    whole = search._best_hits(iter(rows), QUERIES, 4, "l2", None)
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 30)
    parts = search._best_hits(iter(rows), QUERIES, 4, "l2", None)
    key = ["q", "score", "item"]
    assert whole.sort_values(key)[key].values.tolist() == parts.sort_values(key)[key].values.tolist()


def test_search_plan_has_no_cross_join_and_limits_before_the_shuffle(corpus, queries, plan):
    shown = plan(search.nearest(queries, corpus, 3, **NAMES))
    assert "Cartesian" not in shown and "NestedLoop" not in shown
    assert shown.count("WindowGroupLimit") == 2


def test_mixed_or_missing_vectors_are_refused(spark, queries):
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "item long, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        search.nearest(queries, bad.coalesce(1), 1, **NAMES).collect()
    with pytest.raises(ValueError, match="metric"):
        search.nearest(queries, bad, 1, metric="dot", **NAMES)


def twin_mmr(v, k, fetch_k, weight):
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    likeness = [round(1 - round(1 - cos(x, v), 9), 9) for x in ITEMS]
    pool = sorted(range(len(ITEMS)), key=lambda i: (-likeness[i], i))[:fetch_k]
    picked = pool[:1]
    while len(picked) < min(k, len(pool)):
        gains = {
            i: round(weight * likeness[i] - (1 - weight) * max(cos(ITEMS[i], ITEMS[j]) for j in picked), 9)
            for i in pool if i not in picked
        }
        picked.append(max(gains, key=lambda i: (gains[i], -pool.index(i))))
    return picked


@pytest.mark.parametrize("weight", [0.0, 0.5, 1.0])
def test_mmr_equals_the_greedy_twin(corpus, queries, weight):
    cfg = RetrievalConfig("mmr", k=4, fetch_k=12, lambda_mult=weight)
    rows = search.mmr(queries, corpus, cfg, **NAMES).orderBy("q", "rank").collect()
    for q, v in enumerate(QUERIES):
        assert [r["item"] for r in rows if r["q"] == q] == twin_mmr(v, 4, 12, weight)


def test_mmr_with_full_weight_is_top_k_and_small_pools_end_early(corpus, queries):
    cfg = RetrievalConfig("mmr", k=4, fetch_k=20, lambda_mult=1.0)
    top = search.nearest(queries, corpus, 4, metric="cosine", **NAMES)
    assert found(search.mmr(queries, corpus, cfg, **NAMES)) == found(top)
    tiny = RetrievalConfig("mmr", k=9, fetch_k=3)
    assert search.mmr(queries, corpus, tiny, **NAMES).count() == 27


def test_cells_cover_the_corpus_and_full_probing_is_exact(corpus, queries):
    centres = search.train_cells(corpus, cells=5)
    indexed = search.assign_cells(corpus, centres)
    assert indexed.count() == 60
    exact = found(search.nearest(queries, corpus, 4, **NAMES))
    assert found(search.nearest_in_cells(queries, indexed, centres, 4, nprobe=5, **NAMES)) == exact
    some = found(search.nearest_in_cells(queries, indexed, centres, 4, nprobe=3, **NAMES))
    recall = len({(q, i) for q, _, _, i in some} & {(q, i) for q, _, _, i in exact}) / 36
    assert recall > 0.6


def test_cell_table_is_pruned(corpus, queries, tmp_path, plan, spark):
    centres = search.train_cells(corpus, cells=5)
    path = str(tmp_path / "cells")
    search.assign_cells(corpus, centres).write.partitionBy("cell").parquet(path)
    hits = search.nearest_in_cells(queries.limit(1), spark.read.parquet(path), centres, 2, nprobe=1, **NAMES)
    assert "PartitionFilters: [cell" in plan(hits).replace("isnotnull(cell", "cell")


def test_column_vectors_equal_numpy(spark):
    df = spark.createDataFrame([(ITEMS[0].tolist(), ITEMS[1].tolist())], "a array<float>, b array<float>")
    r = df.select(
        vec.dot("a", "b").alias("dot"), vec.squared_l2("a", "b").alias("l2"),
        vec.cosine("a", "b").alias("cos"), vec.normalize("a").alias("unit"),
    ).first()
    a, b = ITEMS[0].astype(np.float32).astype(float), ITEMS[1].astype(np.float32).astype(float)
    assert r["dot"] == pytest.approx(a @ b) and r["l2"] == pytest.approx(((a - b) ** 2).sum())
    assert r["cos"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))
    assert np.linalg.norm(r["unit"]) == pytest.approx(1)
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>")
    assert zero.select(vec.cosine("a", "b").alias("c"), vec.normalize("a").alias("n")).first() == (0.0, [0.0])


def test_hash_embedding_counts_tokens(spark):
    df = spark.createDataFrame([(1, "B a a"), (2, ""), (3, None)], "i int, t string")
    rows = {r["i"]: r["embedding"] for r in embed.hash_embed(df, "t", 16).collect()}
    want = [0.0] * 16
    for token in ("b", "a", "a"):
        want[int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % 16] += 1
    assert rows[1] == want and rows[2] == rows[3] == [0.0] * 16


def test_embedder_gets_batches_and_all_columns_stay(spark):
    def make():
        return lambda texts: np.array([[len(texts), len(t)] for t in texts], dtype=float)

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "i int, t string").coalesce(1)
    rows = embed.embed(df, "t", make, "sizes", batch=4).orderBy("i").collect()
    assert [r["embedding"] for r in rows] == [[4.0 if i < 8 else 2.0, i] for i in range(10)]
    assert rows[3]["t"] == "xxx"
    # Another model under the same name is another model.
    other = embed.embed(df, "t", lambda: lambda texts: np.ones((len(texts), 1)), "sizes")
    assert {tuple(r["embedding"]) for r in other.collect()} == {(1.0,)}


def test_prompts_from_hits(spark):
    hits = spark.createDataFrame(
        [(1, 2, 0.5, "b {question}"), (1, 1, 0.9, "a")], "query_id int, rank int, score double, content string"
    )
    asked = spark.createDataFrame([(1, "Q1?"), (2, "Q2?")], "query_id int, question string")
    template = "{context}|{question}"
    rows = dict(grounding.stuff_prompt(hits, asked, "query_id", template=template).collect())
    assert rows == {1: "a\n\nb {question}|Q1?", 2: "|Q2?"}
    mapped = grounding.map_prompts(hits, asked, "query_id", template).orderBy("rank").collect()
    assert [r["prompt"] for r in mapped] == ["a|Q1?", "b {question}|Q1?"]
    answers = hits.withColumn("answer", F.upper("content"))
    reduced = dict(grounding.reduce_prompts(answers, asked, "query_id", template).collect())
    assert reduced[1] == "A\n\nB {QUESTION}|Q1?"
    rated = lambda rating: dict(grounding.rerank_answers(answers.withColumn("rating", rating), "query_id").collect())
    assert rated(F.col("rank")) == {1: "B {QUESTION}"} and rated(F.lit(1)) == {1: "A"}
    rows = grounding.answer_rows(hits, asked.select("query_id", F.lit("x").alias("answer")), "query_id", ["score"])
    got = {r["query_id"]: [(s["content"], s["metadata"]["score"]) for s in r["source_documents"]] for r in rows.collect()}
    assert got == {1: [("a", 0.9), ("b {question}", 0.5)], 2: []}


def test_refine_asks_once_per_piece(spark):
    from lexweave.operators.evaluate import generate

    hits = spark.createDataFrame([(1, r, f"c{r}") for r in (1, 2, 3)] + [(2, 1, "only")], "query_id int, rank int, content string")
    asked = spark.createDataFrame([(1, "Q"), (2, "Q"), (3, "Q")], "query_id int, question string")

    def make():
        return lambda prompts: [p.replace("\n", " ")[-40:] + "#" for p in prompts]

    rows = grounding.refine(hits, asked, "query_id", lambda df: generate(df, make), k=4, template="{context}")
    got = {r["query_id"]: r["answer"] for r in rows.collect()}
    assert got[2] == "only#" and got[3] == ""
    assert "c3" in got[1] and got[1].endswith("Refined answer:#")
