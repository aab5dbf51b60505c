"""Every registered query against its SQL twin, and the driver contract."""

import os

import pytest

import __spark_entry__ as driver
from check_queries import check, connect
from lexweave.plans.all import QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, SF, name) is None


@needs_data
def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["query_id", "prompt"] and out.count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


# Queries whose work is done by an Arrow function, and those that read their own writes.
ARROW = {
    "chunk_recursive", "embed_texts", "hash_embed", "similarity_search", "attach_sources", "top_sources",
    "top_k_l2", "top_k_cosine", "threshold_filter", "mmr_search", "mmr_text_search", "ivf_search",
    "ivf_full_probe", "ivf_recall",
    "stuff_prompt", "map_prompts", "reduce_prompts", "rerank_answers", "answer_rows",
    "refine_answers", "search_collection", "tokenize_words", "drop_prompt_tokens", "pad_lengths", "collate_lm",
    "collate_seq2seq", "generate_responses", "error_rows",
    "read_csv_table", "read_tsv_table", "read_headerless_table", "read_csv_docs",
}


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, plan, name):
    shown = plan(QUERIES[name](spark, SF))
    python = any(word in shown for word in ("ArrowEvalPython", "MapInArrow", "BatchEvalPython", "InPandas"))
    assert python == (name in ARROW)
    assert "BatchEvalPython" not in shown
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
