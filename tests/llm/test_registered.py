"""The registered queries without SQL, against the libraries or plain versions, on whole tables."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexweave.llm import mixing, queries
from lexweave.llm.common import word_count

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_token_files_have_the_librarys_ids(spark, texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i in sorted(texts):
        ids = np.array([*plain.encode(texts[i]["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows(spark, "op7_token_file"))) == want


def test_pieces_are_the_librarys(spark, texts):
    plain = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op6_sentencepiece")
    assert len(got) == len(texts)
    for r in got:
        assert list(r["ids"]) == plain.encode(texts[r["doc_id"]]["text"] or "")


def test_the_mix_comes_near_its_targets(spark, texts):
    got = rows(spark, "op1_mix_sources")
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, "op1_mix_sources")))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in texts.items()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    names = sorted({r["source"] for r in got}, key=lambda s: (s is None, s))
    source = {s: sum(sizes[i] for i, r in texts.items() if r["source"] == s) for s in names}
    left, open_, target = 1.5 * sum(source.values()), list(names), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    while full := [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * source[s]]:
        target |= {s: 2 * source[s] for s in full}
        open_ = [s for s in open_ if s not in full]
        left -= sum(2 * source[s] for s in full)
    target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == source[s] and r["target"] == pytest.approx(target[s]) for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(target[s], rel=0.02)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_rows_without_ids_spread_over_shards(spark):
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    cfg = mixing.MixConfig(shard_words=1000)
    mixed = mixing.mix(same.repartition(3), word_count(F.col("text")), cfg=cfg)
    assert mixed.count() == 3000
    taken = [r["taken"] for r in mixed.collect()]
    assert max(taken) <= 8 and sum(taken) == pytest.approx(18000, rel=0.02)
    shown = mixed._jdf.queryExecution().analyzed().toString()
    assert "number" in shown


def test_models_are_right_on_what_they_did_not_see(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    quality, language = rows(spark, "op3_quality_classifier"), rows(spark, "op9_language_id")
    for found in (quality, language):
        assert sorted(r["doc_id"] for r in found) == sorted(texts)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in found)
    right = [r["predicted"] == labels[r["doc_id"]] for r in quality if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(right) >= 0.75
    said = [r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in language if r["held_out"]]
    assert np.mean(said) >= 0.95
