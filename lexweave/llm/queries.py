"""The queries of the numbered operators over the given tables, with SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact, html, jaccard, language, mixing, pieces, prefix_trie, quality, rules, substrings, suffixes, token_file
from .common import held_out, table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


@query("""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark, d):
    return exact.exact_groups(table(spark, d, "documents"))


@query(rules.judge_sql())
def op8_quality_rules(spark, d):
    return rules.judge(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op1_mix_sources(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"), word_count(F.col("text")))
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


@query()
def op7_token_file(spark, d):
    import public_tokenizers

    return token_file.token_file(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op10_substring_dedup(spark, d):
    return substrings.remove_repeats(table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query()
def op2_jaccard_join(spark, d):
    return jaccard.similar_documents(table(spark, d, "documents"))


@query()
def op3_quality_classifier(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    net = quality.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return quality.score(docs, net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op9_language_id(spark, d):
    docs = table(spark, d, "documents")
    profiles = language.learn(docs.where(~held_out(F.col("doc_id"))))
    return language.predict(docs, profiles).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query()
def op5_html_extraction(spark, d):
    return html.extract(table(spark, d, "pages"))


@query()
def op6_sentencepiece(spark, d):
    import public_tokenizers

    return pieces.encode(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op11_suffix_dedup(spark, d):
    return suffixes.remove_repeated_strings(table(spark, d, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query(divergence.divergences_sql())
def op12_source_divergence(spark, d):
    return divergence.divergences(table(spark, d, "documents"))


@query(prefix_trie.TRIE_SQL)
def op13_prefix_trie(spark, d):
    return prefix_trie.trie(table(spark, d, "conversations"))
