import hashlib

import pytest
from pyspark.sql import functions as F

from lexweave.operators import collate, tokens

VOCAB = {"a": 2, "b": 3, "c": 4}


def letters():
    """Ids per character, to tell joined text from joined ids."""

    class Letters:
        def encode(self, texts):
            return [[ord(c) for c in t] for t in texts]

    return Letters()


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_vocabulary_ranks_by_count_then_token(spark):
    df = spark.createDataFrame([("b a c",), ("a b d",), ("a  z",), ("",), (None,)], "t string")
    rows = tokens.vocabulary(df, "t", 3).orderBy("token_id").collect()
    assert [(r["token"], r["n"], r["token_id"]) for r in rows] == [("a", 3, 2), ("b", 2, 3), ("c", 1, 4)]
    with pytest.raises(ValueError):
        tokens.vocabulary(df, "t", 0)


def test_tokenize_cuts_and_drops_source_columns(spark):
    df = spark.createDataFrame([(1, "a x b", 9), (2, "", 9), (3, None, 9)], "i int, t string, n int")
    out = tokens.tokenize(df, "t", tokens.WordTokenizer(VOCAB), max_len=2, keep=["i"])
    assert out.columns == ["i", "input_ids", "attention_mask"]
    got = {r["i"]: (r["input_ids"], r["attention_mask"]) for r in out.collect()}
    assert got == {1: ([2, 1], [1, 1]), 2: ([], []), 3: ([], [])}


def test_other_tokenizer_libraries_fit(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()

    class Fast:
        def __init__(self, text):
            self.text = text

        def encode(self, texts):
            model = Tokenizer.from_str(self.text)
            return [e.ids for e in model.encode_batch(list(texts))]

    df = spark.createDataFrame([("a b x",)], "t string")
    assert tokens.tokenize(df, "t", Fast(made.to_str())).first()["input_ids"] == [1, 2, 0]


def test_lookup_ids_broadcasts_the_vocabulary(spark, plan):
    words = spark.createDataFrame([("a",), ("q",), (None,)], "token string")
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, token_id int")
    out = tokens.lookup_ids(words, vocab)
    assert {r["token"]: r["token_id"] for r in out.collect()} == {"a": 2, "q": 1, None: 1}
    assert "BroadcastHashJoin" in plan(out)


def test_prompt_tokens_are_dropped(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2]), ([1], [1, 2]), ([1, 2], [1, 2])], "o array<int>, i array<int>")
    out = df.select(tokens.drop_prompt_tokens(F.col("o"), F.col("i")).alias("x"))
    assert [r["x"] for r in out.collect()] == [[3, 4], [], []]


@pytest.mark.parametrize("n", [1, 8, 10])
@pytest.mark.parametrize("shuffle", [True, False])
@pytest.mark.parametrize("drop_last", [True, False])
def test_batches_are_full_but_the_last(spark, n, shuffle, drop_last):
    out = collate.assign_batches(spark.range(n).repartition(3), ["id"], 4, shuffle, drop_last, segment=3)
    order = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()) if shuffle else list(range(n))
    want = {i: p // 4 for p, i in enumerate(order) if not drop_last or p // 4 < n // 4}
    assert {r["id"]: r["batch_id"] for r in out.collect()} == want


def test_lm_batches(spark):
    rows = [(1, 0, [5, 6, 7]), (2, 0, [5]), (3, 1, [9, 0]), (4, 1, [])]
    df = spark.createDataFrame(rows, "i int, batch_id long, input_ids array<int>")
    df = df.withColumn("attention_mask", tokens.mask(F.col("input_ids")))
    lengths = {r["batch_id"]: r["pad_length"] for r in collate.pad_lengths(df).collect()}
    assert lengths == {0: 3, 1: 2}
    got = {r["i"]: (r["input_ids"], r["attention_mask"], r["labels"]) for r in collate.collate_lm(df).collect()}
    assert got == {
        1: ([5, 6, 7], [1, 1, 1], [5, 6, 7]),
        2: ([5, 0, 0], [1, 0, 0], [5, -100, -100]),
        3: ([9, 0], [1, 1], [9, -100]),
        4: ([0, 0], [0, 0], [-100, -100]),
    }
    other = {r["i"]: r["labels"] for r in collate.collate_lm(df, pad_id=9).collect()}
    assert other[3] == [-100, 0]


def test_seq2seq_pads_labels_by_themselves(spark):
    rows = [(1, 0, [5, 6], [1]), (2, 0, [5], [1, 2, 3])]
    df = spark.createDataFrame(rows, "i int, batch_id long, input_ids array<int>, labels array<int>")
    df = df.withColumn("attention_mask", tokens.mask(F.col("input_ids")))
    got = {r["i"]: (r["input_ids"], r["attention_mask"], r["labels"]) for r in collate.collate_seq2seq(df).collect()}
    assert got == {1: ([5, 6], [1, 1], [1, -100, -100]), 2: ([5, 0], [1, 0], [1, 2, 3])}


def test_dpo_joins_text_before_tokenizing(spark):
    rows = [(1, 0, "ab", "cde", "f"), (2, 0, "xyz", "1", "2345678")]
    df = spark.createDataFrame(rows, "i int, batch_id long, prompt string, chosen string, rejected string")
    out = {r["i"]: r for r in collate.collate_dpo(df, letters(), max_len=6, max_prompt=2).collect()}
    ids = lambda t, n: [ord(c) for c in t] + [0] * (n - len(t))
    assert out[1]["prompt_input_ids"] == ids("ab", 2) and out[2]["prompt_input_ids"] == ids("xy", 2)
    assert out[1]["chosen_input_ids"] == ids("abcde", 5) and out[2]["chosen_input_ids"] == ids("xyz1", 5)
    assert out[1]["rejected_input_ids"] == ids("abf", 6) and out[2]["rejected_input_ids"] == ids("xyz234", 6)
    assert out[1]["rejected_attention_mask"] == [1, 1, 1, 0, 0, 0]
    assert not {"prompt", "chosen", "rejected"} & set(out[1].asDict())

    words = collate.collate_dpo(df, tokens.WordTokenizer({"abcde": 7, "ab": 8, "cde": 9}), 6, 2)
    assert rows_by(words, "i")[(1,)]["chosen_input_ids"] == [7]
