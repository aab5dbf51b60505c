import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators import evaluate


def test_generation_keeps_going_after_errors(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)

        def answer(prompts):
            if "bad" in prompts:
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return answer

    rows = [(1, "a"), (2, "bad"), (3, "c"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "i int, prompt string").coalesce(1)
    got = {r["i"]: (r["response"], r["error"]) for r in evaluate.generate(df, make, batch=4).collect()}
    assert got == {1: ("A", None), 2: ("Error: no", "no"), 3: ("C", None), 4: (None, None), 5: ("", None)}
    assert made.value == 1


def test_wrong_number_of_responses_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    rows = evaluate.generate(df, lambda: lambda prompts: []).collect()
    assert all(r["error"] == "0 responses to 1 prompts" for r in rows)


def test_registry():
    @evaluate.register_generator("fixed")
    def fixed(answer="x"):
        return lambda prompts: [answer] * len(prompts)

    assert evaluate.make_generator("fixed", answer="y")()(["p"]) == ["y"]
    with pytest.raises(ValueError, match="echo"):
        evaluate.make_generator("nothing")


def test_settings_of_the_row_win(spark):
    df = spark.createDataFrame([(0.0, None), (None, 7)], "temperature double, top_k int")
    got = [r.asDict() for r in evaluate.resolve_generation(df, 100, 0.7).collect()]
    rest = {"max_new_tokens": 100, "top_p": 0.9, "do_sample": True, "repetition_penalty": 1.0}
    assert got == [{"temperature": 0.0, "top_k": 50, **rest}, {"temperature": 0.7, "top_k": 7, **rest}]


def test_request_bodies(spark):
    kind = "prompt string, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([('p "q"\n', [("user", "hi")])], kind)
    df = evaluate.resolve_generation(df, 10, 0.5)
    body = lambda style: json.loads(evaluate.request_rows(df, "m", style).first()["request"])
    options = {"num_predict": 10, "temperature": 0.5, "top_p": 0.9, "top_k": 50}
    assert body("prompt") == {"model": "m", "prompt": 'p "q"\n', "stream": False, "options": options}
    assert body("messages") == {
        "model": "m", "messages": [{"role": "user", "content": "hi"}], "stream": False, "options": options,
    }
    assert body("tagged") == {
        "inputs": "<|user|>\nhi</s>\n<|assistant|>",
        "parameters": {"max_new_tokens": 10, "temperature": 0.5, "top_p": 0.9, "return_full_text": False},
    }
    with pytest.raises(ValueError):
        evaluate.request_rows(df, "m", "other")


def test_evaluation_table(spark):
    rows = [(i, f"k{i % 3}", f"q{i}", "e" * 60, s) for i, s in enumerate(["train", "test", "test", "validation", "test"])]
    df = spark.createDataFrame(rows, "i int, k string, instruction string, output string, split string")
    said = spark.createDataFrame([("k1", "g1"), ("k1", "f1"), ("k2", "g" * 50)], "k string, generated string")
    table = evaluate.evaluate_dataset(df, said, "k", [F.col("i")], n=2)
    got = sorted((r["prompt"], r["expected"], r["generated"]) for r in table.collect())
    assert got == [("q1", "e" * 50 + "...", "f1"), ("q2", "e" * 50 + "...", "g" * 50)]


def test_scores(spark):
    rows = [("a", "xx", "xx"), ("a", "xx", "xxxx"), ("a", "xx", None), ("b", "", "y")]
    df = spark.createDataFrame(rows, "g string, expected string, generated string")
    got = {r["g"]: (r["rows"], r["exact"], r["length_ratio"]) for r in evaluate.evaluation_scores(df, ["g"]).collect()}
    assert got == {"a": (3, 1, 1.5), "b": (1, 0, None)}
