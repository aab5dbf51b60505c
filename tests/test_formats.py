import pytest
from pyspark.sql import functions as F

from lexweave import ColumnMap
from lexweave.functions import render
from lexweave.operators import formats

MAP = ColumnMap()


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, "Say {output}", None, "x{input}"), (1, "Sum", "", "3"), (2, "Sum", "1 {instruction}", "3")]
    return spark.createDataFrame(data, "i int, instruction string, input string, output string").orderBy("i")


def texts(df, c="text"):
    return [r[c] for r in df.collect()]


def test_templates_fill_once_and_keep_the_final_line_break(rows):
    df = formats.prepare_sft(rows, MAP, render.INSTRUCTION_TEMPLATE, render.INSTRUCTION_TEMPLATE_NO_INPUT)
    data = [r.asDict() for r in rows.collect()]
    want = [
        (render.INSTRUCTION_TEMPLATE if r["input"] else render.INSTRUCTION_TEMPLATE_NO_INPUT).format(**r)
        for r in data
    ]
    assert texts(df) == want and all(t.endswith("\n") for t in want)


def test_without_the_short_variant_the_full_template_is_used(rows):
    assert texts(formats.prepare_sft(rows, MAP, "{instruction}|{input}|{output}{{}}"))[:2] == [
        "Say {output}||x{input}{}", "Sum||3{}",
    ]


def test_unknown_template_field_fails_on_the_driver(rows):
    with pytest.raises(ValueError, match="answer"):
        formats.prepare_sft(rows, MAP, "{answer}")


def test_plain_join(rows):
    assert texts(formats.prepare_sft(rows, MAP)) == [
        "Say {output}\n\nx{input}", "Sum\n\n3", "Sum\n\n1 {instruction}\n\n3",
    ]


def test_absent_roles_become_empty_text(spark):
    df = spark.createDataFrame([("q",)], "instruction string")
    assert formats.to_instruction(df, MAP).first().asDict() == {"instruction": "q", "input": "", "output": ""}
    assert formats.to_preference(df, ColumnMap()).first().asDict() == {"prompt": "q", "chosen": "", "rejected": ""}


def test_numbers_become_text(spark):
    df = spark.createDataFrame([(1, 2.5)], "instruction int, output double")
    assert formats.to_instruction(df, MAP).first()["output"] == "2.5"


def test_chat_messages(rows):
    chats = texts(formats.to_chat(rows, MAP, "sys"), "messages")
    assert [tuple(m) for m in chats[2]] == [
        ("system", "sys"), ("user", "Sum\n\n1 {instruction}"), ("assistant", "3"),
    ]
    assert [m["role"] for m in texts(formats.to_chat(rows, MAP), "messages")[0]] == ["user", "assistant"]


def test_dpo_keeps_other_columns(spark):
    df = spark.createDataFrame([("p", "c", "r", 7)], "q string, c string, r string, n int")
    out = formats.prepare_dpo(df, ColumnMap("q", None, None, "c", "r")).first()
    assert (out["prompt"], out["chosen"], out["rejected"], out["n"]) == ("p", "c", "r", 7)


MESSAGES = [("system", "S"), ("user", "U"), ("tool", "T"), ("assistant", "A")]


@pytest.fixture(scope="module")
def chat(spark):
    kind = "m array<struct<role:string,content:string>>"
    return spark.createDataFrame([(MESSAGES,)], kind)


@pytest.mark.parametrize(
    "renderer, want",
    [
        (render.render_roles, "system: S\nuser: U\ntool: T\nassistant: A"),
        (render.render_system_user, "System: S\n\nUser: U\n\nAssistant: A\n\nAssistant:"),
        (render.render_tagged, "<|system|>\nS</s>\n<|user|>\nU</s>\n<|assistant|>\nA</s>\n<|assistant|>"),
        (
            lambda m: render.render_named(m, {"user": "[", "assistant": ""}, {"user": "]"}, "<s>", "!"),
            "<s>[U]A!",
        ),
    ],
)
def test_renderers(chat, renderer, want):
    assert chat.select(renderer(F.col("m")).alias("t")).first()["t"] == want


def test_single_turn(spark):
    df = spark.range(1).select(render.render_single_turn(F.lit("hi")).alias("t"))
    assert df.first()["t"] == "User: hi\nAssistant:"


def test_multipart_messages(spark):
    part = "struct<type:string,text:string,image:string>"
    kind = f"m array<struct<role:string,parts:array<{part}>>>"
    data = [
        ("user", [("image", None, "a.png"), ("text", "What?", None), ("audio", "x", None), ("text", None, None)]),
        ("assistant", [("text", "plain", None)]),
        ("user", [("image", None, "b.png")]),
    ]
    df = spark.createDataFrame([(data,)], kind)
    out = df.select(
        render.flatten_parts(F.col("m")).alias("flat"), render.image_paths(F.col("m")).alias("images")
    ).first()
    assert [tuple(m) for m in out["flat"]] == [
        ("user", "<image> What? "), ("assistant", "plain"), ("user", "<image>"),
    ]
    assert out["images"] == ["a.png", "b.png"]


def test_context_and_progress(spark):
    kind = "c array<struct<key:string,value:string>>"
    df = spark.createDataFrame([([("b", "x" * 201), ("a", "y" * 200)],), ([],)], kind)
    task = F.lit("T")
    full, empty = df.select(
        render.render_task(task, F.col("c")).alias("t"), render.render_progress(task, F.col("c")).alias("p")
    ).collect()
    assert full["t"] == f"Task: T\n\nContext:\nb: {'x' * 201}\na: {'y' * 200}"
    assert full["p"] == f"Task: T\n\nProgress:\nb: {'x' * 200}...\na: {'y' * 200}"
    assert (empty["t"], empty["p"]) == ("Task: T", "Task: T\n\nProgress:\n")


def test_native_rendering_has_no_python(rows, plan):
    shown = plan(formats.prepare_chat(formats.prepare_sft(rows, MAP, "{instruction}"), MAP, "s"))
    assert "Python" not in shown and "Arrow" not in shown
