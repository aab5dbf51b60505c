import pytest
from pyspark.sql import functions as F

from lexweave.functions import render
from lexweave.operators import traces

TURNS = [
    (1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
    (1, 4, "assistant", ""), (2, 0, "user", ""), (3, 0, "tool", "t"), (3, 1, "assistant", "x"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv int, turn long, role string, text string").repartition(4)


def test_assembly_keeps_every_message_in_one_row(turns):
    rows = traces.assemble(turns, "conv", part=2).collect()
    got = {r["conv"]: [tuple(m) for m in r["messages"]] for r in rows}
    want = {}
    for c, t, role, text in TURNS:
        want.setdefault(c, []).append((role, text))
    assert got == want and len(rows) == 3
    two = traces.assemble(turns, "conv", two_roles=True).where("conv = 3").first()["messages"]
    assert [m["role"] for m in two] == ["user", "assistant"]


def test_a_conversation_of_any_length_has_one_prompt(spark):
    long = spark.range(2001).selectExpr("7 AS conv", "id AS turn", "'user' AS role", "IF(id = 5, NULL, string(id)) AS text")
    whole = traces.assemble(long.repartition(4), "conv")
    (text,) = [r[0] for r in whole.select(render.render_tagged(F.col("messages"))).collect()]
    said = [f"<|user|>\n{'' if i == 5 else i}</s>" for i in range(2001)]
    assert text == "\n".join([*said, "<|assistant|>"])


def test_runs_in_which_no_agent_spoke(turns):
    rows = traces.fold_context(turns, "conv", ["tool"])
    assert {r["conv"]: [tuple(e) for e in r["context"]] for r in rows.collect()} == {1: [], 2: [], 3: [("tool_output", "t")]}
    first = traces.route_next(F.when(F.size("context") > 0, F.col("context")), F.lit(1), ["user", "tool"])
    assert {r[0] for r in rows.select(first).collect()} == {"user"}


def test_final_output_is_the_last_text(turns):
    assert dict(traces.final_output(turns, "conv").collect()) == {1: "u2", 2: "", 3: "x"}


def test_context_keeps_first_place_and_latest_text(turns):
    rows = traces.fold_context(turns, "conv", ["assistant", "user"]).collect()
    got = {r["conv"]: [tuple(e) for e in r["context"]] for r in rows}
    assert got[1] == [("user_output", "u2"), ("assistant_output", "")]
    assert got[3] == [("assistant_output", "x")]


def test_recent_messages(turns, plan):
    recent = traces.recent_messages(turns, "conv", 2)
    assert sorted((r["conv"], r["turn"]) for r in recent.collect()) == [(1, 3), (1, 4), (2, 0), (3, 0), (3, 1)]
    assert "WindowGroupLimit" in plan(recent)


@pytest.mark.parametrize("part", [2, 1000])
def test_buffer_window(turns, part):
    kept = traces.buffer_window(turns, "conv", F.length("text"), limit=4, part=part)
    assert sorted((r["conv"], r["turn"]) for r in kept.collect()) == [
        (1, 2), (1, 3), (1, 4), (2, 0), (3, 0), (3, 1),
    ]


def test_decisions(spark):
    said = [" Writer\n", "WRITER", "done", "nobody", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i")
    got = [r["d"] for r in df.select(traces.parse_decision(F.col("t"), ["writer", "Done"]).alias("d")).collect()]
    assert got == ["writer", "writer", "end", "end", "end", "end"]


def test_routing(spark):
    kind = "c array<struct<key:string,value:string>>, n int"
    rows = [
        ([], 1), ([("a_output", "x")], 2), ([("b_output", "x")], 2), ([("start", "x")], 1),
        ([("start", "x"), ("a_output", "y")], 1), ([], 5), ([], 6),
    ]
    df = spark.createDataFrame(rows, kind).select(traces.route_next(F.col("c"), F.col("n"), ["a", "b"]).alias("d"))
    assert [r["d"] for r in df.collect()] == ["a", "b", "a", "a", "end", "a", "end"]


def test_pairs_need_the_very_next_turn(turns):
    rows = traces.next_turn_pairs(turns, "conv").collect()
    assert sorted((r["conv"], r["turn"], r["instruction"], r["output"]) for r in rows) == [
        (1, 1, "u1", "a1"), (1, 3, "u2", ""),
    ]
