import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexweave import ColumnMap, PrepConfig
from lexweave.functions import text
from lexweave.operators import prep

MAP = ColumnMap()


def values(df, c):
    return [r[c] for r in df.collect()]


EDGES = [" a ", "\xa0\ta　", " x y ", "\x1cz\x1f", "\x85q", "", " \t\n", "a\n", "\U0001f600 b ", "a  b\n\nc"]


def test_strip_and_clean_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string").orderBy("i")
    assert values(df.select(text.strip("t").alias("t")), "t") == [t.strip() for t in EDGES]
    assert values(df.select(text.clean("t").alias("t")), "t") == [
        re.sub(r"\s+", " ", t).strip() for t in EDGES
    ]
    assert values(df.select(text.words("t").alias("t")), "t") == [t.split() for t in EDGES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aÄ \t\n\xa0 \x1d\U0001f600.", max_size=30), min_size=1, max_size=40))
def test_text_functions_equal_python_on_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", text.strip("t").alias("s"), text.clean("t").alias("c"), text.words("t").alias("w"))
    for i, s, c, w in rows.collect():
        t = texts[i]
        assert (s, c, w) == (t.strip(), re.sub(r"\s+", " ", t).strip(), t.split())


def test_preview_counts_characters(spark):
    rows = ["x" * 49, "x" * 50, "x" * 51, "\U0001f600" * 51, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    assert values(df.select(text.preview("t", 50).alias("p")), "p") == [
        None if t is None else t[:50] + "..." if len(t) > 50 else t for t in rows
    ]


def test_length_bounds_are_inclusive_and_ignore_the_input(spark):
    rows = [("i" * 10, "", "o" * 20), ("i" * 9, "", "o" * 15), ("i" * 10, "x" * 99, "o" * 21), (None, "", "o" * 12)]
    df = spark.createDataFrame(rows, "instruction string, input string, output string")
    kept = prep.filter_length(df, MAP, PrepConfig(min_length=10, max_length=20))
    assert [r["output"] for r in kept.collect()] == ["o" * 20]


def test_nulls_stay_null_unless_asked_for(spark):
    df = spark.createDataFrame([(" A ", None, "B" * 12)], "instruction string, input string, output string")
    plain = prep.preprocess(df, MAP, PrepConfig(min_length=1, lowercase=True)).first()
    assert tuple(plain) == ("a", None, "b" * 12)
    as_text = prep.preprocess(df, MAP, PrepConfig(min_length=1, stringify_nulls=True)).first()
    assert as_text["input"] == "nan"


def test_null_text_counts_three_characters_when_asked_for(spark):
    df = spark.createDataFrame([(None, "abc")], "instruction string, output string")
    keep = PrepConfig(strip=False, min_length=3, stringify_nulls=True)
    assert prep.filter_length(df, MAP, keep).count() == 1
    assert prep.filter_length(df, MAP, PrepConfig(min_length=3)).count() == 0


def test_other_columns_ride_along_and_count_in_dedup(spark):
    rows = [("q" * 10, "a" * 10, 1), ("q" * 10 + " ", "a" * 10, 1), ("q" * 10, "a" * 10, 2)]
    df = spark.createDataFrame(rows, "instruction string, output string, n int")
    assert sorted(r["n"] for r in prep.preprocess(df, MAP).collect()) == [1, 2]


def test_observed_counts_and_funnel(spark):
    rows = [("q" * 10, "a" * 10)] * 3 + [("q" * 10, "short")]
    df = spark.createDataFrame(rows, "instruction string, output string")
    before, after = Observation(), Observation()
    assert prep.preprocess(df, MAP, before=before, after=after).count() == 1
    assert (before.get["rows"], after.get["rows"]) == (4, 1)
    assert tuple(prep.prep_funnel(df, MAP).first()) == (4, 2, 1)
    copies = prep.prep_funnel(df, MAP, PrepConfig(drop_duplicates=False)).first()
    assert tuple(copies) == (4, 4, 3)
    assert tuple(prep.prep_funnel(df.limit(0), MAP).first()) == (0, 0, 0)


def test_required_columns_are_checked_without_a_job():
    with pytest.raises(ValueError, match="output.*instruction"):
        ColumnMap().validate(["instruction"])
    with pytest.raises(ValueError, match="rejected"):
        ColumnMap.preference().validate(["prompt", "chosen"])
    ColumnMap(output=None, chosen="c", rejected=None).validate(["instruction"])
    ColumnMap().validate(["instruction", "output"])


def test_length_filter_runs_before_the_dedup_shuffle(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "b")], "instruction string, output string").write.parquet(path)
    text_plan = plan(prep.preprocess(spark.read.parquet(path), MAP))
    assert text_plan.index("Exchange hashpartitioning") < text_plan.index("Filter")
    assert "Python" not in text_plan and "Arrow" not in text_plan
