import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexweave import SplitConfig
from lexweave.operators import ranking
from lexweave.operators.joins import lookup_join
from lexweave.operators.split import (
    evaluation_split, split, split_counts, split_sizes, union_splits,
)


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def order(n, seed=42):
    return sorted(range(n), key=lambda i: key(i, seed))


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("digits, segment", [(1, 1_000_000), (1, 3), (3, 1_000_000)])
def test_global_rank_is_the_seeded_order(spark, partitions, digits, segment):
    df = spark.range(200).repartition(partitions).withColumn("k", ranking.seeded_key(42, "id"))
    ranked = ranking.with_position(df, "pos", "k", digits=digits, segment=segment)
    got = [r["id"] for r in ranked.orderBy("pos").collect()]
    assert got == order(200)
    assert sorted(r["pos"] for r in ranked.collect()) == list(range(1, 201))


def test_group_positions_with_a_hot_and_a_missing_group(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "cold") for i in range(100)]
    df = spark.createDataFrame(rows, "i long, g string").repartition(5)
    for segment in (4, 1000):
        out = ranking.with_position(df, "pos", "i", by=["g"], segment=segment).collect()
        for g in ("hot", "cold", None):
            ids = sorted(i for i, group in rows if group == g)
            assert {r["i"]: r["pos"] for r in out if r["g"] == g} == {v: p + 1 for p, v in enumerate(ids)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions_of_scattered_keys(spark, plan, by):
    rng = random.Random(5)
    keys = list({rng.getrandbits(62) - (1 << 61) for _ in range(300)})
    rows = [(k, "hot" if i % 4 else None if i % 8 else "cold") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(5)
    placed = ranking.with_position(df, "pos", "k", by=by)
    shown = plan(placed)
    assert "SinglePartition" not in shown and shown.count("__part") > 0
    assert placed.columns == ["k", "g", "pos"]
    for g in ("hot", "cold", None) if by else ("all",):
        mine = sorted(k for k, group in rows if group == g or not by)
        assert {r["k"]: r["pos"] for r in placed.collect() if r["g"] == g or not by} == {k: p + 1 for p, k in enumerate(mine)}


def test_scattered_segments_are_bounded(spark):
    keys = [(i * 7919 % 1000 << 50,) for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small segments would be one
    try:
        marked = ranking.key_segments(spark.createDataFrame(keys, "k long").withColumn("g", F.lit(1)), ["g"], "k")
        sizes = [r["count"] for r in marked.groupBy(ranking.KEY).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 1000 and 2 <= len(sizes) <= 8 and max(sizes) < 600


def test_position_by_range_takes_any_key(spark):
    rows = [(None, "x"), (None, "x"), (2.5, None), (-1.0, "a"), (2.5, "b")]
    df = spark.createDataFrame(rows, "a double, b string")
    placed = {r["pos"]: (r["a"], r["b"]) for r in ranking.position_by_range(df, "pos", [], ["a", "b"]).collect()}
    assert placed == {1: (None, "x"), 2: (None, "x"), 3: (-1.0, "a"), 4: (2.5, None), 5: (2.5, "b")}
    assert ranking.position_by_range(df.limit(0), "pos", ["b"], ["a"]).collect() == []


def test_running_values_equal_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 50)) for g in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i long, v int")
    marked = ranking.segmented(df, ["g"], ranking.block("i", 7))
    out = ranking.running(
        marked, ["g"], [F.col("i")],
        {
            "low": ranking.Running("min", F.col("v"), inclusive=False),
            "high": ranking.Running("max", F.col("v")),
            "total": ranking.Running("sum", F.col("v")),
        },
    )
    for r in out.collect():
        seen = [v for g, i, v in rows if g == r["g"] and i <= r["i"]]
        assert (r["low"], r["high"], r["total"]) == (min(seen[:-1], default=None), max(seen), sum(seen))


def test_running_values_need_one_shuffle_of_the_rows(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumn("wide", F.lit("x")).write.parquet(path)
    df = spark.read.parquet(path)
    shown = plan(ranking.with_position(df, "pos", "id", segment=10))
    moved = [line for line in shown.splitlines() if "Exchange" in line and "wide" in line]
    assert len(moved) <= 1


def test_top_per_group_limits_before_the_shuffle(spark, plan):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    top = ranking.top_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert plan(top).count("WindowGroupLimit") == 2
    assert sorted((r["g"], r["id"]) for r in top.collect()) == [
        (0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998),
    ]


def test_sample_head_and_shuffle(spark, plan):
    df = spark.range(30).repartition(4)
    head = ranking.sample_head(df, [F.col("id")], 10)
    assert "TakeOrderedAndProject" in plan(head)
    assert [r["id"] for r in head.collect()] == list(range(10))
    assert [r["id"] for r in ranking.sample_head(df, [F.col("id")], 99).collect()] == list(range(30))
    for partitions in (1, 5):
        again = ranking.shuffled(df.repartition(partitions), "id")
        assert [r["id"] for r in again.collect()] == order(30)


@pytest.mark.parametrize(
    "n, ratios, want",
    [
        (0, (0.8, 0.1, 0.1), {"train": 0}),
        (1, (0.8, 0.1, 0.1), {"train": 1}),
        (9, (0.8, 0.1, 0.1), {"train": 9}),
        (10, (0.8, 0.1, 0.1), {"train": 8, "validation": 1, "test": 1}),
        (19, (0.9, 0.05, 0.05), {"train": 18, "validation": 1}),
        (20, (0.9, 0.05, 0.05), {"train": 18, "validation": 1, "test": 1}),
        (100, (0.9, 0.1, 0.0), {"train": 90, "validation": 10}),
        (15, (0.8, 0.1, 0.1), {"train": 12, "validation": 1, "test": 2}),
    ],
)
def test_split_sizes(n, ratios, want):
    assert split_sizes(n, *ratios) == want


@pytest.mark.parametrize("n, ratios", [(100, (1.0, 0.0, 0.0)), (100, (0.8, 0.0, 0.2)), (10, (0.05, 0.5, 0.45))])
def test_empty_parts_are_an_error(n, ratios):
    with pytest.raises(ValueError):
        split_sizes(n, *ratios)


@pytest.mark.parametrize("n", [9, 10, 19, 20, 333])
@pytest.mark.parametrize("sort_rows", [1, 100_000])
def test_split_is_disjoint_complete_and_exact(spark, n, sort_rows):
    df = spark.range(n).repartition(3)
    out = split(df, ["id"], sort_rows=sort_rows)
    got = {r["id"]: r["split"] for r in out.collect()}
    want, at = {}, 0
    ids = order(n)
    for name, size in split_sizes(n, 0.8, 0.1, 0.1).items():
        want |= {i: name for i in ids[at : at + size]}
        at += size
    assert got == want
    assert {r["split"]: r["rows"] for r in split_counts(out).collect()} == split_sizes(n, 0.8, 0.1, 0.1)


def test_split_of_skewed_keys_goes_deeper(spark):
    # Ordered ids share long prefixes, as ids of one range do.
    df = spark.range(500).select((F.col("id") + (1 << 40)).alias("id"))
    out = split(df, ["id"], SplitConfig(shuffle=False), sort_rows=4)
    names = [r["split"] for r in out.orderBy("id").collect()]
    assert names == ["train"] * 400 + ["validation"] * 50 + ["test"] * 50


def test_split_moves_no_rows(spark, plan):
    df = spark.range(1000).withColumn("wide", F.lit("x"))
    assert "Exchange" not in plan(split(df, ["id"]))


def test_stratified_split(spark):
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 200, "hot").when(F.col("id") < 260, "b"))
    out = split(df, ["id"], SplitConfig(stratify="g")).groupBy("g", "split").count().collect()
    got = {(r["g"], r["split"]): r["count"] for r in out}
    assert (got[("hot", "train")], got[("hot", "validation")], got[("hot", "test")]) == (160, 20, 20)
    assert (got[("b", "train")], got[("b", "validation")], got[("b", "test")]) == (48, 6, 6)
    assert (got[(None, "train")], got[(None, "validation")], got[(None, "test")]) == (32, 4, 4)


def test_given_files_are_the_splits(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([(2,)], "i int")
    out = union_splits(a, None, b)
    assert sorted((r["i"], r["split"]) for r in out.collect()) == [(1, "train"), (2, "test")]


def test_evaluation_falls_back_to_validation(spark):
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "test")], "i int, split string")
    assert [r["i"] for r in evaluation_split(df).collect()] == [3]
    assert [r["i"] for r in evaluation_split(df.where("i < 3")).collect()] == [2]


def test_lookup_join_with_hot_and_missing_keys(spark, plan):
    rows = [(i, "hot" if i < 50 else None if i < 70 else f"k{i % 7}") for i in range(100)]
    left = spark.createDataFrame(rows, "i int, k string").repartition(4)
    right = spark.createDataFrame([("hot", "H")] + [(f"k{j}", f"v{j}") for j in range(6)], "k string, v string")
    want = {i: {"hot": "H", None: None, "k6": None}.get(k, k and "v" + k[1:]) for i, k in rows}
    joined = lookup_join(left, right, "k")
    assert {r["i"]: r["v"] for r in joined.collect()} == want
    assert joined.count() == 100
    assert "Union" not in plan(joined)


def test_ordered_split_of_negative_and_large_ids(spark):
    for start, step in ((-50, 1), (-(1 << 62), 1 << 55)):
        df = spark.createDataFrame([(start + i * step,) for i in range(100)], "id long")
        out = split(df, ["id"], SplitConfig(shuffle=False), sort_rows=4).orderBy("id").collect()
        assert [r["split"] for r in out] == ["train"] * 80 + ["validation"] * 10 + ["test"] * 10


def test_repeated_ids_are_an_error(spark):
    same = spark.range(100).select(F.lit(7).alias("id"))
    for rows in (1000, 10):
        with pytest.raises(ValueError):
            split(same, ["id"], SplitConfig(), sort_rows=rows)


def test_small_strata_add_up(spark):
    for strata, n in ((100, 100), (50, 100), (7, 100), (3, 9)):
        df = spark.range(n).withColumn("g", F.col("id") % strata)
        out = split(df, ["id"], SplitConfig(stratify="g"))
        got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert got == split_sizes(n, 0.8, 0.1, 0.1)
    with pytest.raises(ValueError):
        split(df, ["id"], SplitConfig(stratify="g", shuffle=False))
