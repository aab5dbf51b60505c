from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm.common import word_count
from lexweave.llm.mixing import MixConfig, mix, mixed_texts, sainte_lague, source_targets, taken_of_shard


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 80))
def test_seats_go_to_the_highest_quotients(parties, seats):
    votes, limits = zip(*parties)
    rest, want = list(limits), [0] * len(votes)
    for _ in range(min(seats, sum(limits))):
        best = max((i for i in range(len(votes)) if rest[i]), key=lambda i: (Fraction(votes[i], 2 * want[i] + 1), -i))
        want[best] += 1
        rest[best] -= 1
    got = sainte_lague(np.array(votes), np.array(limits), seats)
    assert got.sum() == sum(want)
    # Votes are floats inside, so only exact ties may be dealt differently.
    quotient = [Fraction(v, 2 * n + 1) for v, n in zip(votes, want)]
    assert got.tolist() == want or len(set(quotient)) < len(quotient) or any(
        Fraction(v, 2 * n - 1) in quotient for v, n in zip(votes, want) if n
    )


def test_targets_stop_at_twice_the_size():
    assert source_targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert source_targets([0, 10], [3, 1], 1.5, 2) == [0.0, 15.0]
    assert source_targets([], [], 1.5, 2) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(1, 9), st.data())
def test_words_of_a_shard(sizes, blocks, data):
    quota = data.draw(st.integers(0, 2 * blocks))
    sizes = np.array(sizes)
    passes, taken, pieces = taken_of_shard(sizes, blocks, quota, np.random.default_rng(1))
    picked = np.zeros(blocks, bool)
    picked[np.random.default_rng(1).permutation(blocks)[: quota % blocks]] = True
    n = int(sizes.sum())
    word = np.concatenate([np.full((k + 1) * n // blocks - k * n // blocks, picked[k]) for k in range(blocks)])
    for got, parts, span in zip(taken, pieces, np.split(word, np.cumsum(sizes)[:-1])):
        assert got == passes * len(span) + span.sum()
        mine = np.zeros(len(span), int)
        for a, b in zip(parts[::2], parts[1::2]):
            mine[a:b] += 1
        assert (mine == span).all()


ROWS = [(i, f"s{i % 3}" if i % 7 else None, "w " * (i % 50)) for i in range(600)]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, s, 1) for i, s, t in rows], "doc_id long, text string, source string, size int")


def test_sources_come_near_their_targets(spark):
    cfg = MixConfig(shard_words=1000)
    df = documents(spark)
    got = mix(df, word_count(F.col("text")), cfg=cfg).toPandas().sort_values("id")
    assert len(got) == 600 and (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby(got.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.03 * g.target.iloc[0]
        assert (g.source_size == g["size"].sum()).all()
    again = mix(df.repartition(7), word_count(F.col("text")), cfg=cfg).toPandas().sort_values("id")
    assert got.taken.tolist() == again.taken.tolist()
    # Weights 3, 1, 2, 3 in code point order, null last, and no source over twice its words.
    sizes = [sum(len(t.split()) for _, s, t in ROWS if s == n) for n in ("s0", "s1", "s2", None)]
    want = source_targets(sizes, [3, 1, 2, 3], 1.5, 2)
    assert sorted(set(got.target)) == pytest.approx(sorted(want))


def test_edges(spark):
    rows = [(1, None, None), (1, None, ""), (None, "a", "x y z"), (None, "a", "x y z"), (3, "a", "w " * 9000)]
    got = mix(documents(spark, rows), word_count(F.col("text"))).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got if r["size"] == 0) == 0
    assert abs(sum(r["taken"] for r in got) - 1.5 * 9006) < 100
    assert mix(documents(spark, []), word_count(F.col("text"))).collect() == []


def test_mixed_texts_have_the_words_taken(spark):
    df = documents(spark).withColumn("mix_id", F.lit("clash"))
    plan = {r["id"]: r["taken"] for r in mix(df, word_count(F.col("text"))).collect()}
    got = mixed_texts(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: len(r["text"].split()) for r in got.collect()} == {i: n for i, n in plan.items() if n}


def test_a_small_source_leaves_the_blocks_of_others(spark):
    rows = [(i, "large", "w " * 500) for i in range(400)] + [(1000 + i, None, "w " * 15) for i in range(10)]
    got = mix(documents(spark, rows), word_count(F.col("text"))).toPandas()
    large, small = got[got.source == "large"], got[got.source.isna()]
    assert small["size"].sum() == 150 and abs(small.taken.sum() - small.target.iloc[0]) <= 1
    assert abs(large.taken.sum() - large.target.iloc[0]) <= 1024
    # Runs of whole blocks end inside a document at most once for each 1,000 words or so.
    cuts = sum(a > 0 for parts, n in zip(large.pieces, large["size"]) for a in parts[::2])
    cuts += sum(b < n for parts, n in zip(large.pieces, large["size"]) for b in parts[1::2])
    assert 0 < cuts <= 200
