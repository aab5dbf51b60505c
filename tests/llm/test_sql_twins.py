"""The numbered queries that SQL can express, against their SQL, and their edges."""

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexweave.llm import divergence, prefix_trie, queries

SF = "/root/testdata/sf0.001"


def same(df, sql, tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    names = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == names
    pick = ", ".join(f'"{n}"' for n in names)
    want = sorted(map(repr, con.sql(f"SELECT {pick} FROM ({sql})").fetchall()))
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert got == want
    return got


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_query_matches_its_sql(spark, name):
    tables = {t: pq.read_table(f"{SF}/{t}.parquet") for t in ("documents", "conversations")}
    assert same(queries.QUERIES[name](spark, SF), queries.SQL[name], tables)


def with_clashes(df, *names):
    return df.withColumns({n: F.lit(1) for n in names})


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rows = [(i, f"Common word{'' if i % 3 else ' Éa'} w{i % 4}, a-b {'x ' * (i % 5)}", "en" if i % 7 else None, f"s{i % 5}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (100, "", "en", "empty", 1), (None, "12 34", "xx", "only", 1), (101, "rare", "yy", "one", 1), (101, "rare", "yy", "one", 1), (102, "y", "yy", None, 1)]
    return rows + [(200 + i, "long " * 4000 + "Éa", "en", f"t{i % 2}", 1) for i in range(3)]


@pytest.mark.parametrize("blocks", [{}, {"groups_in_block": 2, "terms_in_block": 3}])
def test_divergences_of_edges(spark, blocks):
    df = spark.createDataFrame(documents(), DOCS)
    got = divergence.divergences(with_clashes(df, "term", "n", "docs", "block", "p", "part", "value").repartition(5), **blocks)
    same(got, divergence.divergences_sql(), {"documents": df.toArrow()})


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], DOCS)).collect() == []
    rows = spark.createDataFrame([(1, "a b", "en", s, 1) for s in ("x", "y", None)], DOCS)
    got = {tuple(r) for r in divergence.divergences(rows).select("source", "part", "item", "value", "rank").collect()}
    assert got == {("", "pair", "x", 0, 1), ("", "pair", "y", 0, 2), ("x", "pair", "", 0, 1), ("x", "pair", "y", 0, 2),
                   ("y", "pair", "", 0, 1), ("y", "pair", "x", 0, 2)}


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 3 * 10**14 + 7, 10**15 + 1
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(3).cast("long")).alias("p"))
    assert row.first()["p"] == 1 + 10**9 * (n + 2) // (total + 6)


TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    rows = []
    for c in list(range(-7, 40)) + [500, 501, 77777]:
        if c % 11 == 4:
            continue
        say = ["hi", "who?", f"x{c % 3}", f"y{c % 2}", None, "", f"own {c}", "é" * (c % 4), "end", "more", f"z{c}"]
        rows += [(c, t if t else None, None if t == 2 else "ab"[t % 2], say[t]) for t in range(c % 12 if c < 30 else 9)]
    rows += [(5, 3, "a", "tie"), (5, 3, "a", "tie"), (6, 3, "b", "tie"), (None, 1, "a", "nobody")]
    return rows + [(1000, t, "a", f"long {t // 2}") for t in range(400)] + [(1005 + 5 * k, t, "a", f"long {t // 2}") for k in range(6) for t in range(300 + k // 2)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_trie_of_edges(spark, partitions):
    df = spark.createDataFrame(conversations(), TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = prefix_trie.trie(with_clashes(df, "d", "i", "key", "n", "size", "node", "path").repartition(3))
        rows = same(got, prefix_trie.TRIE_SQL, {"conversations": df.toArrow()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(rows) > 400


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "x")], TURNS)).collect() == []


def test_forest_merges_equal_depths():
    key = lambda *turns: b"".join(bytes([t]) * prefix_trie.KEY for t in turns)
    paths = [key(1), key(1, 2), key(1, 3, 4), key(1, 3, 5), key(2)]
    forest = prefix_trie.Forest(paths)
    nodes = forest.nodes()
    assert sorted(forest.depth[k] for k, _ in nodes) == [0, 1, 1, 2, 2, 3, 3]
    assert sum(over < 0 for _, over in nodes) == 1
