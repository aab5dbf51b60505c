"""The stored index: cells on disk, additions, recall, and collections with one."""

import random

import pytest

from lexweave import RetrievalConfig
from lexweave.operators import search
from lexweave.sources import collections, vector_index

NAMES = {"query_id": "q", "item_id": "i"}


def points(n, seed, start=0):
    draw = random.Random(seed)
    centre = [[draw.gauss(0, 4) for _ in range(6)] for _ in range(8)]
    return [(start + k, [c + draw.gauss(0, 1) for c in centre[k % 8]]) for k in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(points(400, 1), "i long, embedding array<float>")


@pytest.fixture(scope="module")
def asked(corpus):
    return corpus.where("i % 10 = 0").withColumnRenamed("i", "q")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.create_index(corpus.where("i < 200"), path, item_id="i", cells=8, ingest="first")
    vector_index.add_to_index(corpus.where("i >= 200"), path, item_id="i", ingest="second")
    return path


def hits(df):
    return sorted(map(tuple, df.collect()))


def test_asking_all_cells_is_the_exact_search(corpus, asked, index):
    exact = hits(search.nearest(asked, corpus, 4, **NAMES))
    assert hits(vector_index.search_index(asked, index, nprobe=8, **NAMES)) == exact
    assert hits(vector_index.search_index(asked, index, **NAMES)) == exact  # nothing is calibrated yet


def test_a_search_reads_the_cells_it_asks(spark, asked, index, plan):
    one = asked.where("q = 10")
    shown = plan(vector_index.search_index(one, index, nprobe=1, **NAMES))
    assert "PartitionFilters: [isnotnull(cell" in shown or "PartitionFilters: [cell" in shown
    cell = vector_index.indexed_rows(spark, index).where("i = 10").first()["cell"]
    found = vector_index.search_index(one, index, nprobe=1, **NAMES).collect()
    cells = {r["i"]: r["cell"] for r in vector_index.indexed_rows(spark, index).collect()}
    assert {cells[r["i"]] for r in found} == {cell}


def test_recall_is_measured_and_reached(corpus, asked, index):
    curve = vector_index.recall_by_probes(asked, index, 4, **NAMES)
    assert curve == sorted(curve) and len(curve) == 8 and curve[-1] == 1
    probes = vector_index.calibrate(asked, index, 4, 0.9, **NAMES)
    assert curve[probes - 1] >= 0.9 and (probes == 1 or curve[probes - 2] < 0.9)
    exact = {t[::3] for t in hits(search.nearest(asked, corpus, 4, **NAMES))}
    got = {t[::3] for t in hits(vector_index.search_index(asked, index, **NAMES))}
    assert len(exact & got) / len(exact) == pytest.approx(curve[probes - 1])


def test_an_addition_can_be_repeated(spark, corpus, index):
    before = vector_index.centres_of(spark, index).tolist()
    vector_index.add_to_index(corpus.where("i >= 200"), index, item_id="i", ingest="second")
    assert vector_index.indexed_rows(spark, index).count() == 400
    assert vector_index.centres_of(spark, index).tolist() == before
    assert sorted(vector_index.indexed_ingests(spark, index)) == ["first", "second"]


def test_no_index(spark, tmp_path):
    assert vector_index.indexed_ingests(spark, str(tmp_path / "none")) == []
    assert vector_index.probes_of(spark, str(tmp_path / "none")) is None


def test_a_collection_with_an_index(spark, tmp_path):
    root, schema = str(tmp_path), "content string"
    words = ["red", "green", "blue", "house", "sea", "tree"]
    texts = [(f"{a} {b} {c}",) for a in words for b in words for c in words[:2]]
    collections.add_texts(spark.createDataFrame(texts[:40], schema), root, "c", ingest="a")
    assert collections.index_collection(spark, root, "c", cells=4) == ["a"]
    collections.add_texts(spark.createDataFrame(texts[40:], schema), root, "c", ingest="b")
    assert collections.index_collection(spark, root, "c") == ["b"]
    assert collections.index_collection(spark, root, "c") == []
    questions = spark.createDataFrame([(1, "tree sea red"), (2, "red red red")], "query_id int, question string")
    found = [
        [(r["query_id"], r["score"], r["content"]) for r in collections.search(spark, root, "c", questions, RetrievalConfig(k=1), indexed=i).orderBy("query_id").collect()]
        for i in (True, False)
    ]
    assert found[0] == found[1] and [s for _, s, _ in found[0]] == [0, 0]
