import csv
import random

import pytest
from pyspark.sql import functions as F

from lexweave import ChunkConfig, ColumnMap, PrepConfig, RetrievalConfig, SplitConfig
from lexweave.config import DatasetConfig, ReadConfig
from lexweave.operators.split import split
from lexweave.sources import collections, quoted, readers, writers

ROWS = [["instruction", "input", "output"], ['Say "hi", now', "", "line one\nline two"], ["q\t2", "NA", "é"]]


def write(path, rows, delimiter=",", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, delimiter=delimiter).writerows(rows)
    return str(path)


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_quotes_line_breaks_and_nulls(spark, tmp_path):
    path = write(tmp_path / "a.csv", ROWS)
    assert tuples(readers.read_table(spark, path)) == [
        ('Say "hi", now', None, "line one\nline two"), ("q\t2", "NA", "é"),
    ]
    marked = readers.read_table(spark, path, ReadConfig(na_values=readers.NA_VALUES))
    assert tuples(marked)[1] == ("q\t2", None, "é")


def test_tabs_headerless_encoding_and_json(spark, tmp_path):
    path = write(tmp_path / "a.tsv", ROWS, "\t", "latin-1")
    for cfg in (ReadConfig(delimiter="\\t", encoding="latin1"), ReadConfig(fmt="tsv", encoding="latin1")):
        assert tuples(readers.read_table(spark, path, cfg))[1] == ("q\t2", "NA", "é")
    path = write(tmp_path / "b.csv", ROWS[1:])
    cfg = ReadConfig(header=False)
    assert readers.read_table(spark, path, cfg).columns == ["_c0", "_c1", "_c2"]
    named = readers.read_table(spark, path, ReadConfig(header=False, names=("a", "b", "c")))
    assert named.columns == ["a", "b", "c"] and named.count() == 2
    (tmp_path / "c.jsonl").write_text('{"a": "x\\ny", "b": 1}\n{"a": null}\n')
    table = readers.read_table(spark, str(tmp_path / "c.jsonl"), ReadConfig(fmt="jsonl"))
    assert tuples(table) == [("x\ny", "1"), (None, None)]
    typed = readers.read_table(spark, str(tmp_path / "c.jsonl"), ReadConfig(fmt="jsonl"), "b int")
    assert tuples(typed) == [(1,), (None,)]
    with pytest.raises(ValueError):
        readers.read_table(spark, path, ReadConfig(fmt="xml"))


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "150")
    yield
    spark.conf.set(key, before)


def whole(spark, path, header=True):
    """What one task makes of each file."""
    return spark.read.options(header=header, multiLine=True, quote='"', escape='"').csv(path)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_line_breaks_are_read_in_splits(spark, tmp_path, small_splits, seed, ending):
    draw = random.Random(seed)
    field = lambda: "".join(draw.choice(["a", "b ", ",", '"', "\n", "\r\n", "é", "12", " "]) for _ in range(draw.choice([0, 1, 5, 9, 9, 400 if draw.random() < 0.1 else 3])))
    rows = [[f"c {i}" for i in range(3)]] + [[f"{i}", field(), field()] for i in range(60)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        with open(tmp_path / "in" / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator=ending).writerows(rows[: 1 + len(rows) // (k + 1)])
    path = str(tmp_path / "in")
    for header in (True, False):
        got = readers.read_table(spark, path, ReadConfig(header=header))
        # Spark turns line breaks inside quotes to plain ones where lines end in two characters; here they stay.
        plain = lambda r: str(tuple(x and x.replace("\r\n", "\n") for x in r))
        assert sorted(map(plain, got.collect())) == sorted(map(plain, whole(spark, path, header).collect()))
        with open(tmp_path / "in" / "0.csv", newline="", encoding="utf-8") as f:
            exact = {r[0]: tuple(x or None for x in r) for r in csv.reader(f)}
        assert all(exact[r[0]] == tuple(r) for r in got.collect())
    one = readers.read_table(spark, str(tmp_path / "in" / "0.csv"), row_id="at")
    assert [r["c 0"] for r in one.orderBy("at").collect()] == [f"{i}" for i in range(60)]
    splits = quoted.splits_of(spark, path, ",", "utf-8", {})
    assert len(splits) > 10 and any(s.inside for s in splits.values())


def test_a_header_and_a_record_over_many_splits(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.csv", [["x" * 200 + "\n" + "y" * 300, "b"], ["1", "line\n" * 200], ["2", "z"]])
    got = readers.read_table(spark, path)
    assert got.columns == whole(spark, path).columns
    assert sorted(tuples(got)) == [("1", "line\n" * 200), ("2", "z")]


def test_quotes_in_bare_fields_are_read_by_one_task(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('a,b\n5" pipe,x\n"q ""r""","s\nt"\n')
    path = str(tmp_path / "a.csv")
    assert quoted.splits_of(spark, path, ",", "utf-8", {}) is None
    assert tuples(readers.read_table(spark, path)) == [('5" pipe', "x"), ('q "r"', "s\nt")]
    (tmp_path / "b.csv").write_text('a,b\n"","x"\n"""q"," y """\n')
    assert quoted.splits_of(spark, str(tmp_path / "b.csv"), ",", "utf-8", {}) is not None
    assert tuples(readers.read_table(spark, str(tmp_path / "b.csv"))) == tuples(whole(spark, str(tmp_path / "b.csv")))


def test_missing_file_fails_at_once(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="no file"):
        readers.load_documents(spark, str(tmp_path / "none"))


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("first\n\nfile")
    (tmp_path / "sub" / "deep" / "b.txt").write_text("second")
    (tmp_path / "sub" / "c.md").write_text("not read")
    write(tmp_path / "sub" / "d.csv", [["x", "y"], [" 1 ", "two\nlines"], ["3", ""]])
    write(tmp_path / "e.csv", [["x", "y"], ["5", "six"]])
    return tmp_path


def test_text_files_anywhere_below(spark, tree):
    docs = readers.load_documents(spark, str(tree)).collect()
    assert sorted(r["content"] for r in docs) == ["first\n\nfile", "second"]
    assert all(r["metadata"]["source"].endswith(".txt") for r in docs)
    one = readers.load_documents(spark, str(tree / "a.txt")).collect()
    assert [r["content"] for r in one] == ["first\n\nfile"]
    (tree / "my notes.md").write_text("spaced")
    spaced = readers.load_documents(spark, str(tree / "my notes.md")).collect()
    assert [r["content"] for r in spaced] == ["spaced"]


def test_rows_as_documents(spark, tree):
    docs = readers.load_documents(spark, str(tree), "csv").collect()
    got = {(r["metadata"]["source"].rsplit("/", 1)[1], r["metadata"]["row"]): r["content"] for r in docs}
    assert got == {
        ("d.csv", "0"): "x: 1\ny: two\nlines", ("d.csv", "1"): "x: 3\ny: ", ("e.csv", "0"): "x: 5\ny: six",
    }


def dataset(tmp_path, **options):
    rows = [["instruction", "output"]] + [[f"question {i:03d}", f"answer number {i}"] for i in range(60)]
    rows += [["question 000 ", "answer number 0"], ["short", "x"]]
    return DatasetConfig(train_file=write(tmp_path / "train.csv", rows), **options)


def test_dataset_is_cleaned_and_split(spark, tmp_path):
    out = readers.load_dataset(spark, dataset(tmp_path))
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 48, "validation": 6, "test": 6}
    assert out.columns == ["instruction", "output", "split"]
    again = readers.load_dataset(spark, dataset(tmp_path))
    assert sorted(tuples(out)) == sorted(tuples(again))


def test_dataset_in_file_order_and_with_copies(spark, tmp_path):
    ordered = readers.load_dataset(spark, dataset(tmp_path, split=SplitConfig(shuffle=False)))
    got = sorted(r["instruction"] for r in ordered.where("split = 'train'").collect())
    assert got == [f"question {i:03d}" for i in range(48)]
    copies = readers.load_dataset(spark, dataset(tmp_path, prep=PrepConfig(drop_duplicates=False)))
    assert copies.count() == 61 and copies.where("split = 'train'").count() == 48


def test_dataset_with_given_files(spark, tmp_path):
    other = write(tmp_path / "val.csv", [["instruction", "output"], ["question val", "answer is long"]])
    out = readers.load_dataset(spark, dataset(tmp_path, val_file=other))
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 60, "validation": 1}


def test_dataset_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="train file"):
        readers.load_dataset(spark, DatasetConfig())
    with pytest.raises(ValueError, match="chosen"):
        readers.load_dataset(spark, dataset(tmp_path, columns=ColumnMap("instruction", None, None, "chosen", "rejected")))


def test_reading_one_split_prunes_the_others(spark, tmp_path, plan):
    path = str(tmp_path / "out")
    writers.write_dataset(split(spark.range(100), ["id"]), path)
    part = spark.read.parquet(path).where(F.col("split") == "test")
    assert part.count() == 10 and "PartitionFilters: [isnotnull(split" in plan(part)


def texts(spark, values):
    df = spark.createDataFrame([(v, {"source": f"s{i}"}) for i, v in enumerate(values)], "content string, metadata map<string,string>")
    return df


def test_collections_append_upsert_clear(spark, tmp_path):
    root = str(tmp_path / "store")
    open_ = lambda name: collections.open_collection(spark, root, name)
    assert open_("a").count() == 0
    ids = collections.add_texts(texts(spark, ["x", "y"]), root, "a")
    assert ids.distinct().count() == 2
    collections.add_texts(texts(spark, ["x", "y"]), root, "a")
    assert open_("a").count() == 4
    collections.add_texts(texts(spark, ["x", "y", "z"]), root, "a", "upsert")
    assert open_("a").count() == 5 and open_("a").select("chunk_id").distinct().count() == 3
    collections.add_texts(spark.createDataFrame([("plain",)], "content string"), root, "b")
    assert open_("b").first()["source"] == "text"
    collections.clear_collection(spark, root, "a")
    assert open_("a").count() == 0 and open_("b").count() == 1
    collections.add_texts(texts(spark, ["x"]), root, "a")
    assert open_("a").count() == 1
    with pytest.raises(ValueError):
        collections.add_texts(texts(spark, ["x"]), root, "a", "replace")


def test_a_repeated_addition_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "store")
    for mode in ("append", "upsert"):
        for _ in range(2):
            collections.add_texts(texts(spark, ["x", "y"]), root, mode, mode, ingest="one")
        assert collections.open_collection(spark, root, mode).count() == 2


def test_ingest_and_search(spark, tree, tmp_path):
    root = str(tmp_path / "store")
    assert collections.ingest(spark, str(tree), root, "docs", cfg=ChunkConfig(8, 0)) == 3
    asked = spark.createDataFrame([(1, "second"), (2, "first file")], "query_id int, question string")
    hits = collections.search(spark, root, "docs", asked, RetrievalConfig(k=2)).orderBy("query_id", "rank").collect()
    assert [(h["query_id"], h["rank"], h["content"]) for h in hits[:1]] == [(1, 1, "second")]
    assert {h["content"] for h in hits if h["query_id"] == 2} == {"first", "file"}
    assert hits[0]["score"] == 0 and hits[0]["metadata"]["source"].endswith("b.txt")
    collections.ingest(spark, str(tree), root, "docs", cfg=ChunkConfig(8, 0))
    again = collections.search(spark, root, "docs", asked, RetrievalConfig(k=2)).orderBy("query_id", "rank")
    assert again.collect() == hits
    near = collections.search(spark, root, "docs", asked, RetrievalConfig(k=2, max_distance=0.1))
    assert near.count() == 1
    mixed = collections.search(spark, root, "docs", asked, RetrievalConfig("mmr", k=2))
    assert mixed.count() == 4
    with pytest.raises(ValueError):
        collections.search(spark, root, "docs", asked, RetrievalConfig("other"))


def test_images_are_joined_by_path(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(b"12345")
    images = readers.read_images(spark, str(tmp_path))
    path = images.first()["path"]
    refs = spark.createDataFrame([(1, [path, "gone.png"]), (2, [])], "i int, images array<string>")
    got = {r["image"]: r["length"] for r in readers.attach_images(refs, images).collect()}
    assert got == {path: 5, "gone.png": None}


def test_a_single_file_with_a_blank_in_its_name(spark, tmp_path):
    (tmp_path / "my notes.md").write_text("noted")
    assert [r["content"] for r in readers.load_documents(spark, str(tmp_path / "my notes.md")).collect()] == ["noted"]
    assert readers.load_documents(spark, f"file:{tmp_path}", "md").count() == 1
