import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexweave import ChunkConfig, ColumnMap
from lexweave.operators.prep import preprocess
from lexweave.operators.traces import assemble
from lexweave.sources import collections
from lexweave.streaming import jobs


@pytest.fixture
def feed(spark, tmp_path):
    """Drop a table into the watched folder, then run a job over what is new."""
    folder = str(tmp_path / "in")

    def drop(df):
        df.write.mode("append").parquet(folder)
        return jobs.arriving(spark, folder, df)

    return drop


def test_ingest_in_two_arrivals_equals_one_batch(spark, feed, tmp_path):
    schema = "content string, metadata map<string,string>"
    first = spark.createDataFrame([("one two three", {"source": "a"})], schema)
    second = spark.createDataFrame([("four five six seven", {"source": "b"}), ("eight", {"source": "c"})], schema)
    root, progress, cfg = str(tmp_path / "store"), str(tmp_path / "progress"), ChunkConfig(8, 0)
    for part in (first, second):
        jobs.stream_ingest(feed(part), root, "s", progress, cfg).awaitTermination()
    # Nothing new: nothing changes.
    jobs.stream_ingest(jobs.arriving(spark, str(tmp_path / "in"), first), root, "s", progress, cfg).awaitTermination()
    collections.add_chunks(collections.document_chunks(first.union(second), cfg), root, "b")
    rows = lambda name: sorted(
        tuple(r) for r in collections.open_collection(spark, root, name).select("chunk_id", "content").collect()
    )
    assert rows("s") == rows("b") and len(rows("s")) == 7


def test_history_grows_with_arriving_turns(spark, feed, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    parts = [[(1, 0, "user", "a"), (2, 0, "user", "x")], [(1, 1, "assistant", "b")], [(1, 2, "user", "c")]]
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for part in parts:
        stream = feed(spark.createDataFrame(part, schema))
        jobs.stream_history(stream, out, progress, part=2).awaitTermination()
    whole = spark.createDataFrame(sum(parts, []), schema)
    rows = lambda df: sorted((r["conv_id"], r["messages"]) for r in df.collect())
    got = jobs.current_history(spark, out)
    assert rows(got) == rows(assemble(whole, "conv_id", part=2))


def test_cleaning_equals_the_batch_result(spark, feed, tmp_path):
    schema = "instruction string, output string"
    a = [("q" * 10, "a" * 10), ("q" * 10 + " ", "a" * 10), ("q", "a")]
    b = [("q" * 10, "a" * 10), ("r" * 10, "b" * 10)]
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for part in (a, b):
        jobs.stream_prep(feed(spark.createDataFrame(part, schema)), out, progress, ColumnMap()).awaitTermination()
    want = preprocess(spark.createDataFrame(a + b, schema), ColumnMap())
    got = jobs.clean_rows(spark, out, want)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cleaning_with_event_time_drops_copies_within_the_lateness(spark, feed, tmp_path):
    schema = "instruction string, output string, ts timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [("q" * 10, "a" * 10, t), ("q" * 10, "a" * 10, t + dt.timedelta(minutes=5))]
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    stream = feed(spark.createDataFrame(rows, schema))
    jobs.stream_prep(stream, out, progress, ColumnMap(), event_time="ts", lateness="1 hour").awaitTermination()
    assert jobs.clean_rows(spark, out, spark.createDataFrame(rows, schema)).count() == 1


def test_metric_windows_equal_the_batch_result(spark, feed, tmp_path):
    schema = "run_id long, metric string, step long, ts timestamp, value double"
    t = dt.datetime(2024, 1, 1)
    rows = [(i % 2, "loss", i, t + dt.timedelta(minutes=7 * i), i / 4) for i in range(40)]
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for part in (rows[:25], rows[25:]):
        stream = feed(spark.createDataFrame(part, schema))
        jobs.stream_metrics(stream, out, progress, "1 hour").awaitTermination()
    got = jobs.current_windows(spark, out)
    want = jobs.metric_windows(spark.createDataFrame(rows, schema), "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


TURNS = "conv_id long, turn long, role string, text string"
POINTS = "run_id long, metric string, step long, ts timestamp, value double"
NOON = dt.datetime(2024, 1, 1, 12)


def each_by_a_stream(spark, tmp_path, parts, schema, start):
    """One stream with its own checkpoint per part, all into one target, the first one run twice."""
    for k, rows in enumerate([*parts, parts[0]]):
        k %= len(parts)
        source = str(tmp_path / f"in{k}")
        spark.createDataFrame(rows, schema).write.mode("overwrite" if k else "ignore").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start(stream, str(tmp_path / "out"), str(tmp_path / f"check{k}")).awaitTermination()
    return str(tmp_path / "out")


def test_streams_add_turns_to_one_conversation(spark, tmp_path):
    parts = [[(1, 0, "user", "a"), (2, 0, "user", "x")], [(1, 1, "assistant", "b")], [(1, 5, "user", "d"), (1, 4, None, None)]]
    out = each_by_a_stream(spark, tmp_path, parts, TURNS, lambda s, o, c: jobs.stream_history(s, o, c, part=3))
    rows = lambda df: sorted((r["conv_id"], r["messages"]) for r in df.collect())
    want = assemble(spark.createDataFrame(sum(parts, []), TURNS), "conv_id", part=3)
    assert rows(jobs.current_history(spark, out)) == rows(want)
    jobs.clear_history(spark, out)
    assert rows(jobs.current_history(spark, out)) == []


def test_streams_add_points_to_one_window(spark, tmp_path):
    late = NOON - dt.timedelta(days=9)
    parts = [[(1, "loss", 0, NOON, 1.5)], [(1, "loss", 1, NOON, 2.0), (1, "loss", 9, late, 4.0)], [(1, "loss", 2, late, 8.0)]]
    out = each_by_a_stream(spark, tmp_path, parts, POINTS, jobs.stream_metrics)
    want = jobs.metric_windows(spark.createDataFrame(sum(parts, []), POINTS))
    got = jobs.current_windows(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2


def test_a_fresh_checkpoint_at_the_same_path_is_another_stream(spark, feed, tmp_path):
    """The first checkpoint is set aside, so the second stream starts at batch 0 again."""
    schema = "content string, metadata map<string,string>"
    root, progress = str(tmp_path / "store"), tmp_path / "progress"
    for k in range(2):
        source = str(tmp_path / f"docs{k}")
        spark.createDataFrame([(f"text {k}", {"source": str(k)})], schema).write.parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_ingest(stream, root, "s", str(progress)).awaitTermination()
        progress.rename(tmp_path / f"old{k}")
    assert {r["content"] for r in collections.open_collection(spark, root, "s").collect()} == {"text 0", "text 1"}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("q" * 10, None), ("r" * 10, "b"), ("r" * 10, "b")], "instruction string, output string")
    out, read = str(tmp_path / "out"), lambda: sorted(map(str, jobs.clean_rows(spark, out, rows).collect()))
    for stream, number in (("a", 0), ("b", 0), ("a", 0), ("a", 1), ("b", 0)):
        jobs._add(jobs._unseen(rows, out, stream, number), out, stream, number)
        assert read() == sorted(map(str, rows.distinct().collect()))


def test_cleaning_keeps_no_state(spark, tmp_path):
    schema = "instruction string, output string"
    rows = spark.createDataFrame([("q" * 10, "a" * 10)] * 2, schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    job = jobs.stream_prep(stream, str(tmp_path / "out"), str(tmp_path / "progress"), ColumnMap())
    job.awaitTermination()
    assert not (tmp_path / "progress" / "state").exists()
    assert jobs.clean_rows(spark, str(tmp_path / "out"), rows).count() == 1
