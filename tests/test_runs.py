import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import runs

T0 = dt.datetime(2024, 1, 1)


def log_of(spark, rows):
    stamped = [(r, m, s, T0 + dt.timedelta(seconds=i), v) for i, (r, m, s, v) in enumerate(rows)]
    return spark.createDataFrame(stamped, "run_id long, metric string, step long, ts timestamp, value double").repartition(3)


def stop_twin(values, patience, threshold):
    best, wait = None, 0
    for step, v in values:
        if best is None or (v < best and abs(v - best) > threshold):
            wait = 0
        else:
            wait += 1
        best = v if best is None else min(best, v)
        if wait >= patience:
            return step
    return None


@pytest.mark.parametrize("segment", [5, 1_000_000])
@pytest.mark.parametrize("patience, threshold", [(1, 0.0), (3, 0.001), (3, 2.0), (50, 0.0)])
def test_early_stop_equals_the_loop(spark, segment, patience, threshold):
    rng = random.Random(segment + patience)
    rows = [(r, "loss", s * r, rng.randint(0, 40) / 2 - s / 10) for r in (1, 2, 3) for s in range(40)]
    log, unique = log_of(spark, rows), segment == 5
    got = runs.early_stop(log, patience, threshold, unique_steps=unique, segment=segment).collect()
    for r in got:
        values = [(s, v) for run, _, s, v in rows if run == r["run_id"]]
        assert (r["steps"], r["stop_step"]) == (40, stop_twin(values, patience, threshold))


def test_early_stop_can_maximize_and_takes_the_last_value_of_a_step(spark):
    rows = [(1, "acc", 0, 0.1), (1, "acc", 1, 0.9), (1, "acc", 1, 0.5), (1, "acc", 2, 0.6), (1, "acc", 3, 0.6)]
    got = runs.early_stop(log_of(spark, rows), 1, 0.0, maximize=True).first()
    assert (got["steps"], got["stop_step"]) == (4, 3)


def test_latest_best_and_compare(spark):
    rows = [(1, "loss", 0, 3.0), (1, "loss", 2, 1.5), (2, "loss", 1, 1.0), (2, "loss", 1, 2.0), (3, "acc", 0, 0.5)]
    log = log_of(spark, rows)
    latest = {(r["run_id"], r["metric"]): r["value"] for r in runs.latest_metrics(log).collect()}
    assert latest == {(1, "loss"): 1.5, (2, "loss"): 2.0, (3, "acc"): 0.5}
    best = runs.load_best_run(log, "loss")
    assert best.asDict() == {"run_id": 1, "loss": 1.5, "artifact_uri": "runs:/1/model"}
    assert runs.load_best_run(log, "loss", maximize=True)["run_id"] == 2
    with pytest.raises(ValueError):
        runs.load_best_run(log, "absent")
    assert runs.load_best_run(log, "absent", runs=log.select("run_id").distinct())["absent"] is None
    assert runs.best_run(log.where("step < 2"), "loss", unique_steps=True).first()["run_id"] in (1, 2)
    known = spark.createDataFrame([(i, f"r{i}", "FINISHED", T0) for i in (1, 2, 3, 4)], "run_id long, run_name string, status string, start_time timestamp")
    wide = {r["run_id"]: (r["loss"], r["acc"]) for r in runs.compare_runs(log, known, ["loss", "acc"]).collect()}
    assert wide == {1: (1.5, None), 2: (2.0, None), 3: (None, 0.5), 4: (None, None)}
    assert runs.compare_runs(log, known).columns == ["run_id", "run_name", "status", "start_time"]


def test_checkpoints(spark):
    rows = [(1, "loss", s, v) for s, v in [(10, 5.0), (20, 1.0), (30, 2.0), (40, 1.0), (50, 3.0)]]
    log = log_of(spark, rows)
    assert tuple(runs.best_checkpoint(log).first())[2:] == (20, 1.0)
    assert tuple(runs.best_checkpoint(log, maximize=True).first())[2:] == (10, 5.0)
    kept = lambda n: sorted(r["step"] for r in runs.retain_checkpoints(log, n).collect())
    assert kept(3) == [20, 40, 50] and kept(2) == [20, 50] and kept(1) == [20, 50]
    assert kept(4) == [20, 30, 40, 50] and kept(9) == [10, 20, 30, 40, 50]


def test_nested_configurations(spark):
    rows = [
        (1, '{"a": {"b": 1, "c": {"d": "x", "e": null}}, "l": [1], "f": 1.5, "t": true}'),
        (2, '{"a": {"b": "two"}, "k.z": 3, "n": null}'),
        (3, "{}"),
        (4, "no json {"),
    ]
    df = spark.createDataFrame(rows, "run int, config string")
    got = {(r["run"], r["key"]): (r["value"], r["type"]) for r in runs.flatten_params(df, "run", "config").collect()}
    assert got == {
        (1, "a.b"): ("1", "int"), (1, "a.c.d"): ("x", "str"), (1, "f"): ("1.5", "float"),
        (1, "t"): ("true", "bool"), (2, "a.b"): ("two", "str"), (2, "k.z"): ("3", "int"),
    }


def test_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    log = log_of(spark, [(1, "loss", 0, 1.0), (1, "acc", 0, 0.1)])
    runs.log_metrics(log, path)
    runs.log_metrics(log.where(F.col("metric") == "acc"), path)
    assert spark.read.parquet(path).groupBy("metric").count().orderBy("metric").collect() == [("acc", 2), ("loss", 1)]


def test_mixed_quoted_and_malformed_configurations(spark):
    rows = [
        (1, '{"a": 1}'), (2, '{"a": {"b": 2}}'), (3, '{"q\\"k": "x{\\\\\\"}", "OBJECT<y": 1}'),
        (4, "{bad"), (5, "[1]"), (6, None), (7, '{"a": {"b": {"c": {"d": 0.5}}}}'), (8, '{"": {"z": 1}}'), (9, "7"),
    ]
    df = spark.createDataFrame(rows, "run int, config string")
    got = {(r["run"], r["key"]): (r["value"], r["type"]) for r in runs.flatten_params(df, "run", "config").collect()}
    assert got == {
        (1, "a"): ("1", "int"), (2, "a.b"): ("2", "int"), (3, 'q"k'): ('x{\\"}', "str"),
        (3, "OBJECT<y"): ("1", "int"), (7, "a.b.c.d"): ("0.5", "float"), (8, "z"): ("1", "int"),
    }
    assert runs.flatten_params(df.where("run = 6"), "run", "config").collect() == []


def test_experiments_are_separate(spark):
    log = log_of(spark, [(1, "loss", 0, 1.0), (2, "loss", 0, 0.5)])
    known = spark.createDataFrame([(1, "x"), (2, "y")], "run_id long, experiment string")
    mine, named = runs.in_experiment(log, known, "x")
    assert runs.best_run(mine, "loss", runs=named).first()["run_id"] == 1
    with pytest.raises(ValueError):
        runs.in_experiment(log, known, "z")
