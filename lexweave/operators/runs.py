"""Experiment runs over a long metric log: run_id, metric, step, ts, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import KEY, SEGMENT, Running, key_segments, position_by_range, running, top_per_group


def log_metrics(log: DataFrame, path: str) -> None:
    """Append values to the run-log table."""
    log.write.mode("append").partitionBy("metric").parquet(path)


def _age(unique_steps: bool) -> Column:
    """The order of a run's values. A bare step keeps the aggregate hash-based."""
    return F.col("step") if unique_steps else F.struct("step", "ts", "value")


def latest_metrics(log: DataFrame, unique_steps: bool = False) -> DataFrame:
    """The value of the highest step, then time, per run and metric.

    ``unique_steps`` says that a run logs a metric once per step, which saves a sort.
    """
    newest = F.max_by("value", _age(unique_steps))
    return log.groupBy("run_id", "metric").agg(newest.alias("value"))


def compare_runs(
    log: DataFrame, runs: DataFrame, metrics: list[str] | None = None, unique_steps: bool = False
) -> DataFrame:
    """One row per run: its name, status, start, and the latest value per metric named.

    A metric that no run has gets no column; one pass over the names alone finds those.
    """
    summary = runs.select("run_id", "run_name", "status", "start_time")
    if not metrics:
        return summary
    mine = log.where(F.col("metric").isin(metrics))
    there = {r["metric"] for r in mine.select("metric").distinct().collect()}
    known = [m for m in metrics if m in there]
    if not known:
        return summary
    latest = latest_metrics(mine, unique_steps)
    wide = latest.groupBy("run_id").pivot("metric", known).agg(F.first("value"))
    return summary.join(wide, "run_id", "left")


def order_runs(runs: DataFrame, metric: str, maximize: bool = False) -> list[Column]:
    m = F.col(metric)
    return [m.desc_nulls_last() if maximize else m.asc_nulls_last(), F.col("run_id")]


def placed_runs(runs: DataFrame, metric: str, maximize: bool = False, name: str = "place") -> DataFrame:
    """The runs with their place in the order by a metric, for any number of runs."""
    m = F.col(metric)
    keyed = runs.withColumns({"__none": m.isNull(), "__by": -m if maximize else m})
    return position_by_range(keyed, name, [], ["__none", "__by", "run_id"]).drop("__none", "__by")


def best_run(
    log: DataFrame,
    metric: str = "eval_loss",
    maximize: bool = False,
    runs: DataFrame | None = None,
    unique_steps: bool = False,
) -> DataFrame:
    """The run with the best latest value, with its model address; no row without runs.

    Only the metric's values are read. Given the table of ``runs``, those without a
    value come last instead of being left out.
    """
    latest = latest_metrics(log.where(F.col("metric") == metric), unique_steps).select(
        "run_id", F.col("value").alias(metric)
    )
    if runs is not None:
        latest = runs.select("run_id").join(latest, "run_id", "left")
    first = latest.orderBy(*order_runs(latest, metric, maximize)).limit(1)
    uri = F.concat(F.lit("runs:/"), F.col("run_id").cast("string"), F.lit("/model"))
    return first.withColumn("artifact_uri", uri)


def load_best_run(log: DataFrame, metric: str = "eval_loss", maximize: bool = False, **options):
    row = best_run(log, metric, maximize, **options).first()
    if row is None:
        raise ValueError(f"no run has the metric {metric!r}")
    return row


def in_experiment(
    log: DataFrame, runs: DataFrame, experiment: str, column: str = "experiment"
) -> tuple[DataFrame, DataFrame]:
    """The values and the runs of one named experiment; an unknown name is an error."""
    named = runs.where(F.col(column) == experiment)
    if named.isEmpty():
        raise ValueError(f"no experiment {experiment!r}")
    return log.join(named.select("run_id"), "run_id", "left_semi"), named


def early_stop(
    log: DataFrame,
    patience: int = 3,
    threshold: float = 0.001,
    maximize: bool = False,
    unique_steps: bool = False,
    segment: int = SEGMENT,
) -> DataFrame:
    """Per run and metric the step at which training would have stopped, or null.

    A step improves if it is first, or better than the best so far by more than the
    threshold. Training stops at the ``patience``-th step in a row without improvement.
    """
    by = ["run_id", "metric"]
    score = -F.col("value") if maximize else F.col("value")
    # One shuffle, by segment, serves the values per step and both running passes.
    steps = key_segments(log, by, "step", segment).repartition(KEY)
    if not unique_steps:
        value = F.max_by("value", F.struct("ts", "value")).alias("value")
        steps = steps.groupBy(KEY, *by, "step").agg(value)
    steps = steps.withColumn("__score", score)
    order = [F.col("step")]
    seen = running(
        steps, by, order,
        {
            "best": Running("min", F.col("__score"), inclusive=False),
            "pos": Running("count", F.lit(1)),
        },
    )
    better = F.col("best").isNull() | (F.col("best") - F.col("__score") > threshold)
    improved_at = {"improved_at": Running("max", F.when(better, F.col("pos")))}
    counted = running(seen, by, order, improved_at)
    waited = F.col("pos") - F.col("improved_at") >= patience
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"),
        F.min(F.when(waited, F.col("step"))).alias("stop_step"),
    )


def best_checkpoint(log: DataFrame, maximize: bool = False) -> DataFrame:
    """The step with the best value, the first such on ties."""
    score = -F.col("value") if maximize else F.col("value")
    return log.groupBy("run_id", "metric").agg(
        F.min_by("step", F.struct(score, F.col("step"))).alias("best_step"),
        (F.max("value") if maximize else F.min("value")).alias("best_value"),
    )


def retain_checkpoints(log: DataFrame, limit: int = 3, maximize: bool = False) -> DataFrame:
    """The newest steps that are kept on disk; the best one takes a place if it is older."""
    by = ["run_id", "metric"]
    steps = log.select(*by, "step").distinct()
    newest = top_per_group(steps, by, [F.col("step").desc()], limit, "from_end")
    best = best_checkpoint(log, maximize).select(*by, F.col("best_step").alias("step"))
    marked = newest.select(*by, "step", F.lit(False).alias("best")).unionByName(
        best.withColumn("best", F.lit(True))
    )
    merged = marked.groupBy(*by, "step").agg(F.max("best").alias("best"))
    # limit + 1 rows per group at most come here. A limit of one still keeps best and newest.
    order = [F.col("best").desc(), F.col("step").desc()]
    kept = top_per_group(merged, by, order, max(limit, 2), "place")
    return kept.select(*by, "step", "best")


def _depth(text: str) -> Column:
    """How deep the objects of a JSON text are nested: braces outside its strings."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    braces = F.split(F.regexp_replace(bare, "[^{}]", ""), "")
    step = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda at, b: F.struct(
            (at["now"] + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)).alias("now"),
            F.greatest(at["top"], at["now"] + F.when(b == "{", 1).otherwise(0)).alias("top"),
        ),
    )
    return step["top"]


def flatten_params(runs: DataFrame, run: str, column: str) -> DataFrame:
    """Nested configurations → run, dotted key, value, type; only plain scalars are kept.

    A key may hold an object in one row and a scalar in another. A text that is no JSON
    object has no parameters. Each row opens its own objects, level by level inside one
    expression, as often as its text is deep: the plan does not depend on the rows.
    """
    kinds = {
        "STRING": "str", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool"
    }
    entry_type = "array<struct<key:string,value:variant>>"

    def fields(value: Column) -> Column:
        return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def opened(entry: Column) -> Column:
        named = F.transform(
            fields(entry["value"]),
            lambda f: F.struct(
                F.when(entry["key"] != "", F.concat(entry["key"], F.lit("."), f["key"]))
                .otherwise(f["key"]).alias("key"),
                f["value"].alias("value"),
            ),
        )
        return F.coalesce(named.cast(entry_type), F.array(entry).cast(entry_type))

    parsed = runs.select(run, F.try_parse_json(column).alias("value"), _depth(column).alias("depth"))
    parsed = parsed.where(fields(F.col("value")).isNotNull())
    whole = F.array(F.struct(F.lit("").alias("key"), F.col("value").alias("value"))).cast(entry_type)
    entries = F.aggregate(
        F.sequence(F.lit(1), F.col("depth")), whole, lambda found, _: F.flatten(F.transform(found, opened)).cast(entry_type)
    )
    rows = parsed.select(run, F.explode(entries).alias("p")).select(run, "p.key", "p.value")
    kind = F.schema_of_variant("value")
    plain = F.when(kind.startswith("DECIMAL"), F.lit("float"))
    for spark_type, tag in kinds.items():
        plain = plain.when(kind == spark_type, F.lit(tag))
    text = F.try_variant_get("value", "$", "string")
    flat = rows.select(run, "key", text.alias("value"), plain.alias("type"))
    return flat.where(F.col("type").isNotNull())
