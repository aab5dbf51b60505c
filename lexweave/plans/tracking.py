"""Experiment runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..session import scratch_path
from .registry import query
from .tables import LOG, RUNS, metric_log, run_list, table

METRICS = ["view", "click", "purchase"]


@query(f"WITH {LOG} SELECT run_id, metric, arg_max(value, step) AS value FROM metric_log GROUP BY ALL")
def latest_metrics(spark, d):
    return runs.latest_metrics(metric_log(spark, d), unique_steps=True)


@query(f"""WITH {RUNS} SELECT run_id, run_name, status, start_time,
  arg_max(value, step) FILTER (WHERE metric = 'view') AS view,
  arg_max(value, step) FILTER (WHERE metric = 'click') AS click,
  arg_max(value, step) FILTER (WHERE metric = 'purchase') AS purchase
FROM run_list LEFT JOIN metric_log USING (run_id) GROUP BY ALL""")
def compare_runs(spark, d):
    return runs.compare_runs(metric_log(spark, d), run_list(spark, d), METRICS, unique_steps=True)


@query(f"""WITH {LOG}, latest AS (
  SELECT run_id, arg_max(value, step) FILTER (WHERE metric = 'purchase') AS purchase
  FROM metric_log GROUP BY 1)
SELECT run_id, purchase, 'runs:/' || run_id || '/model' AS artifact_uri FROM latest
ORDER BY purchase NULLS LAST, run_id LIMIT 1""")
def best_run(spark, d):
    return runs.best_run(metric_log(spark, d), "purchase", runs=run_list(spark, d))


@query(f"""WITH {LOG}, latest AS (
  SELECT run_id, arg_max(value, step) FILTER (WHERE metric = 'signup') AS signup
  FROM metric_log GROUP BY 1)
SELECT run_id, signup, 'runs:/' || run_id || '/model' AS artifact_uri FROM latest
ORDER BY signup DESC NULLS LAST, run_id LIMIT 1""")
def best_run_maximize(spark, d):
    return runs.best_run(metric_log(spark, d), "signup", maximize=True, unique_steps=True)


@query(f"""WITH {RUNS} SELECT run_id, run_name, status, start_time,
  arg_max(value, step) FILTER (WHERE metric = 'view') AS view
FROM run_list LEFT JOIN metric_log USING (run_id) GROUP BY ALL""")
def compare_existing_metrics(spark, d):
    """A metric that no run has gets no column."""
    return runs.compare_runs(metric_log(spark, d), run_list(spark, d), ["view", "nowhere"], unique_steps=True)


# A run's experiment is named after its first metric.
@query(f"""WITH {RUNS}, first AS (
  SELECT run_id, arg_min(metric, step) AS experiment FROM metric_log GROUP BY run_id)
SELECT run_id, run_name, status, start_time,
  arg_max(value, step) FILTER (WHERE metric = 'view') AS view,
  arg_max(value, step) FILTER (WHERE metric = 'click') AS click
FROM run_list JOIN first USING (run_id) JOIN metric_log USING (run_id)
WHERE experiment = 'click' GROUP BY ALL""")
def experiment_runs(spark, d):
    log = metric_log(spark, d)
    first = log.groupBy("run_id").agg(F.min_by("metric", "step").alias("experiment"))
    known = run_list(spark, d).join(first, "run_id")
    return runs.compare_runs(*runs.in_experiment(log, known, "click"), ["view", "click"], unique_steps=True)


@query(f"""WITH {RUNS}, wide AS (
  SELECT run_id, arg_max(value, step) FILTER (WHERE metric = 'view') AS view FROM metric_log GROUP BY 1)
SELECT run_id, status, view, row_number() OVER (ORDER BY view DESC NULLS LAST, run_id) AS place
FROM run_list JOIN wide USING (run_id)""")
def order_runs(spark, d):
    table_ = runs.compare_runs(metric_log(spark, d), run_list(spark, d), ["view"], unique_steps=True)
    placed = runs.placed_runs(table_, "view", maximize=True)
    return placed.select("run_id", "status", "view", "place")


# The stopping rule step by step: patience 3, threshold 0.001.
_STEPS = f"""{LOG},
seen AS (SELECT *, min(value) OVER (PARTITION BY run_id, metric ORDER BY step
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
  row_number() OVER (PARTITION BY run_id, metric ORDER BY step) AS pos FROM metric_log),
improved AS (SELECT *, max(CASE WHEN best IS NULL OR best - value > 0.001 THEN pos END) OVER (
  PARTITION BY run_id, metric ORDER BY step) AS improved_at FROM seen)"""


@query(f"""WITH {_STEPS} SELECT run_id, metric, count(*) AS steps,
  min(step) FILTER (WHERE pos - improved_at >= 3) AS stop_step FROM improved GROUP BY ALL""")
def early_stop(spark, d):
    return runs.early_stop(metric_log(spark, d), unique_steps=True)


@query(f"""WITH {LOG} SELECT run_id, metric, arg_min(step, (value, step)) AS best_step,
  min(value) AS best_value FROM metric_log GROUP BY ALL""")
def best_checkpoint(spark, d):
    return runs.best_checkpoint(metric_log(spark, d))


@query(f"""WITH {LOG}, best AS (
  SELECT run_id, metric, arg_min(step, (value, step)) AS best_step FROM metric_log GROUP BY ALL),
marked AS (SELECT l.run_id, l.metric, step, step = best_step AS best FROM metric_log l
  JOIN best b ON l.run_id = b.run_id AND l.metric = b.metric)
SELECT run_id, metric, step, best FROM marked
QUALIFY row_number() OVER (PARTITION BY run_id, metric ORDER BY best DESC, step DESC) <= 3""")
def retain_checkpoints(spark, d):
    return runs.retain_checkpoints(metric_log(spark, d))


@query("""SELECT event_id, key, json_extract_string(props, '$.' || key) AS value,
  CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool'
    WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS type
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def flatten_params(spark, d):
    return runs.flatten_params(table(spark, d, "events", "event_id", "props"), "event_id", "props")


@query("""WITH nested AS (
  SELECT event_id, event_type, user_id, value, value > 10 AS high FROM events)
SELECT event_id, 'run.type' AS key, event_type AS value, 'str' AS type FROM nested UNION ALL
SELECT event_id, 'run.user.id', user_id::VARCHAR, 'int' FROM nested UNION ALL
SELECT event_id, 'run.user.high', CASE WHEN high THEN 'true' ELSE 'false' END, 'bool' FROM nested""")
def flatten_nested_params(spark, d):
    """Configurations three levels deep; lists and missing values are left out."""
    events = table(spark, d, "events", "event_id", "event_type", "user_id", "value")
    config = F.struct(
        F.struct(
            F.col("event_type").alias("type"),
            F.struct(F.col("user_id").alias("id"), (F.col("value") > 10).alias("high")).alias("user"),
            F.array(F.col("value")).alias("list"),
            F.when(F.col("value") < 0, F.lit(1)).alias("missing"),
        ).alias("run")
    )
    return runs.flatten_params(
        events.select("event_id", F.to_json(config).alias("config")), "event_id", "config"
    )


@query("""SELECT event_id, CASE WHEN value > 10 THEN 'opt.rate' ELSE 'opt' END AS key,
  event_type AS value, 'str' AS type FROM events""")
def flatten_mixed_params(spark, d):
    """One key that is an object in some rows and a plain value in others."""
    events = table(spark, d, "events", "event_id", "event_type", "value")
    nested = F.to_json(F.struct(F.struct(F.col("event_type").alias("rate")).alias("opt")))
    plain = F.to_json(F.struct(F.col("event_type").alias("opt")))
    config = F.when(F.col("value") > 10, nested).otherwise(plain)
    return runs.flatten_params(events.select("event_id", config.alias("config")), "event_id", "config")


@query(f"""WITH {LOG} SELECT run_id, metric, step, value FROM metric_log""")
def log_metrics(spark, d):
    """Two appends, one per half of the metrics, read back as one log."""
    log, path = metric_log(spark, d), scratch_path(spark, "metrics")
    bought = F.col("metric").isin("purchase", "signup")
    runs.log_metrics(log.where(bought), path)
    runs.log_metrics(log.where(~bought), path)
    return spark.read.parquet(path).select("run_id", "metric", "step", "value")
