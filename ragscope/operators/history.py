"""Run history as tables.

``RUNS`` (one row per run), ``METRIC_SUMMARY`` and ``SCORES`` are Parquet
tables with one folder per ``run_date`` and ``run_id`` (unique, Q22). A run
counts once its row is in RUNS, which is written last; all tables of a run
carry one date from one clock. Saving a run again replaces its folders, so a
save that was cut off is simply repeated. Listing a history reads only the
small RUNS table; a run's rows are read from its own folder alone.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragscope.operators.filters import by_tag
from ragscope.functions.text import short_ts
from ragscope.storage import exists

SPARK_LEVELS = 8  # sparkline has 9 glyphs, levels 0..8


def new_run_id() -> str:
    return uuid.uuid4().hex


def _table(history_dir: str, name: str) -> str:
    return f"{history_dir.rstrip('/')}/{name}"


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(path)


def save_run(spark: SparkSession, history_dir: str, run_summary: DataFrame,
             metric_summary: DataFrame, scores: DataFrame | None = None, *,
             tag: str | None = None, config_path: str | None = None, ts: datetime | None = None) -> None:
    """Save the runs of ``run_summary`` (usually one) as one step: scores
    and metric summary first, the RUNS row last, which commits them. ``ts`` is
    the run's time (UTC; now unless given)."""
    ts = ts or datetime.now(timezone.utc)
    day = F.lit(ts.strftime("%Y-%m-%d")).alias("run_date")
    if scores is not None:
        _replace(scores.select("*", day), _table(history_dir, "scores"))
    _replace(metric_summary.select("*", day), _table(history_dir, "metric_summary"))
    runs = run_summary.select(
        "run_id", F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp").alias("ts"), F.lit(tag).cast("string").alias("tag"),
        F.lit(config_path).cast("string").alias("config_path"),
        "total_samples", "overall_score", "pass_count", "fail_count", "threshold",
        F.lit(spark.version).alias("engine_version"), day)
    _replace(runs, _table(history_dir, "runs"))


def read_table(spark: SparkSession, history_dir: str, name: str) -> DataFrame:
    """A table of the committed runs. RUNS commits itself; rows of another
    table whose run has no row in RUNS (a save that was cut off) do not show."""
    # run ids are text, also where all of them look like numbers
    def read(table: str) -> DataFrame:
        t = spark.read.option("basePath", _table(history_dir, table)).parquet(_table(history_dir, table))
        return t.withColumn("run_id", F.col("run_id").cast("string"))

    t = read(name)
    return t if name == "runs" else t.join(read("runs").select("run_id"), "run_id", "left_semi")


def run_date(spark: SparkSession, history_dir: str, run_id: str) -> str | None:
    """The date of a committed run; null where there is none."""
    row = read_table(spark, history_dir, "runs").where(F.col("run_id") == run_id).select(
        F.col("run_date").cast("string")).first()
    return row[0] if row else None


def load_run(spark: SparkSession, history_dir: str, run_id: str, name: str = "scores") -> DataFrame:
    """One run's rows, read from its folder alone."""
    day = run_date(spark, history_dir, run_id)
    if day is None:
        raise KeyError(f"no run {run_id} in {history_dir}")
    folder = f"{_table(history_dir, name)}/run_date={day}/run_id={run_id}"
    if not exists(spark, folder):
        raise KeyError(f"run {run_id} was saved without {name}")
    return spark.read.parquet(folder).select(F.lit(run_id).alias("run_id"), "*", F.lit(day).cast("date").alias("run_date"))


def list_runs(runs: DataFrame, tag: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first (ties on run_id), optional tag; all runs unless ``limit``."""
    listed = by_tag(runs, tag).orderBy(F.col("ts").desc(), F.col("run_id").desc())
    return listed if limit is None else listed.limit(limit)


def trend(runs: DataFrame, tag: str | None = None, limit: int = 20) -> DataFrame:
    """The listed runs oldest first with their number and sparkline
    level ``int((s-min)/range*8)`` (range 0 counts as 1, Q27). A report of at
    most ``limit`` rows, so the un-partitioned windows here are small."""
    listed = list_runs(runs, tag, limit)
    w_all = Window.partitionBy(F.lit(1))
    mn, mx = F.min("overall_score").over(w_all), F.max("overall_score").over(w_all)
    rng = F.when(mx > mn, mx - mn).otherwise(F.lit(1.0))
    return listed.select(
        F.row_number().over(Window.orderBy(F.col("ts").asc(), F.col("run_id").asc())).alias("run_number"),
        "run_id", "ts", short_ts(F.col("ts")).alias("ts_text"), "tag", "overall_score",
        "total_samples",
        F.floor((F.col("overall_score") - mn) / rng * SPARK_LEVELS).cast("int").alias("level"))


def trend_stats(listed: DataFrame) -> DataFrame:
    """Min, max, mean and latest of the listed overall scores."""
    return listed.agg(F.count(F.lit(1)).alias("runs"),
                      F.min("overall_score").alias("min_score"),
                      F.max("overall_score").alias("max_score"),
                      F.avg("overall_score").alias("mean_score"),
                      F.max_by("overall_score", F.struct("ts", "run_id")).alias("latest_score"))


def latest_metric_means(runs: DataFrame, metric_summary: DataFrame,
                        tag: str | None = None) -> DataFrame:
    """T5: per-metric means of the newest run."""
    newest = list_runs(runs, tag, 1).select("run_id")
    return metric_summary.join(F.broadcast(newest), "run_id").select("run_id", "metric", "mean")


def run_over_run(runs: DataFrame, metric_summary: DataFrame) -> DataFrame:
    """Per tag and metric, change against the previous run."""
    j = metric_summary.select("run_id", "metric", "mean").join(
        runs.select("run_id", "tag", "ts"), "run_id")
    w = Window.partitionBy("tag", "metric").orderBy("ts", "run_id")
    prev = F.lag("mean").over(w)
    return j.select("tag", "metric", "run_id", "ts", "mean", prev.alias("previous"),
                    (F.col("mean") - prev).alias("delta"))
