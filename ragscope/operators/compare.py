"""Run comparison and regression checks.

Both sides are per-metric aggregates (one row per metric), so these joins
are between tiny tables; Spark broadcasts them from their runtime size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.functions.text import direction, verdict
from ragscope.operators.summary import current_means


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-metric means of two runs, full outer on ``metric``.

    A metric missing on one side counts 0.0 there; ``delta = b - a``. The
    labels of the two sides are values, not column names (Q26)."""
    x = a.select("metric", F.col("mean").alias("score_a"))
    y = b.select("metric", F.col("mean").alias("score_b"))
    j = x.join(y, "metric", "full_outer").select(
        "metric", F.coalesce("score_a", F.lit(0.0)).alias("score_a"),
        F.coalesce("score_b", F.lit(0.0)).alias("score_b"))
    d = F.col("score_b") - F.col("score_a")
    return j.select("metric", "score_a", "score_b", d.alias("delta"), direction(d).alias("direction"))


def in_order(comparison: DataFrame) -> DataFrame:
    """A comparison sorted by metric, for output (one row per metric)."""
    return comparison.orderBy("metric")


def compare_overall(a: DataFrame, b: DataFrame) -> DataFrame:
    """J1 overall line from two run summaries of one row each (a side without
    rows counts 0.0): one aggregate over both, no join."""
    both = a.select(F.lit("a").alias("side"), "overall_score").unionByName(b.select(F.lit("b").alias("side"), "overall_score"))
    side = lambda k: F.coalesce(F.max(F.when(F.col("side") == k, F.col("overall_score"))), F.lit(0.0))
    d = F.col("overall_b") - F.col("overall_a")
    return both.agg(side("a").alias("overall_a"), side("b").alias("overall_b")).select(
        "overall_a", "overall_b", d.alias("overall_delta"), verdict(d).alias("verdict"))


def compare_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """J8 per sample: the row scores of two runs side by side. A sample that
    only one run has shows null for the other, and no delta."""
    x = a.select("sample_id", F.col("overall_score").alias("score_a"))
    y = b.select("sample_id", F.col("overall_score").alias("score_b"))
    d = F.col("score_b") - F.col("score_a")
    return x.join(y, "sample_id", "full_outer").select(
        "sample_id", "score_a", "score_b", d.alias("delta"),
        F.when(F.col("score_a").isNull(), F.lit("added")).when(F.col("score_b").isNull(), F.lit("removed"))
        .otherwise(direction(d)).alias("direction"))


@dataclass(frozen=True)
class RunDiff:
    """What changed from one stored run to another."""

    metrics: DataFrame
    overall: DataFrame
    samples: DataFrame


def diff_runs(spark: SparkSession, history_dir: str, run_a: str, run_b: str) -> RunDiff:
    """J8/I6 of two stored runs. The metric and overall lines come from the
    small tables; only the lines per sample read the scores, each run's from
    its own folder."""
    from ragscope.operators.history import load_run
    from ragscope.operators.summary import sample_scores

    def each(name):
        return load_run(spark, history_dir, run_a, name), load_run(spark, history_dir, run_b, name)

    return RunDiff(compare(*each("metric_summary")), compare_overall(*each("runs")),
                   compare_samples(*map(sample_scores, each("scores"))))


def check_regression(current_scores: DataFrame, baseline: DataFrame,
                     tolerance: float = 0.05) -> DataFrame:
    """The baseline drives (left join); a metric missing in the current
    results counts 0.0; passes when ``delta >= -tolerance`` (Q10: raw floats).
    Metrics only in the current results are ignored."""
    cur = current_means(current_scores).groupBy("metric").agg(F.avg("mean").alias("current"))
    base = baseline.select("metric", F.col("mean").alias("baseline"))
    j = base.join(cur, "metric", "left")
    c = F.coalesce("current", F.lit(0.0))
    d = c - F.col("baseline")
    return j.select("metric", "baseline", c.alias("current"), d.alias("delta"),
                    (d >= -float(tolerance)).alias("passed"))


def regression_verdict(reg: DataFrame) -> DataFrame:
    """All metrics within tolerance (true for an empty baseline)."""
    return reg.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
                   F.count(F.lit(1)).alias("metrics"),
                   F.count_if(~F.col("passed")).alias("regressed"))
