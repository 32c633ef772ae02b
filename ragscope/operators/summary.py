"""Summaries of the SCORES table (A1-A13, F4, F5, J4, T6, S14 shape).

Only ``run_id, sample_id, metric, score, status`` are read, so a stored
SCORES table is pruned to those columns at the scan. ``judge_error`` rows are
left out of the statistics and counted in ``error_count``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscope.operators.quantiles import distribution_of

QUANTILES = [0.25, 0.5, 0.75]


def _ok() -> Column:
    return F.coalesce(F.col("status"), F.lit("ok")) != F.lit("judge_error")


def _valid_score() -> Column:
    return F.when(_ok(), F.col("score"))


def distribution(value: Column, accuracy: int = 10000) -> list[Column]:
    """mean, min, max, p25, median, p75 and population std of ``value``, the
    quantiles from a mergeable sketch (``quantiles`` has the exact ones)."""
    q = F.percentile_approx(value, QUANTILES, accuracy)
    return [F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
            q[0].alias("p25"), q[1].alias("median"), q[2].alias("p75"),
            F.stddev_pop(value).alias("std_dev")]


def metric_summary(scores: DataFrame, approx: bool = False) -> DataFrame:
    """A1: per run and metric, with exact quantiles (A2) unless ``approx``."""
    v = _valid_score()
    if approx:
        return scores.groupBy("run_id", "metric").agg(
            F.count(v).alias("n"),
            F.count_if(~_ok()).alias("error_count"),
            *distribution(v))
    narrow = scores.select("run_id", "metric", v.alias("v"), _ok().alias("ok"))
    return distribution_of(narrow, ["run_id", "metric"], F.col("v"), [F.count_if(~F.col("ok")).alias("error_count")]).select(
        "run_id", "metric", "n", "error_count", "mean", "min", "max", "p25", "median", "p75", "std_dev")


def sample_scores(scores: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """row score = plain mean of the sample's metric scores.

    With ``samples`` (run_id, sample_id), a sample that has no metric rows is
    kept with 0.0 and ``n_metrics`` 0."""
    own = scores.groupBy("run_id", "sample_id").agg(
        F.coalesce(F.avg(_valid_score()), F.lit(0.0)).alias("overall_score"),
        F.count(F.lit(1)).alias("n_metrics"))
    if samples is None:
        return own
    every = samples.select("run_id", "sample_id").distinct()
    return every.join(own, ["run_id", "sample_id"], "left").select(
        "run_id", "sample_id", F.coalesce("overall_score", F.lit(0.0)).alias("overall_score"),
        F.coalesce("n_metrics", F.lit(0)).cast("long").alias("n_metrics"))


def metric_verdicts(metric_summ: DataFrame, threshold: float) -> DataFrame:
    """F5 per metric: ``metric_passed`` where the mean reaches the threshold."""
    return metric_summ.withColumn("metric_passed", F.coalesce(F.col("mean") >= float(threshold), F.lit(False)))


def current_means(scores: DataFrame) -> DataFrame:
    """Unrounded mean per metric over all rows of the results."""
    return scores.groupBy("run_id", "metric").agg(F.avg(_valid_score()).alias("mean"))


def metric_means(scores: DataFrame) -> DataFrame:
    """n and mean per run and metric: what A4 needs of A1."""
    v = _valid_score()
    return scores.groupBy("run_id", "metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


def weights_table(spark, weights: dict[str, float]) -> DataFrame:
    """The weights dict as a table (size bounded by the metric list)."""
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()],
                                 "metric string, weight double")


def weighted_overall(metric_summ: DataFrame, weights: DataFrame) -> DataFrame:
    """``sum(mean*w)/sum(w)``, weight 1.0 when unspecified, 0.0 if the
    total weight is not positive. The weights side is a driver-built table of
    one row per metric, so broadcasting it is bounded."""
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    joined = metric_summ.where(F.col("n") > 0).join(F.broadcast(weights), "metric", "left")
    return joined.groupBy("run_id").agg(
        F.coalesce(F.sum(F.col("mean") * w) / F.when(F.sum(w) > 0, F.sum(w)), F.lit(0.0))
        .alias("weighted_score"))


def run_summary(samp: DataFrame, threshold: float = 0.7, metric_summ: DataFrame | None = None,
                weights: DataFrame | None = None, run_ids: DataFrame | None = None,
                approx: bool = False) -> DataFrame:
    """One row per run.

    ``overall_score`` is the weighted score when ``weights`` is given, else the
    mean of row scores. Pass/fail always uses the unweighted row score (Q6).
    ``run_ids`` (one row per expected run) keeps runs without samples as zeros.
    """
    t = float(threshold)
    o = F.col("overall_score")
    if approx:
        dist = samp.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("total_samples"),
            F.count_if(o >= t).alias("pass_count"),
            *distribution(o))
    else:
        dist = distribution_of(samp.select("run_id", o.alias("v")), ["run_id"], F.col("v"), [
            F.count(F.lit(1)).alias("total_samples"), F.count_if(F.col("v") >= t).alias("pass_count")])
    dist = dist.withColumnRenamed("mean", "unweighted_score")
    if weights is not None and metric_summ is not None:
        dist = dist.join(weighted_overall(metric_summ, weights), "run_id", "left") \
            .withColumn("overall_score", F.coalesce("weighted_score", F.lit(0.0))) \
            .drop("weighted_score")
    else:
        dist = dist.withColumn("overall_score", F.col("unweighted_score"))
    if run_ids is not None:
        dist = run_ids.select("run_id").join(dist, "run_id", "left")
    zero = F.lit(0.0)
    total = F.coalesce(F.col("total_samples"), F.lit(0)).cast("long")
    passed = F.coalesce(F.col("pass_count"), F.lit(0)).cast("long")
    return dist.select(
        "run_id",
        total.alias("total_samples"),
        F.coalesce("overall_score", zero).alias("overall_score"),
        passed.alias("pass_count"),
        (total - passed).alias("fail_count"),
        F.coalesce(passed / F.when(total > 0, total), zero).alias("pass_rate"),
        F.lit(t).alias("threshold"),
        F.coalesce("median", zero).alias("median"),
        F.coalesce("p25", zero).alias("p25"),
        F.coalesce("p75", zero).alias("p75"),
        F.coalesce("std_dev", zero).alias("std_dev"),
        F.coalesce("min", zero).alias("min_score"),
        F.coalesce("max", zero).alias("max_score"),
        # the run passes when the rounded overall reaches the threshold;
        # The SDK's verdict is "no failures and at least one sample".
        (F.round(F.coalesce("overall_score", zero), 4) >= t).alias("run_passed"),
        ((total - passed == 0) & (total > 0)).alias("all_passed"),
    )


def pass_flags(samp: DataFrame, threshold: float) -> DataFrame:
    """F5 per sample."""
    return samp.withColumn("sample_passed", F.col("overall_score") >= float(threshold))


def histogram(scores: DataFrame, bins: int = 10) -> DataFrame:
    """A10: equal-width bins ``min(int(score*bins), bins-1)``, empty bins kept.

    One aggregation with a conditional count per bin, then ``posexplode``:
    every (run, metric) gets all bins without a join or a second scan.
    """
    v = _valid_score()
    b = F.least(F.floor(v * bins).cast("int"), F.lit(bins - 1))
    counts = scores.groupBy("run_id", "metric").agg(
        F.array(*[F.count_if(b == i) for i in range(bins)]).alias("_c"))
    return counts.select("run_id", "metric", F.posexplode("_c").alias("bin", "count")) \
        .select("run_id", "metric", F.col("bin").cast("int").alias("bin"),
                (F.col("bin") / F.lit(float(bins))).alias("lower"),
                F.col("count").cast("long").alias("count"))


def failures_by_metric(scores: DataFrame, threshold: float) -> DataFrame:
    """Per metric, the number of cases and of cases below the threshold
    (a missing or failed score counts as 0.0). Each sample has one row per
    metric, so ``tests`` is the per-metric sample count (Q25)."""
    s = F.coalesce(_valid_score(), F.lit(0.0))
    return scores.groupBy("run_id", "metric").agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(s < float(threshold)).alias("failures"))


def failure_cases(scores: DataFrame, threshold: float) -> DataFrame:
    """A11 case rows with the X16 message. Over a scoring plan that is not
    stored, the rows pass a generator, so that the test of the score does not
    carry a second copy of the whole scoring expression below it."""
    from ragscope.functions.text import failure_message
    cases = scores.select("run_id", "sample_id", "metric", F.coalesce(_valid_score(), F.lit(0.0)).alias("score"))
    row = F.struct("run_id", "sample_id", "metric", "score")
    failing = cases.select(F.inline(F.filter(F.array(row), lambda r: r["score"] < float(threshold))))
    return failing.withColumn("message", failure_message(F.col("score"), threshold))


def worst_samples(samp: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest row scores (ties on sample_id); a top-k report."""
    return samp.orderBy(F.col("overall_score").asc(), F.col("sample_id").asc()).limit(k)


def small_table(rows: DataFrame, most: int = 20) -> tuple[DataFrame | None, int]:
    """T4: the per-sample table of a short report and its number of rows, or
    None and ``most`` + 1 where there are more than ``most`` rows. No more than
    ``most`` + 1 rows are looked at."""
    first = rows.limit(most + 1)
    n = first.count()
    return (rows if n <= most else None), n


def scores_wide(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """S14 shape: one row per sample, one column per metric (missing -> 0.0),
    built with conditional aggregates in a single aggregation."""
    v = _valid_score()
    cols = [F.coalesce(F.max(F.when(F.col("metric") == m, v)), F.lit(0.0)).alias(m)
            for m in metrics]
    return scores.groupBy("run_id", "sample_id").agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("overall_score"), *cols)
