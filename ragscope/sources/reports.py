"""Report documents and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.schemas import REPORT_RESULT
from ragscope.storage import exists

REPORT = T.StructType([
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("summary", T.StructType([
        T.StructField("total_samples", T.LongType(), True),
        T.StructField("overall_score", T.DoubleType(), True),
        T.StructField("pass_count", T.LongType(), True),
        T.StructField("fail_count", T.LongType(), True),
        T.StructField("pass_rate", T.DoubleType(), True),
        T.StructField("threshold", T.DoubleType(), True),
        T.StructField("metric_scores", T.MapType(T.StringType(), T.StringType()), True),
    ]), True),
    T.StructField("results", T.ArrayType(REPORT_RESULT), True),
])


#: A report in a folder: its summary (one row) and its results (any number).
HEAD, RESULTS = "summary", "results"
HEAD_SCHEMA = T.StructType([f for f in REPORT.fields if f.name != "results"])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report documents (one per file), or a report that Spark wrote as a
    folder (``write_json_report``): then ``results`` is null here, and
    ``read_results`` has its rows. A document without ``summary`` is an error."""
    folder = f"{path.rstrip('/')}/{HEAD}"
    if exists(spark, folder):
        df = spark.read.schema(HEAD_SCHEMA).json(folder) \
            .select("*", F.lit(None).cast(REPORT["results"].dataType).alias("results"))
        where = F.lit(path)
    else:
        df = spark.read.option("multiLine", True).schema(REPORT).json(path)
        where = F.col("_metadata.file_path")
    df = df.withColumn("path", where)
    if df.where(F.col("summary").isNull()).limit(1).count():
        raise ValueError(f"Report missing 'summary' field: {path}")
    return df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of a report folder, in the shape of documents with
    one result each, so that ``report_to_scores`` reads both."""
    rows = spark.read.schema(REPORT_RESULT).json(f"{path.rstrip('/')}/{RESULTS}")
    return rows.select(F.lit(path).alias("path"), F.array(F.struct("*")).alias("results"))


def report_metric_means(reports: DataFrame) -> DataFrame:
    """``(path, metric, mean)`` from ``summary.metric_scores``; an entry
    is an object (take ``mean``, default 0.0) or a bare number."""
    e = reports.select("path", F.explode("summary.metric_scores").alias("metric", "v"))
    mean = F.coalesce(F.get_json_object("v", "$.mean").try_cast("double"),
                      F.when(~F.col("v").startswith("{"), F.col("v").try_cast("double")),
                      F.lit(0.0))
    return e.select("path", "metric", mean.alias("mean"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, mean)`` of a baseline report."""
    return report_metric_means(read_report(spark, path)).select("metric", "mean")


def report_to_scores(reports: DataFrame, run_id_col: str = "path") -> DataFrame:
    """Per-sample, per-metric rows rebuilt from report documents."""
    r = reports.select(F.col(run_id_col).alias("run_id"), F.explode("results").alias("r"))
    m = r.select("run_id", F.col("r.sample_index").alias("sample_id"),
                 F.explode("r.metrics").alias("m"))
    return m.select("run_id", "sample_id", F.col("m.name").alias("metric"),
                    F.col("m.score").alias("score"), F.col("m.details").alias("details"),
                    F.lit("ok").alias("status"))


def results_table(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """S13 rows: one per sample with its metric results in the requested
    order (E4). A sample has at most one row per metric, so each collected
    list is bounded by the metric count."""
    pos = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    item = F.struct(pos.alias("pos"), F.col("metric").alias("name"), F.col("score"),
                    F.col("details"))
    by_pos = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    return scores.groupBy("run_id", "sample_id").agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall_score"),
        F.array_sort(F.collect_list(item), by_pos).alias("_m")) \
        .select("run_id", F.col("sample_id").alias("sample_index"), "overall_score",
                F.transform("_m", lambda x: x.dropFields("pos")).alias("metrics"))


def report_head(summary: DataFrame, metric_summary: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """S13 head: one row (metadata?, summary) from a run's one-row summary, its
    per-metric statistics (a row per metric) and one row of metadata."""
    stats = [c for c in ("mean", "min", "max", "median", "p25", "p75", "std_dev") if c in metric_summary.columns]
    each = metric_summary.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "metric", F.struct(*stats).alias("stats"))))).alias("metric_scores"))
    head = summary.join(each, "run_id", "left").select(F.struct(
        "total_samples", "overall_score", "pass_count", "fail_count", "pass_rate", "threshold", "metric_scores").alias("summary"))
    if metadata is None:
        return head
    row = metadata.select(F.struct("*").alias("metadata"))
    return head.withColumn("metadata", F.lit(None) if row.isEmpty() else row.scalar())


def write_json_report(scores: DataFrame, metrics: list[str], path: str, summary: DataFrame | None = None,
                      metric_summary: DataFrame | None = None, metadata: DataFrame | None = None) -> None:
    """A report as a folder that executors write: ``results`` (JSON Lines,
    one per sample) and, last, ``summary`` (one JSON line), which ``read_report``
    and ``read_results`` read back."""
    path = path.rstrip("/")
    results_table(scores, metrics).write.mode("overwrite").json(f"{path}/{RESULTS}")
    if summary is not None and metric_summary is not None:
        report_head(summary, metric_summary, metadata).coalesce(1).write.mode("overwrite").json(f"{path}/{HEAD}")


def write_csv_report(wide: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Wide table at 4 decimals; report metadata goes to a text file in the
    folder ``<path>_metadata``."""
    cols = [c for c in wide.columns if c not in ("run_id", "sample_id", "overall_score")]
    out = wide.select(F.col("sample_id").alias("sample_index"),
                      F.format_number("overall_score", 4).alias("overall_score"),
                      *[F.format_string("%.4f", F.col(c)).alias(c) for c in cols])
    out.write.mode("overwrite").option("header", True).csv(path)
    if metadata:
        lines = [f"# {k}: {metadata[k]}" for k in ("timestamp", "version", "config_path", "git_hash") if k in metadata]
        spark = wide.sparkSession
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite") \
            .text(f"{path.rstrip('/')}_metadata")


def write_samples(samples: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Samples to JSON Lines (null reference / empty metadata left out)
    or CSV (context as a JSON array, metadata as JSON text -- kept, Q21)."""
    if fmt == "csv":
        out = samples.select(
            "sample_id", "query",
            F.when(F.size("context") > 0, F.to_json("context")).otherwise(F.lit("")).alias("context"),
            "answer", F.coalesce("reference", F.lit("")).alias("reference"),
            F.when(F.size("metadata") > 0, F.to_json("metadata")).otherwise(F.lit("")).alias("metadata"))
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return
    md = F.when(F.size("metadata") > 0, F.col("metadata"))
    ref = F.nullif(F.col("reference"), F.lit(""))
    line = F.to_json(F.struct("sample_id", "query", "context", "answer",
                              ref.alias("reference"), md.alias("metadata")), {"ignoreNullFields": "false"})
    samples.select(line.alias("value")).write.mode("overwrite").text(path)


def write_many(scores: DataFrame, metrics: list[str], base_path: str, formats: list[str]) -> list[str]:
    """Several sinks from one scoring pass (the caller persists or
    stores ``scores`` first, so the scoring plan runs once)."""
    from ragscope.operators.summary import scores_wide
    paths = []
    for f in formats:
        p = f"{base_path}.{f}"
        if f == "json":
            write_json_report(scores, metrics, p)
        elif f == "csv":
            write_csv_report(scores_wide(scores, metrics), p)
        elif f == "parquet":
            scores.write.mode("overwrite").parquet(p)
        else:
            raise ValueError(f"unknown format {f}")
        paths.append(p)
    return paths


def report_metadata(spark: SparkSession, config_path: str | None = None) -> DataFrame:
    """One row of run metadata (no subprocess calls)."""
    return spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(spark.version).alias("engine_version"),
        F.lit(config_path).cast("string").alias("config_path"))
