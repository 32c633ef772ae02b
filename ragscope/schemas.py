"""Table schemas (see the data model): samples, scores, runs, cache."""

from pyspark.sql import types as T

SAMPLE = T.StructType([
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("query", T.StringType(), True),
    T.StructField("context", T.ArrayType(T.StringType()), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("reference", T.StringType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])

CHECK = T.StructType([
    T.StructField("check", T.StringType(), True),
    T.StructField("passed", T.BooleanType(), True),
    T.StructField("detail", T.StringType(), True),
])

# Long table every summary is derived from: one row per run x sample x metric.
SCORES = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("status", T.StringType(), True),  # ok | guarded | judge_error
    T.StructField("reasoning", T.StringType(), True),
    T.StructField("method", T.StringType(), True),
    T.StructField("details", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("hits", T.ArrayType(T.StringType()), True),
    T.StructField("claims", T.ArrayType(T.StringType()), True),
    T.StructField("checks", T.ArrayType(CHECK), True),
])

SCORE_COLUMNS = [f.name for f in SCORES.fields]

JUDGE_CACHE = T.StructType([
    T.StructField("cache_key", T.StringType(), False),
    T.StructField("response", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

# One row per stored run.
RUNS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("tag", T.StringType(), True),
    T.StructField("config_path", T.StringType(), True),
    T.StructField("total_samples", T.LongType(), True),
    T.StructField("overall_score", T.DoubleType(), True),
    T.StructField("pass_count", T.LongType(), True),
    T.StructField("fail_count", T.LongType(), True),
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("engine_version", T.StringType(), True),
])

METRIC_SUMMARY_COLUMNS = ["run_id", "metric", "n", "mean", "min", "max",
                          "p25", "median", "p75", "std_dev"]

REJECT = T.StructType([
    T.StructField("file", T.StringType(), True),
    T.StructField("line", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("missing", T.ArrayType(T.StringType()), True),
])

# Report document (JSON sink / source).
REPORT_METRIC = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("details", T.MapType(T.StringType(), T.StringType()), True),
])
REPORT_RESULT = T.StructType([
    T.StructField("sample_index", T.LongType(), True),
    T.StructField("overall_score", T.DoubleType(), True),
    T.StructField("metrics", T.ArrayType(REPORT_METRIC), True),
])
