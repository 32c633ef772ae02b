"""Sample readers (S1-S9): JSON Lines, CSV, Parquet, with a rejects table.

Every reader returns ``(samples, rejects)``: rows that do not fit the sample
schema are kept in ``rejects(file, line, reason, missing)`` instead of
stopping the job; ``strict=True`` raises on the first reject instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ragscope.functions.text import py_strip
from ragscope.session import last_key_wins
from ragscope.storage import exists, store

REQUIRED = ["query", "context", "answer"]

# JSON shape of one sample line (sample_id optional).
SAMPLE_JSON = T.StructType([
    T.StructField("sample_id", T.LongType(), True),
    T.StructField("query", T.StringType(), True),
    T.StructField("context", T.ArrayType(T.StringType()), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("reference", T.StringType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])


class RejectedRows(ValueError):
    pass


def positions() -> list[Column]:
    """Partition and place of each row in it, to be stored with the rows."""
    pid, mid = F.spark_partition_id(), F.monotonically_increasing_id()
    return [pid.alias("_pid"), (mid - F.shiftleft(pid.cast("long"), 33)).alias("_at")]


def with_row_ids(table: DataFrame, col: str = "sample_id") -> DataFrame:
    """Dense 0-based ids without a global window, for a stored ``table``
    with ``positions()``: the rows of a partition are numbered by place, and
    counts per partition (one small row each) become offsets. Only these two
    narrow columns are read twice, never the source."""
    order = Window.partitionBy("_pid").orderBy("_at")
    counts = table.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_pid", F.coalesce(before, F.lit(0)).alias("_off"))
    return table.withColumn("_i", F.row_number().over(order)).join(F.broadcast(offsets), "_pid") \
        .withColumn(col, F.col("_off") + F.col("_i") - 1).drop("_pid", "_at", "_i", "_off")


def parse_jsonl_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """S1/S2/S8 on a ``(file, value)`` line table: one row per non-blank line
    with the parsed sample fields, ``missing`` keys and a ``reason`` (null if
    the line is a good sample), and the columns ``keep``. Of a repeated key,
    the last value counts. Works the same on a stream."""
    last_key_wins()
    text = py_strip(F.col("value"))
    keys = F.json_object_keys(text)
    parsed = F.from_json(text, SAMPLE_JSON)
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), F.coalesce(keys, F.array()))
    kind = _json_kind(text)
    field = lambda k: F.regexp_extract(F.schema_of_variant(F.try_variant_get(
        F.try_parse_json(text), f"$.{k}", "variant")), "^[A-Z]+", 0)
    fits = {"query": ["STRING", "VOID"], "answer": ["STRING", "VOID"], "context": ["ARRAY", "VOID"],
            "reference": ["STRING", "VOID"], "metadata": ["OBJECT", "VOID"]}
    misfit = F.lit(False)
    for k, kinds in fits.items():
        misfit = misfit | F.coalesce(~field(k).isin(*kinds), F.lit(False))
    reason = (F.when(keys.isNull() | F.coalesce(kind != "OBJECT", F.lit(True)), F.lit("invalid JSON (not an object)"))
              .when(F.size(missing) > 0, F.lit("missing required field(s)"))
              .when(misfit, F.lit("a field has the wrong type")))
    return (lines.where(text != F.lit(""))
            .select("file", F.col("value").alias("line"), parsed.alias("s"),
                    F.when(keys.isNotNull(), missing).alias("missing"), reason.alias("reason"), *(keep or [])))


SAMPLE_FIELDS = ["sample_id", "query", "context", "answer", "reference", "metadata"]


def _rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("file", "line", "reason", "missing")


def _check_strict(rejects: DataFrame, strict: bool) -> None:
    if strict:
        first = rejects.limit(1).collect()
        if first:
            r = first[0]
            raise RejectedRows(f"{r['reason']} in {r['file']}: {r['line'][:200]!r}"
                               + (f" missing {r['missing']}" if r["missing"] else ""))


def _with_ids(good: DataFrame, assign_ids: bool | None) -> DataFrame:
    """Ids for the rows of a stored table of samples with ``positions()``.

    Given ids stay. Where no row has one, rows are numbered from 0; where some
    have, the others get -1, -2, ..., which no given id is meant to be."""
    if assign_ids is None:
        assign_ids = good.where("sample_id IS NOT NULL").isEmpty()
    if assign_ids:
        return with_row_ids(good.drop("sample_id"))
    given = good.where("sample_id IS NOT NULL").drop("_pid", "_at")
    others = with_row_ids(good.where("sample_id IS NULL").drop("sample_id"), "_row")
    return given.unionByName(others.withColumn("sample_id", -1 - F.col("_row")).drop("_row"))


def read_jsonl(spark: SparkSession, path: str, strict: bool = False,
               assign_ids: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON Lines samples, and the lines that are none.

    The source is read once: the parsed lines are stored, and ids, rejects and
    samples come from there. A given ``sample_id`` is kept; see ``_with_ids``
    for lines without one. ``assign_ids=True`` numbers all lines. With
    ``assign_ids=False`` nothing is stored and both results are lazy scans;
    lines without an id are rejects then.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", *positions())
    parsed = parse_jsonl_lines(lines, ["_pid", "_at"])
    sample = [F.col("s.sample_id"), F.col("s.query"),
              F.coalesce("s.context", F.array().cast("array<string>")).alias("context"),  # Q19
              F.col("s.answer"), F.col("s.reference"),
              F.coalesce("s.metadata", F.create_map().cast("map<string,string>")).alias("metadata")]
    bad = F.col("reason").isNotNull()
    if assign_ids is False:
        parsed = parsed.withColumn("reason", F.coalesce("reason", F.when(
            F.col("s.sample_id").isNull(), F.lit("missing sample_id"))))
        rejects = _rejects(parsed)
        _check_strict(rejects, strict)
        return parsed.where(~bad).select(*sample), rejects
    # a good line's text is not stored beside its fields
    stored = store(parsed.select("file", F.when(bad, F.col("line")).alias("line"), "reason", "missing", "_pid", "_at", *sample),
                   "jsonl")
    rejects = _rejects(stored)
    _check_strict(rejects, strict)
    good = stored.where(~bad).select("_pid", "_at", *SAMPLE_FIELDS)
    return _with_ids(good, assign_ids).select(*SAMPLE_FIELDS), rejects


def _json_kind(text: Column) -> Column:
    """OBJECT, ARRAY or another kind if all of ``text`` is one JSON value, else null."""
    # within brackets, text after the value would break the list or lengthen it
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant")), "^[A-Z]+", 0)
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), kind)


def parse_csv_context(raw: Column) -> Column:
    """Empty -> []; a JSON list -> its items as strings; else split on
    ``|``, trim, drop empties."""
    r = py_strip(F.coalesce(raw, F.lit("")))
    # within brackets, text after the list would break the outer list
    whole = F.from_json(F.concat(F.lit("["), r, F.lit("]")), T.ArrayType(T.ArrayType(T.StringType())),
                        {"mode": "PERMISSIVE"})
    as_json = F.when(r.startswith("[") & (_json_kind(r) == "ARRAY"),
                     F.transform(F.get(whole, F.lit(0)), lambda c: F.coalesce(c, F.lit("null"))))
    piped = F.filter(F.transform(F.split(r, r"\|"), lambda c: py_strip(c)), lambda c: c != "")
    return (F.when(r == F.lit(""), F.array().cast("array<string>"))
            .otherwise(F.coalesce(as_json, piped)))


def parse_csv_metadata(raw: Column) -> Column:
    """Blank -> {}; JSON object -> map; otherwise ``{raw_metadata: text}``."""
    r = py_strip(F.coalesce(raw, F.lit("")))
    return (F.when(r == F.lit(""), F.create_map().cast("map<string,string>"))
            .otherwise(F.coalesce(F.when(_json_kind(r) == "OBJECT", F.from_json(r, T.MapType(T.StringType(), T.StringType()))),
                                  F.create_map(F.lit("raw_metadata"), r))))


def _csv(spark: SparkSession, path: str, multi_line: bool):
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record"))


def read_csv(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: CSV samples with a header, and the records that are none.

    query/answer are trimmed, an empty reference is null (Q15/Q16). A record
    with fewer cells than the header has is a reject, with the cells it lacks
    (more cells are ignored); ``strict`` raises on the first, and on a file
    without records. Missing required columns raise. Cells with line breaks
    need ``multi_line``, with which a file is read by one task; without it,
    large files are split. The source is read once and stored; a ``sample_id``
    column is kept, else records are numbered from 0.
    """
    names = _csv(spark, path, multi_line).csv(path).columns
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"CSV missing required column(s): {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField("_record", T.StringType())])
    raw = _csv(spark, path, multi_line).schema(schema).csv(path)
    # Spark marks records with fewer and with more cells alike
    cells = F.size(F.split(F.regexp_replace("_record", '"[^"]*"', ""), ","))
    short = F.coalesce(cells < len(names), F.lit(False))
    lacks = F.slice(F.array(*[F.lit(c) for c in names]), F.least(cells, F.lit(len(names))) + 1, len(names))
    has_id = "sample_id" in names
    out = raw.select(
        F.col("_metadata.file_path").alias("file"), F.when(short, F.col("_record")).alias("line"),
        F.when(short, F.lit("fewer cells than the header")).alias("reason"), F.when(short, lacks).alias("missing"),
        (F.col("sample_id").try_cast("long") if has_id else F.lit(None).cast("long")).alias("sample_id"),
        py_strip(F.coalesce("query", F.lit(""))).alias("query"),
        parse_csv_context(F.col("context")).alias("context"),
        py_strip(F.coalesce("answer", F.lit(""))).alias("answer"),
        (F.nullif(py_strip(F.col("reference")), F.lit("")) if "reference" in names
         else F.lit(None).cast("string")).alias("reference"),
        (parse_csv_metadata(F.col("metadata")) if "metadata" in names
         else F.create_map().cast("map<string,string>")).alias("metadata"), *positions())
    out = store(out, "csv")
    if strict and out.isEmpty():
        raise ValueError("CSV file contains no data rows")
    rejects = _rejects(out)
    _check_strict(rejects, strict)
    good = out.where(F.col("reason").isNull())
    good = good if has_id else with_row_ids(good.drop("sample_id"))
    return good.select(*SAMPLE_FIELDS), rejects


def format_of(path: str) -> str:
    """.csv -> CSV, .parquet -> Parquet, anything else -> JSON Lines."""
    name = path.lower().rstrip("/")
    return "csv" if name.endswith(".csv") else "parquet" if name.endswith(".parquet") else "jsonl"


def read_samples(spark: SparkSession, path: str, fmt: str | None = None,
                 strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The reader for ``fmt`` or the extension, on any storage."""
    if not any(c in path for c in "*?[{") and not exists(spark, path):
        raise FileNotFoundError(path)
    f = fmt or format_of(path)
    if f == "csv":
        return read_csv(spark, path, strict=strict)
    if f == "parquet":
        df = spark.read.parquet(path)
        empty = spark.createDataFrame([], "file string, line string, reason string, missing array<string>")
        return df, empty
    return read_jsonl(spark, path, strict=strict)


def count_samples(spark: SparkSession, path: str) -> int:
    """Non-blank lines (JSON Lines), records (CSV) or rows (Parquet); no validation."""
    f = format_of(path)
    if f == "csv":
        return _csv(spark, path, True).csv(path).count()
    if f == "parquet":
        return spark.read.parquet(path).count()
    return spark.read.text(path).where(py_strip(F.col("value")) != F.lit("")).count()
