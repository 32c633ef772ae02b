"""Dataset profile and validation (A9, A12, F9, J6) and chat pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.functions.text import py_strip
from ragscope.operators.metrics import METRIC_REQUIREMENTS


def _has_reference():
    return F.coalesce(F.length("reference"), F.lit(0)) > 0


def _has_context():
    return F.coalesce(F.size("context"), F.lit(0)) > 0


def profile(samples: DataFrame) -> DataFrame:
    """One global aggregate; an empty input gives zeros (Q23)."""
    return samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(_has_reference()).alias("with_reference"),
        F.count_if(_has_context()).alias("with_context"),
        F.coalesce(F.avg(F.coalesce(F.size("context"), F.lit(0))), F.lit(0.0)).alias("avg_context_chunks"),
        F.coalesce(F.avg(F.length("query")), F.lit(0.0)).alias("avg_query_len"),
        F.coalesce(F.avg(F.length("answer")), F.lit(0.0)).alias("avg_answer_len"))


# Validation messages.
ISSUE_RULES = [
    ("error", "empty_query", "Empty query"),
    ("error", "empty_answer", "Empty answer"),
    ("warning", "no_context", "No context (ok for non-RAG tasks)"),
    ("warning", "query_equals_answer", "Query identical to answer"),
]


def issues(samples: DataFrame) -> DataFrame:
    """one row per (sample, issue); computed in one projection + explode."""
    q = F.coalesce(F.col("query"), F.lit(""))
    a = F.coalesce(F.col("answer"), F.lit(""))
    conds = [py_strip(q) == "", py_strip(a) == "", ~_has_context(), q == a]
    found = F.filter(F.array(*[
        F.when(c, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"),
                           F.lit(msg).alias("message")))
        for c, (sev, code, msg) in zip(conds, ISSUE_RULES)]), lambda x: x.isNotNull())
    return samples.select("sample_id", F.explode(found).alias("i")).select("sample_id", "i.*")


def missing_fields(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Per required field, rows missing it and the selected metrics
    that need it. One aggregate over the samples; the requirement map is a
    driver-side constant of a few entries."""
    need: dict[str, list[str]] = {}
    for m in metrics:
        for f in METRIC_REQUIREMENTS.get(m, ()):
            need.setdefault(f, []).append(m)
    if not need:
        return samples.sparkSession.createDataFrame(
            [], "field string, missing long, needed_by array<string>")
    missing = {"reference": ~_has_reference(), "context": ~_has_context()}
    agg = samples.agg(*[F.count_if(missing[f]).alias(f) for f in need])
    rows = [F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("missing"),
                     F.array(*[F.lit(m) for m in ms]).alias("needed_by"))
            for f, ms in need.items()]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("missing > 0")


TURNS = 1 << 24  # turns of one conversation that sample ids tell apart


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """Samples from chat logs: a user turn directly followed by an assistant
    turn. Pairing is an equi-join on ``(conv_id, turn + 1)``: keys are unique,
    so a very long conversation does not land in one task. The system text of
    a conversation (first by turn) becomes the context. ``sample_id`` is unique
    for conversations of up to TURNS turns; metadata holds both of its parts."""
    c = conversations
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    sysmsg = c.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("system"))
    pairs = u.join(a, ["conv_id", "turn"], "inner").join(sysmsg, "conv_id", "left")
    return pairs.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("sample_id"),
        "query",
        F.when(F.col("system").isNotNull(), F.array("system"))
         .otherwise(F.array().cast("array<string>")).alias("context"),
        "answer",
        F.lit(None).cast("string").alias("reference"),
        F.create_map(F.lit("conv_id"), F.col("conv_id").cast("string"),
                     F.lit("turn"), F.col("turn").cast("string")).alias("metadata"))
