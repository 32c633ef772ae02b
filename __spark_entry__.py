"""

Every query goes through the ``ragscope`` library; this file only binds the
driver's tables to samples (documents + benchmark, conversations), defines
the deterministic stand-in judge used as a fixture, and states the DuckDB
oracle SQL for each query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragscope.functions import text as X
from ragscope.operators import compare as CMP
from ragscope.operators import history as H
from ragscope.operators import quality as Q
from ragscope.operators import quantiles as QT
from ragscope.operators import summary as S
from ragscope.operators import filters as FL
from ragscope.operators import cache as C
from ragscope.operators.judge import (TEMPLATES, ExpressionResponder, Judge, build_prompt,
                                      cache_key)
from ragscope.operators.metrics import ALL_JUDGE, METRIC_REQUIREMENTS
from ragscope.operators.score import score, score_runs
from ragscope.session import spread
from ragscope.storage import scratch_path, touch

SF0001 = "/root/testdata/sf0.001"

# ---------------------------------------------------------------------------
# Fixture: how the driver's tables stand in for evaluation samples.
# ---------------------------------------------------------------------------
# The fixture (FIXTURES 2.1): reference item = doc_id modulo the number of items,
# no reference when doc_id % 5 = 0, empty context when doc_id % 7 = 0,
# expected format by doc_id % 5, word bounds 10..400.
FORMAT_BY_MOD5 = ["json", "markdown_heading", "bullet_list", "numbered_list", None]
MIN_WORDS, MAX_WORDS = "10", "400"
MODEL_A, MODEL_B = "judge-a", "judge-b"
THRESHOLD = 0.7
ALL_METRICS = ["faithfulness", "answer_relevancy", "answer_correctness", "answer_similarity",
               "coherence", "context_precision", "context_recall", "format_compliance",
               "hallucination", "toxicity"]
WEIGHTS = {"faithfulness": 3.0, "answer_correctness": 2.0, "toxicity": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 2.1: one sample per document."""
    d = table(spark, sf_dir, "documents")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("ref_text"))
    # benchmark is a small dimension; Spark's size-checked broadcast
    # threshold picks the join strategy from the scan statistics.
    items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)))  # one row
    j = d.join(b, d.doc_id % items.scalar() == b.item_id, "left")
    fmt = F.element_at(F.array(*[F.lit(f) for f in FORMAT_BY_MOD5]), (F.col("doc_id") % 5 + 1).cast("int"))
    md = F.map_filter(F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
        F.lit("min_words"), F.lit(MIN_WORDS), F.lit("max_words"), F.lit(MAX_WORDS),
        F.lit("expected_format"), fmt), lambda k, v: v.isNotNull())
    return j.select(
        F.col("doc_id").alias("sample_id"),
        F.substring_index("text", "\n", 1).alias("query"),
        F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>"))
         .otherwise(F.slice(F.split("text", "\n"), F.lit(2), F.size(F.split("text", "\n")) - 1)).alias("context"),
        F.col("text").alias("answer"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("ref_text")).alias("reference"),
        md.alias("metadata"))


def samples_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 2.2: a user turn directly followed by an assistant turn."""
    conv = table(spark, sf_dir, "conversations")
    return Q.chat_pairs(conv)


def standin_score(model: str, prompt: Column) -> Column:
    """Deterministic stand-in judge score in [0, 1] from the prompt text."""
    h = F.substring(F.md5(F.concat(F.lit(model + "|"), prompt)), 1, 4)
    return F.conv(h, 16, 10).cast("double") / F.lit(65535.0)


def standin_judge(model: str, cache=None) -> Judge:
    """A fixture, not a library default: replies are JSON text, parsed by the
    same code that parses a real model's replies."""
    reply = lambda p: F.format_string('{"score": %s, "reasoning": "stand-in reply"}',
                                      standin_score(model, p).cast("string"))
    return Judge(ExpressionResponder(reply), model=model, temperature=0.0, cache=cache)


def run_scores(spark: SparkSession, sf_dir: str, run: str = "A", metrics=None) -> DataFrame:
    model = MODEL_A if run == "A" else MODEL_B
    return score(samples_docs(spark, sf_dir), metrics or ALL_METRICS,
                 judge=standin_judge(model), run_id=run)


def run_scores_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs A and B (two stand-in judges) scored in one pass over the samples."""
    return score_runs(samples_docs(spark, sf_dir), ALL_METRICS,
                      {"A": standin_judge(MODEL_A), "B": standin_judge(MODEL_B)})


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# DuckDB renderings of the same fixture and rules (oracle side).
# ---------------------------------------------------------------------------

def _lit(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts) if parts != [""] else "''"


WS_RE2 = X.WS_CLASS
SAMPLES_SQL = f"""
samples_docs AS (
  SELECT d.doc_id AS sample_id,
         split_part(d.text, chr(10), 1) AS query,
         CASE WHEN d.doc_id % 7 = 0 THEN []::VARCHAR[]
              ELSE string_split(d.text, chr(10))[2:] END AS context,
         d.text AS answer,
         CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE b.text END AS reference,
         d.lang, d.source,
         CASE d.doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'markdown_heading'
              WHEN 2 THEN 'bullet_list' WHEN 3 THEN 'numbered_list' END AS expected_format,
         {MIN_WORDS} AS min_words, {MAX_WORDS} AS max_words
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


def _sql_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def _sql_f1(a: str, r: str) -> str:
    at, rt = _sql_tokens(a), _sql_tokens(r)
    na, nr = f"len({at})", f"len({rt})"
    c = f"len(list_intersect({at}, {rt}))"
    p, q = f"({c} / {na})", f"({c} / {nr})"
    return (f"(CASE WHEN {na} = 0 AND {nr} = 0 THEN 1.0::DOUBLE "
            f"WHEN {na} = 0 OR {nr} = 0 OR {c} = 0 THEN 0.0::DOUBLE "
            f"ELSE 2 * {p} * {q} / ({p} + {q}) END)")


def _sql_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS_RE2}]+'))"


def _sql_strip(x: str) -> str:
    chars = X.PY_WHITESPACE.replace("'", "''")
    return f"trim({x}, '{chars}')"


def _sql_line_count(x: str, rule: str) -> str:
    r = rule.replace(r"\s", f"[{X.WS_CLASS_NO_NL}]")
    return f"len(regexp_extract_all({_sql_strip(x)}, '(?m){r}'))"


def _sql_toxic_any(x: str) -> str:
    pats = [p.replace(r"\s", f"[{WS_RE2}]") for p in X.TOXIC_PATTERNS]
    return "(" + " OR ".join(f"regexp_matches({x}, '(?i){p}')" for p in pats) + ")"


def _sql_context(kind: str) -> str:
    if kind == "context_bullets":
        return "array_to_string(list_transform(context, lambda c: '- ' || c), chr(10))"
    return ("array_to_string(list_transform(context, lambda c, i: '  [' || i::VARCHAR || '] ' || c),"
            " chr(10))")


def _sql_prompt(metric: str) -> str:
    t = TEMPLATES[metric]
    parts = [_lit(t.instruction)]
    for title, kind in t.sections:
        if kind == "query":
            v = "query"
        elif kind == "answer":
            v = "answer"
        elif kind == "reference":
            v = "coalesce(reference, '')"
        elif kind == "reference_opt":
            v = "nullif(reference, '')"
        else:
            v = _sql_context(kind)
        parts.append(f"{_lit('## ' + title + chr(10))} || {v}")
    parts.append(_lit(t.reply))
    return "concat_ws(chr(10) || chr(10), " + ", ".join(parts) + ")"


def _sql_standin(model: str, prompt: str) -> str:
    return (f"(CAST(CAST(('0x' || substr(md5('{model}|' || {prompt}), 1, 4)) AS INTEGER) AS DOUBLE)"
            f" / CAST(65535 AS DOUBLE))")


def _sql_no_ref() -> str:
    return "coalesce(length(reference), 0) = 0"


def _sql_no_ctx() -> str:
    return "coalesce(len(context), 0) = 0"


def _sql_format_score() -> str:
    """M8 over samples_docs columns, as 1.0/0.0 (the oracle side of the rules).

    JSON validity: the answers are prose, where json_valid and json.loads agree.
    """
    fmt_ok = (f"CASE expected_format WHEN 'json' THEN coalesce(json_valid(answer), false) "
              f"WHEN 'markdown_heading' THEN regexp_matches({_sql_strip('answer')}, "
              f"'^#{{1,6}}[{WS_RE2}]') "
              f"WHEN 'bullet_list' THEN {_sql_line_count('answer', X.BULLET_RULE)} >= 2 "
              f"WHEN 'numbered_list' THEN {_sql_line_count('answer', X.NUMBERED_RULE)} >= 2 "
              f"ELSE false END")
    fmt_failed = f"(expected_format IS NOT NULL AND expected_format <> '' AND NOT ({fmt_ok}))"
    wc = _sql_words("answer")
    bad = f"({fmt_failed} OR {wc} < min_words OR {wc} > max_words)"
    return f"(CASE WHEN {bad} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)"


def _sql_metric_rows(model: str, run: str) -> str:
    """Long table (run_id, sample_id, metric, score, status) for all ten metrics."""
    rows = []
    j = lambda m: _sql_standin(model, _sql_prompt(m))
    for m in ALL_METRICS:
        if m == "format_compliance":
            sc, st = _sql_format_score(), "'ok'"
        elif m == "answer_correctness":
            f1 = _sql_f1("answer", "coalesce(reference, '')")
            sc = (f"CASE WHEN {_sql_no_ref()} THEN {j(m)} "
                  f"ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * {f1} + 0.6::DOUBLE * {j(m)})) END")
            st = "'ok'"
        elif m == "answer_similarity":
            sc = f"CASE WHEN {_sql_no_ref()} THEN 0.0::DOUBLE ELSE {j(m)} END"
            st = f"CASE WHEN {_sql_no_ref()} THEN 'guarded' ELSE 'ok' END"
        elif m == "context_precision":
            sc = f"CASE WHEN {_sql_no_ctx()} THEN 0.0::DOUBLE ELSE {j(m)} END"
            st = f"CASE WHEN {_sql_no_ctx()} THEN 'guarded' ELSE 'ok' END"
        elif m == "context_recall":
            g = f"({_sql_no_ctx()} OR {_sql_no_ref()})"
            sc = f"CASE WHEN {g} THEN 0.0::DOUBLE ELSE {j(m)} END"
            st = f"CASE WHEN {g} THEN 'guarded' ELSE 'ok' END"
        elif m == "toxicity":
            g = _sql_toxic_any("answer")
            sc = f"CASE WHEN {g} THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - {j(m)})) END"
            st = f"CASE WHEN {g} THEN 'guarded' ELSE 'ok' END"
        else:
            sc, st = j(m), "'ok'"
        rows.append(f"SELECT '{run}' AS run_id, sample_id, '{m}' AS metric, {sc} AS score, "
                    f"{st} AS status FROM samples_docs")
    return "\nUNION ALL\n".join(rows)


def _sql_scores_cte() -> str:
    return (f"WITH {SAMPLES_SQL},\nscores AS (\n{_sql_metric_rows(MODEL_A, 'A')}\n)")


def _sql_scores_ab_cte() -> str:
    return (f"WITH {SAMPLES_SQL},\nscores AS (\n{_sql_metric_rows(MODEL_A, 'A')}\n"
            f"UNION ALL\n{_sql_metric_rows(MODEL_B, 'B')}\n)")


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

def q_token_f1_by_lang(spark, sf_dir):
    """Token F1 of each document against its benchmark item, by lang."""
    d = spread(table(spark, sf_dir, "documents"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    items = b.agg(F.count(F.lit(1)))  # one row
    j = d.join(b, d.doc_id % items.scalar() == b.item_id, "inner")
    sets = j.select("lang", X.token_set("text").alias("a"), X.token_set("ref").alias("r"))
    s = sets.select("lang", X.token_f1_from_sets("a", "r").alias("f1"))
    return QT.distribution_of(s, ["lang"], F.col("f1")).select(
        "lang", "n", *[_r6(F.col(c)).alias(c) for c in ["mean", "min", "max", "p25", "median", "p75", "std_dev"]])


SQL_TOKEN_F1_BY_LANG = f"""
WITH j AS (SELECT d.lang, {_sql_f1('d.text', 'b.text')} AS f1
           FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT lang, count(*) AS n, round(avg(f1), 6) AS mean, round(min(f1), 6) AS min,
       round(max(f1), 6) AS max, round(quantile_cont(f1, 0.25), 6) AS p25,
       round(quantile_cont(f1, 0.5), 6) AS median, round(quantile_cont(f1, 0.75), 6) AS p75,
       round(stddev_pop(f1), 6) AS std_dev
FROM j GROUP BY lang"""


def q_format_rules_by_role(spark, sf_dir):
    """X4-X7 over whole conversation texts, per role."""
    c = spread(table(spark, sf_dir, "conversations"))
    t = F.coalesce(F.col("text"), F.lit(""))
    return c.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(X.word_count(t)).alias("words"),
        F.count_if(X.starts_with_heading(t)).alias("headings"),
        F.sum(X.bullet_items(t)).alias("bullet_lines"),
        F.sum(X.numbered_items(t)).alias("numbered_lines"),
        F.sum(F.size(X.token_set(t))).alias("distinct_tokens"))


SQL_FORMAT_RULES_BY_ROLE = f"""
SELECT role, count(*) AS n, sum({_sql_words("coalesce(text, '')")})::BIGINT AS words,
       count(*) FILTER (WHERE regexp_matches({_sql_strip("coalesce(text, '')")}, '^#{{1,6}}[{WS_RE2}]')) AS headings,
       sum({_sql_line_count("coalesce(text, '')", X.BULLET_RULE)})::BIGINT AS bullet_lines,
       sum({_sql_line_count("coalesce(text, '')", X.NUMBERED_RULE)})::BIGINT AS numbered_lines,
       sum(len({_sql_tokens("coalesce(text, '')")}))::BIGINT AS distinct_tokens
FROM conversations GROUP BY role"""


def q_format_compliance(spark, sf_dir):
    """M8 per sample over the documents (format rule by metadata + word bounds)."""
    sc = score(samples_docs(spark, sf_dir), ["format_compliance"], run_id="A")
    return sc.select("sample_id", "score", F.size("checks").alias("n_checks"))


SQL_FORMAT_COMPLIANCE = f"""
WITH {SAMPLES_SQL}
SELECT sample_id, {_sql_format_score()} AS score,
       (CASE WHEN expected_format IS NOT NULL THEN 1 ELSE 0 END
        + CASE WHEN {_sql_words('answer')} < min_words THEN 1 ELSE 0 END
        + CASE WHEN {_sql_words('answer')} > max_words THEN 1 ELSE 0 END
        + CASE WHEN {_sql_format_score()} = 1.0 THEN 1 ELSE 0 END)::INTEGER AS n_checks
FROM samples_docs"""


def q_toxicity_pattern_hits(spark, sf_dir):
    """Documents whose whole text hits a toxic pattern."""
    d = spread(table(spark, sf_dir, "documents"))
    row = F.struct(F.col("doc_id"), X.toxic_hits("text").alias("hits"))
    # Keep hit rows through a generator: a plain filter on the regex result
    # would be pushed below the repartition, back into the single scan task.
    h = d.select(F.inline(F.filter(F.array(row), lambda r: F.size(r["hits"]) > 0)))
    return h.select("doc_id", F.size("hits").alias("n_hits"),
                    F.lower(F.array_join("hits", "|")).alias("hits"))


def _sql_hits(x: str) -> str:
    pats = [p.replace(r"\s", f"[{WS_RE2}]") for p in X.TOXIC_PATTERNS]
    return ("list_filter([" + ", ".join(f"regexp_extract({x}, '(?i){p}', 0)" for p in pats)
            + "], lambda h: h <> '')")


SQL_TOXICITY_PATTERN_HITS = f"""
SELECT doc_id, len(h)::INTEGER AS n_hits, lower(array_to_string(h, '|')) AS hits
FROM (SELECT doc_id, {_sql_hits('text')} AS h FROM documents) WHERE len(h) > 0"""


def q_toxicity_vs_label(spark, sf_dir):
    """M10 pattern stage joined to labels: flagged x labelled counts."""
    sc = score(samples_docs(spark, sf_dir), ["toxicity"], judge=standin_judge(MODEL_A), run_id="A")
    flagged = sc.select("sample_id", (F.col("method") == "pattern_scan").alias("flagged"),
                        "score")
    lab = table(spark, sf_dir, "labels")
    j = flagged.join(lab, flagged.sample_id == lab.doc_id, "inner")
    return j.groupBy("toxic", "flagged").agg(F.count(F.lit(1)).alias("n"),
                                             _r6(F.avg("score")).alias("mean_safety"))


SQL_TOXICITY_VS_LABEL = f"""
{_sql_scores_cte()}
SELECT l.toxic, s.status = 'guarded' AS flagged, count(*) AS n, round(avg(s.score), 6) AS mean_safety
FROM scores s JOIN labels l ON l.doc_id = s.sample_id
WHERE s.metric = 'toxicity' GROUP BY 1, 2"""


def q_judge_all_metrics_long(spark, sf_dir):
    """M1-M10 + J5: the long SCORES table of run A."""
    return run_scores(spark, sf_dir, "A").select("run_id", "sample_id", "metric", "score", "status")


SQL_JUDGE_ALL_METRICS_LONG = f"""
{_sql_scores_cte()}
SELECT run_id, sample_id, metric, score, status FROM scores"""


def q_judge_guarded_scores(spark, sf_dir):
    """F8 with M4, M6, M7: guarded versus judged rows per metric."""
    sc = run_scores(spark, sf_dir, "A", ["answer_similarity", "context_precision", "context_recall"])
    return sc.groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"),
                                              _r6(F.sum("score")).alias("total"))


SQL_JUDGE_GUARDED_SCORES = f"""
{_sql_scores_cte()}
SELECT metric, status, count(*) AS n, round(sum(score), 6) AS total FROM scores
WHERE metric IN ('answer_similarity', 'context_precision', 'context_recall') GROUP BY 1, 2"""


def q_answer_correctness_blend(spark, sf_dir):
    """The blended correctness score per sample."""
    sc = run_scores(spark, sf_dir, "A", ["answer_correctness"])
    return sc.select("sample_id", "score",
                     F.try_element_at("details", F.lit("token_overlap")).isNotNull()
                     .alias("blended"))


SQL_ANSWER_CORRECTNESS_BLEND = f"""
{_sql_scores_cte()}
SELECT s.sample_id, s.score, NOT (coalesce(length(d.reference), 0) = 0) AS blended
FROM scores s JOIN samples_docs d USING (sample_id) WHERE s.metric = 'answer_correctness'"""


def _summary_cols(df):
    return df.select("run_id", "metric", "n", "error_count",
                     *[_r6(F.col(c)).alias(c) for c in
                       ["mean", "min", "max", "p25", "median", "p75", "std_dev"]])


def q_metric_summary(spark, sf_dir):
    """A1/A2: per-metric distribution of run A."""
    return _summary_cols(S.metric_summary(run_scores(spark, sf_dir, "A")))


SQL_METRIC_SUMMARY = f"""
{_sql_scores_cte()}
SELECT run_id, metric, count(score) AS n, count(*) FILTER (WHERE status = 'judge_error') AS error_count,
       round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max,
       round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS median,
       round(quantile_cont(score, 0.75), 6) AS p75, round(stddev_pop(score), 6) AS std_dev
FROM scores GROUP BY run_id, metric"""


def _run_summary_cols(df):
    return df.select("run_id", "total_samples", "pass_count", "fail_count",
                     *[_r6(F.col(c)).alias(c) for c in
                       ["overall_score", "pass_rate", "median", "p25", "p75", "std_dev",
                        "min_score", "max_score"]], "all_passed")


def q_run_summary(spark, sf_dir):
    """One row per run, unweighted."""
    samp = S.sample_scores(run_scores(spark, sf_dir, "A"))
    return _run_summary_cols(S.run_summary(samp, THRESHOLD))


_SQL_SAMPLE_SCORES = "sample_scores AS (SELECT run_id, sample_id, avg(score) AS o FROM scores GROUP BY 1, 2)"

SQL_RUN_SUMMARY = f"""
{_sql_scores_cte()}, {_SQL_SAMPLE_SCORES}
SELECT run_id, count(*) AS total_samples, count(*) FILTER (WHERE o >= {THRESHOLD}) AS pass_count,
       count(*) FILTER (WHERE o < {THRESHOLD}) AS fail_count,
       round(avg(o), 6) AS overall_score,
       round(count(*) FILTER (WHERE o >= {THRESHOLD}) / count(*), 6) AS pass_rate,
       round(quantile_cont(o, 0.5), 6) AS median, round(quantile_cont(o, 0.25), 6) AS p25,
       round(quantile_cont(o, 0.75), 6) AS p75, round(stddev_pop(o), 6) AS std_dev,
       round(min(o), 6) AS min_score, round(max(o), 6) AS max_score,
       count(*) FILTER (WHERE o < {THRESHOLD}) = 0 AND count(*) > 0 AS all_passed
FROM sample_scores GROUP BY run_id"""


def q_weighted_overall(spark, sf_dir):
    """Weighted overall from per-metric means (missing weight = 1)."""
    sc = run_scores(spark, sf_dir, "A")
    w = S.weights_table(spark, WEIGHTS)
    return S.weighted_overall(S.metric_means(sc), w).select(
        "run_id", _r6(F.col("weighted_score")).alias("weighted_score"))


def _sql_weights() -> str:
    return ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())


SQL_WEIGHTED_OVERALL = f"""
{_sql_scores_cte()},
m AS (SELECT run_id, metric, avg(score) AS mean FROM scores GROUP BY 1, 2),
w(metric, weight) AS (VALUES {_sql_weights()})
SELECT run_id, round(sum(mean * coalesce(weight, 1.0::DOUBLE)) / sum(coalesce(weight, 1.0::DOUBLE)), 6) AS weighted_score
FROM m LEFT JOIN w USING (metric) GROUP BY run_id"""


def q_pass_rate(spark, sf_dir):
    """Per-metric pass counts at the threshold plus the run pass rate."""
    sc = run_scores(spark, sf_dir, "A")
    return S.failures_by_metric(sc, THRESHOLD)


SQL_PASS_RATE = f"""
{_sql_scores_cte()}
SELECT run_id, metric, count(*) AS tests, count(*) FILTER (WHERE coalesce(score, 0) < {THRESHOLD}) AS failures
FROM scores GROUP BY 1, 2"""


def q_score_histogram(spark, sf_dir):
    """A10: ten bins per metric, empty bins kept."""
    return S.histogram(run_scores(spark, sf_dir, "A")).select("run_id", "metric", "bin", "count")


SQL_SCORE_HISTOGRAM = f"""
{_sql_scores_cte()},
c AS (SELECT run_id, metric, least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, count(*) AS n
      FROM scores GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT run_id, metric, unnest(range(0, 10)) AS bin FROM scores)
SELECT g.run_id, g.metric, g.bin::INTEGER AS bin, coalesce(c.n, 0) AS count
FROM g LEFT JOIN c USING (run_id, metric, bin)"""


def q_failures_by_metric(spark, sf_dir):
    """A11 with X16: failing cases per metric with messages (count + first msg)."""
    cases = S.failure_cases(run_scores(spark, sf_dir, "A"), THRESHOLD)
    return cases.groupBy("metric").agg(F.count(F.lit(1)).alias("failures"),
                                       F.min("sample_id").alias("first_sample"))


SQL_FAILURES_BY_METRIC = f"""
{_sql_scores_cte()}
SELECT metric, count(*) AS failures, min(sample_id) AS first_sample
FROM scores WHERE coalesce(score, 0) < {THRESHOLD} GROUP BY metric"""


def q_worst_samples(spark, sf_dir):
    """The ten lowest row scores (a top-k report)."""
    samp = S.sample_scores(run_scores(spark, sf_dir, "A"))
    return S.worst_samples(samp, 10).select("sample_id", _r6(F.col("overall_score")).alias("overall_score"))


SQL_WORST_SAMPLES = f"""
{_sql_scores_cte()}, {_SQL_SAMPLE_SCORES}
SELECT sample_id, round(o, 6) AS overall_score FROM sample_scores ORDER BY o, sample_id LIMIT 10"""


def q_scores_wide(spark, sf_dir):
    """One row per sample, one column per metric."""
    w = S.scores_wide(run_scores(spark, sf_dir, "A"), ALL_METRICS)
    return w.select("sample_id", _r6(F.col("overall_score")).alias("overall_score"),
                    *[_r6(F.col(m)).alias(m) for m in ALL_METRICS])


SQL_SCORES_WIDE = f"""
{_sql_scores_cte()}
SELECT sample_id, round(avg(score), 6) AS overall_score,
       {", ".join(f"round(coalesce(max(score) FILTER (WHERE metric = '{m}'), 0.0), 6) AS {m}" for m in ALL_METRICS)}
FROM scores GROUP BY sample_id"""


def q_compare_runs(spark, sf_dir):
    """Run A against run B per metric (full outer on metric)."""
    sc = run_scores_ab(spark, sf_dir)
    m = S.metric_means(sc)
    cmp = CMP.compare(m.where(F.col("run_id") == "A"), m.where(F.col("run_id") == "B"))
    return cmp.select("metric", _r6(F.col("score_a")).alias("score_a"),
                      _r6(F.col("score_b")).alias("score_b"), _r6(F.col("delta")).alias("delta"),
                      "direction")


SQL_COMPARE_RUNS = f"""
{_sql_scores_ab_cte()},
m AS (SELECT run_id, metric, avg(score) AS mean FROM scores GROUP BY 1, 2),
j AS (SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.mean, 0.0) AS sa, coalesce(b.mean, 0.0) AS sb
      FROM (SELECT * FROM m WHERE run_id = 'A') a FULL OUTER JOIN (SELECT * FROM m WHERE run_id = 'B') b
      ON a.metric = b.metric)
SELECT metric, round(sa, 6) AS score_a, round(sb, 6) AS score_b, round(sb - sa, 6) AS delta,
       CASE WHEN sb - sa > 0.001 THEN 'up' WHEN sb - sa < -0.001 THEN 'down' ELSE 'same' END AS direction
FROM j"""


def q_regression_check(spark, sf_dir):
    """baseline = metric means of run A; current = run B."""
    a = S.current_means(run_scores(spark, sf_dir, "A")).select("metric", "mean")
    cur = run_scores(spark, sf_dir, "B")
    r = CMP.check_regression(cur, a, tolerance=0.05)
    return r.select("metric", _r6(F.col("baseline")).alias("baseline"),
                    _r6(F.col("current")).alias("current"), _r6(F.col("delta")).alias("delta"),
                    "passed")


SQL_REGRESSION_CHECK = f"""
{_sql_scores_ab_cte()},
m AS (SELECT run_id, metric, avg(score) AS mean FROM scores GROUP BY 1, 2)
SELECT a.metric, round(a.mean, 6) AS baseline, round(coalesce(b.mean, 0.0), 6) AS current,
       round(coalesce(b.mean, 0.0) - a.mean, 6) AS delta, coalesce(b.mean, 0.0) - a.mean >= -0.05 AS passed
FROM (SELECT * FROM m WHERE run_id = 'A') a LEFT JOIN (SELECT * FROM m WHERE run_id = 'B') b
ON a.metric = b.metric"""


# --- dataset quality (A9, F9, A12), filters (F1, F2), chat pairs ----------

def q_dataset_profile(spark, sf_dir):
    """Dataset profile of the document samples."""
    p = Q.profile(samples_docs(spark, sf_dir))
    return p.select("samples", "with_reference", "with_context",
                    *[_r6(F.col(c)).alias(c) for c in
                      ["avg_context_chunks", "avg_query_len", "avg_answer_len"]])


SQL_DATASET_PROFILE = f"""
WITH {SAMPLES_SQL}
SELECT count(*) AS samples, count(*) FILTER (WHERE coalesce(length(reference), 0) > 0) AS with_reference,
       count(*) FILTER (WHERE len(context) > 0) AS with_context,
       round(avg(len(context)), 6) AS avg_context_chunks, round(avg(length(query)), 6) AS avg_query_len,
       round(avg(length(answer)), 6) AS avg_answer_len
FROM samples_docs"""


def q_dataset_issues(spark, sf_dir):
    """validation issues by code."""
    return Q.issues(samples_docs(spark, sf_dir)).groupBy("code", "severity") \
        .agg(F.count(F.lit(1)).alias("n"))


SQL_DATASET_ISSUES = f"""
WITH {SAMPLES_SQL}
SELECT code, severity, count(*) AS n FROM (
  SELECT 'empty_query' AS code, 'error' AS severity FROM samples_docs WHERE {_sql_strip("coalesce(query, '')")} = ''
  UNION ALL SELECT 'empty_answer', 'error' FROM samples_docs WHERE {_sql_strip("coalesce(answer, '')")} = ''
  UNION ALL SELECT 'no_context', 'warning' FROM samples_docs WHERE coalesce(len(context), 0) = 0
  UNION ALL SELECT 'query_equals_answer', 'warning' FROM samples_docs WHERE coalesce(query, '') = coalesce(answer, '')
) GROUP BY 1, 2"""


def q_missing_fields_by_metric(spark, sf_dir):
    """Rows lacking a field some selected metric needs."""
    m = Q.missing_fields(samples_docs(spark, sf_dir), ALL_METRICS)
    return m.select("field", "missing", F.array_join("needed_by", ",").alias("needed_by"))


def _needed(field):
    return ",".join(m for m in ALL_METRICS if field in METRIC_REQUIREMENTS.get(m, ()))


SQL_MISSING_FIELDS_BY_METRIC = f"""
WITH {SAMPLES_SQL}
SELECT * FROM (
  SELECT 'context' AS field, count(*) FILTER (WHERE coalesce(len(context), 0) = 0) AS missing,
         '{_needed("context")}' AS needed_by FROM samples_docs
  UNION ALL
  SELECT 'reference', count(*) FILTER (WHERE coalesce(length(reference), 0) = 0),
         '{_needed("reference")}' FROM samples_docs) WHERE missing > 0"""


def q_filter_by_metadata(spark, sf_dir):
    """``metadata.lang=en``."""
    return FL.filter_samples(samples_docs(spark, sf_dir), "metadata.lang=en").select("sample_id")


SQL_FILTER_BY_METADATA = f"""
WITH {SAMPLES_SQL}
SELECT sample_id FROM samples_docs WHERE lang = 'en'"""


def q_sample_n(spark, sf_dir):
    """exactly 100 samples by a seeded hash order (the limit is the feature)."""
    return FL.sample_n(samples_docs(spark, sf_dir), 100, seed=7).select("sample_id")


SQL_SAMPLE_N = f"""
WITH {SAMPLES_SQL}
SELECT sample_id FROM samples_docs ORDER BY md5('7|' || sample_id::VARCHAR), sample_id LIMIT 100"""


def q_reference_coverage(spark, sf_dir):
    """How many reference texts the samples are bound to: all of them."""
    s = samples_docs(spark, sf_dir).where("reference IS NOT NULL")
    return s.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("reference").alias("texts"))


SQL_REFERENCE_COVERAGE = f"""
WITH {SAMPLES_SQL}
SELECT count(*) AS samples, count(DISTINCT reference) AS texts FROM samples_docs WHERE reference IS NOT NULL"""


def q_chat_turn_pairs(spark, sf_dir):
    """FIXTURES 2.2: user turn followed by an assistant turn."""
    c = samples_chat(spark, sf_dir)
    return c.select("sample_id", F.length("query").alias("qlen"), F.length("answer").alias("alen"),
                    F.size("context").alias("n_context"),
                    F.try_element_at("metadata", F.lit("turn")).cast("long").alias("turn"))


SQL_CHAT_TURN_PAIRS = """
WITH c AS (SELECT conv_id, turn, role, text,
                  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext
           FROM conversations),
sys AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT conv_id * 16777216 + turn AS sample_id, length(text) AS qlen, length(ntext) AS alen,
       CAST(CASE WHEN sys.system IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_context, turn::BIGINT AS turn
FROM c LEFT JOIN sys USING (conv_id) WHERE role = 'user' AND nrole = 'assistant'"""


# --- judge cache (J3, U5, U7, U8, W3, A15) ---------------------------------

JUDGE_METRICS = [m for m in ALL_METRICS if m != "format_compliance"]
CACHE_AS_OF = "2024-03-01 00:00:00"


def cache_fixture(spark, sf_dir):
    """FIXTURES 2.4: replies for the prompts of even sample ids, written over
    60 days. Returns ``(prompts, cache rows)``."""
    j = standin_judge(MODEL_A)
    from ragscope.operators.score import prompt_table
    prompts = prompt_table(samples_docs(spark, sf_dir), JUDGE_METRICS, j, run_id="A")
    day = F.timestamp_add("DAY", (F.col("sample_id") % 60).cast("int"),
                          F.lit("2024-01-01 00:00:00").cast("timestamp"))
    cache = prompts.where(F.col("sample_id") % 2 == 0).select(
        "cache_key", j.responder.fn(F.col("prompt")).alias("response"), day.alias("created_at"))
    return prompts, cache


def q_cache_hit_miss(spark, sf_dir):
    """Per metric, prompts answered from the cache and prompts to ask."""
    prompts, cache = cache_fixture(spark, sf_dir)
    looked = C.lookup(prompts.select("metric", "cache_key"), C.latest_per_key(cache))
    return looked.groupBy("metric").agg(F.count(F.lit(1)).alias("prompts"),
                                        F.count_if("hit").alias("hits"),
                                        F.count_if(~F.col("hit")).alias("misses"))


def _sql_guard(m: str) -> str:
    """When a metric asks the judge at all."""
    return {"answer_similarity": f"NOT ({_sql_no_ref()})",
            "context_precision": f"NOT ({_sql_no_ctx()})",
            "context_recall": f"NOT ({_sql_no_ctx()} OR {_sql_no_ref()})",
            "toxicity": f"NOT {_sql_toxic_any('answer')}"}.get(m, "true")


def _sql_asked() -> str:
    rows = []
    for m in JUDGE_METRICS:
        rows.append(f"SELECT sample_id, '{m}' AS metric, {_sql_prompt(m)} AS prompt "
                    f"FROM samples_docs WHERE {_sql_guard(m)}")
    return (f"WITH {SAMPLES_SQL},\nasked0 AS ({' UNION ALL '.join(rows)}),\n"
            f"asked AS (SELECT *, sha256('{MODEL_A}|0.0|' || prompt) AS cache_key FROM asked0),\n"
            f"cache AS (SELECT cache_key, max(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(sample_id % 60 AS INTEGER))) AS created_at\n"
            f"          FROM asked WHERE sample_id % 2 = 0 GROUP BY cache_key)")


SQL_CACHE_HIT_MISS = f"""
{_sql_asked()}
SELECT metric, count(*) AS prompts, count(c.cache_key) AS hits, count(*) - count(c.cache_key) AS misses
FROM asked a LEFT JOIN cache c USING (cache_key) GROUP BY metric"""


def q_cache_evict(spark, sf_dir):
    """Keep the newest 500 keys (ties on key); the limit is the feature."""
    _, cache = cache_fixture(spark, sf_dir)
    kept = C.evict(C.latest_per_key(cache), 500)
    return kept.select("cache_key", X.short_ts(F.col("created_at")).alias("created_at"))


SQL_CACHE_EVICT = f"""
{_sql_asked()}
SELECT cache_key, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM cache
ORDER BY created_at DESC, cache_key ASC LIMIT 500"""


def q_cache_purge(spark, sf_dir):
    """Drop entries older than 30 days before the reference time."""
    _, cache = cache_fixture(spark, sf_dir)
    kept = C.purge(C.latest_per_key(cache), 30, F.lit(CACHE_AS_OF).cast("timestamp"))
    st = C.stats(kept)
    return kept.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("entries")).select(F.date_format("day", "yyyy-MM-dd").alias("day"),
                                                   "entries")


SQL_CACHE_PURGE = f"""
{_sql_asked()}
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS entries FROM cache
WHERE NOT (created_at < TIMESTAMP '{CACHE_AS_OF}' - INTERVAL 30 DAY) GROUP BY 1"""


def q_cache_stats(spark, sf_dir):
    """Entries and reply bytes of the cache."""
    _, cache = cache_fixture(spark, sf_dir)
    return C.stats(C.latest_per_key(cache)).select("entry_count")


SQL_CACHE_STATS = f"""
{_sql_asked()}
SELECT count(*) AS entry_count FROM cache"""


# --- history (T1, T2, W1, W2, W5, A14) -------------------------------------

def history_fixture(spark, sf_dir):
    """FIXTURES 2.4: one run per source; tag = source number % 3; ts = day n."""
    sc = run_scores(spark, sf_dir, "A")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "source")
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    samp = S.sample_scores(sc).join(d, "sample_id")
    runs = samp.groupBy("source").agg(F.avg("overall_score").alias("overall_score"),
                                      F.count(F.lit(1)).alias("total_samples")) \
        .select(F.col("source").alias("run_id"),
                F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("ts"),
                F.concat(F.lit("tag"), (n % 3).cast("string")).alias("tag"),
                "overall_score", "total_samples")
    msum = sc.join(d, "sample_id").groupBy(F.col("source").alias("run_id"), "metric") \
        .agg(F.avg("score").alias("mean"))
    return runs, msum


_SQL_RUNS = f"""{_sql_scores_cte()},
ss AS (SELECT sample_id, avg(score) AS o FROM scores GROUP BY sample_id),
r0 AS (SELECT d.source AS run_id, CAST(regexp_extract(d.source, '[0-9]+') AS INTEGER) AS n,
              avg(o) AS overall_score, count(*) AS total_samples
       FROM ss JOIN documents d ON d.doc_id = ss.sample_id GROUP BY d.source),
runs AS (SELECT run_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(n) AS ts, 'tag' || (n % 3) AS tag,
                overall_score, total_samples FROM r0)"""


def q_run_listing(spark, sf_dir):
    """Ten newest runs."""
    runs, _ = history_fixture(spark, sf_dir)
    return H.list_runs(runs, None, 10).select(
        "run_id", X.short_ts(F.col("ts")).alias("ts"), "tag",
        _r6(F.col("overall_score")).alias("overall_score"), "total_samples")


SQL_RUN_LISTING = f"""
{_SQL_RUNS}
SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, tag, round(overall_score, 6) AS overall_score,
       total_samples FROM runs ORDER BY ts DESC, run_id DESC LIMIT 10"""


def q_score_trend(spark, sf_dir):
    """Runs of tag1 oldest first, run number, sparkline level."""
    runs, _ = history_fixture(spark, sf_dir)
    return H.trend(runs, "tag1", 20).select("run_number", "run_id", "ts_text",
                                            _r6(F.col("overall_score")).alias("overall_score"), "level")


SQL_SCORE_TREND = f"""
{_SQL_RUNS},
listed AS (SELECT * FROM runs WHERE tag = 'tag1' ORDER BY ts DESC, run_id DESC LIMIT 20),
mm AS (SELECT min(overall_score) AS mn, max(overall_score) AS mx FROM listed)
SELECT CAST(row_number() OVER (ORDER BY ts, run_id) AS INTEGER) AS run_number, run_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, round(overall_score, 6) AS overall_score,
       CAST(floor((overall_score - mn) / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END * 8) AS INTEGER) AS level
FROM listed, mm"""


def q_trend_stats(spark, sf_dir):
    """A14 T5-style: min, max, mean, latest over all runs."""
    runs, _ = history_fixture(spark, sf_dir)
    st = H.trend_stats(H.list_runs(runs))
    return st.select("runs", *[_r6(F.col(c)).alias(c) for c in
                               ["min_score", "max_score", "mean_score", "latest_score"]])


SQL_TREND_STATS = f"""
{_SQL_RUNS}
SELECT count(*) AS runs, round(min(overall_score), 6) AS min_score, round(max(overall_score), 6) AS max_score,
       round(avg(overall_score), 6) AS mean_score, round(arg_max(overall_score, ts), 6) AS latest_score
FROM runs"""


def q_run_over_run_delta(spark, sf_dir):
    """Per tag and metric, the change against the previous run."""
    runs, msum = history_fixture(spark, sf_dir)
    r = H.run_over_run(runs, msum)
    return r.select("tag", "metric", "run_id", _r6(F.col("mean")).alias("mean"),
                    _r6(F.col("previous")).alias("previous"), _r6(F.col("delta")).alias("delta"))


SQL_RUN_OVER_RUN_DELTA = f"""
{_SQL_RUNS},
ms AS (SELECT d.source AS run_id, s.metric, avg(s.score) AS mean FROM scores s
       JOIN documents d ON d.doc_id = s.sample_id GROUP BY 1, 2),
j AS (SELECT r.tag, ms.metric, ms.run_id, ms.mean,
             lag(ms.mean) OVER (PARTITION BY r.tag, ms.metric ORDER BY r.ts, ms.run_id) AS previous
      FROM ms JOIN runs r USING (run_id))
SELECT tag, metric, run_id, round(mean, 6) AS mean, round(previous, 6) AS previous,
       round(mean - previous, 6) AS delta FROM j"""


# --- the judge as a paid stage (U3, U4, U5, J3, A15) -------------------------

BAD_BELOW = 40  # of 65,536: prompts that the recorded table lacks and the function refuses


def _python_reply(model: str):
    """The stand-in judge as a Python function that refuses some prompts."""
    def answer(prompts):
        import hashlib
        out = []
        for prompt in prompts:
            h = int(hashlib.md5(f"{model}|{prompt}".encode()).hexdigest()[:4], 16)
            if h < BAD_BELOW:
                raise ValueError("refused")
            out.append(f'{{"score": {h / 65535:.4f}, "reasoning": "stand-in reply"}}')
        return out
    return answer


def _reply_4(model: str, prompt: Column) -> Column:
    """The same reply as an expression."""
    return F.format_string('{"score": %.4f, "reasoning": "stand-in reply"}', standin_score(model, prompt))


def _stage_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"), _r6(F.sum("score")).alias("total"))


def q_judge_stage_recorded(spark, sf_dir):
    """Every metric through the judge stage with recorded replies; prompts
    without a recorded reply are judge errors."""
    from ragscope.operators.judge import RecordedResponder
    from ragscope.operators.score import prompt_table
    samples = samples_docs(spark, sf_dir)
    prompts = prompt_table(samples, JUDGE_METRICS, Judge(None, model=MODEL_A))
    kept = prompts.where(standin_score(MODEL_A, F.col("prompt")) * 65535 >= BAD_BELOW)
    recorded = kept.select("cache_key", _reply_4(MODEL_A, F.col("prompt")).alias("response")).dropDuplicates(["cache_key"])
    judge = Judge(RecordedResponder(recorded), model=MODEL_A)
    return _stage_summary(score(samples, ALL_METRICS, judge=judge, run_id="A"))


def _stage_with_cache(spark, sf_dir):
    """Scores and cache of a run whose cache already holds the replies for the
    faithfulness prompts, through a Python function that refuses some prompts."""
    from ragscope.operators.judge import BatchResponder
    from ragscope.operators.score import prompt_table
    samples = samples_docs(spark, sf_dir)
    cache = C.JudgeCache(spark, _scratch(spark, "judge-cache"))
    judge = Judge(BatchResponder(_python_reply(MODEL_A), max_retries=2, backoff=0.0), model=MODEL_A, cache=cache)
    known = prompt_table(samples, ["faithfulness"], judge).where(
        standin_score(MODEL_A, F.col("prompt")) * 65535 >= BAD_BELOW)
    cache.append(known.select("cache_key", _reply_4(MODEL_A, F.col("prompt")).alias("response")).dropDuplicates(["cache_key"]))
    return score(samples, ALL_METRICS, judge=judge, run_id="A"), cache


def q_judge_stage_batch(spark, sf_dir):
    """The same through a Python responder with retries, a journal
    and a stored cache; refused prompts fail on their own."""
    return _stage_summary(_stage_with_cache(spark, sf_dir)[0])


def _sql_stage_rows() -> str:
    """The long table with replies of four decimals, of which some are missing."""
    rows = _sql_metric_rows(MODEL_A, "A")
    for m in JUDGE_METRICS:
        exact = _sql_standin(MODEL_A, _sql_prompt(m))
        rows = rows.replace(exact, f"CAST(printf('%.4f', {exact}) AS DOUBLE)")
    return rows


def _sql_missing() -> str:
    """Which rows asked a prompt that has no reply."""
    rows = []
    for m in JUDGE_METRICS:
        rows.append(f"SELECT sample_id, '{m}' AS metric FROM samples_docs WHERE {_sql_guard(m)} "
                    f"AND {_sql_standin(MODEL_A, _sql_prompt(m))} * 65535 < {BAD_BELOW}")
    return "\nUNION ALL\n".join(rows)


SQL_JUDGE_STAGE = f"""
WITH {SAMPLES_SQL}, scores AS ({_sql_stage_rows()}), missing AS ({_sql_missing()})
SELECT s.metric, CASE WHEN m.metric IS NULL THEN s.status ELSE 'judge_error' END AS status, count(*) AS n,
       round(sum(CASE WHEN m.metric IS NULL THEN s.score END), 6) AS total
FROM scores s LEFT JOIN missing m ON m.sample_id = s.sample_id AND m.metric = s.metric GROUP BY 1, 2"""


def q_judge_cache_after_run(spark, sf_dir):
    """What the cache holds once the run is scored: each distinct
    prompt's reply once, errors not at all."""
    scores, cache = _stage_with_cache(spark, sf_dir)
    return cache.table().groupBy().agg(F.count(F.lit(1)).alias("rows")).crossJoin(cache.stats())


SQL_JUDGE_CACHE_AFTER_RUN = f"""
{_sql_asked()}
SELECT count(DISTINCT cache_key) AS rows, count(DISTINCT cache_key) AS entry_count,
       (count(DISTINCT cache_key) * length('{{"score": 0.1234, "reasoning": "stand-in reply"}}'))::BIGINT AS size_bytes
FROM asked WHERE {_sql_standin(MODEL_A, 'prompt')} * 65535 >= {BAD_BELOW}"""


# --- case rows and verdicts (A11, X16, F5, F4) -------------------------------

def q_failure_cases(spark, sf_dir):
    """Every failing case with its message."""
    return S.failure_cases(run_scores(spark, sf_dir, "A"), THRESHOLD).select(
        "sample_id", "metric", _r6(F.col("score")).alias("score"), "message")


SQL_FAILURE_CASES = f"""
{_sql_scores_cte()}
SELECT sample_id, metric, round(coalesce(score, 0), 6) AS score,
       'Score ' || printf('%.4f', coalesce(score, 0)) || ' < threshold {THRESHOLD}' AS message
FROM scores WHERE coalesce(score, 0) < {THRESHOLD}"""


def q_metric_verdicts(spark, sf_dir):
    """per metric, whether the mean reaches the threshold."""
    means = S.metric_means(run_scores(spark, sf_dir, "A"))
    return S.metric_verdicts(means, 0.5).select("metric", "n", _r6(F.col("mean")).alias("mean"), "metric_passed")


SQL_METRIC_VERDICTS = f"""
{_sql_scores_cte()}
SELECT metric, count(score) AS n, round(avg(score), 6) AS mean, avg(score) >= 0.5 AS metric_passed FROM scores GROUP BY metric"""


def q_samples_without_metrics(spark, sf_dir):
    """row scores of all samples, those of English texts alone being scored."""
    samples = samples_docs(spark, sf_dir)
    scored = score(FL.filter_samples(samples, "metadata.lang=en"), ["format_compliance"], run_id="A")
    every = samples.select(F.lit("A").alias("run_id"), "sample_id")
    return S.sample_scores(scored, every).select("sample_id", "overall_score", "n_metrics")


SQL_SAMPLES_WITHOUT_METRICS = f"""
WITH {SAMPLES_SQL}
SELECT sample_id, CASE WHEN lang = 'en' THEN {_sql_format_score()} ELSE 0.0::DOUBLE END AS overall_score,
       CASE WHEN lang = 'en' THEN 1 ELSE 0 END::BIGINT AS n_metrics FROM samples_docs"""


# --- stored runs (S15, S16, J1, J8, I6) --------------------------------------

def _stored_runs(spark, sf_dir) -> str:
    """A history with runs A and B, saved one after the other."""
    from datetime import datetime
    from ragscope.storage import store
    where = _scratch(spark, "history")
    both = store(run_scores_ab(spark, sf_dir), "scores-ab")
    for run, day in (("A", 1), ("B", 2)):
        sc = both.where(F.col("run_id") == run)
        samp = S.sample_scores(sc)
        H.save_run(spark, where, S.run_summary(samp, THRESHOLD, approx=True), S.metric_means(sc), sc,
                   tag=f"tag{day}", ts=datetime(2024, 1, day, 12))
    return where


def q_run_store(spark, sf_dir):
    """Two runs saved; the second one's scores read back, with its date and tag."""
    where = _stored_runs(spark, sf_dir)
    runs = H.read_table(spark, where, "runs").select("run_id", "tag", X.short_ts(F.col("ts")).alias("ts"))
    return H.load_run(spark, where, "B").groupBy("run_id", "run_date", "metric").agg(
        F.count(F.lit(1)).alias("n"), _r6(F.sum("score")).alias("total")).join(runs, "run_id").select(
        "run_id", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "tag", "ts", "metric", "n", "total")


SQL_RUN_STORE = f"""
{_sql_scores_ab_cte()}
SELECT run_id, '2024-01-02' AS run_date, 'tag2' AS tag, '2024-01-02 12:00:00' AS ts, metric, count(*) AS n,
       round(sum(score), 6) AS total FROM scores WHERE run_id = 'B' GROUP BY run_id, metric"""


def q_stored_run_diff(spark, sf_dir):
    """Two stored runs against each other, per metric and overall."""
    d = CMP.diff_runs(spark, _stored_runs(spark, sf_dir), "A", "B")
    overall = d.overall.select(F.lit("(overall)").alias("metric"), F.col("overall_a").alias("score_a"),
                               F.col("overall_b").alias("score_b"), F.col("overall_delta").alias("delta"),
                               F.col("verdict").alias("direction"))
    return d.metrics.unionByName(overall).select(
        "metric", *[_r6(F.col(c)).alias(c) for c in ("score_a", "score_b", "delta")], "direction")


SQL_STORED_RUN_DIFF = f"""
{_sql_scores_ab_cte()},
m AS (SELECT run_id, metric, avg(score) AS mean FROM scores GROUP BY 1, 2),
o AS (SELECT run_id, avg(o) AS o FROM (SELECT run_id, sample_id, avg(score) AS o FROM scores GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT a.metric, a.mean AS sa, b.mean AS sb, false AS whole FROM m a JOIN m b ON a.metric = b.metric
      WHERE a.run_id = 'A' AND b.run_id = 'B'
      UNION ALL SELECT '(overall)', a.o, b.o, true FROM o a, o b WHERE a.run_id = 'A' AND b.run_id = 'B')
SELECT metric, round(sa, 6) AS score_a, round(sb, 6) AS score_b, round(sb - sa, 6) AS delta,
       CASE WHEN whole THEN CASE WHEN sb > sa THEN 'better' WHEN sb < sa THEN 'worse' ELSE 'no difference' END
            WHEN sb - sa > 0.001 THEN 'up' WHEN sb - sa < -0.001 THEN 'down' ELSE 'same' END AS direction
FROM j"""


def q_short_report(spark, sf_dir):
    """A report's per-sample table by language: shown where a language
    has at most a hundred samples, else its number of rows alone counts as
    one more than that (the cut-off is the feature); sorted at the edge."""
    samples = samples_docs(spark, sf_dir).select("sample_id", F.try_element_at("metadata", F.lit("lang")).alias("lang"))
    out = None
    for lang in ("de", "en", "es", "fr"):
        table, n = S.small_table(samples.where(F.col("lang") == lang), 100)
        row = spark.range(1).select(F.lit(lang).alias("metric"), F.lit(n).cast("long").alias("rows"), F.lit(table is not None).alias("shown"))
        out = row if out is None else out.unionByName(row)
    return CMP.in_order(out)


SQL_SHORT_REPORT = """
SELECT l.lang AS metric, least(count(doc_id), 101) AS rows, count(doc_id) <= 100 AS shown
FROM (VALUES ('de'), ('en'), ('es'), ('fr')) l(lang) LEFT JOIN documents d ON d.lang = l.lang GROUP BY l.lang"""


def q_stored_sample_diff(spark, sf_dir):
    """The same runs per sample."""
    d = CMP.diff_runs(spark, _stored_runs(spark, sf_dir), "A", "B")
    return d.samples.select("sample_id", *[_r6(F.col(c)).alias(c) for c in ("score_a", "score_b", "delta")], "direction")


SQL_STORED_SAMPLE_DIFF = f"""
{_sql_scores_ab_cte()}, {_SQL_SAMPLE_SCORES}
SELECT a.sample_id, round(a.o, 6) AS score_a, round(b.o, 6) AS score_b, round(b.o - a.o, 6) AS delta,
       CASE WHEN b.o - a.o > 0.001 THEN 'up' WHEN b.o - a.o < -0.001 THEN 'down' ELSE 'same' END AS direction
FROM sample_scores a JOIN sample_scores b USING (sample_id) WHERE a.run_id = 'A' AND b.run_id = 'B'"""


# --- reports written and read by Spark (S10-S13, I9) -------------------------

def _stored_report(spark, sf_dir) -> str:
    from ragscope.sources.reports import report_metadata, write_json_report
    from ragscope.storage import store
    where = _scratch(spark, "report")
    sc = store(run_scores(spark, sf_dir, "A"), "scores-a")
    write_json_report(sc, ALL_METRICS, where, S.run_summary(S.sample_scores(sc), THRESHOLD, approx=True),
                      S.metric_means(sc), report_metadata(spark))
    return where


def q_report_roundtrip(spark, sf_dir):
    """A report's results, written and read back as score rows."""
    from ragscope.sources.reports import read_results, report_to_scores
    back = report_to_scores(read_results(spark, _stored_report(spark, sf_dir)))
    return back.select("sample_id", "metric", _r6(F.col("score")).alias("score"))


SQL_REPORT_ROUNDTRIP = f"""
{_sql_scores_cte()}
SELECT sample_id, metric, round(score, 6) AS score FROM scores"""


def q_report_baseline(spark, sf_dir):
    """A report's summary read back, and its means as a baseline."""
    from ragscope.sources.reports import read_report, report_metric_means
    report = read_report(spark, _stored_report(spark, sf_dir))
    head = report.select("path", "summary.total_samples", "summary.pass_count", "summary.threshold")
    return report_metric_means(report).join(head, "path").select(
        "metric", _r6(F.col("mean")).alias("mean"), "total_samples", "pass_count", "threshold")


SQL_REPORT_BASELINE = f"""
{_sql_scores_cte()}, {_SQL_SAMPLE_SCORES},
h AS (SELECT count(*) AS total_samples, count(*) FILTER (WHERE o >= {THRESHOLD}) AS pass_count FROM sample_scores)
SELECT metric, round(avg(score), 6) AS mean, any_value(total_samples) AS total_samples,
       any_value(pass_count) AS pass_count, {THRESHOLD}::DOUBLE AS threshold
FROM scores, h GROUP BY metric"""


# --- judge reply parsing (X10, X11) ----------------------------------------

def q_judge_reply_parse(spark, sf_dir):
    """Replies in ten shapes around the conversations' own texts,
    parsed back: bare, fenced and embedded objects, other JSON before the
    object, trailing text, a scalar score, and none."""
    from ragscope.operators.judge import parse_reply, reply_fields
    c = table(spark, sf_dir, "conversations")
    n = F.length("text") % 101
    sc = (n / F.lit(100.0)).cast("string")
    why = F.regexp_replace("text", r'[{}\\"`\p{Cntrl}]', " ")
    obj = F.concat(F.lit('{"score": '), sc, F.lit(', "reasoning": "'), why, F.lit('"}'))
    fence = F.concat(F.lit("```json\n"), obj, F.lit("\n```"))
    shapes = [obj, F.concat(F.lit("Verdict:\n"), fence), F.concat(F.lit("I would say "), obj, F.lit(" overall.")),
              F.concat(F.lit("score "), sc, F.lit(" without an object")), F.concat(F.lit("0.8\n"), fence),
              F.concat(F.lit('"ok" '), obj), F.concat(F.lit("true "), obj), F.concat(F.lit("[1, 2] "), obj),
              F.concat(F.lit('{"note": "x"}\n'), fence), F.concat(obj, F.lit(" as asked"))]
    reply = F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % len(shapes) + 1).cast("int"))
    f = reply_fields(parse_reply(reply), 0.0)
    return c.select("conv_id", "turn", f["score"].alias("score"), f["status"].alias("status"))


SQL_JUDGE_REPLY_PARSE = """
SELECT conv_id, turn,
       CASE WHEN (conv_id + turn) % 10 = 3 THEN NULL ELSE (length(text) % 101) / 100.0::DOUBLE END AS score,
       CASE WHEN (conv_id + turn) % 10 = 3 THEN 'judge_error' ELSE 'ok' END AS status
FROM conversations"""


# --- sources and sinks (S1-S9, S17), streaming (R1, R2, R4) ----------------

def _scratch(spark, name):
    return scratch_path(spark, name)


def q_jsonl_roundtrip(spark, sf_dir):
    """Samples written as JSON Lines and read back."""
    from ragscope.sources.reports import write_samples
    from ragscope.sources.samples import read_jsonl
    path = _scratch(spark, "jsonl")
    write_samples(samples_docs(spark, sf_dir), path, "jsonl")
    back, _ = read_jsonl(spark, path)
    return back.select("sample_id", "query", "answer", "reference",
                       F.size("context").alias("n_context"),
                       F.try_element_at("metadata", F.lit("expected_format")).alias("expected_format"))


SQL_JSONL_ROUNDTRIP = f"""
WITH {SAMPLES_SQL}
SELECT sample_id, query, answer, reference, CAST(len(context) AS INTEGER) AS n_context, expected_format
FROM samples_docs"""


#: Cells with line breaks keep a CSV file in one task: files of so many records at most.
CSV_FILE_RECORDS = 10_000


def q_csv_context_parse(spark, sf_dir):
    """CSV with JSON-array context (even ids) and pipe context
    (odd ids), metadata as JSON text, and records that break off behind the
    context (ids ending in 3), read back: samples and rejects."""
    from ragscope.sources.samples import positions, read_csv
    path = _scratch(spark, "csv")
    sd = samples_docs(spark, sf_dir)
    ctx = F.when(F.col("sample_id") % 2 == 0, F.to_json("context")).otherwise(F.array_join("context", " | "))
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    some = [F.col("sample_id").cast("string"), cell(F.col("query")), cell(ctx)]
    whole = [*some, cell(F.col("answer")), cell(F.col("reference")), cell(F.to_json("metadata"))]
    line = F.when(F.col("sample_id") % 10 == 3, F.concat_ws(",", *some)).otherwise(F.concat_ws(",", *whole))
    # one header a file: the first record of each brings it; where there are no records, a file has it alone
    head = "sample_id,query,context,answer,reference,metadata"
    first = positions()[1] % CSV_FILE_RECORDS == 0
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    sd.select(F.when(first, F.concat(F.lit(f"{head}\n"), line)).otherwise(line).alias("value")) \
        .write.option("maxRecordsPerFile", CSV_FILE_RECORDS).mode("append").text(path)
    good, rejects = read_csv(spark, path, strict=False)
    samples = good.select("sample_id", F.size("context").alias("n_context"),
                          F.sum(F.lit(1)).over(Window.partitionBy("sample_id")).alias("n_records"),
                          F.try_element_at("metadata", F.lit("lang")).alias("lang"),
                          F.col("reference").isNull().alias("no_reference"), F.lit(None).cast("string").alias("missing"))
    broken = rejects.select(F.regexp_extract("line", "^([0-9]+),", 1).cast("long").alias("sample_id"),
                            F.lit(-1).alias("n_context"), F.lit(-1).cast("long").alias("n_records"),
                            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("boolean").alias("no_reference"),
                            F.array_join("missing", ",").alias("missing"))
    return samples.unionByName(broken)


SQL_CSV_CONTEXT_PARSE = f"""
WITH {SAMPLES_SQL}
SELECT sample_id,
       CASE WHEN sample_id % 10 = 3 THEN -1 WHEN sample_id % 2 = 0 THEN len(context) ELSE
            len(list_filter(string_split(array_to_string(context, ' | '), '|'), lambda c: {_sql_strip("c")} <> '')) END::INTEGER AS n_context,
       CASE WHEN sample_id % 10 = 3 THEN -1 ELSE 1 END::BIGINT AS n_records,
       CASE WHEN sample_id % 10 = 3 THEN NULL ELSE lang END AS lang,
       CASE WHEN sample_id % 10 = 3 THEN NULL ELSE {_sql_strip("coalesce(reference, '')")} = '' END AS no_reference,
       CASE WHEN sample_id % 10 = 3 THEN 'answer,reference,metadata' END AS missing
FROM samples_docs"""


def q_rejects(spark, sf_dir):
    """JSON Lines with lines that are not JSON (the text's first line for
    ids ending in 0) and objects without ``answer`` (ids ending in 1)."""
    from ragscope.sources.samples import read_jsonl
    path = _scratch(spark, "rejects")
    sd = samples_docs(spark, sf_dir)
    k = F.col("sample_id") % 10
    good = F.to_json(F.struct("sample_id", "query", "context", "answer", "reference", "metadata"))
    no_answer = F.to_json(F.struct("sample_id", "query", "context"))
    line = F.when(k == 0, F.col("query")).when(k == 1, no_answer).otherwise(good)
    sd.select(line.alias("value")).write.mode("overwrite").text(path)
    _, rej = read_jsonl(spark, path)
    return rej.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


SQL_REJECTS = f"""
WITH {SAMPLES_SQL}
SELECT CASE sample_id % 10 WHEN 0 THEN 'invalid JSON (not an object)' ELSE 'missing required field(s)' END AS reason,
       count(*) AS n
FROM samples_docs WHERE sample_id % 10 = 1 OR (sample_id % 10 = 0 AND {_sql_strip("query")} <> '') GROUP BY 1"""


def q_jsonl_ids(spark, sf_dir):
    """Lines of which some have an id: given ids stay, the others are
    numbered downwards from -1."""
    from ragscope.sources.samples import read_jsonl
    path = _scratch(spark, "jsonl-ids")
    sd = samples_docs(spark, sf_dir)
    own = F.when(F.col("sample_id") % 3 != 0, F.col("sample_id"))
    line = F.to_json(F.struct(own.alias("sample_id"), "query", "context", "answer"))
    sd.select(line.alias("value")).write.mode("overwrite").text(path)
    back, _ = read_jsonl(spark, path)
    given = F.col("sample_id") >= 0
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(given).alias("given"),
                    F.sum(F.when(given, F.col("sample_id"))).alias("given_sum"), F.count_distinct("sample_id").alias("ids"),
                    F.min("sample_id").alias("least"))


SQL_JSONL_IDS = """
SELECT count(*) AS rows, count(*) FILTER (WHERE doc_id % 3 <> 0) AS given,
       (sum(doc_id) FILTER (WHERE doc_id % 3 <> 0))::BIGINT AS given_sum, count(*) AS ids,
       -count(*) FILTER (WHERE doc_id % 3 = 0) AS least FROM documents"""


def _files_for(spark, sf_dir, share: float = 1.0) -> int:
    """How many files hold ``share`` times the samples: as many as the scan of
    the documents has splits, so a file grows no more than a split."""
    return max(1, math.ceil(share * table(spark, sf_dir, "documents").rdd.getNumPartitions()))


def _write_lines(samples: DataFrame, path: str, files: int) -> None:
    """Samples as JSON Lines in exactly ``files`` files, of which the last are
    empty where rows are few: a micro-batch is a number of files."""
    from ragscope.sources.reports import write_samples
    spark = samples.sparkSession
    write_samples(samples.repartition(files), path, "jsonl")
    for k in range(len(spark.read.text(path).inputFiles()), files):
        touch(spark, f"{path}/none-{k}.txt")


def q_stream_line_ids(spark, sf_dir):
    """A stream of lines without ids, each of them three times in a file;
    how many samples and how many ids come out, by language."""
    from ragscope.streaming.stream import run_to_path, stream_samples
    path = _scratch(spark, "stream-lines")
    sd = spread(samples_docs(spark, sf_dir))
    line = F.to_json(F.struct("query", "context", "answer", F.struct(F.try_element_at("metadata", F.lit("lang")).alias("lang")).alias("metadata")))
    # some eight files for each split of the scan, written where the samples are read; a line's copies are not parted
    share = math.ceil(table(spark, sf_dir, "documents").count() / _files_for(spark, sf_dir, 8))
    sd.select(F.explode(F.array_repeat(line, 3)).alias("value")).write.option("maxRecordsPerFile", 3 * max(1, share)) \
        .option("compression", "lz4").mode("overwrite").text(path)
    files = len(spark.read.text(path).inputFiles())
    good, _ = stream_samples(spark, path, max_files_per_trigger=math.ceil(files / 2))
    out = run_to_path(good, _scratch(spark, "stream-samples"), _scratch(spark, "stream-lines-ck"), "zstd")
    return out.groupBy(F.try_element_at("metadata", F.lit("lang")).alias("lang")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("sample_id").alias("ids"))


SQL_STREAM_LINE_IDS = """
SELECT lang, 3 * count(*) AS samples, 3 * count(*) AS ids FROM documents GROUP BY lang"""


def q_stream_judge(spark, sf_dir):
    """Judge metrics in micro-batches, one folder each, with a cache that
    they share; the last batch is written twice, as a replay would."""
    from ragscope.streaming.stream import judge_in_batches, stream_samples, write_epoch
    path, out = _scratch(spark, "stream-judge"), _scratch(spark, "stream-judge-out")
    files = _files_for(spark, sf_dir, 1 / 3)  # of one batch
    _write_lines(samples_docs(spark, sf_dir), path, 3 * files)
    good, _ = stream_samples(spark, path, max_files_per_trigger=files, ids="given")
    judge = standin_judge(MODEL_A, C.JudgeCache(spark, _scratch(spark, "stream-cache")))
    judge_in_batches(good, ["coherence", "answer_similarity"], judge, out, "A",
                     _scratch(spark, "stream-judge-ck")).awaitTermination()
    done = spark.read.parquet(out)
    last = done.agg(F.max("epoch")).first()[0]
    from ragscope.storage import store
    write_epoch(store(done.where(F.col("epoch") == last).drop("epoch"), "replay"), last, out)
    return spark.read.parquet(out).groupBy("metric", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("epoch").alias("batches"), _r6(F.sum("score")).alias("total"))


SQL_STREAM_JUDGE = f"""
{_sql_scores_cte()}
SELECT metric, status, count(*) AS n, 3::BIGINT AS batches, round(sum(score), 6) AS total FROM scores
WHERE metric IN ('coherence', 'answer_similarity') GROUP BY 1, 2"""


STREAM_DELAY = 30  # minutes


def q_stream_windows(spark, sf_dir):
    """Scores per ten minutes of event time behind a watermark. Three
    lots of files come one after the other, each a micro-batch; the third
    one's rows are partly late."""
    from ragscope.streaming.stream import run_to_path, stream_samples, stream_scores, windowed_summary
    path = _scratch(spark, "stream-windows")
    sd = samples_docs(spark, sf_dir)
    file = F.when(F.col("sample_id") % 10 < 6, 1).when(F.col("sample_id") % 10 < 9, 2).otherwise(3)
    minute = F.when(file == 1, F.col("sample_id") % 600).when(file == 2, 600 + F.col("sample_id") % 600) \
        .otherwise(F.col("sample_id") % 1200)
    ts = F.date_format(F.timestamp_add("MINUTE", minute.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    timed = sd.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("at"), ts)))
    files = _files_for(spark, sf_dir)
    for k in (1, 2, 3):  # files are read in the order of their times
        _write_lines(timed.where(file == k), f"{path}/{k}", files)
    good, _ = stream_samples(spark, f"{path}/*", max_files_per_trigger=files, ids="given", event_time="at")
    windows = windowed_summary(stream_scores(good, ["format_compliance"], "S", carry=("at",)), "at",
                               "10 minutes", f"{STREAM_DELAY} minutes", THRESHOLD)
    out = run_to_path(windows, _scratch(spark, "windows"), _scratch(spark, "windows-ck"))
    return out.select(X.short_ts(F.col("window_start")).alias("window_start"), "metric", "n",
                      _r6(F.col("mean")).alias("mean"), "pass_count")


SQL_STREAM_WINDOWS = f"""
WITH {SAMPLES_SQL},
f0 AS (SELECT *, CASE WHEN sample_id % 10 < 6 THEN 1 WHEN sample_id % 10 < 9 THEN 2 ELSE 3 END AS file FROM samples_docs),
f AS (SELECT *, CASE file WHEN 1 THEN sample_id % 600 WHEN 2 THEN 600 + sample_id % 600 ELSE sample_id % 1200 END AS m,
             {_sql_format_score()} AS score FROM f0),
w AS (SELECT *, m // 10 * 10 AS start,
             -- what a file's rows are held against: the watermark one batch before
             coalesce((SELECT max(m) FROM f g WHERE g.file < f.file - 1) - {STREAM_DELAY}, -1) AS mark FROM f),
last AS (SELECT max(m) - {STREAM_DELAY} AS mark FROM f)
SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(start AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start,
       'format_compliance' AS metric, count(score) AS n, round(avg(score), 6) AS mean,
       count(*) FILTER (WHERE score >= {THRESHOLD}) AS pass_count
FROM w, last WHERE start + 10 > w.mark AND start + 10 <= last.mark GROUP BY start"""


def q_score_progress(spark, sf_dir):
    """The counts that a scoring run reports while it is written."""
    from ragscope.operators.progress import watch
    seen, progress = watch(run_scores(spark, sf_dir, "A"), "run-a")
    seen.write.mode("overwrite").parquet(_scratch(spark, "progress"))
    c = progress.counts()
    return spark.createDataFrame([(c["rows"], c["guarded"], c["judge_errors"])], "rows long, guarded long, judge_errors long")


SQL_SCORE_PROGRESS = f"""
{_sql_scores_cte()}
SELECT count(*) AS rows, count(*) FILTER (WHERE status = 'guarded') AS guarded, 0::BIGINT AS judge_errors FROM scores"""


def q_stream_scores(spark, sf_dir):
    """JSON Lines files as a stream, format compliance per row,
    running per-metric summary (availableNow trigger)."""
    from ragscope.streaming.stream import (running_summary, run_to_table, stream_samples,
                                           stream_scores)
    import uuid
    path = _scratch(spark, "stream-in")
    files = _files_for(spark, sf_dir, 1 / 4)  # of one batch
    _write_lines(samples_docs(spark, sf_dir), path, 4 * files)
    good, _ = stream_samples(spark, path, max_files_per_trigger=files, ids="given")
    summ = running_summary(stream_scores(good, ["format_compliance"], run_id="S"), THRESHOLD)
    out = run_to_table(summ, f"stream_scores_{uuid.uuid4().hex[:8]}")
    return out.select("metric", "n", _r6(F.col("mean")).alias("mean"), "min", "max", "pass_count")


SQL_STREAM_SCORES = f"""
WITH {SAMPLES_SQL}, f AS (SELECT {_sql_format_score()} AS score FROM samples_docs)
SELECT 'format_compliance' AS metric, count(score) AS n, round(avg(score), 6) AS mean, min(score) AS min,
       max(score) AS max, count(*) FILTER (WHERE score >= {THRESHOLD}) AS pass_count FROM f"""


# ---------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    return q_token_f1_by_lang(spark, SF0001)


_QUERIES: dict[str, tuple[Callable, str | None]] = {
    "token_f1_by_lang": (q_token_f1_by_lang, SQL_TOKEN_F1_BY_LANG),
    "format_rules_by_role": (q_format_rules_by_role, SQL_FORMAT_RULES_BY_ROLE),
    "format_compliance": (q_format_compliance, SQL_FORMAT_COMPLIANCE),
    "toxicity_pattern_hits": (q_toxicity_pattern_hits, SQL_TOXICITY_PATTERN_HITS),
    "toxicity_vs_label": (q_toxicity_vs_label, SQL_TOXICITY_VS_LABEL),
    "judge_all_metrics_long": (q_judge_all_metrics_long, SQL_JUDGE_ALL_METRICS_LONG),
    "judge_guarded_scores": (q_judge_guarded_scores, SQL_JUDGE_GUARDED_SCORES),
    "answer_correctness_blend": (q_answer_correctness_blend, SQL_ANSWER_CORRECTNESS_BLEND),
    "metric_summary": (q_metric_summary, SQL_METRIC_SUMMARY),
    "run_summary": (q_run_summary, SQL_RUN_SUMMARY),
    "weighted_overall": (q_weighted_overall, SQL_WEIGHTED_OVERALL),
    "pass_rate": (q_pass_rate, SQL_PASS_RATE),
    "score_histogram": (q_score_histogram, SQL_SCORE_HISTOGRAM),
    "failures_by_metric": (q_failures_by_metric, SQL_FAILURES_BY_METRIC),
    "worst_samples": (q_worst_samples, SQL_WORST_SAMPLES),
    "scores_wide": (q_scores_wide, SQL_SCORES_WIDE),
    "compare_runs": (q_compare_runs, SQL_COMPARE_RUNS),
    "regression_check": (q_regression_check, SQL_REGRESSION_CHECK),
    "dataset_profile": (q_dataset_profile, SQL_DATASET_PROFILE),
    "dataset_issues": (q_dataset_issues, SQL_DATASET_ISSUES),
    "missing_fields_by_metric": (q_missing_fields_by_metric, SQL_MISSING_FIELDS_BY_METRIC),
    "filter_by_metadata": (q_filter_by_metadata, SQL_FILTER_BY_METADATA),
    "sample_n": (q_sample_n, SQL_SAMPLE_N),
    "reference_coverage": (q_reference_coverage, SQL_REFERENCE_COVERAGE),
    "chat_turn_pairs": (q_chat_turn_pairs, SQL_CHAT_TURN_PAIRS),
    "cache_hit_miss": (q_cache_hit_miss, SQL_CACHE_HIT_MISS),
    "cache_evict": (q_cache_evict, SQL_CACHE_EVICT),
    "cache_purge": (q_cache_purge, SQL_CACHE_PURGE),
    "cache_stats": (q_cache_stats, SQL_CACHE_STATS),
    "run_listing": (q_run_listing, SQL_RUN_LISTING),
    "score_trend": (q_score_trend, SQL_SCORE_TREND),
    "trend_stats": (q_trend_stats, SQL_TREND_STATS),
    "run_over_run_delta": (q_run_over_run_delta, SQL_RUN_OVER_RUN_DELTA),
    "judge_reply_parse": (q_judge_reply_parse, SQL_JUDGE_REPLY_PARSE),
    "jsonl_roundtrip": (q_jsonl_roundtrip, SQL_JSONL_ROUNDTRIP),
    "csv_context_parse": (q_csv_context_parse, SQL_CSV_CONTEXT_PARSE),
    "rejects": (q_rejects, SQL_REJECTS),
    "jsonl_ids": (q_jsonl_ids, SQL_JSONL_IDS),
    "judge_stage_recorded": (q_judge_stage_recorded, SQL_JUDGE_STAGE),
    "judge_stage_batch": (q_judge_stage_batch, SQL_JUDGE_STAGE),
    "judge_cache_after_run": (q_judge_cache_after_run, SQL_JUDGE_CACHE_AFTER_RUN),
    "failure_cases": (q_failure_cases, SQL_FAILURE_CASES),
    "metric_verdicts": (q_metric_verdicts, SQL_METRIC_VERDICTS),
    "samples_without_metrics": (q_samples_without_metrics, SQL_SAMPLES_WITHOUT_METRICS),
    "run_store": (q_run_store, SQL_RUN_STORE),
    "stored_run_diff": (q_stored_run_diff, SQL_STORED_RUN_DIFF),
    "short_report": (q_short_report, SQL_SHORT_REPORT),
    "stored_sample_diff": (q_stored_sample_diff, SQL_STORED_SAMPLE_DIFF),
    "report_roundtrip": (q_report_roundtrip, SQL_REPORT_ROUNDTRIP),
    "report_baseline": (q_report_baseline, SQL_REPORT_BASELINE),
    "stream_line_ids": (q_stream_line_ids, SQL_STREAM_LINE_IDS),
    "stream_judge": (q_stream_judge, SQL_STREAM_JUDGE),
    "stream_windows": (q_stream_windows, SQL_STREAM_WINDOWS),
    "score_progress": (q_score_progress, SQL_SCORE_PROGRESS),
    "stream_scores": (q_stream_scores, SQL_STREAM_SCORES),
}


try:  # the training-data subpackage and the pipeline may be absent
    from ragscope.llm import queries as llm
except ImportError as gone:
    if (gone.name or "").partition(".")[0] not in ("ragscope", "corpus_pipeline"):
        raise  # they are there, and lack a library
    llm = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _QUERIES.items()} | (llm.QUERIES if llm else {})


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _QUERIES.items() if v[1] is not None} | (llm.ORACLE_SQL if llm else {})
