"""Metrics as specifications of Spark expressions.

A metric is described, not executed: a deterministic metric gives a result
struct straight from the sample columns; a judge metric gives guards (fixed
results that skip the judge), a prompt, an optional pre-computed value that
travels with the request, and a ``finish`` that turns the parsed reply into
the result. ``ragscope.operators.score`` stacks all metrics into one plan.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.functions import text as X
from ragscope.functions.jsoncheck import json_check
from ragscope.operators.judge import TEMPLATES, PromptTemplate, build_prompt
from ragscope.schemas import CHECK

RESULT = T.StructType([
    T.StructField("score", T.DoubleType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("reasoning", T.StringType(), True),
    T.StructField("method", T.StringType(), True),
    T.StructField("details", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("hits", T.ArrayType(T.StringType()), True),
    T.StructField("claims", T.ArrayType(T.StringType()), True),
    T.StructField("checks", T.ArrayType(CHECK), True),
])


def _lit_or(c, dtype):
    if c is None:
        return F.lit(None).cast(dtype)
    if isinstance(c, Column):
        return c.cast(dtype)
    return F.lit(c).cast(dtype)


def result(score, status="ok", reasoning=None, method=None, details=None,
           hits=None, claims=None, checks=None) -> Column:
    """One metric result as a struct of the fixed ``RESULT`` type."""
    return F.struct(
        _lit_or(score, "double").alias("score"),
        _lit_or(status, "string").alias("status"),
        _lit_or(reasoning, "string").alias("reasoning"),
        _lit_or(method, "string").alias("method"),
        _lit_or(details, "map<string,string>").alias("details"),
        _lit_or(hits, "array<string>").alias("hits"),
        _lit_or(claims, "array<string>").alias("claims"),
        _lit_or(checks, T.ArrayType(CHECK)).alias("checks"),
    )


def details_map(**kv: Column) -> Column:
    """A details map without null values."""
    m = F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(m, lambda k, v: v.isNotNull())


@dataclass
class Guard:
    """Rows where ``when`` holds get ``result`` and never reach the judge."""
    when: Callable[[dict], Column]
    result: Callable[[dict], Column]


@dataclass
class MetricSpec:
    """A metric. Exactly one of ``native`` / ``template`` is set."""

    name: str
    description: str = ""
    requires: tuple = ()                      # sample fields that must be non-empty
    higher_is_better: bool = True
    native: Callable[[dict, dict], Column] | None = None      # (sample cols, opts) -> RESULT
    template: PromptTemplate | None = None
    guards: list = field(default_factory=list)
    pre: Callable[[dict, dict], Column] | None = None         # value carried to finish
    finish: Callable[[dict, Column, dict], Column] | None = None  # (reply, pre, opts) -> RESULT
    default_score: float = 0.0
    options: dict = field(default_factory=dict)
    # Per-sample values computed once before the metrics are stacked:
    # (sample cols) -> {column name: expression}.
    features: Callable[[dict], dict] | None = None

    @property
    def uses_judge(self) -> bool:
        return self.template is not None

    def with_options(self, **opts) -> "MetricSpec":
        """C4: the same metric with options merged in."""
        merged = dict(self.options)
        merged.update(opts)
        return MetricSpec(**{**self.__dict__, "options": merged})


# ---------------------------------------------------------------------------
# Detail and reasoning texts the reference produces.
# ---------------------------------------------------------------------------
NO_CONTEXT = "No context provided"
NO_REFERENCE_RECALL = "Reference answer required for context recall"
NO_REFERENCE_WARNING = "No reference answer provided"
NO_CONSTRAINTS = "No format constraints specified"
ALL_PASSED = "All checks passed"
SOME_FAILED = "Some checks failed"
HEADING_OK = "Starts with markdown heading"
HEADING_BAD = "Does not start with a markdown heading"
BULLETS_OK = "Contains %d bullet items"
BULLETS_BAD = "Does not contain a proper bullet list (need >= 2 items)"
NUMBERED_OK = "Contains %d numbered items"
NUMBERED_BAD = "Does not contain a proper numbered list (need >= 2 items)"
UNKNOWN_FORMAT = "Unknown format: "
WORDS_MIN = "Got %d words, minimum %s"
WORDS_MAX = "Got %d words, maximum %s"
WORDS_OK = "%d words within bounds"
TOXIC_FOUND = "Detected %d toxic pattern(s)"
KNOWN_FORMATS = ("json", "markdown_heading", "bullet_list", "numbered_list")
# Fields each metric needs (dataset validation, A12).
METRIC_REQUIREMENTS = {
    "answer_similarity": ("reference",),
    "context_recall": ("reference",),
    "context_precision": ("context",),
    "faithfulness": ("context",),
    "hallucination": ("context",),
}


# ---------------------------------------------------------------------------
# Guards and finishes
# ---------------------------------------------------------------------------

def _no_context(s):
    return F.coalesce(F.size(s["context"]), F.lit(0)) == 0


def _no_reference(s):
    return F.coalesce(F.length(s["reference"]), F.lit(0)) == 0


def _guarded(reason: str, key: str = "reasoning"):
    if key == "reasoning":
        return lambda s: result(0.0, "guarded", reasoning=reason)
    return lambda s: result(0.0, "guarded", details=details_map(**{key: F.lit(reason)}))


def _finish_plain(reply, pre, opts):
    return result(X.clamp01(reply["score"]), reply["status"], reasoning=reply["reasoning"],
                  method="llm_judge")


def _finish_correctness(reply, pre, opts):
    tw = float(opts.get("token_weight", 0.4))
    jw = float(opts.get("judge_weight", 0.6))
    j = reply["score"]
    score = F.when(pre.isNotNull(), X.clamp01(F.lit(tw) * pre + F.lit(jw) * j)) \
        .otherwise(X.clamp01(j))
    return result(score, reply["status"], reasoning=reply["reasoning"], method="llm_judge",
                  details=details_map(token_overlap=pre, judge_score=j))


def _finish_hallucination(reply, pre, opts):
    claims = F.coalesce(reply["claims"], F.array().cast("array<string>"))
    return result(X.clamp01(reply["score"]), reply["status"], reasoning=reply["reasoning"],
                  method="llm_judge", claims=claims)


def _finish_toxicity(reply, pre, opts):
    level = reply["score"]
    return result(X.clamp01(F.lit(1.0) - level), reply["status"], reasoning=reply["reasoning"],
                  method="llm_judge", details=details_map(toxicity_level=level))


def _toxic_guard_when(s):
    return F.size(s["_hits"]) > 0


def _toxic_guard_result(s):
    return result(0.0, "guarded", reasoning=F.format_string(TOXIC_FOUND, F.size(s["_hits"])),
                  method="pattern_scan", hits=s["_hits"])


# ---------------------------------------------------------------------------
# Deterministic format compliance (M8)
# ---------------------------------------------------------------------------

def format_features(s: dict) -> dict:
    """Values M8 reads more than once, computed once per sample."""
    answer = F.coalesce(s["answer"], F.lit(""))
    fmt = F.try_element_at(s["metadata"], F.lit("expected_format"))
    return {
        "_fc_json": json_check(F.when(fmt == F.lit("json"), answer)),
        "_fc_bullets": F.when(fmt == F.lit("bullet_list"), X.bullet_items(answer)),
        "_fc_numbered": F.when(fmt == F.lit("numbered_list"), X.numbered_items(answer)),
        "_fc_heading": F.when(fmt == F.lit("markdown_heading"), X.starts_with_heading(answer)),
        "_fc_words": X.word_count(answer),
    }


def format_compliance_result(s: dict, opts: dict | None = None) -> Column:
    """M8: format rule and word bounds from the sample's metadata."""
    if "_fc_words" not in s:
        s = {**s, **{k: v for k, v in format_features(s).items()}}
    md = s["metadata"]
    fmt = F.try_element_at(md, F.lit("expected_format"))
    has_fmt = fmt.isNotNull() & (fmt != F.lit(""))
    js = s["_fc_json"]
    n_bullets = s["_fc_bullets"]
    n_numbered = s["_fc_numbered"]
    heading = s["_fc_heading"]
    fmt_passed = (F.when(fmt == "json", js["valid"])
                  .when(fmt == "markdown_heading", heading)
                  .when(fmt == "bullet_list", n_bullets >= 2)
                  .when(fmt == "numbered_list", n_numbered >= 2)
                  .otherwise(F.lit(False)))
    fmt_detail = (F.when(fmt == "json", js["detail"])
                  .when(fmt == "markdown_heading",
                        F.when(heading, F.lit(HEADING_OK)).otherwise(F.lit(HEADING_BAD)))
                  .when(fmt == "bullet_list",
                        F.when(n_bullets >= 2, F.format_string(BULLETS_OK, n_bullets))
                        .otherwise(F.lit(BULLETS_BAD)))
                  .when(fmt == "numbered_list",
                        F.when(n_numbered >= 2, F.format_string(NUMBERED_OK, n_numbered))
                        .otherwise(F.lit(NUMBERED_BAD)))
                  .otherwise(F.concat(F.lit(UNKNOWN_FORMAT), fmt)))
    fmt_failed = has_fmt & ~fmt_passed
    min_raw = F.try_element_at(md, F.lit("min_words"))
    max_raw = F.try_element_at(md, F.lit("max_words"))
    has_bounds = min_raw.isNotNull() | max_raw.isNotNull()
    wc = s["_fc_words"]
    min_fail = F.coalesce(min_raw.isNotNull() & (wc < min_raw.try_cast("double")), F.lit(False))
    max_fail = F.coalesce(max_raw.isNotNull() & (wc > max_raw.try_cast("double")), F.lit(False))
    all_passed = ~fmt_failed & ~min_fail & ~max_fail

    def check(name, passed, detail):
        return F.struct(name.alias("check"), passed.alias("passed"), detail.alias("detail"))

    checks = F.filter(F.array(
        F.when(has_fmt, check(fmt, fmt_passed, fmt_detail)),
        F.when(min_fail, check(F.lit("min_words"), F.lit(False),
                               F.format_string(WORDS_MIN, wc, min_raw))),
        F.when(max_fail, check(F.lit("max_words"), F.lit(False),
                               F.format_string(WORDS_MAX, wc, max_raw))),
        F.when(has_bounds & all_passed, check(F.lit("word_count"), F.lit(True),
                                              F.format_string(WORDS_OK, wc))),
    ), lambda c: c.isNotNull())
    any_check = has_fmt | has_bounds
    score = F.when(all_passed, F.lit(1.0)).otherwise(F.lit(0.0))
    reasoning = (F.when(~any_check, F.lit(NO_CONSTRAINTS))
                 .when(all_passed, F.lit(ALL_PASSED)).otherwise(F.lit(SOME_FAILED)))
    return result(score, "ok", reasoning=reasoning, method="rules", checks=checks)


def _correctness_pre(s, opts):
    if "_tok_common" in s:
        f1 = X.token_f1_from_counts(s["_tok_na"], s["_tok_nr"], s["_tok_common"])
    else:
        f1 = X.token_f1(F.coalesce(s["answer"], F.lit("")), F.coalesce(s["reference"], F.lit("")))
    return F.when(~_no_reference(s), f1)


# ---------------------------------------------------------------------------
# Built-in metrics
# ---------------------------------------------------------------------------

def _judge_metric(name, description, requires=(), guards=(), pre=None,
                  finish=_finish_plain, default=0.0) -> MetricSpec:
    return MetricSpec(name=name, description=description, requires=requires,
                      template=TEMPLATES[name], guards=list(guards), pre=pre,
                      finish=finish, default_score=default)


def builtin_metrics() -> list[MetricSpec]:
    return [
        _judge_metric("faithfulness", "Claims of the answer supported by the context",
                      ("context",)),
        _judge_metric("answer_relevancy", "Answer addresses the question"),
        _judge_metric("answer_correctness", "Token overlap blended with a judge score",
                      pre=_correctness_pre, finish=_finish_correctness),
        _judge_metric("answer_similarity", "Meaning of answer against the reference",
                      ("reference",),
                      guards=[Guard(_no_reference, _guarded(NO_REFERENCE_WARNING, "warning"))]),
        _judge_metric("coherence", "Clarity and logical flow of the answer"),
        _judge_metric("context_precision", "Share of relevant context chunks", ("context",),
                      guards=[Guard(_no_context, _guarded(NO_CONTEXT))]),
        _judge_metric("context_recall", "Reference covered by the context",
                      ("context", "reference"),
                      guards=[Guard(_no_context, _guarded(NO_CONTEXT)),
                              Guard(_no_reference, _guarded(NO_REFERENCE_RECALL))]),
        MetricSpec(name="format_compliance",
                   description="Answer follows the requested format (deterministic)",
                   native=format_compliance_result, features=format_features),
        _judge_metric("hallucination", "Unsupported claims (1.0 is bad)", ("context",),
                      finish=_finish_hallucination),
        _judge_metric("toxicity", "Harmful content; pattern scan first, then the judge",
                      guards=[Guard(_toxic_guard_when, _toxic_guard_result)],
                      finish=_finish_toxicity, default=1.0),
    ]


# ---------------------------------------------------------------------------
# Registry (C2, C3)
# ---------------------------------------------------------------------------

class MetricRegistry:
    def __init__(self, specs: list[MetricSpec] | None = None):
        self._specs: dict[str, MetricSpec] = {}
        for s in specs or []:
            self.register(s)

    def register(self, spec: MetricSpec) -> None:
        if not isinstance(spec, MetricSpec):
            raise TypeError(f"not a MetricSpec: {spec!r}")
        self._specs[spec.name] = spec

    def get(self, name: str) -> MetricSpec:
        if name not in self._specs:
            raise KeyError(f"Unknown metric: {name}. Available: {', '.join(self.list_metrics())}")
        return self._specs[name]

    def __contains__(self, name: str) -> bool:
        return name in self._specs

    def is_registered(self, name: str) -> bool:
        return name in self

    def list_metrics(self) -> list[str]:
        return sorted(self._specs)

    def register_from(self, target: str) -> str:
        """Register ``"package.module:attribute"`` (a MetricSpec or a
        function returning one). Returns the metric name."""
        mod_name, _, attr = target.partition(":")
        if not mod_name or not attr:
            raise ValueError(f"expected 'module:attribute', got {target!r}")
        obj = getattr(importlib.import_module(mod_name), attr)
        spec = obj() if callable(obj) and not isinstance(obj, MetricSpec) else obj
        self.register(spec)
        return spec.name

    def resolve(self, names: list[str], options: dict | None = None) -> list[MetricSpec]:
        """J7 + Q18: unknown names raise, duplicates are rejected."""
        seen = set()
        out = []
        for n in names:
            if n in seen:
                raise ValueError(f"metric listed twice: {n}")
            seen.add(n)
            spec = self.get(n)
            if options and n in options:
                spec = spec.with_options(**options[n])
            out.append(spec)
        return out


def default_registry() -> MetricRegistry:
    return MetricRegistry(builtin_metrics())


DETERMINISTIC = ["format_compliance"]
ALL_JUDGE = ["faithfulness", "answer_relevancy", "answer_correctness", "answer_similarity",
             "coherence", "context_precision", "context_recall", "hallucination", "toxicity"]
