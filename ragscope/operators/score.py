"""Scoring: samples x metrics -> the long SCORES table.

All metrics are stacked in one projection: every sample row becomes an array
of one request per metric, exploded once, so the samples are scanned once
and deterministic metrics never leave that projection. Judge requests go
through one judge stage (dedup, cache, responder, join back).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscope.functions import text as X
from ragscope.operators.judge import (ExpressionResponder, Judge, ask, build_prompt, cache_key,
                                      parse_reply, reply_fields)
from ragscope.operators.metrics import RESULT, MetricRegistry, MetricSpec, default_registry, result
from ragscope.schemas import SCORES
from ragscope.session import spread
from ragscope.storage import store

SAMPLE_COLUMNS = ["sample_id", "query", "context", "answer", "reference", "metadata"]


def normalize_samples(samples: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The sample columns with null context -> [] and null metadata -> {}."""
    return samples.select(
        *carry,
        F.col("sample_id").cast("long").alias("sample_id"),
        F.col("query"),
        F.coalesce(F.col("context"), F.array().cast("array<string>")).alias("context"),
        F.col("answer"),
        F.col("reference"),
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def resolve_metrics(metrics, registry: MetricRegistry | None = None,
                    options: dict | None = None) -> list[MetricSpec]:
    reg = registry or default_registry()
    names, specs = [], []
    for m in metrics:
        if isinstance(m, MetricSpec):
            specs.append(m if not (options and m.name in options)
                         else m.with_options(**options[m.name]))
            names.append(m.name)
        else:
            specs.extend(reg.resolve([m], options))
            names.append(m)
    if len(set(names)) != len(names):
        raise ValueError(f"metric listed twice in {names}")
    return specs


def _requests(specs: list[MetricSpec], s: dict) -> Column:
    reqs = []
    for pos, spec in enumerate(specs):
        opts = spec.options
        if spec.native is not None:
            prompt = F.lit(None).cast("string")
            pre_result = spec.native(s, opts)
            aux = F.lit(None).cast("double")
        else:
            fired = F.lit(False)
            guard_result = F.lit(None).cast(RESULT)
            for g in reversed(spec.guards):
                guard_result = F.when(g.when(s), g.result(s)).otherwise(guard_result)
            for g in spec.guards:
                fired = fired | g.when(s)
            prompt = F.when(~fired, build_prompt(spec.template, s))
            pre_result = guard_result
            aux = spec.pre(s, opts).cast("double") if spec.pre else F.lit(None).cast("double")
        reqs.append(F.struct(F.lit(spec.name).alias("metric"), F.lit(pos).alias("metric_pos"),
                             prompt.alias("prompt"), pre_result.alias("pre"),
                             aux.alias("aux")))
    return F.array(*reqs)


def _features(specs: list[MetricSpec], base: DataFrame) -> DataFrame:
    """Per-sample values used by several metrics, computed once per row
    before the metrics are stacked (one projection, no shuffle)."""
    s = {c: F.col(c) for c in base.columns}
    names = {sp.name for sp in specs}
    cols: dict[str, Column] = {}
    if any(sp.pre for sp in specs):
        cols["_answer_tokens"] = X.token_set(F.coalesce(s["answer"], F.lit("")))
        cols["_ref_tokens"] = X.token_set(F.coalesce(s["reference"], F.lit("")))
    staged = base.select("*", *[c.alias(n) for n, c in cols.items()]) if cols else base
    if "_answer_tokens" in cols:
        # Set sizes as columns so F1 reads each intersection once.
        a, r = F.col("_answer_tokens"), F.col("_ref_tokens")
        staged = staged.select("*", F.size(a).alias("_tok_na"), F.size(r).alias("_tok_nr"),
                               F.size(F.array_intersect(a, r)).alias("_tok_common")) \
            .drop("_answer_tokens", "_ref_tokens")
    base, cols = staged, {}
    if "toxicity" in names:
        cols["_hits"] = X.toxic_hits(F.coalesce(s["answer"], F.lit("")))
    kinds = {k for sp in specs if sp.template for _, k in sp.template.sections}
    if "context_bullets" in kinds:
        cols["_ctx_bullets"] = X.context_bullets(s["context"])
    if "context_numbered" in kinds:
        cols["_ctx_numbered"] = X.context_numbered(s["context"])
    for sp in specs:
        if sp.features:
            cols.update(sp.features(s))
    return base.select("*", *[c.alias(n) for n, c in cols.items()]) if cols else base


def _finish(judged: list[MetricSpec], df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Parse each reply once into a column, then apply each metric's finish
    (one CASE on ``metric``). The parsed reply is its own column because
    Catalyst does not share subexpressions across CASE branches."""
    parsed = df.withColumn("_v", parse_reply(F.col("response")))
    v = F.col("_v")
    finished = F.lit(None).cast(RESULT)
    for spec in reversed(judged):
        fields = reply_fields(v, spec.default_score)
        finished = F.when(F.col("metric") == spec.name,
                          spec.finish(fields, F.col("aux"), spec.options)).otherwise(finished)
    error = F.col("error")
    err = F.coalesce(error, F.lit("no JSON object in the judge reply"))
    res = F.when(F.col("pre").isNotNull(), F.col("pre")) \
        .when(error.isNotNull() | v.isNull(),
              result(None, "judge_error", reasoning=err, method="llm_judge")) \
        .otherwise(finished)
    return parsed.select("run_id", "sample_id", "metric", res.alias("_res"), *carry) \
        .select("run_id", "sample_id", "metric", "_res.*", *carry)


def _stored_form(rows: DataFrame) -> DataFrame:
    """Columns that are null throughout have no type that can be stored."""
    return rows.withColumns({c: F.col(c).cast("string") for c in ("query", "answer", "reference")})


def _prompts_at(specs: list[MetricSpec], rows: DataFrame, places: DataFrame, tasks: int | None) -> DataFrame:
    """``(cache_key, prompt)`` of ``places(cache_key, place)``, a place being
    ``_row * len(specs) + metric_pos`` of the stored samples ``rows``. Each
    sample goes once to one of a fixed number of tasks, by its row."""
    judged = [sp for sp in specs if sp.uses_judge]
    n = tasks or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    name = F.element_at(F.array(*[F.lit(sp.name) for sp in specs]), (F.col("place") % len(specs) + 1).cast("int"))
    wanted = (places.select(F.expr(f"place div {len(specs)}").alias("_row"), F.struct(name, "cache_key").alias("k"))
              .repartition(n, "_row").groupBy("_row").agg(F.map_from_entries(F.collect_list("k")).alias("_keys")))
    base = _features(judged, rows.repartition(n, "_row").join(wanted, "_row"))
    s = {c: F.col(c) for c in base.columns}
    return (base.select("_keys", F.explode(_requests(judged, s)).alias("r"))
            .select(F.try_element_at("_keys", F.col("r.metric")).alias("cache_key"), "r.prompt")
            .where("cache_key IS NOT NULL"))


def score(samples: DataFrame, metrics, judge: Judge | None = None, run_id: str = "run",
          registry: MetricRegistry | None = None, options: dict | None = None,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every sample with every metric; returns SCORES rows, with the
    columns ``carry`` of the samples (an event time, say) behind them.

    Plan: samples -> features -> one explode into (sample, metric) requests.
    Rows resolved without the judge (deterministic metrics, guards, pattern
    hits) keep their result. Judge requests: with a pure-expression judge and
    no cache the reply is computed in the same projection (nothing to
    deduplicate); otherwise the distinct prompts are answered once (see
    ``judge.ask``) and joined back on the cache key. The samples are stored
    for that under row numbers: keys are made and grouped without the prompts,
    which are built anew beside the samples for the keys that are asked.
    """
    specs = resolve_metrics(metrics, registry, options)
    spark = samples.sparkSession
    if not specs:
        return spark.createDataFrame([], SCORES)
    judged = [sp for sp in specs if sp.uses_judge]
    if judged and judge is None:
        raise ValueError(f"metrics {[sp.name for sp in judged]} need a judge")

    rows, numbered = spread(normalize_samples(samples, carry)), []
    if judged and judge.responder.reads_prompts and not (
            isinstance(judge.responder, ExpressionResponder) and judge.cache is None):
        rows, numbered = store(_stored_form(rows).withColumn("_row", F.monotonically_increasing_id()), "samples"), ["_row"]
    base = _features(specs, spread(rows))
    s = {c: F.col(c) for c in base.columns}
    exploded = (base.select(F.lit(run_id).alias("run_id"), "sample_id",
                            F.explode(_requests(specs, s)).alias("r"), *carry, *numbered)
                .select("run_id", "sample_id", "r.*", *carry, *numbered))

    def out(df: DataFrame, res: Column) -> DataFrame:
        return df.select("run_id", "sample_id", "metric", res.alias("_res"), *carry) \
                 .select("run_id", "sample_id", "metric", "_res.*", *carry)

    if not judged:
        return out(exploded, F.col("pre"))

    prompt = F.col("prompt")
    if isinstance(judge.responder, ExpressionResponder) and judge.cache is None:
        replied = exploded.select("run_id", "sample_id", "metric", "aux", "pre",
                                  judge.responder.fn(prompt).alias("response"),
                                  F.lit(None).cast("string").alias("error"), *carry)
        return _finish(judged, replied, carry)

    key = cache_key(judge.model, judge.temperature, prompt)
    # Rows that need no reply get a key that can never match a SHA-256 hex
    # (and spreads evenly), so one left join serves every row; the prompt
    # text is dropped before the shuffle.
    own_key = F.concat(F.lit("-"), F.col("sample_id").cast("string"), F.lit("-"), F.col("metric"))
    columns = ["run_id", "sample_id", "metric", "aux", "pre",
               F.when(prompt.isNull(), own_key).otherwise(key).alias("cache_key"), *carry]
    if not numbered:
        keyed = exploded.select(*columns)
        replies = ask(judge, exploded.where(prompt.isNotNull()).select(key.alias("cache_key"), "prompt"))
    else:
        place = F.when(prompt.isNotNull(), F.col("_row") * len(specs) + F.col("metric_pos"))
        stored = store(exploded.select(*columns, place.alias("_place")), "requests")
        keyed = stored.drop("_place")
        replies = ask(judge, stored.where("_place IS NOT NULL").select("cache_key", F.col("_place").alias("place")),
                      lambda places, tasks: _prompts_at(specs, rows, places, tasks))
    return _finish(judged, keyed.join(replies, "cache_key", "left"), carry)


def prompt_table(samples: DataFrame, metrics, judge: Judge, run_id: str = "run",
                 registry: MetricRegistry | None = None) -> DataFrame:
    """The judge requests of a run: ``(run_id, sample_id, metric, cache_key,
    prompt)`` for rows no guard resolved (X9, X13)."""
    specs = [sp for sp in resolve_metrics(metrics, registry) if sp.uses_judge]
    base = _features(specs, spread(normalize_samples(samples)))
    s = {c: F.col(c) for c in base.columns}
    exploded = (base.select(F.lit(run_id).alias("run_id"), "sample_id",
                            F.explode(_requests(specs, s)).alias("r"))
                .select("run_id", "sample_id", "r.metric", "r.prompt")
                .where(F.col("prompt").isNotNull()))
    return exploded.select("run_id", "sample_id", "metric",
                           cache_key(judge.model, judge.temperature, F.col("prompt")).alias("cache_key"),
                           "prompt")


def score_runs(samples: DataFrame, metrics, judges: dict, registry: MetricRegistry | None = None,
               options: dict | None = None) -> DataFrame:
    """Several runs (one judge each) over the same samples.

    With pure-expression judges the features and prompts are built once per
    (sample, metric) and fanned out over the runs by a second explode; other
    judges are scored one run at a time (each run has its own judge stage).
    """
    inline = all(isinstance(j.responder, ExpressionResponder) and j.cache is None
                 for j in judges.values())
    if not inline or len(judges) < 2:
        out = None
        for rid, j in judges.items():
            df = score(samples, metrics, judge=j, run_id=rid, registry=registry, options=options)
            out = df if out is None else out.unionByName(df)
        return out
    specs = resolve_metrics(metrics, registry, options)
    judged = [sp for sp in specs if sp.uses_judge]
    base = _features(specs, spread(normalize_samples(samples)))
    s = {c: F.col(c) for c in base.columns}
    per_metric = (base.select("sample_id", F.explode(_requests(specs, s)).alias("r"))
                  .select("sample_id", "r.*"))
    runs = per_metric.select("*", F.explode(F.array(*[F.lit(r) for r in judges])).alias("run_id"))
    prompt = F.col("prompt")
    reply = F.lit(None).cast("string")
    for rid, j in reversed(list(judges.items())):
        reply = F.when(F.col("run_id") == rid, j.responder.fn(prompt)).otherwise(reply)
    replied = runs.select("run_id", "sample_id", "metric", "aux", "pre",
                          F.when(prompt.isNotNull(), reply).alias("response"),
                          F.lit(None).cast("string").alias("error"))
    if not judged:
        return replied.select("run_id", "sample_id", "metric", "pre.*")
    return _finish(judged, replied)
