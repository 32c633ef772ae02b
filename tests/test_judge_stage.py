"""The judge as a paid stage: cache, journal, retries, eviction, custom metrics."""

import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragscope.operators import cache as C
from ragscope.operators.judge import BatchResponder, Journal, Judge, RecordedResponder, ask, parse_reply, reply_fields
from ragscope.operators.metrics import MetricSpec, default_registry, result
from ragscope.operators.score import score

PROMPTS = "cache_key string, prompt string"


def prompts(spark, n):
    return spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(n)] * 2, PROMPTS)  # each of them twice


def counting(folder, refuse=(), die_after=None):
    """A responder that leaves one file per prompt it was paid for."""
    def answer(batch):
        out = []
        for p in batch:
            if p in refuse:
                raise ValueError("refused")
            if die_after is not None and len(os.listdir(folder)) >= die_after:
                raise SystemExit("worker lost")  # no error of a prompt: the task dies
            open(os.path.join(folder, f"{p}-{len(os.listdir(folder))}"), "w").close()
            out.append(f"reply {p}")
        return out
    return answer


def paid(folder):
    return Counter(f.rsplit("-", 1)[0] for f in os.listdir(folder))


def test_an_ended_job_is_resumed_without_paying_twice(spark, scratch):
    folder = os.path.join(scratch, "paid")
    os.mkdir(folder)
    cache = C.JudgeCache(spark, os.path.join(scratch, "cache"))
    broken = Judge(BatchResponder(counting(folder, die_after=25), backoff=0, parallelism=1, batch_rows=5), cache=cache)
    with pytest.raises(Exception):
        ask(broken, prompts(spark, 40)).collect()
    assert sum(paid(folder).values()) == 25 and cache.latest().count() == 0
    assert len(Journal(cache.journal).read("part-0")) == 25
    judge = Judge(BatchResponder(counting(folder), backoff=0, parallelism=3, batch_rows=5), cache=cache)
    got = {r.cache_key: r.response for r in ask(judge, prompts(spark, 40)).collect()}
    assert got == {f"k{i}": f"reply p{i}" for i in range(40)}
    assert set(paid(folder).values()) == {1} and len(paid(folder)) == 40
    assert cache.latest().count() == 40 and not os.path.exists(cache.journal)
    ask(judge, prompts(spark, 40)).collect()  # all cached
    assert sum(paid(folder).values()) == 40


def test_a_retried_task_reads_its_journal(spark, scratch):
    journal = Journal(os.path.join(scratch, "journal"))
    journal.write("part-0", {"k1": "kept", "k3": "kept"})
    asked = BatchResponder(lambda batch: [f"new {p}" for p in batch], parallelism=1, batch_rows=2)
    rows = {r.cache_key: r.response for r in asked.respond(prompts(spark, 5).distinct(), journal).collect()}
    assert rows == {"k0": "new p0", "k1": "kept", "k2": "new p2", "k3": "kept", "k4": "new p4"}


def test_refused_prompts_cost_only_themselves(spark, scratch):
    folder = os.path.join(scratch, "paid")
    os.mkdir(folder)
    cache = C.JudgeCache(spark, os.path.join(scratch, "cache"))
    judge = Judge(BatchResponder(counting(folder, refuse={"p3", "p8"}), max_retries=2, backoff=0), cache=cache)
    rows = {r.cache_key: r for r in ask(judge, prompts(spark, 12)).collect()}
    assert len(rows) == 12
    assert {k for k, r in rows.items() if r.error} == {"k3", "k8"} and "refused" in rows["k3"].error
    assert cache.latest().count() == 10


def test_batches_are_asked_whole_and_retried(spark):
    seen = []
    tries = {"n": 0}

    def flaky(batch):
        tries["n"] += 1
        if tries["n"] < 3:
            raise ValueError("busy")
        seen.append(len(batch))
        return ["ok"] * len(batch)
    replies, errors = BatchResponder(flaky, max_retries=3, backoff=0)._ask(pd.Series(["a", "b", "c"]))
    assert (replies, errors, seen) == (["ok"] * 3, [None] * 3, [3])


def test_recorded_replies(spark):
    table = spark.createDataFrame([("k1", "one")], "cache_key string, response string")
    rows = {r.cache_key: r for r in ask(Judge(RecordedResponder(table)), prompts(spark, 2)).collect()}
    assert rows["k1"].response == "one" and rows["k0"].error == "no recorded reply"


def test_repeated_keys_count_with_their_last_value(spark):
    v = spark.createDataFrame([('{"score": 0.1, "reasoning": "a", "score": 0.9}',)], "r string").select(parse_reply(F.col("r")).alias("v"))
    f = reply_fields(F.col("v"), 0.0)
    row = v.select(f["score"].alias("score"), f["status"].alias("status")).first()
    assert (row.score, row.status) == (0.9, "ok")


@pytest.mark.parametrize("wanted", [1, 7, 250, 999, 1000])
def test_eviction_is_the_sorted_head(spark, monkeypatch, wanted):
    monkeypatch.setattr(C, "BOUNDARY_ROWS", 20)
    monkeypatch.setattr(C, "BUCKETS", 8)
    rows = [(f"{i * 7919 % 1000:03d}", "r", 0 if i % 3 else i * 10**6) for i in range(1000)]  # two thirds at one time
    cache = spark.createDataFrame(rows, "cache_key string, response string, t long") \
        .select("cache_key", "response", F.timestamp_seconds(F.col("t")).alias("created_at"))
    want = {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:wanted]}
    kept = C.evict(cache, wanted)
    assert {r.cache_key for r in kept.collect()} == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_custom_metrics_and_registry(spark):
    sample = spark.createDataFrame([(1, "q", ["c"], "abc", None, None)], "sample_id long, query string, context array<string>, "
                                   "answer string, reference string, metadata map<string,string>")
    length = MetricSpec("short_answer", native=lambda s, o: result(F.when(F.length(s["answer"]) <= o.get("most", 2), 1.0).otherwise(0.0), "ok"))
    registry = default_registry()
    registry.register(length)
    assert "short_answer" in registry and registry.is_registered("coherence")
    one = lambda **kw: score(sample, ["short_answer"], registry=registry, **kw).first().score
    assert one() == 0.0 and one(options={"short_answer": {"most": 3}}) == 1.0
    assert score(sample, [length.with_options(most=5)]).first().score == 1.0
    assert registry.register_from("tests.test_judge_stage:made_elsewhere") == "made_elsewhere"
    assert score(sample, ["made_elsewhere"], registry=registry).first().score == 0.25
    with pytest.raises(KeyError, match="Unknown metric: nothing"):
        registry.resolve(["nothing"])
    with pytest.raises(ValueError, match="twice"):
        registry.resolve(["coherence", "coherence"])
    with pytest.raises(TypeError):
        registry.register("coherence")
    with pytest.raises(ValueError):
        registry.register_from("no_attribute")


def made_elsewhere():
    return MetricSpec("made_elsewhere", native=lambda s, o: result(F.lit(0.25), "ok"))
