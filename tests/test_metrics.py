import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragscope.operators.judge import BatchResponder, ExpressionResponder, Judge
from ragscope.operators.score import score

SCHEMA = ("sample_id long, query string, context array<string>, answer string, "
          "reference string, metadata map<string,string>")


def samples(spark, rows):
    full = []
    for i, r in enumerate(rows):
        full.append((i, r.get("query", "q"), r.get("context", ["c"]), r.get("answer", "a"),
                     r.get("reference"), r.get("metadata", {})))
    return spark.createDataFrame(full, SCHEMA)


def by_id(df):
    return {r["sample_id"]: r for r in df.collect()}


def never_called():
    def fail(p):
        raise AssertionError("judge must not be called")
    return Judge(BatchResponder(fail, max_retries=1, backoff=0), model="m")


def test_format_compliance_cases(spark):
    words100 = " ".join(["w"] * 100)
    rows = [
        {"answer": "anything"},                                                      # 0 no constraint
        {"answer": '{"a": 1}', "metadata": {"expected_format": "json"}},              # 1
        {"answer": "not json", "metadata": {"expected_format": "json"}},              # 2
        {"answer": "# Title\ntext", "metadata": {"expected_format": "markdown_heading"}},  # 3
        {"answer": "Title", "metadata": {"expected_format": "markdown_heading"}},     # 4
        {"answer": "- a\n- b\n- c", "metadata": {"expected_format": "bullet_list"}},  # 5
        {"answer": "- a", "metadata": {"expected_format": "bullet_list"}},            # 6
        {"answer": "1. a\n2. b\n3. c", "metadata": {"expected_format": "numbered_list"}},  # 7
        {"answer": "one two three four five", "metadata": {"min_words": "3", "max_words": "50"}},  # 8
        {"answer": "too short", "metadata": {"min_words": "10"}},                     # 9
        {"answer": words100, "metadata": {"max_words": "10"}},                        # 10
        {"answer": "x", "metadata": {"expected_format": "yaml"}},                     # 11
        {"answer": '{"a": 1}', "metadata": {"expected_format": "json", "max_words": "10"}},  # 12
        {"answer": "Title only", "metadata": {"expected_format": "markdown_heading", "min_words": "1"}},  # 13
    ]
    got = by_id(score(samples(spark, rows), ["format_compliance"]))
    want = [1, 1, 0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 1, 0]
    assert [got[i]["score"] for i in range(len(rows))] == [float(w) for w in want]
    assert got[0]["reasoning"] == "No format constraints specified" and got[0]["checks"] == []
    assert got[2]["checks"][0]["detail"].startswith("Invalid JSON: Expecting value")
    assert got[5]["checks"][0]["detail"] == "Contains 3 bullet items"
    assert got[11]["checks"][0]["detail"] == "Unknown format: yaml"
    assert [c["check"] for c in got[8]["checks"]] == ["word_count"]
    assert got[8]["checks"][0]["detail"] == "5 words within bounds"
    assert got[10]["checks"][0]["detail"] == "Got 100 words, maximum 10"
    # Q13: the passing word check is left out once something failed.
    assert [c["check"] for c in got[13]["checks"]] == ["markdown_heading"]


def test_toxicity_pattern_then_judge(spark):
    rows = [{"answer": "A calm and helpful reply."}, {"answer": "You idiot, you are a moron"},
            {"answer": "Go hurt yourself."}, {"answer": "YOU ARE STUPID"}]
    judge = Judge(ExpressionResponder(lambda p: F.lit('{"score": 0.25, "reasoning": "ok"}')), model="m")
    got = by_id(score(samples(spark, rows), ["toxicity"], judge=judge))
    assert got[0]["score"] == 0.75 and got[0]["method"] == "llm_judge"
    assert got[0]["details"]["toxicity_level"] == "0.25"
    for i in (1, 2, 3):
        assert got[i]["score"] == 0.0 and got[i]["method"] == "pattern_scan" and got[i]["hits"]
    assert got[1]["hits"] == ["idiot"]


def test_guards_skip_judge(spark):
    rows = [{"context": [], "reference": None}]
    got = by_id(score(samples(spark, rows), ["context_precision", "context_recall",
                                              "answer_similarity"], judge=never_called()))
    assert got[0]["score"] == 0.0
    out = score(samples(spark, rows), ["context_precision", "context_recall", "answer_similarity"],
                judge=never_called()).collect()
    reasons = {r["metric"]: (r["reasoning"], r["details"]) for r in out}
    assert reasons["context_precision"][0] == "No context provided"
    assert reasons["context_recall"][0] == "No context provided"
    assert reasons["answer_similarity"][1] == {"warning": "No reference answer provided"}


def test_judge_reply_shapes(spark):
    replies = {0: '{"score": 0.8, "reasoning": "good"}',
               1: 'Sure! Here: {"score": 0.6, "reasoning": "fine"} done',
               2: "```json\n{\"score\": 0.4, \"reasoning\": \"meh\"}\n```",
               3: "I cannot answer that",
               4: '{"reasoning": "no score"}',
               5: '{"score": "abc"}'}
    rows = [{"query": f"q{i}"} for i in replies]

    def respond(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            i = int(p.split("## Question\nq")[1].split("\n")[0])
            out.append(replies[i])
        return pd.Series(out)

    judge = Judge(BatchResponder(respond), model="m")
    got = by_id(score(samples(spark, rows), ["coherence"], judge=judge))
    assert got[0]["score"] == 0.8 and got[0]["reasoning"] == "good"
    assert got[1]["score"] == 0.6
    assert got[2]["score"] == 0.4
    assert got[3]["status"] == "judge_error" and got[3]["score"] is None
    assert got[4]["score"] == 0.0 and got[4]["status"] == "ok"
    assert got[5]["status"] == "judge_error"


def test_answer_correctness_blend(spark):
    rows = [{"answer": "the cat sat", "reference": "the dog sat"}, {"answer": "x", "reference": ""}]
    judge = Judge(ExpressionResponder(lambda p: F.lit('{"score": 0.5}')), model="m")
    got = by_id(score(samples(spark, rows), ["answer_correctness"], judge=judge))
    assert got[0]["score"] == pytest.approx(0.4 * (2 / 3) + 0.6 * 0.5)
    assert got[1]["score"] == 0.5 and "token_overlap" not in got[1]["details"]


def test_batch_judge_with_cache_matches_expression(spark, scratch):
    from ragscope.operators.cache import JudgeCache

    def md5_score(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            h = hashlib.md5(("m|" + p).encode("utf-8")).hexdigest()[:4]
            out.append('{"score": %r, "reasoning": "r"}' % (int(h, 16) / 65535.0))
        return pd.Series(out)

    def expr(p):
        h = F.substring(F.md5(F.concat(F.lit("m|"), p)), 1, 4)
        return F.format_string('{"score": %s, "reasoning": "r"}',
                               (F.conv(h, 16, 10).cast("double") / F.lit(65535.0)).cast("string"))

    rows = [{"query": f"q{i % 3}", "answer": f"a{i % 3}"} for i in range(9)]  # duplicate prompts
    df = samples(spark, rows)
    metrics = ["coherence", "answer_relevancy"]
    cache = JudgeCache(spark, scratch + "/cache")
    a = score(df, metrics, judge=Judge(BatchResponder(md5_score), model="m", cache=cache)) \
        .select("sample_id", "metric", "score").orderBy("sample_id", "metric").collect()
    b = score(df, metrics, judge=Judge(ExpressionResponder(expr), model="m")) \
        .select("sample_id", "metric", "score").orderBy("sample_id", "metric").collect()
    assert a == b
    assert cache.latest().count() == 6  # 3 distinct prompts x 2 metrics, asked once
    # Second run: every key is cached, the responder is never called.
    c = score(df, metrics, judge=Judge(BatchResponder(lambda s: (_ for _ in ()).throw(
        AssertionError("called"))), model="m", cache=cache)) \
        .select("sample_id", "metric", "score").orderBy("sample_id", "metric").collect()
    assert c == a


def test_score_runs_equals_per_run(spark):
    import __spark_entry__ as E
    from ragscope.operators.score import score_runs
    sd = E.samples_docs(spark, E.SF0001)
    metrics = ["format_compliance", "answer_correctness", "toxicity", "context_recall"]
    judges = {"A": E.standin_judge(E.MODEL_A), "B": E.standin_judge(E.MODEL_B)}
    cols = ["run_id", "sample_id", "metric", "score", "status"]
    fused = score_runs(sd, metrics, judges).select(*cols).orderBy(*cols[:3]).collect()
    single = score(sd, metrics, judge=judges["A"], run_id="A").unionByName(
        score(sd, metrics, judge=judges["B"], run_id="B")).select(*cols).orderBy(*cols[:3]).collect()
    assert fused == single
