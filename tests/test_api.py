import json
import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from ragscope.operators import history as H
from ragscope.plans.api import Job, evaluate, run_job
from ragscope.sources.reports import write_samples


def test_run_job_end_to_end(spark, scratch):
    src = os.path.join(scratch, "samples.jsonl")
    write_samples(E.samples_docs(spark, E.SF0001), src, "jsonl")
    judge = E.standin_judge(E.MODEL_A)
    base = spark.createDataFrame([("coherence", 0.0), ("format_compliance", 0.0)],
                                 "metric string, mean double")
    job = Job(input_path=src, metrics=["format_compliance", "coherence"], judge=judge,
              filter="metadata.lang=en", sample=50, output=os.path.join(scratch, "out/report"),
              formats=("json", "csv"), baseline=base, history_dir=os.path.join(scratch, "hist"),
              tag="nightly")
    res = run_job(spark, job)
    assert res["passed"] is True
    assert all(os.path.exists(p) for p in res["paths"])
    out = res["output"]
    assert out.scores.count() == 100
    assert out.summary.first()["total_samples"] == 50
    runs = H.read_table(spark, job.history_dir, "runs")
    listed = H.list_runs(runs, "nightly", 5).collect()
    assert len(listed) == 1 and listed[0]["run_id"] == res["run_id"]
    again = H.load_run(spark, job.history_dir, res["run_id"]).count()
    assert again == 100


def test_evaluate_weights_and_verdict(spark):
    sd = E.samples_docs(spark, E.SF0001)
    out = evaluate(sd, ["format_compliance"], threshold=0.5, weights={"format_compliance": 2.0},
                   store=False)
    s = out.summary.first()
    m = out.metric_summary.first()
    assert abs(s["overall_score"] - m["mean"]) < 1e-12
    assert out.passed() == (s["fail_count"] == 0 and s["total_samples"] > 0)


def test_report_roundtrip_and_baseline(spark, scratch):
    from ragscope.operators import compare as CMP
    from ragscope.operators.score import score
    from ragscope.sources.reports import read_baseline, read_report, report_to_scores, results_table
    sd = E.samples_docs(spark, E.SF0001)
    sc = score(sd, ["format_compliance"], run_id="r1")
    ms = {r["metric"]: r["mean"] for r in
          __import__("ragscope.operators.summary", fromlist=["x"]).metric_summary(sc).collect()}
    summary = {"total_samples": 200, "overall_score": 0.5,
               "metric_scores": {"format_compliance": {"mean": ms["format_compliance"]},
                                 "legacy": 0.25}}
    path = os.path.join(scratch, "rep.json")
    rows = results_table(sc, ["format_compliance"]).select(F.to_json(F.struct("*")).alias("r")).collect()
    with open(path, "w") as f:
        json.dump({"metadata": {"version": "x"}, "summary": summary, "results": [json.loads(r.r) for r in rows]}, f)
    rep = read_report(spark, path)
    base = {r["metric"]: r["mean"] for r in read_baseline(spark, path).collect()}
    assert base == {"format_compliance": ms["format_compliance"], "legacy": 0.25}
    back = report_to_scores(rep)
    assert back.count() == 200
    assert back.agg(F.avg("score")).first()[0] == sc.agg(F.avg("score")).first()[0]
    reg = CMP.check_regression(sc, read_baseline(spark, path), 0.05)
    assert {r["metric"]: r["passed"] for r in reg.collect()} == {"format_compliance": True,
                                                                 "legacy": False}
