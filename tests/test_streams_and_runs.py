"""Streams, stored runs, reports, rejects and progress."""

import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ragscope.operators import compare as CMP
from ragscope.operators import history as H
from ragscope.operators import summary as S
from ragscope.operators.progress import watch
from ragscope.operators.score import score
from ragscope.sources import samples as SRC
from ragscope.sources.reports import read_baseline, read_report, read_results, report_to_scores, write_json_report
from ragscope.streaming import stream as ST

LINE = json.dumps({"query": "q", "context": [], "answer": "same"})


def ids_of_stream(spark, folder, out):
    good, _ = ST.stream_samples(spark, folder)
    return ST.run_to_path(good, f"{out}/rows", f"{out}/ck")


def test_equal_lines_of_a_file_have_own_ids(spark, scratch):
    folder = os.path.join(scratch, "in")
    os.mkdir(folder)
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write(f"{LINE}\n{LINE}\n\n{LINE}\n" + json.dumps({"sample_id": 5, "query": "q", "context": [], "answer": "given"}) + "\n")
    first = {r.sample_id for r in ids_of_stream(spark, folder, f"{scratch}/1").collect()}
    assert len(first) == 4 and 5 in first
    # another stream over the same files: the same ids
    assert {r.sample_id for r in ids_of_stream(spark, folder, f"{scratch}/2").collect()} == first
    # a restart goes on with new files and repeats nothing
    with open(f"{folder}/b.jsonl", "w") as f:
        f.write(f"{LINE}\n{LINE}\n")
    again = [r.sample_id for r in ids_of_stream(spark, folder, f"{scratch}/1").collect()]
    assert len(again) == 6 and len(set(again)) == 6 and first < set(again)


@pytest.mark.parametrize("read", ["whole", "split", "dealt out", "compressed"])
def test_ids_do_not_depend_on_how_a_file_is_read(spark, scratch, monkeypatch, read):
    folder, before = os.path.join(scratch, "in"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    os.mkdir(folder)
    line = lambda i: json.dumps({"query": f"q{i}", "context": ["c" * 200], "answer": f"a{i}"})
    times = {i: 1 + i % 4 for i in range(200)}  # equal lines stand far apart
    lines = [line(i) for k in range(4) for i in times if k < times[i]] + ["no JSON"] * 3
    for name in ("a", "b"):
        if read == "compressed":
            with gzip.open(f"{folder}/{name}.txt.gz", "wt") as f:
                f.write("\n".join(lines))
        else:
            with open(f"{folder}/{name}.txt", "w") as f:
                f.write("\n".join(lines))
    if read == "dealt out":
        monkeypatch.setattr(ST, "WHOLE_BYTES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k" if read in ("split", "compressed") else before)
    try:
        good, bad = ST.stream_samples(spark, folder)
        got = ST.run_to_path(good, f"{scratch}/rows", f"{scratch}/ck").select("sample_id", "answer")
        rejects = ST.run_to_path(bad, f"{scratch}/bad", f"{scratch}/bad-ck")
        files = [r[0] for r in rejects.select("file").distinct().collect()]
        wanted = spark.createDataFrame([(f, line(i), f"a{i}", k) for f in files for i in times for k in range(times[i])],
                                       "file string, line string, answer string, seq long")
        wanted = wanted.select(F.xxhash64("file", "line", "seq").alias("sample_id"), "answer")
        assert len(files) == 2 and rejects.count() == 6
        assert sorted(got.collect()) == sorted(wanted.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_whole_files_are_not_moved(spark, scratch):
    folder = os.path.join(scratch, "in")
    os.mkdir(folder)
    for name in ("a", "b"):
        with open(f"{folder}/{name}.txt", "w") as f:
            f.writelines(json.dumps({"query": os.urandom(400).hex(), "context": [], "answer": "a"}) + "\n" for _ in range(1000))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {f.getName(): f.length() for f in (blocks.getAllFiles().apply(i) for i in range(blocks.getAllFiles().size()))}
    before = kept()
    good, _ = ST.stream_samples(spark, folder)
    assert ST.run_to_path(good, f"{scratch}/rows", f"{scratch}/ck").count() == 2000
    lines = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))
    assert sum(n for f, n in kept().items() if f not in before) < lines / 10


def test_given_ids_reject_lines_without_one(spark, scratch):
    folder = os.path.join(scratch, "in")
    os.mkdir(folder)
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write(f"{LINE}\n")
    good, bad = ST.stream_samples(spark, folder, ids="given")
    assert ST.run_to_path(good, f"{scratch}/g", f"{scratch}/gck").count() == 0
    assert ST.run_to_path(bad, f"{scratch}/b", f"{scratch}/bck").first().reason == "missing sample_id"


def test_a_replayed_batch_leaves_the_rows_as_they_are(spark, scratch):
    batch = score(E.samples_docs(spark, E.SF0001), ["format_compliance"], run_id="r")
    for _ in range(2):
        ST.write_epoch(batch, 0, f"{scratch}/out")
    ST.write_epoch(batch, 1, f"{scratch}/out")
    counts = {r.epoch: r["count"] for r in spark.read.parquet(f"{scratch}/out").groupBy("epoch").count().collect()}
    assert counts == {0: 200, 1: 200}


def saved(spark, where, run, value, day, with_scores=True):
    sc = spark.createDataFrame([(run, i, m, value, "ok") for i in range(4) for m in ("x", "y")],
                               "run_id string, sample_id long, metric string, score double, status string")
    H.save_run(spark, where, S.run_summary(S.sample_scores(sc), 0.5), S.metric_summary(sc), sc if with_scores else None,
               ts=datetime(2024, 1, day))
    return sc


def test_run_store(spark, scratch):
    where = os.path.join(scratch, "history")
    a = saved(spark, where, "7", 0.4, 1)
    saved(spark, where, "8", 0.9, 2)
    saved(spark, where, "8", 0.9, 2)  # again: replaces itself
    assert [r.run_id for r in H.list_runs(H.read_table(spark, where, "runs")).collect()] == ["8", "7"]
    one = H.load_run(spark, where, "8")
    assert one.count() == 8 and {r.run_id for r in one.collect()} == {"8"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "run_date=2024-01-02/run_id=8" in str(one.inputFiles()) and len({os.path.dirname(f) for f in one.inputFiles()}) == 1, plan
    # scores of a save that never committed do not show
    a.withColumn("run_date", F.lit("2024-01-01")).withColumn("run_id", F.lit("lost")).write.mode("append") \
        .partitionBy("run_date", "run_id").parquet(f"{where}/scores")
    assert H.read_table(spark, where, "scores").select("run_id").distinct().count() == 2
    with pytest.raises(KeyError):
        H.load_run(spark, where, "lost")
    d = CMP.diff_runs(spark, where, "7", "8")
    assert {(r.metric, round(r.delta, 6), r.direction) for r in d.metrics.collect()} == {("x", 0.5, "up"), ("y", 0.5, "up")}
    assert d.overall.first().verdict == "better" and d.samples.where("direction = 'up'").count() == 4
    plan = d.overall._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_latest_means_and_samples_without_metrics(spark):
    runs = spark.createDataFrame([("a", datetime(2024, 1, 1), None), ("b", datetime(2024, 1, 2), None)], "run_id string, ts timestamp, tag string")
    means = spark.createDataFrame([("a", "x", 0.1), ("b", "x", 0.7)], "run_id string, metric string, mean double")
    assert [tuple(r) for r in H.latest_metric_means(runs, means).collect()] == [("b", "x", 0.7)]
    sc = spark.createDataFrame([("a", 1, "x", 0.5, "ok")], "run_id string, sample_id long, metric string, score double, status string")
    every = spark.createDataFrame([("a", 1), ("a", 2)], "run_id string, sample_id long")
    assert sorted(tuple(r) for r in S.sample_scores(sc, every).collect()) == [("a", 1, 0.5, 1), ("a", 2, 0.0, 0)]


def test_report_folder(spark, scratch):
    sc = score(E.samples_docs(spark, E.SF0001), ["format_compliance"], run_id="r1").cache()
    where = os.path.join(scratch, "report")
    write_json_report(sc, ["format_compliance"], where, S.run_summary(S.sample_scores(sc), 0.7), S.metric_summary(sc))
    head = read_report(spark, where).first().summary
    assert head.total_samples == 200 and head.threshold == 0.7
    mean = sc.agg(F.avg("score")).first()[0]
    assert read_baseline(spark, where).first()["mean"] == pytest.approx(mean, abs=1e-12)
    back = report_to_scores(read_results(spark, where))
    assert back.count() == 200 and back.agg(F.avg("score")).first()[0] == pytest.approx(mean, abs=1e-12)


def test_json_lines_are_read_once(spark, scratch):
    path = os.path.join(scratch, "s.jsonl")
    with open(path, "w") as f:
        for i in (None, 7, None, None):
            f.write(json.dumps({"query": "q", "context": [], "answer": "a"} | ({"sample_id": i} if i else {})) + "\n")
        f.write('{"query": "first", "query": "last", "context": [], "answer": "a"}\n')
    good, rejects = SRC.read_jsonl(spark, path)
    assert sorted(r.sample_id for r in good.collect()) == [-4, -3, -2, -1, 7] and rejects.count() == 0
    assert good.where("query = 'last'").count() == 1
    assert path not in str(good.inputFiles()) + str(rejects.inputFiles())  # both from what was stored
    lazy, bad = SRC.read_jsonl(spark, path, assign_ids=False)
    assert [r.sample_id for r in lazy.collect()] == [7] and bad.count() == 4
    assert lazy._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_csv_rejects(spark, scratch):
    path = os.path.join(scratch, "S.CSV")
    with open(path, "w") as f:
        f.write('query,context,answer,reference\nq1,a | b,one,\nq2,"x, ""y"" z"\nq3,c,three,r,more\n"q\n4",c,"four, five",r\n')
    good, rejects = SRC.read_samples(spark, path)
    assert [(r.sample_id, r["query"], r.context, r.answer, r.reference) for r in good.orderBy("sample_id").collect()] == [
        (0, "q1", ["a", "b"], "one", None), (1, "q3", ["c"], "three", "r"), (2, "q\n4", ["c"], "four, five", "r")]
    bad = rejects.collect()
    assert [(r.reason, r.missing) for r in bad] == [("fewer cells than the header", ["answer", "reference"])]
    assert bad[0].line.startswith("q2,") and SRC.count_samples(spark, path) == 4
    with pytest.raises(SRC.RejectedRows):
        SRC.read_csv(spark, path)
    with pytest.raises(FileNotFoundError):
        SRC.read_samples(spark, os.path.join(scratch, "none.csv"))


def test_progress_counts_what_is_written(spark, scratch):
    sc, progress = watch(E.run_scores(spark, E.SF0001, "A", ["coherence", "answer_similarity"]))
    sc.write.parquet(f"{scratch}/scores")
    back = spark.read.parquet(f"{scratch}/scores")
    assert progress.counts() == {"rows": back.count(), "guarded": back.where("status = 'guarded'").count(), "judge_errors": 0}


def test_small_tables_and_sorted_comparisons(spark):
    rows = spark.createDataFrame([("r", i, 0.1 * i) for i in range(20)], "run_id string, sample_id long, overall_score double")
    table, n = S.small_table(rows)
    assert table.count() == n == 20
    assert S.small_table(rows.unionByName(rows)) == (None, 21)
    assert S.small_table(rows.where("false"))[1] == 0
    a = spark.createDataFrame([("y", 0.5), ("x", 0.1), ("z", 0.3)], "metric string, mean double")
    assert [r.metric for r in CMP.in_order(CMP.compare(a, a)).collect()] == ["x", "y", "z"]
