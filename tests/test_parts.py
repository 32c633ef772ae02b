"""Written samples grow by files, not within one; long texts are not moved by key."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E


@pytest.fixture()
def tables(spark, scratch):
    """Documents in five files, each a split of its own, and three benchmark items."""
    text = F.concat(F.lit('# a "title", '), F.col("id").cast("string"), F.lit("\n- one | two\n\nthree "), F.col("id").cast("string"))
    docs = spark.range(0, 300, 1, 5).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
        F.lit("web").alias("source"), F.length(text).alias("n_chars"))
    docs.write.parquet(f"{scratch}/documents.parquet")
    spark.range(3).select(F.col("id").alias("item_id"), F.lit("an item").alias("text")).write.parquet(f"{scratch}/benchmark.parquet")
    sizes = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "8k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield scratch
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture()
def written(monkeypatch):
    """Where a query writes, by name."""
    paths, real = {}, E._scratch
    monkeypatch.setattr(E, "_scratch", lambda spark, name: paths.setdefault(name, real(spark, name)))
    return paths


def files(folder):
    """The sizes of a folder's data files."""
    return [os.path.getsize(os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f[0] not in "._"]


def test_csv_records_are_written_in_files_of_bounded_size(spark, tables, written, monkeypatch):
    monkeypatch.setattr(E, "CSV_FILE_RECORDS", 20, raising=False)
    rows = E.q_csv_context_parse(spark, tables).collect()
    sizes = files(written["csv"])
    assert len(sizes) > 15 and max(sizes) < sum(sizes) / 10
    got = {r.sample_id: r for r in rows}
    assert len(rows) == 300 and sorted(got) == list(range(300))
    for i, r in got.items():
        assert r.missing == ("answer,reference,metadata" if i % 10 == 3 else None)
        # three lines; of odd ids "one | two" and no blank line
        assert r.n_context == (-1 if i % 10 == 3 else 0 if i % 7 == 0 else 3)


def test_csv_without_records_has_its_header(spark, tables, written):
    spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 0").write.parquet(f"{tables}/none/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tables}/none/benchmark.parquet")
    assert E.q_csv_context_parse(spark, f"{tables}/none").count() == 0


def test_windows_are_fed_by_as_many_files_as_the_scan_has_splits(spark, tables, written):
    splits = spark.read.parquet(f"{tables}/documents.parquet").rdd.getNumPartitions()
    rows = E.q_stream_windows(spark, tables).collect()
    for k in (1, 2, 3):
        sizes = files(os.path.join(written["stream-windows"], str(k)))
        assert len(sizes) == splits > 1 and max(sizes) < sum(sizes) * 0.8
    # three micro-batches: the third is held against the first one's watermark, and
    # windows are out up to the last one (898 - 30 minutes)
    late = [i for i in range(300) if i % 10 == 9 and i // 10 * 10 + 10 <= 295 - 30]
    out = [i for i in range(300) if 6 <= i % 10 < 9 and (600 + i) // 10 * 10 + 10 > 898 - 30]
    assert sum(r.n for r in rows) == 300 - len(late) - len(out)


def test_a_batch_of_few_rows_has_its_number_of_files(spark, tables, scratch):
    few = E.samples_docs(spark, tables).where("sample_id < 2")
    E._write_lines(few, f"{scratch}/few", 6)
    assert len(files(f"{scratch}/few")) == 6
    assert spark.read.text(f"{scratch}/few").count() == 2


@pytest.mark.parametrize("query, folder, few", [
    ("stream_line_ids", "stream-lines", 4),
    ("stream_judge", "stream-judge", 3),
    ("stream_scores", "stream-in", 4),
])
def test_streams_are_fed_by_files_that_grow_in_number(spark, tables, written, query, folder, few):
    assert E.queries()[query](spark, tables).count() > 0
    assert len(files(written[folder])) > few


def test_lines_that_come_three_times_take_the_room_of_one(spark, tables, written):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 40").coalesce(2)
    more = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.sha2(F.concat("text", k.cast("string")), 256))
    docs = docs.withColumn("text", F.concat("text", F.array_join(more, " ")))
    docs.write.parquet(f"{tables}/long/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tables}/long/benchmark.parquet")
    rows = E.q_stream_line_ids(spark, f"{tables}/long").collect()
    assert sorted(map(tuple, rows)) == [("de", 60, 60), ("en", 60, 60)]
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    # a line holds its text twice, and so does a sample
    assert sum(files(written["stream-lines"])) < 2 * texts
    assert sum(files(written["stream-samples"])) < 2 * texts
    # a line's copies are not parted
    counts = spark.read.text(written["stream-lines"]).groupBy(F.input_file_name(), "value").count()
    assert [r["count"] for r in counts.collect()] == [3] * 40


def test_a_stream_of_no_lines(spark, tables, written):
    spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 0").write.parquet(f"{tables}/none/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tables}/none/benchmark.parquet")
    assert E.q_stream_line_ids(spark, f"{tables}/none").count() == 0


def test_the_judge_stage_moves_samples_not_prompts(spark, tables, scratch, monkeypatch):
    from ragscope.operators import cache as C
    from ragscope.operators import score as SC
    from ragscope.operators.judge import BatchResponder, Judge
    grouped, real = [], SC.ask
    monkeypatch.setattr(SC, "ask", lambda judge, prompts, *texts: grouped.append(prompts.columns) or real(judge, prompts, *texts))
    twice = E.samples_docs(spark, tables).where("sample_id < 40")
    # rows and ids that come twice, one row without any text
    twice = twice.unionByName(twice.where("sample_id < 20")).unionByName(
        twice.where("sample_id = 1").withColumns({c: F.lit(None).cast("string") for c in ("query", "answer", "reference")}))
    cache = C.JudgeCache(spark, f"{scratch}/cache")
    judge = Judge(BatchResponder(E._python_reply("m"), max_retries=1, backoff=0.0), model="m", cache=cache)
    got = SC.score(twice, E.ALL_METRICS, judge=judge, run_id="A")
    assert grouped == [["cache_key", "place"]]
    asked = SC.prompt_table(twice, E.JUDGE_METRICS, judge)
    kept = asked.where(E.standin_score("m", F.col("prompt")) * 65535 >= E.BAD_BELOW).select("cache_key").distinct()
    assert sorted(r[0] for r in cache.table().select("cache_key").collect()) == sorted(r[0] for r in kept.collect())
    plain = SC.score(twice, E.ALL_METRICS, run_id="A", judge=Judge(SC.ExpressionResponder(lambda p: F.when(
        E.standin_score("m", p) * 65535 >= E.BAD_BELOW, E._reply_4("m", p))), model="m"))
    rows = lambda df: sorted(map(str, df.select("sample_id", "metric", "score", "status").collect()))
    assert rows(got) == rows(plain)
