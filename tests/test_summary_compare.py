import pytest
from pyspark.sql import functions as F

from ragscope.operators import compare as CMP
from ragscope.operators import summary as S


def scores(spark, rows, run="r"):
    return spark.createDataFrame([(run, i, m, float(s), "ok") for i, (m, s) in enumerate(rows)],
                                 "run_id string, sample_id long, metric string, score double, status string")


def test_metric_distribution(spark):
    sc = scores(spark, [("faithfulness", s) for s in (0.9, 0.7, 0.5, 0.3)])
    r = S.metric_summary(sc).first()
    assert r["median"] == pytest.approx(0.6) and r["p25"] == pytest.approx(0.45)
    assert r["p75"] == pytest.approx(0.75)
    assert r["std_dev"] == pytest.approx(0.05 ** 0.5)
    one = S.metric_summary(scores(spark, [("m", 0.8)])).first()
    assert one["median"] == 0.8 and one["std_dev"] == 0.0
    three = S.metric_summary(scores(spark, [("m", s) for s in (0.9, 0.5, 0.7)])).first()
    assert three["median"] == pytest.approx(0.7)


def test_percentile_matches_python(spark):
    import random
    import statistics
    g = random.Random(3)
    vals = [g.random() for _ in range(101)]
    r = S.metric_summary(scores(spark, [("m", v) for v in vals])).first()
    for k, want in zip(("p25", "median", "p75"), statistics.quantiles(vals, n=4, method="inclusive")):
        assert r[k] == pytest.approx(want, abs=1e-12)


def test_quantiles_of_awkward_groups(spark):
    import numpy as np

    from ragscope.operators.quantiles import distribution_of
    g = np.random.default_rng(4)
    groups = {"ties": g.integers(0, 3, 400).astype(float), "many": g.normal(size=3000), "two": np.array([1.0, 2.0]),
              "one": np.array([0.8]), "hot": np.concatenate((np.zeros(900), g.random(50))), None: g.random(77)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("many", None), ("void", None), ("void", None)]
    table = spark.createDataFrame(rows, "k string, x double").repartition(5)
    for most, cells in ((1 << 18, 256), (50, 16)):  # groups as they are, and cut again and again
        got = {r.k: r for r in distribution_of(table, ["k"], F.col("x"), cells=cells, most=most).collect()}
        assert set(got) == {*groups, "void"}
        for k, v in groups.items():
            want = [len(v), v.mean(), v.min(), v.max(), *np.quantile(v, [0.25, 0.5, 0.75]), v.std()]
            assert list(got[k])[1:] == pytest.approx(want, abs=1e-12), k
        assert list(got["void"])[1:] == [0] + [None] * 7
    assert distribution_of(table.where("k = 'none'"), ["k"], F.col("x")).count() == 0


def test_exact_summaries_hold_no_group_in_one_buffer(spark):
    table = scores(spark, [("m", s) for s in (0.9, 0.7, 0.5)])
    for df in (S.metric_summary(table), S.run_summary(S.sample_scores(table))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan


def test_empty_run_summary_is_zeros(spark):
    empty = spark.createDataFrame([], "run_id string, sample_id long, overall_score double")
    ids = spark.createDataFrame([("r",)], "run_id string")
    r = S.run_summary(empty, 0.7, run_ids=ids).first()
    assert r["total_samples"] == 0 and r["overall_score"] == 0.0 and r["pass_rate"] == 0.0
    assert r["threshold"] == 0.7 and r["all_passed"] is False


def test_weighted_overall(spark):
    ms = spark.createDataFrame([("r", "a", 1, 0.85), ("r", "b", 1, 0.65)],
                               "run_id string, metric string, n long, mean double")
    w = S.weights_table(spark, {"a": 3.0, "b": 1.0})
    assert S.weighted_overall(ms, w).first()["weighted_score"] == pytest.approx(0.8)
    w2 = S.weights_table(spark, {"a": 2.0})
    assert S.weighted_overall(ms, w2).first()["weighted_score"] == pytest.approx(0.7833333, abs=1e-6)


def test_histogram_keeps_empty_bins(spark):
    sc = scores(spark, [("m", 0.05), ("m", 1.0), ("m", 0.95)])
    h = {r["bin"]: r["count"] for r in S.histogram(sc).collect()}
    assert len(h) == 10 and h[0] == 1 and h[9] == 2 and h[5] == 0


def test_regression_cases(spark):
    base = spark.createDataFrame([("faithfulness", 0.9), ("relevancy", 0.85)], "metric string, mean double")
    def check(cur_rows):
        cur = scores(spark, cur_rows)
        return {r["metric"]: r["passed"] for r in CMP.check_regression(cur, base, 0.05).collect()}
    assert check([("faithfulness", 0.80), ("relevancy", 0.85)])["faithfulness"] is False  # drop 0.10
    assert check([("faithfulness", 0.86), ("relevancy", 0.85)])["faithfulness"] is True   # drop 0.04
    assert check([("faithfulness", 0.95), ("relevancy", 0.90)]) == {"faithfulness": True, "relevancy": True}
    assert check([("faithfulness", 0.9)])["relevancy"] is False                           # missing
    reg = CMP.check_regression(scores(spark, [("faithfulness", 0.9)]), base, 0.05)
    assert CMP.regression_verdict(reg).first()["passed"] is False


def test_compare_union_of_metrics(spark):
    a = spark.createDataFrame([("x", 0.8), ("y", 0.7)], "metric string, mean double")
    b = spark.createDataFrame([("x", 0.9), ("y", 0.7), ("z", 0.5)], "metric string, mean double")
    rows = {r["metric"]: r for r in CMP.compare(a, b).collect()}
    assert set(rows) == {"x", "y", "z"}
    assert rows["z"]["score_a"] == 0.0 and rows["z"]["delta"] == pytest.approx(0.5)
    assert rows["x"]["direction"] == "up" and rows["y"]["direction"] == "same"
