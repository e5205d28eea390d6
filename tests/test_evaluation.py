import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import curves, folds, metrics


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")


def test_curve_and_area_with_ties(scored):
    for drop in (True, False):
        points = [(r.threshold, r.fpr, r.tpr) for r in curves.roc_curve(scored, "y", "s", (), drop).collect()]
        assert sorted(points, key=lambda p: (p[1], p[2])) == [(None, 0, 0), (0.9, 0, 0.5), (0.8, 0.5, 1), (0.1, 1, 1)]
    found = curves.auc(scored, "y", "s").first()
    assert (found.auc, found.support) == (0.875, 2)


def test_straight_parts_are_dropped(spark):
    df = spark.createDataFrame([(float(s), int(s > 5)) for s in range(10)], "s double, y int")
    points = curves.roc_curve(df, "y", "s").collect()
    assert sorted((r.fpr, r.tpr) for r in points) == [(0, 0), (0, 0.25), (0, 1), (1, 1)]


def test_one_kind_of_label_has_no_curve(spark):
    df = spark.createDataFrame([("a", 0.5, 0), ("a", 0.6, 0), ("b", 0.1, 0), ("b", 0.9, 1)], "g string, s double, y int")
    assert {r.g for r in curves.roc_curve(df, "y", "s", ["g"]).collect()} == {"b"}
    assert {r.g: r.auc for r in curves.auc(df, "y", "s", ["g"]).collect()} == {"a": None, "b": 1.0}


def test_area_equals_the_share_of_ordered_pairs(spark):
    random.seed(5)
    rows = [(round(random.random(), 2), int(random.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    expected = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert curves.auc(df, "y", "s").first().auc == pytest.approx(expected)


def test_one_vs_rest_gives_unknown_classes_zero(spark):
    df = spark.createDataFrame([("a", [0.9, 0.1]), ("b", [0.2, 0.8]), ("c", [0.6, 0.4])], "y string, p array<double>")
    long = curves.ovr_scores(df, "y", "p", ["a", "b"], ["a", "b", "c"])
    assert long.count() == 9
    assert {r["class"]: r.auc for r in curves.ovr_auc(long).collect()} == {"a": 1.0, "b": 1.0, "c": 0.5}


def test_downsample_keeps_the_ends(spark):
    rows = [(None, 0.0, 0.0)] + [(float(100 - i), i / 50, i / 50) for i in range(1, 51)]
    curve = spark.createDataFrame(rows, "threshold double, fpr double, tpr double")
    points = sorted(r.point for r in curves.curve_downsample(curve).collect())
    assert points[0] == 0 and points[-1] == 50 and len(points) == 25
    assert curves.curve_downsample(curve.filter("threshold is null or threshold > 80")).count() == 20


def test_means_of_areas(spark):
    df = spark.createDataFrame([("a", 0.9, 30), ("b", 0.6, 10), ("c", None, 0)], "class string, auc double, support int")
    found = curves.macro_weighted_auc(df).first()
    assert (found.macro_auc, found.weighted_auc) == (pytest.approx(0.75), pytest.approx(0.825))


def test_comparison_and_verification(spark):
    kind = "class string, auc double, support int"
    a = spark.createDataFrame([("x", 0.9, 10), ("y", 0.5, 10), ("z", 0.7, 20)], kind)
    b = spark.createDataFrame([("x", 0.8, 10), ("y", 0.5, 10)], kind)
    rows = {r["class"]: (r.b_auc, r.better) for r in curves.compare_class_auc(a, b).collect()}
    assert rows == {"x": (0.8, "a"), "y": (0.5, None), "z": (None, "a")}
    checked = curves.verify_auc(b, a).first()
    assert checked.max_abs_diff == pytest.approx(0.1) and checked.mean_abs_diff == pytest.approx(0.05)
    assert checked.stored_macro == pytest.approx(0.7) and checked.stored_weighted == pytest.approx(0.7)


def test_weighted_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    m = metrics.classification_metrics(df, "y", "p").first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == tuple(pytest.approx(x, abs=1e-4) for x in (0.6667, 0.8333, 0.6667, 0.6667))
    dense = {(r.label, r.prediction): r["count"] for r in metrics.confusion_matrix(df, "y", "p", True).collect()}
    assert dense == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 1}
    none = metrics.binary_metrics(df, "y", "p", "q").first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")
    m = metrics.regression_metrics(df, "y", "p").first()
    assert (m.r2, m.rmse, m.mae, m.n) == (pytest.approx(0.5), pytest.approx(0.57735, abs=1e-5), pytest.approx(1 / 3), 3)
    flat = df.withColumn("y", F.lit(2.0))
    assert metrics.regression_metrics(flat, "y", "p").first().r2 == 0.0
    assert metrics.regression_metrics(flat, "y", "y").first().r2 == 1.0


def test_metric_tables(spark):
    rows = [("a", "r2", 0.9), ("b", "r2", 0.9), ("a", "rmse", 2.0), ("b", "rmse", 1.0), ("c", "rmse", None)]
    df = spark.createDataFrame(rows, "variant string, metric string, value double")
    assert metrics.best_variant(df, ["a", "b", "c"], "r2").first()[0] == "a"
    assert {r.metric: r.best for r in metrics.best_per_metric(df).collect()} == {"r2": 0.9, "rmse": 1.0}
    wide = {r.metric: (r.a, r.b) for r in metrics.compare_variants(df, ["a", "b"]).collect()}
    assert wide == {"r2": (0.9, 0.9), "rmse": (2.0, 1.0)}
    expected = spark.createDataFrame([("r2", 0.9), ("mae", 1.0)], "metric string, value double")
    actual = spark.createDataFrame([("r2", 0.9005)], "metric string, value double")
    diffs = metrics.metric_diff(expected, actual)
    assert {r.metric: r.within for r in diffs.collect()} == {"r2": True, "mae": None}
    assert metrics.metrics_pass(diffs).first()[0] is True
    assert metrics.metrics_pass(diffs.filter("metric = 'mae'")).first()[0] is False
    points = metrics.actual_vs_predicted(actual, "value", "value", ["metric"]).first()
    assert points.actual == points.predicted == 0.9005


def test_fold_sizes(spark):
    df = spark.createDataFrame([(i, "High" if i < 11 else "Low") for i in range(18)], "id int, y string")
    dealt = folds.stratified_folds(df, "y", ["id"], 5)
    assert dealt.count() == 18
    for label, total in (("High", 11), ("Low", 7)):
        sizes = [r["count"] for r in dealt.filter(F.col("y") == label).groupBy("fold").count().collect()]
        assert sum(sizes) == total and len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = folds.stratified_folds(df.repartition(3), "y", ["id"], 5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, dealt.collect()))
