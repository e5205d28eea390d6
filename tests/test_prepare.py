import pytest
from pyspark.sql import functions as F

from panelmill.functions import items, numeric
from panelmill.functions.labels import level, level_flag, trend_class
from panelmill.operators import prepare, scaling
from panelmill.operators.ranks import exact_quantiles

NAN = float("nan")


def test_level_of_missing_values_is_low(spark):
    df = spark.createDataFrame([(0.4,), (0.332187,), (0.1,), (None,), (NAN,)], "v double")
    found = [r.level for r in prepare.label_threshold(df, "v", 0.332187).collect()]
    assert found == ["High", "Low", "Low", "Low", "Low"]
    flags = df.select(level_flag(level(F.col("v"), 0.332187)).alias("f")).collect()
    assert [r.f for r in flags] == [1, 0, 0, 0, 0]


def test_median_is_exact_and_interpolated(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"]) == {"a": 2.5, "b": None}
    assert exact_quantiles(df, ["a"], 0.25) == {"a": 1.75}


def test_median_of_train_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 100.0), (2, 2.0)], "p int, v double")
    found = prepare.label_by_train_median(df, "v", F.col("p") <= 1).orderBy("v").collect()
    assert [(r.threshold, r.level) for r in found] == [(2.0, "Low"), (2.0, "Low"), (2.0, "High"), (2.0, "High")]


def test_names_features_and_filters(spark):
    df = spark.createDataFrame([(" Mandalay ", 1.0, 3)], "regionName string, sownAcre double, keep int")
    named = prepare.normalize_columns(df)
    assert named.columns == ["region_name", "sown_acre", "keep"]
    assert prepare.normalize_columns(df, {"sownAcre": "area", "absent": "x"}).columns == ["regionName", "area", "keep"]
    picked = prepare.select_features(named, {"absent": "string", "sown_acre": "float"}).first()
    assert picked.absent is None and picked.sown_acre == 1.0
    assert prepare.filter_trimmed_equal(named, {"region_name": "Mandalay"}).count() == 1
    assert prepare.drop_columns(named, ["keep", "absent"]).columns == ["region_name", "sown_acre"]


def test_interactions_and_logs(spark):
    df = spark.createDataFrame([("Paddy", None, -5.0), ("Bean", "Clay", None)], "c string, s string, v double")
    made = prepare.log1p_clipped(prepare.add_interactions(df, {"cs": ("c", "s")}), {"l": "v"})
    rows = made.collect()
    assert [(r.cs, r.l) for r in rows] == [("Paddy | nan", 0.0), ("Bean | Clay", None)]


def test_constraints_and_vocabulary(spark):
    df = spark.createDataFrame([(2012, "A"), (2040, "B"), (None, "Z")], "yr int, k string")
    limits = {"yr": prepare.range_rule("yr", 2010, 2030), "k": prepare.vocabulary_rule("k", ["A", "B"])}
    counted = {r.rule: r.violations for r in prepare.check_constraints(df, limits).collect()}
    assert counted == {"yr": 2, "k": 1}
    flags = [r.violations for r in prepare.flag_violations(df, limits).collect()]
    assert flags == [[], ["yr"], ["yr", "k"]]
    words = spark.createDataFrame([("A",), ("B",)], "k string")
    assert [r.k for r in prepare.unknown_values(df, "k", words).collect()] == ["Z"]


def test_override_and_outside(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, None)], "p int, v double")
    macro = spark.createDataFrame([(1, 9.0)], "p int, v double")
    filled = sorted(prepare.override_else_lookup(df, macro, "p", ["v"]).collect(), key=str)
    assert [(r.p, r.v) for r in filled] == [(1, 5.0), (1, 9.0), (2, None)]
    probe = spark.createDataFrame([(0.0,), (6.0,), (10.0,)], "v double")
    base = spark.createDataFrame([(1.0,), (9.0,)], "v double")
    assert [r.v_outside for r in prepare.flag_outside_typical(probe, base, ["v"]).collect()] == [True, False, True]


def test_items_and_rounding(spark):
    df = spark.createDataFrame([("Soil_Type=a=b",), ("plain",)], "i string")
    rows = df.select(items.item_label(F.col("i")).alias("l"), items.item_value(F.col("i")).alias("v")).collect()
    assert [(r.l, r.v) for r in rows] == [("Soil Type: a=b", "a=b"), ("plain", None)]
    parted = spark.createDataFrame([("b||a",), (None,)], "t string").select(items.parted(F.col("t")).alias("p"))
    assert [r.p for r in parted.collect()] == [["a", "b"], []]
    n = spark.createDataFrame([(0.125,), (NAN,), (float("inf"),)], "v double")
    got = n.select(numeric.rounded(F.col("v"), 2).alias("r"), numeric.finite_or_null(F.col("v")).alias("f")).collect()
    assert [g.r for g in got][:2] == [0.12, None] and [g.f for g in got] == [0.125, None, None]
    s = spark.createDataFrame([(-0.01,), (0.0,), (0.35,), (0.5,)], "v double")
    assert [r[0] for r in s.select(numeric.separation_band(F.col("v"))).collect()] == ["Poor", "Weak", "Fair", "Strong"]


@pytest.mark.parametrize("first,last,n,expected", [(1.0, 1.04, 3, "increasing"), (0.0, 5.0, 2, "stable"), (1.0, 0.9, 1, "stable"), (1.0, 0.9, 2, "decreasing")])
def test_trend_class(spark, first, last, n, expected):
    df = spark.createDataFrame([(first, last, n)], "a double, b double, n int")
    assert df.select(trend_class(F.col("a"), F.col("b"), F.col("n"))).first()[0] == expected


def test_scaling_and_imputation(spark):
    df = spark.createDataFrame([(7.0, 1.0), (7.0, 3.0), (7.0, None)], "c double, v double")
    scaled = scaling.min_max_scale(df, ["c", "v"]).collect()
    assert [(r.c, r.v) for r in scaled] == [(0.0, 0.0), (0.0, 1.0), (0.0, None)]
    standard = scaling.standard_scale(df, ["c", "v"]).collect()
    assert [(r.c, r.v) for r in standard] == [(0.0, -1.0), (0.0, 1.0), (0.0, None)]
    assert [r.v for r in scaling.impute_median(df, ["v"]).collect()] == [1.0, 3.0, 2.0]
    words = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert [r.k for r in scaling.impute_most_frequent(words, ["k"]).collect()] == ["b", "a", "a"]


def test_one_hot_has_no_slot_for_unknown_values(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([("a",), ("b",)], "k string")
    probe = spark.createDataFrame([("a",), ("b",), ("q",), (None,)], "k string")
    model = Pipeline(stages=scaling.one_hot_stages(["k"])).fit(train)
    rows = model.transform(probe).select(vector_to_array("k_hot").alias("v")).collect()
    assert [r.v for r in rows] == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]
