import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import history, ranks, sequences

COLUMNS = "k string, yr int, level string, id long"


def flags(row):
    return [row[f] for f in history.FLAGS]


@pytest.fixture(scope="module")
def levels(spark):
    return spark.createDataFrame([("x", 2012, "High", 1), ("x", 2013, "Low", 2), ("x", 2015, "Low", 3)], COLUMNS)


@pytest.mark.parametrize("year,expected", [(2012, [0, 0, 0, 0]), (2014, [0, 1, 0, 0]), (2016, [0, 1, 1, 0])])
def test_asof_flags(spark, levels, year, expected):
    ask = spark.createDataFrame([("x", year), ("new", year), (None, year)], "k string, yr int")
    rows = history.persistence_features_asof(ask, levels, ["k"], "yr", "level", ["id"]).collect()
    assert len(rows) == 3
    assert {r.k: flags(r) for r in rows} == {"x": expected, "new": [0] * 4, None: [0] * 4}


def test_last_row_of_a_year_gives_its_level(spark):
    df = spark.createDataFrame([("x", 2012, "High", 1), ("x", 2012, "Low", 2)], COLUMNS)
    assert history.levels_per_period(df, ["k"], "yr", "level", ["id"]).first().level == "Low"


def test_row_flags_and_asof_flags_differ_on_purpose(spark):
    df = spark.createDataFrame([("x", 2012, "High", 1), ("x", 2012, "Low", 2)], COLUMNS)
    by_row = history.persistence_features(df, ["k"], "yr", "level", ["id"]).filter("id = 2").first()
    as_of = history.persistence_features_asof(df, df, ["k"], "yr", "level", ["id"]).filter("id = 2").first()
    assert flags(by_row) == [1, 0, 0, 0] and flags(as_of) == [0, 0, 0, 0]


def test_lags_across_blocks_of_a_hot_key(spark):
    random.seed(3)
    rows = [
        ("hot" if random.random() < 0.7 else random.choice(["a", None]), random.randint(2000, 2002), random.choice(["High", "Low", None]), i)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    found = {r.id: (r.lag1, r.lag2, r.lag3) for r in history.lag_levels(df, ["k"], "yr", "level", ["id"]).collect()}
    assert len(found) == len(rows)
    for key in ("hot", "a"):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3]))
        for i, r in enumerate(ordered):
            assert found[r[3]] == tuple(ordered[i - j][2] if i >= j else None for j in (1, 2, 3))
    assert all(found[r[3]] == (None, None, None) for r in rows if r[0] is None)


def test_lags_with_text_tie(spark):
    df = spark.createDataFrame([("x", 1, "High", "b"), ("x", 1, "Low", "a")], "k string, yr int, level string, t string")
    found = {r.t: r.lag1 for r in history.lag_levels(df, ["k"], "yr", "level", ["t"]).collect()}
    assert found == {"a": None, "b": "Low"}


def test_trend(spark):
    df = spark.createDataFrame(
        [("t", 1, 1.00), ("t", 2, 0.90), ("t", 3, 1.04), ("z", 1, 0.0), ("z", 2, 5.0), ("one", 1, 2.0)],
        "k string, yr int, v double",
    )
    rows = {r.k: r for r in history.trend_summary(df, ["k"], "yr", "v").collect()}
    t = rows["t"]
    assert t.trend == "increasing" and t.change_percent == pytest.approx(15.5556, abs=1e-4)
    assert (t.highest, t.highest_period, t.lowest, t.lowest_period) == (1.04, 3, 0.90, 2)
    assert rows["z"].trend == "stable" and rows["z"].change_percent is None
    assert rows["one"].trend == "stable" and rows["one"].previous is None


def test_history_overview_span_is_of_the_region(spark):
    df = spark.createDataFrame([("r", "a", 2012, 1.0), ("r", "a", 2012, 3.0), ("r", "b", 2015, 4.0)], "r string, c string, yr int, v double")
    found = history.history_overview(df, "r", "c", "yr", "v").filter("c = 'a'").first()
    assert (found.value, found.period_min, found.period_max) == (2.0, 2012, 2015)
    nested = history.nested_series(history.history(df, ["r"], "yr", {"v": "v"}), ["r"], "yr", "v").first()
    assert [(p.yr, p.v) for p in nested.points] == [(2012, 2.0), (2015, 4.0)]


def test_macro_ignores_missing_values(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, None)], "yr int, g double")
    macro = history.macro_by_period(df, "yr", ["g"])
    assert {r.yr: r.g for r in macro.collect()} == {1: 2.0, 2: None}
    asked = spark.createDataFrame([(1,), (3,)], "yr int")
    assert {r.yr: r.g for r in history.join_period_macro(asked, macro, "yr").collect()} == {1: 2.0, 3: None}


def test_sequences_follow_available_periods(spark):
    df = spark.createDataFrame([("x", 2012, 1.0), ("x", 2013, 0.0), ("x", 2015, 0.2), ("x", 2015, 0.0)], "k string, yr int, v double")
    two = {(r.step1, r.step2): (r["count"], r.support) for r in sequences.sequence_patterns(df, ["k"], "yr", "v", 0.5, 2).collect()}
    assert two == {("High", "Low"): (1, 0.5), ("Low", "Low"): (1, 0.5)}
    three = sequences.sequence_patterns(df, ["k"], "yr", "v", 0.5, 3).first()
    assert (three.step1, three.step2, three.step3, three.total) == ("High", "Low", "Low", 1)
    assert sequences.sequence_count(df, ["k"], "yr").first()[0] == 1


def test_lags_of_one_key_by_text_dates_and_times(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        at = datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=7 * i)
        rows.append(("k", 1, f"https://host/{i:05d}" if i else None, at, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), "ab"[rng.random() < 0.4]))
    df = spark.createDataFrame(rows, "g string, y int, text string, at timestamp, day date, label string").repartition(5)
    expected = [tuple(rows[i - k][5] if i >= k else None for k in (1, 2, 3)) for i in range(600)]
    for tie in ("text", "at", "day"):
        found = history.lag_levels(df, ["g"], "y", "label", [tie])
        got = sorted(found.collect(), key=lambda r: (r[tie] is not None, r[tie] or 0))
        assert [(r.lag1, r.lag2, r.lag3) for r in got] == expected, tie
        place = ranks.with_range(df.withColumn("p", ranks.ordinal(df, tie)), "p")
        sizes = [r["count"] for r in place.groupBy(ranks.RANGE).count().collect()]
        assert len(sizes) > 2 and max(sizes) < 400, tie


def test_a_period_is_one_point_of_a_nested_series(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 5.0), ("a", 2, 3.0), ("b", 1, None)], "k string, y int, v double")
    found = {r.k: [tuple(p) for p in r.points] for r in history.nested_series(df, ["k"], "y", "v").collect()}
    assert found == {"a": [(1, 5.0), (2, 2.0)], "b": [(1, None)]}
