import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill import session
from panelmill.operators import correlation, groups, ranks, summary

NAN = float("nan")


def test_profile_and_quality(spark):
    df = spark.createDataFrame([(1.0, "a", 2012), (2.0, None, 2012), (NAN, "a", 2013), (None, "b", None)], "v double, k string, yr int")
    clean = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    row = summary.numeric_profile(clean, ["v"]).first()
    assert (row["count"], row["mean"], row["median"], row["min"], row["max"]) == (2, 1.5, 1.5, 1.0, 2.0)
    assert row["std"] == pytest.approx(math.sqrt(0.5))
    missing = {r.column: r.missing for r in summary.missing_counts(df).collect()}
    assert missing == {"v": 2, "k": 1, "yr": 1}
    shares = {r.label: (r["count"], r.share) for r in summary.category_distribution(df, ["k"]).collect()}
    assert shares == {"a": (2, 0.5), "b": (1, 0.25), "(missing)": (1, 0.25)}
    assert [(r.yr, r["count"]) for r in summary.period_counts(df, "yr").collect()] == [(2012, 2), (2013, 1)]
    for approximate in (False, True):
        over = summary.dataset_overview(df, "yr", ["k"], approximate).first()
        assert (over.records, over.attributes, over.period_min, over.period_max, over.num_k) == (4, 3, 2012, 2013, 2)


def test_duplicates_count_copies_and_nulls(spark):
    df = spark.createDataFrame([(1, "x")] * 3 + [(2, None)] * 2 + [(3, "y")], "a int, b string")
    assert summary.duplicate_rows(df).first()[0] == 3
    assert summary.duplicate_rows(df.distinct()).first()[0] == 0


def test_correlation_of_constant_and_incomplete_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 1.0), (4.0, 5.0, 7.0)], "x double, y double, z double")
    found = {(r.feature, r.other): r.r for r in correlation.correlation_matrix(df).collect()}
    assert len(found) == 9
    assert found["x", "y"] is None and found["y", "y"] is None and found["x", "x"] == 1.0
    expected = df.filter("z is not null").select(F.corr("x", "z")).first()[0]
    assert found["x", "z"] == pytest.approx(expected) == found["z", "x"]
    bands = correlation.correlation_bands(correlation.correlation_matrix(df))
    assert bands.filter("feature = 'x' and other = 'x'").first().band == "very strong"


def test_correlation_constant_on_the_shared_rows(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.7, None)], "x double, y double")
    found = {(r.feature, r.other): r.r for r in correlation.correlation_matrix(df).collect()}
    assert found["x", "y"] is None


def test_mode_ties_and_shares(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "a"), (1, None), (2, None)], "g int, k string")
    found = {r.g: r.k for r in groups.dominant_value(df, ["g"], ["k"]).collect()}
    assert found == {1: "a", 2: None}
    shares = {r.g: r.percent for r in groups.group_share(df, ["g"]).collect()}
    assert shares[1] == pytest.approx(500 / 6)


def test_missing_keys_form_no_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "k string, v double")
    assert [(r.k, r.v) for r in groups.mean_by(df, ["k"], "v").collect()] == [("a", 2.0)]
    assert groups.distinct_groups(df, ["k"]).first()[0] == 1


def test_match_on_keys_keeps_the_first(spark):
    left = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, o int")
    right = spark.createDataFrame([(1,), (1,)], "k int")
    assert [(r.k, r.o) for r in groups.match_on_keys(left, right, ["k"], ["o"]).collect()] == [(1, 1)]


def test_running_totals_across_ranges(spark):
    rows = [("hot" if i % 3 else "cold", float(i * 7 % 101), i % 5 + 1) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, o double, n int")
    for cuts in (None, [], [10.0, 50.0, 51.0]):
        found = ranks.running_totals(df, "o", {"t": "n"}, ["g"], True, {"nx": "n"}, cuts=cuts).collect()
        assert len(found) == len(rows)
        for r in found:
            same = [(o, n) for g, o, n in rows if g == r.g]
            assert r.t == sum(n for o, n in same if o >= r.o)
            assert r.t_all == sum(n for _, n in same)
            below = [(o, n) for o, n in same if o < r.o]
            assert r.nx == (max(below)[1] if below else None)


def test_exact_median_of_many_values(spark):
    df = spark.range(20001).select(((F.col("id") * 7919) % 20011).cast("double").alias("v"))
    values = sorted(r.v for r in df.collect())
    for limits in ({}, {"ordered_rows": 500}, {"ordered_rows": 5}, {"ordered_rows": 0}):
        assert ranks.exact_quantiles(df, ["v"], **limits)["v"] == values[10000]
        assert ranks.exact_quantiles(df, ["v"], 0.9, **limits)["v"] == values[18000]


def test_exact_median_of_few_distinct_values(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("double").alias("v"), F.lit(None).cast("double").alias("e"))
    assert ranks.exact_quantiles(df, ["v", "e"], ordered_rows=10) == {"v": 1.0, "e": None}


def test_exact_median_of_a_sparse_column_beside_a_dense_one(spark):
    dense, sparse = F.col("id").cast("double"), F.when(F.col("id") % 100 == 0, (F.col("id") * 7 % 4001).cast("double"))
    df = spark.range(40000).select(dense.alias("d"), sparse.alias("s"))
    found = ranks.exact_quantiles(df, ["d", "s"], ordered_rows=50)
    values = sorted(i * 7 % 4001 for i in range(0, 40000, 100))
    assert found == {"d": 19999.5, "s": (values[199] + values[200]) / 2}


def test_exact_quantiles_of_odd_numbers(spark):
    rng = np.random.default_rng(1)
    columns = {
        "signed": rng.normal(0, 1e-300, 3001),
        "wide": np.exp(rng.normal(0, 200, 3001)) * rng.choice([-1, 1], 3001),
        "zeros": rng.choice([-0.0, 0.0], 3001),
        "ends": rng.choice([-np.inf, np.inf, 5e-324, 1.0], 3001),
        "equal": np.full(3001, 0.1),
        "sparse": np.where(rng.random(3001) < 0.01, rng.random(3001), np.nan),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns)).repartition(3)
    for q in (0.0, 0.25, 0.5, 1.0):
        for limit in (0, 100):
            found = ranks.exact_quantiles(df, list(columns), q, ordered_rows=limit)
            for c, x in columns.items():
                x = np.sort(x[~np.isnan(x)])
                place = (len(x) - 1) * q
                low, high = x[math.floor(place)], x[math.ceil(place)]
                assert found[c] == (low if low == high else low + (high - low) * (place - math.floor(place))), (c, q, limit)


def test_numeric_ties_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([(1, 10), (1, 9)], "g int, v int")
    assert groups.dominant_value(df, ["g"], ["v"]).first().v == 9


def test_scopes_delete_their_tables(spark):
    import os

    with session.scope() as own:
        kept = session.durable(spark.range(3))
        path = own.paths[0][1].removeprefix("file:")
        assert kept.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)
