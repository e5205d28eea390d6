"""The whole set-up on a small table with the columns of the crop data."""

import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import models
from panelmill.plans import crops, features


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(11)
    data = []
    for i in range(240):
        crop = random.choice(["Paddy", "Bean", "Maize"])
        acre = random.uniform(10, 500)
        harvested = acre * 0.9
        good = (crop == "Paddy") != (random.random() < 0.15)
        ton = harvested * (random.uniform(0.4, 0.9) if good else random.uniform(0.05, 0.3))
        year = 2012 + i % 12
        data.append(
            (
                random.choice(["Bago", "Shan"]), crop, random.choice(["Clay", "Sand"]), random.choice(["Rainy", "Summer"]),
                random.choice(["Irrigation", "Rainfed"]), year, acre, harvested, ton, 1e6 + year, random.uniform(21, 29),
                random.uniform(300, 9000), 5e10 + year, random.uniform(70, 93), ton / harvested,
            )
        )
    return spark.createDataFrame(data, crops.schema()).withColumn("id", F.monotonically_increasing_id())


def test_statistics_and_limits(rows):
    found = crops.statistics(rows.drop("id"))
    assert found["overview"].first().attributes == 15
    assert found["numeric"].count() == 10
    from panelmill.operators.prepare import check_constraints

    assert all(r.violations == 0 for r in check_constraints(rows, crops.limits()).collect())


def test_mining_reports(rows):
    found = crops.mining(rows.drop("id"))
    assert found["correlation"].count() == 100
    assert found["yield_level_rules"].count() > 0
    sizes = {r["size"]: (r.candidates, r.frequent) for r in found["yield_level_totals"].collect()}
    assert set(sizes) == {1, 2, 3} and all(c >= f for c, f in sizes.values())
    assert found["sequence_count"].first()[0] == 6


def test_trends_and_macro(spark, rows):
    assert crops.trends(rows).count() == rows.select(*crops.GROUP, "Year").distinct().count()
    ask = spark.createDataFrame([(2015, None), (2015, 1.0), (1990, None)], f"Year int, `{crops.GDP}` double")
    found = sorted(((r.Year, r[crops.GDP], r[crops.FERTILIZER]) for r in crops.with_macro(ask, rows).collect()), key=str)
    assert found == [(1990, None, None), (2015, 1.0, 1e6 + 2015), (2015, 5e10 + 2015, 1e6 + 2015)]


def test_advanced_level_model(rows):
    labelled = crops.with_level(rows)
    spec = crops.yield_features(["id"], ["id"])
    assert len(spec.features_of("engineered")) == 12 and len(spec.features_of("advanced")) == 21
    made = features.build_features(labelled, spec, "advanced", crops.yield_rules(labelled))
    assert made.count() == 240
    categories, numbers = spec.categories_of("advanced"), spec.numbers_of("advanced")
    pipeline = models.forest_classifier(categories, numbers, crops.LEVEL, ["High", "Low"], 5, 5)
    model = pipeline.fit(made.filter("Year <= 2022"))
    right = model.transform(made.filter("Year = 2023")).filter(F.col("prediction") == F.col(crops.LEVEL)).count()
    assert right >= 12
    crop = crops.crop_features(["id"], ["id"])
    assert crop.features_of("baseline") == [*crop.categories, *crop.numbers]
    assert "Log_Sown_Acre" in crop.features_of("engineered") and "Sown_Acre" not in crop.features_of("engineered")


def test_clustering(rows):
    found = crops.clustering(rows, ["id"], 3, 1, (2, 3))
    assert found["profiles"].count() == 3
    assert sum(r["count"] for r in found["distribution"].collect()) == 240
    assert 0 < found["hopkins"].first().hopkins < 1
    assert found["evaluation_quality"].count() == 3
