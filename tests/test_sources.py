import pytest
from pyspark.sql import functions as F

from panelmill.operators import curves
from panelmill.plans import reports
from panelmill.sources import observations, reports as files


def test_csv_observations(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_text(",Unnamed: 1,Region,Year,Value(USD)\n0,7,Bago,2012,1.5\n1,7,Shan,2013,NaN\n2,7,,2014,\n")
    schema = observations.observation_schema(
        ["Region"], "Year", ["Value(USD)"], ["_c0", "Unnamed: 1", "Region", "Year", "Value(USD)"]
    )
    df = observations.read_observations(spark, str(path), schema)
    assert df.columns == ["Region", "Year", "Value(USD)"]
    assert [tuple(r) for r in df.collect()] == [("Bago", 2012, 1.5), ("Shan", 2013, None), (None, 2014, None)]
    df.write.parquet(str(tmp_path / "table"))
    wanted = observations.observation_schema(["Region"], "Year", [])
    again = observations.read_observations(spark, str(tmp_path / "table"), wanted)
    assert again.columns == ["Region", "Year"] and again.count() == 3


def test_metric_tables(spark, tmp_path):
    path = tmp_path / "auc.csv"
    path.write_text("Crop_Type,AUC,Test Support\nPaddy,0.97,30\n")
    row = files.read_metric_table(spark, str(path), files.CLASS_AUC_SCHEMA).first()
    assert (row.crop_type, row.auc, row.test_support) == ("Paddy", 0.97, 30)
    assert files.plain_name("Weighted F1-score") == "weighted_f1_score"


def test_exports(spark, tmp_path):
    kind = "class string, auc double, support int"
    a = spark.createDataFrame([("x", 0.9, 10), ("z", 0.7, 20)], kind)
    b = spark.createDataFrame([("x", 0.8, 10)], kind)
    files.write_auc_comparison(curves.compare_class_auc(a, b), str(tmp_path / "cmp"))
    back = spark.read.csv(str(tmp_path / "cmp"), header=True)
    rows = {r["class"]: (r.a_auc, r.b_auc) for r in back.collect()}
    assert rows == {"x": ("0.900000", "0.800000"), "z": ("0.700000", None)}
    files.write_report({"first": a, "second": b}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/first")).count() == 2


def test_a_failed_section_leaves_the_old_report(spark, tmp_path):
    path, kind = str(tmp_path / "report"), "name string, n int"
    frame = lambda n: spark.createDataFrame([("a", n)], kind)
    with pytest.raises(LookupError):
        files.read_section(spark, path, "first", kind)
    first = files.commit_report({"first": frame(1), "second": frame(1)}, path)
    bad = frame(2).withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        files.commit_report({"first": frame(2), "second": bad}, path)
    assert [files.read_section(spark, path, s, kind).first().n for s in ("first", "second")] == [1, 1]
    assert files.commit_report({"first": frame(3)}, path) != first
    assert files.read_section(spark, path, "first", kind).first().n == 3
    with pytest.raises(LookupError):
        files.read_section(spark, path, "second", kind)


def test_reports_have_all_sections(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], 2012 + i % 4, float(i % 7), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, r string, k string, yr int, v double, w double")
    stats = reports.data_statistics(df, "yr", ["r", "k"])
    assert stats["overview"].first().records == 60 and stats["duplicates"].first()[0] == 0
    labelled = df.withColumn("level", F.when(F.col("v") > 3, "High").otherwise("Low"))
    target = dict(columns=["r", "k", "level"], target="level", min_support=0.05, min_confidence=0.5, min_lift=1.0)
    mining = reports.descriptive_mining(labelled, {"level": target}, ["r"], "yr", "v", 3.0)
    assert all(frame.count() >= 0 for frame in mining.values())
    assert {"correlation", "level_rules", "level_itemsets", "level_totals", "sequences_2", "sequences_3", "sequence_count"} == set(mining)
    found = reports.clustering(df, ["id"], ["v", "w"], ["v"], ["w"], ["v", "w"], ["r", "k"], k=2, n_init=1, ks=(2, 3))
    assert found["profiles"].count() == 2 and found["optimal_k"].count() == 2 and found["overall"].count() == 1
    scores = spark.createDataFrame([("a", 0.9, 1), ("a", 0.2, 0), ("b", 0.3, 1), ("b", 0.4, 0)], "class string, score double, is_class int")
    stored = spark.createDataFrame([("a", 0.9, 1), ("b", 0.2, 1)], "class string, auc double, support int")
    roc = reports.roc_report(scores, stored)
    assert roc["means"].first().macro_auc == 0.5 and roc["verification"].first().max_abs_diff > 0.09
    assert reports.roc_summary({"one": scores, "two": scores}).count() == 2
