"""Quality of predictions: confusion, classification, regression and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.functions.labels import HIGH
from panelmill.functions.params import one_row

LOWER_IS_BETTER = ("rmse", "mae")
TOLERANCE = 1e-3


def confusion_matrix(df: DataFrame, label: str, prediction: str, dense: bool = False) -> DataFrame:
    """Rows per (label, prediction); ``dense`` adds the empty cells of all labels of both sides."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("count")
    )
    if not dense:
        return counts
    names = counts.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()
    every = one_row(names.agg(F.collect_list("label").alias("names")))["names"]
    cells = names.withColumn("prediction", F.explode(every))
    filled = cells.join(counts, ["label", "prediction"], "left")
    return filled.withColumn("count", F.coalesce("count", F.lit(0)))


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Support, precision, recall and F1 per class; a zero denominator gives 0."""
    cells = confusion_matrix(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("count").alias("predicted"), zero.alias("tp")),
    )
    sums = cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    return sums.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
            "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row."""
    scores = class_scores(df, label, prediction)

    def weighted(name: str) -> Column:
        return F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(name)

    return scores.agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
        F.sum("support").alias("n"),
    )


def binary_metrics(
    df: DataFrame, label: str, prediction: str, positive: str = HIGH, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, per group of ``by``."""
    truth, guess = F.col(label) == positive, F.col(prediction) == positive
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == F.col(prediction)).alias("right"),
        F.count_if(truth & guess).alias("tp"),
        F.count_if(truth).alias("actual"),
        F.count_if(guess).alias("predicted"),
    )
    return counts.select(
        *by,
        _ratio(F.col("right"), F.col("n")).alias("accuracy"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("actual")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual")).alias("f1"),
        "n",
    )


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE, MAE and row count in one pass.

    R2 compares the squared error with the spread around the mean of the
    labels. A constant label scores 1 when it is met exactly, else 0.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = df.select(*by, y.alias("y"), p.alias("p")).filter("y is not null and p is not null")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("sse"),
        F.sum(F.abs(F.col("y") - F.col("p"))).alias("sae"),
        F.var_pop("y").alias("spread"),
        (F.min("y") == F.max("y")).alias("constant"),
    )
    constant = F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    r2 = 1.0 - F.try_divide(F.col("sse"), F.col("spread") * F.col("n"))
    return sums.select(
        *by,
        F.when(F.col("constant"), constant).otherwise(r2).alias("r2"),
        F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"),
        F.try_divide(F.col("sae"), F.col("n")).alias("mae"),
        "n",
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def metric_rows(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Metrics as rows (metric, value)."""
    values = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return values.unpivot(list(keys), list(names), "metric", "value")


def metric_diff(expected: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Actual minus expected for each expected metric; a metric not reproduced has no difference."""
    joined = expected.withColumnRenamed("value", "expected").join(
        actual.withColumnRenamed("value", "actual"), "metric", "left"
    )
    diff = F.col("actual") - F.col("expected")
    return joined.withColumns({"diff": diff, "within": F.abs(diff) <= tolerance})


def metrics_pass(diffs: DataFrame) -> DataFrame:
    """True when there are shared metrics and all of them are within the tolerance."""
    return diffs.agg(F.coalesce(F.bool_and("within"), F.lit(False)).alias("pass"))


def compare_variants(metrics: DataFrame, variants: Sequence[str]) -> DataFrame:
    """One row per metric, one column per variant."""
    return metrics.groupBy("metric").pivot("variant", list(variants)).agg(F.first("value"))


def best_variant(metrics: DataFrame, variants: Sequence[str], key: str) -> DataFrame:
    """The variant with the largest ``key`` metric; the earlier in the list wins ties."""
    position = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("variant"))
    known = metrics.filter((F.col("metric") == key) & F.col("value").isNotNull() & (position > 0))
    return known.agg(F.max_by("variant", F.struct("value", -position)).alias("best_variant"))


def best_per_metric(metrics: DataFrame, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """Best value per metric: the smallest for errors, the largest otherwise."""
    lower = F.lower("metric").isin(list(lower_is_better))
    return metrics.groupBy("metric").agg(
        F.when(F.first(lower), F.min("value")).otherwise(F.max("value")).alias("best")
    )


def actual_vs_predicted(
    df: DataFrame, label: str, prediction: str, keys: Sequence[str], digits: int = 6
) -> DataFrame:
    """The points of an actual against predicted chart."""
    return df.select(
        F.bround(F.col(label).cast("double"), digits).alias("actual"),
        F.bround(F.col(prediction).cast("double"), digits).alias("predicted"),
        *keys,
    )
