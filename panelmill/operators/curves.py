"""ROC curves and areas for one score, or for one score per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.operators.ranks import running_totals, split_points


def _scored(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())


def _cumulated(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives at and above every distinct score; rows without a score are left out.

    The ranges are cut on the raw scores, one scan of one column, so the
    grouping by score runs once.
    """
    scored = _scored(df, label, score)
    counts = scored.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(F.lit(1) - F.col(label).cast("long")).alias("neg"),
    )
    return running_totals(
        counts,
        score,
        {"tp": "pos", "fp": "neg"},
        by,
        descending=True,
        following={"next_pos": "pos", "next_neg": "neg"},
        cuts=split_points(scored, score),
    )


def roc_curve(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), drop_intermediate: bool = True
) -> DataFrame:
    """Points (threshold, fpr, tpr) of the curve of a 0/1 label, per group of ``by``.

    A curve starts at (0, 0) with a NULL threshold and has one point per
    distinct score; ``drop_intermediate`` leaves out points on a straight line
    between their neighbours. A group with one kind of label has no curve.
    """
    points = _cumulated(df, label, score, by).filter((F.col("tp_all") > 0) & (F.col("fp_all") > 0))
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        points = points.filter(first | turns | F.col("next_pos").isNull())
    curve = points.select(
        *by,
        F.col(score).cast("double").alias("threshold"),
        (F.col("fp") / F.col("fp_all")).alias("fpr"),
        (F.col("tp") / F.col("tp_all")).alias("tpr"),
    )
    both = _scored(df, label, score).groupBy(*by).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    start = both.filter(F.col("lo") < F.col("hi")).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(curve)


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by trapezoids, ties count half; NULL for one kind of label.

    The step of one score adds its negatives times the mean of the true
    positives before and after it.
    """
    step = F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))
    return (
        _cumulated(df, label, score, by)
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum(step), F.max("tp_all").cast("double") * F.max("fp_all")).alias("auc"),
            F.max("tp_all").alias("support"),
        )
    )


def ovr_scores(
    df: DataFrame, label: str, probabilities: str, model_classes: Sequence[str], classes: Sequence[str]
) -> DataFrame:
    """One row per row and class: its score and whether the row is of the class.

    ``probabilities`` is an array in the order of ``model_classes``; a class
    unknown to the model scores 0.
    """
    index = {name: i for i, name in enumerate(model_classes)}
    scores = [
        F.struct(
            F.lit(name).alias("class"),
            (F.col(probabilities)[index[name]] if name in index else F.lit(0.0)).cast("double").alias("score"),
            (F.col(label) == name).cast("int").alias("is_class"),
        )
        for name in classes
    ]
    return df.select(F.inline(F.array(*scores)))


def ovr_roc(scores: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    return roc_curve(scores, "is_class", "score", ["class"], drop_intermediate)


def ovr_auc(scores: DataFrame) -> DataFrame:
    return auc(scores, "is_class", "score", ["class"])


def curve_downsample(curve: DataFrame, by: Sequence[str] = (), target: int = 25) -> DataFrame:
    """At most ``target`` evenly spaced points per curve, its ends included.

    Point i of n is kept when i = floor(k (n - 1) / (target - 1)) for some k.
    """
    start = curve.filter(F.col("threshold").isNull()).withColumn("point", F.lit(0).cast("long"))
    later = curve.filter(F.col("threshold").isNotNull()).withColumn("__one", F.lit(1))
    numbered = running_totals(later, "threshold", {"point": "__one"}, by, descending=True)
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(target - 1)),
        lambda k: F.floor(k * F.col("point_all") / F.lit(target - 1)),
    )
    # point_all is n - 1: the start is not counted.
    kept = numbered.filter((F.col("point_all") < target) | F.array_contains(picks, F.col("point")))
    columns = [*by, "point", "threshold", "fpr", "tpr"]
    return start.select(*columns).unionByName(kept.select(*columns))


def macro_weighted_auc(class_auc: DataFrame, auc_column: str = "auc", support: str = "support") -> DataFrame:
    """Plain mean and support-weighted mean of the areas of the classes that have one."""
    known = class_auc.filter(F.col(auc_column).isNotNull())
    return known.agg(
        F.avg(auc_column).alias("macro_auc"),
        F.try_divide(F.sum(F.col(auc_column) * F.col(support)), F.sum(support)).alias("weighted_auc"),
    )


def compare_class_auc(first: DataFrame, second: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Areas of two variants side by side over the classes of the first; the better one, if any."""
    left = first.select("class", F.col("auc").alias(f"{a}_auc"), "support")
    right = second.select("class", F.col("auc").alias(f"{b}_auc"))
    joined = left.join(right, "class", "left")
    return joined.withColumn("better", better(F.col(f"{a}_auc"), F.col(f"{b}_auc"), a, b))


def better(left: Column, right: Column, a: str, b: str) -> Column:
    """Name of the larger value; a missing value loses, equal values have no winner."""
    return (
        F.when(left.isNull() & right.isNull(), F.lit(None).cast("string"))
        .when(left.isNull() | (left < right), F.lit(b))
        .when(right.isNull() | (left > right), F.lit(a))
    )


def verify_auc(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """Differences over the classes both sides know, with support.

    The stored weighted value covers all stored classes; the other means
    cover the common ones.
    """
    new = recomputed.filter(F.col("auc").isNotNull()).select("class", F.col("auc").alias("new"))
    joined = stored.join(new, "class", "left")
    common = F.col("new").isNotNull() & (F.col("support") > 0)
    gap = F.when(common, F.abs(F.col("new") - F.col("auc")))
    weight = F.when(common, F.col("support"))
    return joined.agg(
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
        F.avg(F.when(common, F.col("auc"))).alias("stored_macro"),
        F.avg(F.when(common, F.col("new"))).alias("recomputed_macro"),
        F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("stored_weighted"),
        F.try_divide(F.sum(F.col("new") * weight), F.sum(weight)).alias("recomputed_weighted"),
    )
