"""Runs of consecutive levels along the periods of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelmill.functions.labels import level
from panelmill.functions.params import one_row
from panelmill.operators.groups import distinct_groups, mean_by


def ngrams(df: DataFrame, keys: Sequence[str], period: str, label: str, n: int) -> DataFrame:
    """``n`` consecutive labels per key as ``step1..stepn``.

    ``df`` holds one row per key and period, so a group is no longer than the
    number of periods. Consecutive means the next period that exists.
    """
    order = Window.partitionBy(*keys).orderBy(period)
    steps = {"step1": F.col(label)} | {
        f"step{i + 1}": F.lead(label, i).over(order) for i in range(1, n)
    }
    full = df.withColumns(steps | {"__end": F.lead(F.lit(1), n - 1).over(order)})
    return full.filter(F.col("__end").isNotNull()).select(*keys, period, *steps)


def sequence_patterns(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    value: str,
    threshold,
    n: int,
    min_support: float = 0.10,
) -> DataFrame:
    """Patterns of ``n`` levels with count, support among all n-grams and their total.

    Values are averaged per key and period before they are labelled.
    """
    cells = mean_by(df, [*keys, period], value)
    labelled = cells.withColumn("__level", level(F.col(value), threshold))
    steps = [f"step{i}" for i in range(1, n + 1)]
    patterns = ngrams(labelled, keys, period, "__level", n).groupBy(*steps).agg(F.count("*").alias("count"))
    total = one_row(patterns.agg(F.sum("count").alias("n")))["n"]
    supported = patterns.withColumn("total", total).withColumn(
        "support", F.col("count").cast("double") / F.col("total")
    )
    return supported.filter(F.bround("support", 4) >= min_support)


def sequence_count(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Number of keys that have at least one complete period."""
    return distinct_groups(df.filter(F.col(period).isNotNull()), keys, "sequences")
