"""Reproducible stratified folds."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import DataFrame, functions as F

from panelmill.functions.hashing import seeded_hash
from panelmill.operators.ranks import RANGE, range_count, running_totals


def stratified_folds(
    df: DataFrame, label: str, keys: Sequence[str], k: int, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Fold number 0..k-1 per row; within a class fold sizes differ by at most one.

    Rows are dealt out in the order of a seeded hash of their unique key. The
    leading digits of the hash are the ranges of a running count, so a class
    with half of all rows is still spread over many tasks.
    """
    digits = max(1, ceil(log(range_count(df, df.count()), 16)))
    dealt = df.withColumn("__order", seeded_hash(keys, seed))
    dealt = dealt.withColumns(
        {
            RANGE: F.conv(F.substring("__order", 1, digits), 16, 10).cast("int"),
            "__one": F.lit(1),
            "__class": F.coalesce(F.col(label).cast("string"), F.lit("")),
        }
    )
    ranked = running_totals(dealt, "__order", {"__rank": "__one"}, ["__class"], range_column=RANGE)
    fold = ((F.col("__rank") - 1) % k).cast("int")
    return ranked.withColumn(out, fold).select(*df.columns, out)
