"""Grouped means, modes, shares, levels and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelmill.functions.params import fitted, one_row


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with all keys present: missing keys form no group."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def mean_by(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Average of the duplicates of a key."""
    return with_keys(df, keys).groupBy(*keys).agg(F.avg(value).alias(out or value))


def distinct_groups(df: DataFrame, keys: Sequence[str], out: str = "groups") -> DataFrame:
    """Number of distinct complete keys, as a one-row frame."""
    return with_keys(df, keys).select(*keys).distinct().agg(F.count("*").alias(out))


def first_row_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in an explicit order."""
    return top_k_per_group(df, keys, order, 1).drop("rank")


def match_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``, the first one per key."""
    matched = left.join(right.select(*keys).distinct(), list(keys), "left_semi")
    return first_row_by(matched, keys, order)


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group; Spark drops later rows before the shuffle."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) <= k)


def group_share(
    df: DataFrame, keys: Sequence[str], count: str = "count", percent: str = "percent"
) -> DataFrame:
    """Rows per group and their percentage of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(count))
    total = one_row(counts.agg(F.sum(count).alias("n")))["n"]
    return counts.withColumn(percent, F.try_divide(F.col(count).cast("double"), total) * 100.0)


def dominant_value(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column per group; ties go to the smallest, NULL is ignored.

    Values are counted as rows of their own, so a column of high cardinality
    never sits in the memory of one aggregation buffer. Values keep their type,
    so numbers are compared as numbers.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
    own = [
        F.struct(F.lit(i).alias("column"), *[(F.col(c) if j == i else F.lit(None).cast(kinds[d])).alias(f"v{j}") for j, d in enumerate(columns)])
        for i, c in enumerate(columns)
    ]
    long = df.select(*keys, F.inline(F.array(*own)))
    values = [f"v{i}" for i in range(len(columns))]
    counts = long.groupBy(*keys, "column", *values).count()
    found = []
    for i, c in enumerate(columns):
        rank = F.struct((-F.col("count")).alias("n"), F.col(f"v{i}").alias("v"))
        mine = (F.col("column") == i) & F.col(f"v{i}").isNotNull()
        found.append(F.min(F.when(mine, rank))["v"].alias(c))
    return counts.groupBy(*keys).agg(*found)


def level_vs_global(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """HIGH where the mean of the group reaches the mean of all rows, else LOW."""
    overall = fitted(df.agg(*[F.avg(c).alias(c) for c in columns]))
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
    return means.withColumns(
        {c: F.when(F.col(c) >= overall[c], "HIGH").otherwise("LOW") for c in columns}
    )


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, absent ones NULL."""
    head, *rest = frames
    for frame in rest:
        head = head.unionByName(frame, allowMissingColumns=True)
    return head
