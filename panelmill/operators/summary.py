"""Profile of a table: overview, distributions, missing values and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelmill.functions.params import one_row
from panelmill.operators.prepare import category_columns, numeric_columns
from panelmill.operators.ranks import exact_quantiles

MISSING_LABEL = "(missing)"


def category_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per value of each category with their share; missing values count as a value."""
    columns = list(columns or category_columns(df))
    texts = df.select([F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        texts.unpivot([], columns, "column", "value")
        .groupBy("column", F.coalesce("value", F.lit(MISSING_LABEL)).alias("label"))
        .agg(F.count("*").alias("count"))
    )
    total = one_row(df.agg(F.count("*").alias("n")))["n"]
    return counts.withColumn("share", F.col("count").cast("double") / total)


def top_categories(distribution: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of each column, ties by label."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("label"))
    return distribution.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def category_cardinality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-missing values per column, by counting the rows of a grouping."""
    columns = list(columns or category_columns(df))
    texts = df.select([F.col(c).cast("string").alias(c) for c in columns])
    values = texts.unpivot([], columns, "column", "value").distinct()
    return values.groupBy("column").agg(F.count("value").alias("distinct_values"))


def dataset_overview(df: DataFrame, period: str, dims: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows, attributes, range of periods and distinct values per dimension in one row."""
    basic = [
        F.count("*").alias("records"),
        F.lit(len(df.columns)).alias("attributes"),
        F.min(period).alias("period_min"),
        F.max(period).alias("period_max"),
    ]
    if approximate:
        return df.agg(*basic, *[F.approx_count_distinct(d).alias(f"num_{d}") for d in dims])
    distinct = category_cardinality(df, dims)
    counted = one_row(
        distinct.agg(
            *[F.max(F.when(F.col("column") == d, F.col("distinct_values"))).alias(d) for d in dims]
        )
    )
    return df.agg(*basic).withColumns({f"num_{d}": F.coalesce(counted[d], F.lit(0)) for d in dims})


def period_counts(df: DataFrame, period: str) -> DataFrame:
    """Rows per period in order; rows without a period are left out."""
    present = df.filter(F.col(period).isNotNull())
    return present.groupBy(period).agg(F.count("*").alias("count")).orderBy(period)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, exact median, sample deviation, minimum and maximum per numeric column."""
    columns = list(columns or numeric_columns(df))
    values = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    medians = exact_quantiles(values, columns)
    measures = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    wide = values.agg(
        *[
            F.struct(*[fn(f"`{c}`").cast("double").alias(m) for m, fn in measures.items()]).alias(c)
            for c in columns
        ]
    )
    long = wide.unpivot([], columns, "column", "m")
    median = F.coalesce(*[F.when(F.col("column") == c, F.lit(medians[c])) for c in columns])
    return long.select(
        "column",
        F.col("m.count").cast("long").alias("count"),
        F.col("m.mean").alias("mean"),
        median.alias("median"),
        F.col("m.std").alias("std"),
        F.col("m.min").alias("min"),
        F.col("m.max").alias("max"),
    )


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values (NULL or NaN) per column in one pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(_missing(c, kinds[c])).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "missing")


def _missing(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def duplicate_rows(df: DataFrame, out: str = "duplicate_rows") -> DataFrame:
    """Rows equal to an earlier one on all columns.

    Only a 64-bit hash of every row is shuffled first. Rows whose hash occurs
    once cannot have a copy; the others are compared on all their columns.
    """
    hashed = df.withColumn("__hash", F.xxhash64(*df.columns))
    repeated = hashed.groupBy("__hash").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    suspects = hashed.join(repeated.select("__hash"), "__hash", "left_semi")
    copies = suspects.groupBy(*df.columns).agg((F.count("*") - 1).alias("extra"))
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias(out))
