"""Observation tables from CSV or Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelmill.functions.numeric import null_if_nan

INDEX_NAMES = re.compile(r"^(Unnamed.*|_c\d+|)$")


def observation_schema(
    categories: list[str], period: str, measures: list[str], order: list[str] | None = None
) -> T.StructType:
    """Text categories, an integer period and double measures, in file order if one is given."""
    kinds = {c: T.StringType() for c in categories} | {period: T.IntegerType()}
    kinds |= {m: T.DoubleType() for m in measures}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in (order or list(kinds))])


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Without the unnamed index columns that data-frame exports leave behind."""
    return df.drop(*[c for c in df.columns if INDEX_NAMES.match(c)])


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL once, at the border."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(F.col(f"`{c}`")) for c in floats})


def read_observations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header row, or a Parquet table for any path that is not CSV.

    The schema covers the columns by name; Parquet columns outside of it are
    not read. A CSV schema lists all columns in file order, index columns
    included.
    """
    if ".csv" in path:
        df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    else:
        df = spark.read.schema(schema).parquet(path)
    return missing_as_null(drop_index_columns(df))
