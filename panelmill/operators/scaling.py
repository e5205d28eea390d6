"""Scaling, imputation and one-hot encoding with parameters fitted on the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, functions as F

from panelmill.functions.params import fitted
from panelmill.operators.ranks import exact_quantiles


def min_max_scale(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """To 0..1 by the range of ``fitted_on``; a constant column becomes 0."""
    source = df if fitted_on is None else fitted_on
    bounds = fitted(
        source.agg(
            *[F.min(c).cast("double").alias(f"{c}_lo") for c in columns],
            *[F.max(c).cast("double").alias(f"{c}_hi") for c in columns],
        )
    )
    scaled = {}
    for c in columns:
        low, high = bounds[f"{c}_lo"], bounds[f"{c}_hi"]
        spread = low is not None and high > low
        ratio = (F.col(c) - low) / (high - low) if spread else F.lit(0.0)
        scaled[c] = F.when(F.col(c).isNotNull(), ratio)
    return df.withColumns(scaled)


def standard_scale(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """To mean 0 and population deviation 1; a constant column becomes 0."""
    source = df if fitted_on is None else fitted_on
    moments = fitted(
        source.agg(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_dev") for c in columns],
        )
    )
    scaled = {}
    for c in columns:
        mean, dev = moments[f"{c}_mean"], moments[f"{c}_dev"]
        ratio = (F.col(c) - mean) / dev if dev else F.lit(0.0)
        scaled[c] = F.when(F.col(c).isNotNull(), ratio)
    return df.withColumns(scaled)


def impute_median(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Missing numbers become the exact median of the fitting rows."""
    medians = exact_quantiles(df if fitted_on is None else fitted_on, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns})


def impute_most_frequent(
    df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None
) -> DataFrame:
    """Missing categories become the most frequent one, the smallest on ties."""
    source = df if fitted_on is None else fitted_on
    texts = source.select([F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").count()
    rank = F.struct((-F.col("count")).alias("n"), F.col("value").alias("v"))
    modes = fitted(
        counts.agg(*[F.min(F.when(F.col("column") == c, rank))["v"].alias(c) for c in columns])
    )
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in columns})


def one_hot_stages(columns: Sequence[str]) -> list:
    """Pipeline stages that turn each category into 0/1 slots ``<column>_hot``.

    The indexer keeps one slot for values it has not seen and the encoder
    drops exactly that slot, so missing and unseen values are all zeros.
    """
    indexes = [f"{c}_index" for c in columns]
    return [
        StringIndexer(
            inputCols=list(columns), outputCols=indexes, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexes, outputCols=[f"{c}_hot" for c in columns], dropLast=True),
    ]


def slot_sources(model: PipelineModel, categories: Sequence[str], numbers: Sequence[str]) -> list[str]:
    """Source column of every slot of the assembled vector, categories first."""
    labels = model.stages[0].labelsArray if categories else []
    slots = [c for c, values in zip(categories, labels) for _ in values]
    return [*slots, *numbers]
