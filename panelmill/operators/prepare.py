"""Projections, filters, labels and checks on observation tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelmill.functions import numeric
from panelmill.functions.labels import interaction, level
from panelmill.functions.params import fitted
from panelmill.operators.ranks import exact_quantiles


def snake_aliases(names: Sequence[str]) -> dict[str, str]:
    """``sownAcre`` -> ``sown_acre`` for every camelCase name; other names have no alias."""
    found = {}
    for name in names:
        if name[:1].islower() and re.search(r"[A-Z]", name):
            found[name] = re.sub(r"([A-Z])", r"_\1", name).lower()
    return found


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by ``aliases`` (by default camelCase to snake_case); unknown names pass."""
    return df.withColumnsRenamed(dict(snake_aliases(df.columns) if aliases is None else aliases))


def select_features(df: DataFrame, features: Mapping[str, str]) -> DataFrame:
    """The named features with their types in the given order, absent ones as NULL."""
    present = set(df.columns)
    return df.select(
        [
            (F.col(f"`{name}`") if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in features.items()
        ]
    )


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without targets and leaking columns; absent names are ignored."""
    return df.drop(*names)


def filter_trimmed_equal(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Rows whose trimmed texts equal the trimmed values."""
    for name, value in wanted.items():
        df = df.filter(F.trim(F.col(name).cast("string")) == str(value).strip())
    return df


def period_split(
    df: DataFrame, period: str, train_end: Any, test: Any | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows up to ``train_end``, and the rows after it (or those of the period ``test``)."""
    later = F.col(period) > train_end if test is None else F.col(period) == test
    return df.filter(F.col(period) <= train_end), df.filter(later)


def label_threshold(df: DataFrame, value: str, threshold: float, out: str = "level") -> DataFrame:
    return df.withColumn(out, level(F.col(value), threshold))


def label_by_train_median(
    df: DataFrame, value: str, train: Column, out: str = "level", threshold: str = "threshold"
) -> DataFrame:
    """High above the exact median of the training rows, which is kept as a column."""
    median = exact_quantiles(df.filter(train), [value])[value]
    limit = F.lit(median).cast("double")
    return df.withColumns({threshold: limit, out: level(F.col(value), limit)})


def add_interactions(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({out: interaction(*pair) for out, pair in pairs.items()})


def log1p_clipped(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``columns`` maps each new column to its source."""
    return df.withColumns({o: numeric.log1p_clipped(F.col(c)) for o, c in columns.items()})


def override_else_lookup(
    df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """The row's own value, else the one of ``lookup`` (one row per key).

    A table cannot tell an absent value from an explicit NULL, so NULL falls
    back. A column that ``df`` lacks is taken from the lookup alone.
    """
    found = lookup.select(key, *[F.col(f"`{c}`").alias(f"__{c}") for c in columns])
    joined = df.join(found, key, "left")
    values = {
        c: F.coalesce(f"`{c}`", f"`__{c}`") if c in df.columns else F.col(f"`__{c}`")
        for c in columns
    }
    return joined.withColumns(values).drop(*[f"__{c}" for c in columns])


def range_rule(name: str, low: float | None = None, high: float | None = None) -> Column:
    """True where the value breaks the bounds; a missing value breaks a required field."""
    value = F.col(name)
    broken = value.isNull()
    if low is not None:
        broken = broken | (value < low)
    if high is not None:
        broken = broken | (value > high)
    return broken


def vocabulary_rule(name: str, allowed: Sequence[Any]) -> Column:
    """True where the value is not one of a short list."""
    return F.col(name).isNull() | ~F.col(name).isin(list(allowed))


def flag_violations(df: DataFrame, rules: Mapping[str, Column], out: str = "violations") -> DataFrame:
    """Per row the names of the broken rules."""
    broken = [F.when(rule, F.lit(name)) for name, rule in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def check_constraints(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule with the number of violating rows, counted in one pass."""
    counted = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def unknown_values(df: DataFrame, name: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose value is missing from a long vocabulary table."""
    return df.join(vocabulary.select(name).distinct(), name, "left_anti")


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``column_min``, ``column_max`` per column."""
    return df.agg(
        *[F.min(c).alias(f"{c}_min") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
    )


def flag_outside_typical(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_outside`` is true where a value leaves the range of the reference rows."""
    bounds = fitted(value_ranges(reference, columns))
    return df.withColumns(
        {
            f"{c}_outside": ~F.col(c).between(bounds[f"{c}_min"], bounds[f"{c}_max"])
            for c in columns
        }
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def category_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
