"""Two-level labels, interaction texts and trend classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelmill.functions.items import text_of

HIGH = "High"
LOW = "Low"


def level(value: Column, threshold: Column | float) -> Column:
    """High when strictly above the threshold; a missing value is Low.

    Spark orders NaN above every number, so NaN is ruled out by hand.
    """
    return F.when(~F.isnan(value) & (value > threshold), HIGH).otherwise(LOW)


def level_flag(label: Column) -> Column:
    return (label == HIGH).cast("int")


def interaction(left: str, right: str) -> Column:
    """Two categories as one: ``left | right``."""
    return F.concat(text_of(left), F.lit(" | "), text_of(right))


def trend_class(first: Column, last: Column, points: Column, limit: float = 3.0) -> Column:
    """Direction from the first to the last value, stable within ``limit`` percent."""
    change = F.when(F.abs(first) < 1e-9, 0.0).otherwise(
        F.try_divide(last - first, F.abs(first)) * 100.0
    )
    return (
        F.when((points < 2) | change.isNull(), "stable")
        .when(change > limit, "increasing")
        .when(change < -limit, "decreasing")
        .otherwise("stable")
    )
