"""Numeric expressions with the missing-value rules of the library: NaN never leaves them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(INFINITY)), value)


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-even rounding for report views; NaN and NULL stay missing."""
    return F.bround(null_if_nan(value), digits)


def log1p_clipped(value: Column) -> Column:
    """``log1p(max(x, 0))``; ``greatest`` would turn NULL into 0, hence the guard."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def percent_change(later: Column, earlier: Column, floor: float = 1e-9) -> Column:
    """Change relative to ``abs(earlier)`` in percent, NULL when that is about zero."""
    return F.when(F.abs(earlier) > floor, (later - earlier) / F.abs(earlier) * 100.0)


def separation_band(score: Column, fair: float = 0.35, strong: float = 0.5) -> Column:
    """Quality word of a silhouette; the bounds are those customary for Euclidean distances."""
    return (
        F.when(score < 0, "Poor")
        .when(score < fair, "Weak")
        .when(score < strong, "Fair")
        .when(score.isNotNull(), "Strong")
    )


def correlation_band(r: Column) -> Column:
    """Strength class of a correlation coefficient by its absolute value."""
    size = F.abs(r)
    return (
        F.when(size > 0.85, "very strong")
        .when(size > 0.6, "strong")
        .when(size > 0.3, "moderate")
        .when(r.isNotNull(), "weak")
    )
