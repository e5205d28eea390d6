"""Means over time, as-of lookups, lags and trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelmill.functions.labels import HIGH, LOW, trend_class
from panelmill.functions.numeric import percent_change
from panelmill.operators.groups import with_keys
from panelmill.operators.ranks import RANGE, ordinal, with_range

FLAGS = ["prev_high", "prev_low", "prev2_persistent", "prev3_persistent"]


def history(df: DataFrame, keys: Sequence[str], period: str, measures: Mapping[str, str]) -> DataFrame:
    """Mean of each measure per key and period; ``measures`` maps output to input columns."""
    cells = with_keys(df, [*keys, period]).groupBy(*keys, period)
    return cells.agg(*[F.avg(source).alias(out) for out, source in measures.items()])


def history_overview(df: DataFrame, region: str, kind: str, period: str, value: str) -> DataFrame:
    """Series of means per region and kind, with the range of periods of the whole region."""
    series = history(df, [region, kind], period, {"value": value})
    span = df.filter(F.col(region).isNotNull()).groupBy(region).agg(
        F.min(period).alias("period_min"), F.max(period).alias("period_max")
    )
    return series.join(span, region)


def nested_series(series: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """One row per key with its (period, value) points in order.

    Several rows of a period are one point, their mean, so an array is no longer
    than the number of periods.
    """
    once = series.groupBy(*keys, period).agg(F.avg(value).alias(value))
    points = F.array_sort(F.collect_list(F.struct(period, value)))
    return once.groupBy(*keys).agg(points.alias("points"))


def macro_by_period(df: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the non-missing values of table-wide measures per period."""
    present = df.filter(F.col(period).isNotNull())
    return present.groupBy(period).agg(*[F.avg(f"`{c}`").alias(c) for c in columns])


def join_period_macro(df: DataFrame, macro: DataFrame, period: str) -> DataFrame:
    """Attach the values of a row's period, NULL where the period is unknown."""
    return df.join(macro, period, "left")


def lag_levels(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    label: str,
    tie: Sequence[str],
    n: int = 3,
    prefix: str = "lag",
) -> DataFrame:
    """The labels of the 1st to n-th previous row of the key, in the order (period, tie).

    A key may hold a large share of all rows, so its rows are not gathered in
    one window. They are cut into blocks by period and by ranges of the first
    tie column; lags are taken inside a block, and its first rows get theirs
    from the last ``n`` labels of the earlier blocks. Rows without a key or a
    period have no previous row. The tie columns must make the order total;
    blocks are as small as the first one is selective, be it numbers, text, dates
    or times.
    """
    whole = with_keys(df, [*keys, period])
    ranged = with_range(whole.withColumn("__place", ordinal(whole, tie[0])), "__place").drop("__place")
    block = [*keys, period, RANGE]
    inside = Window.partitionBy(*block).orderBy(*tie)
    local = ranged.withColumns(
        {"__row": F.row_number().over(inside)}
        | {f"__lag{k}": F.lag(label, k).over(inside) for k in range(1, n + 1)}
    )
    # Each task sends the last rows of its blocks alone.
    last = Window.partitionBy(*block).orderBy(*[F.desc(c) for c in tie])
    tails = ranged.withColumn("__back", F.row_number().over(last)).filter(F.col("__back") <= n)
    newest_first = F.array_sort(F.collect_list(F.struct("__back", F.col(label).alias("label"))))
    ends = tails.groupBy(*block).agg(newest_first["label"].alias("end"))
    earlier = Window.partitionBy(*keys).orderBy(period, RANGE)
    nothing = F.array().cast(T.ArrayType(df.schema[label].dataType))
    before = [F.coalesce(F.lag("end", k).over(earlier), nothing) for k in range(1, n + 1)]
    carried = ends.select(*block, F.concat(*before).alias("__before"))

    lags = {
        f"{prefix}{k}": F.when(F.col("__row") > k, F.col(f"__lag{k}")).otherwise(
            F.get("__before", F.lit(k) - F.col("__row"))
        )
        for k in range(1, n + 1)
    }
    found = local.join(carried, block, "left").withColumns(lags).select(*df.columns, *lags)
    keyless = F.lit(False)
    for name in (*keys, period):
        keyless = keyless | F.col(name).isNull()
    return found.unionByName(df.filter(keyless), allowMissingColumns=True)


def persistence_flags(first: Column, second: Column, third: Column, high: str, low: str) -> dict[str, Column]:
    """The four 0/1 flags from the three previous labels; without history all are 0."""
    flags = {
        FLAGS[0]: first == high,
        FLAGS[1]: first == low,
        FLAGS[2]: first == second,
        FLAGS[3]: (first == second) & (second == third),
    }
    return {name: F.coalesce(flag, F.lit(False)).cast("int") for name, flag in flags.items()}


def persistence_features(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    label: str,
    tie: Sequence[str],
    high: str = HIGH,
    low: str = LOW,
) -> DataFrame:
    """Flags from the previous rows of the table itself (the training form)."""
    lagged = lag_levels(df, keys, period, label, tie)
    flags = persistence_flags(F.col("lag1"), F.col("lag2"), F.col("lag3"), high, low)
    return lagged.withColumns(flags).drop("lag1", "lag2", "lag3")


def levels_per_period(
    history_rows: DataFrame, keys: Sequence[str], period: str, label: str, tie: Sequence[str]
) -> DataFrame:
    """One label per key and period: that of the last row in the order of ``tie``."""
    cells = with_keys(history_rows, [*keys, period]).groupBy(*keys, period)
    return cells.agg(F.max_by(label, F.struct(*tie)).alias(label))


def asof_previous(
    queries: DataFrame, levels: DataFrame, keys: Sequence[str], period: str, label: str, n: int = 3
) -> DataFrame:
    """The labels of the last ``n`` periods strictly before the period of each query row.

    ``levels`` holds one row per key and period. The lookup runs on the
    distinct (key, period) pairs of the queries, so a window sees at most two
    rows per key and period, and the answers are joined back to the rows.
    """
    names = [f"asof{k}" for k in range(1, n + 1)]
    series = Window.partitionBy(*keys).orderBy(period)
    recent = F.struct(
        F.col(label).alias(names[0]), *[F.lag(label, k).over(series).alias(names[k]) for k in range(1, n)]
    )
    known = levels.select(*keys, period, recent.alias("recent"), F.lit(1).alias("__level"))
    asked = with_keys(queries, [*keys, period]).select(*keys, period).distinct()
    asked = asked.withColumns({"recent": F.lit(None).cast(known.schema["recent"].dataType), "__level": F.lit(0)})
    # Queries sort before the level of their own period and so see only earlier ones.
    upto = Window.partitionBy(*keys).orderBy(period, "__level").rowsBetween(Window.unboundedPreceding, -1)
    answered = (
        known.unionByName(asked)
        .withColumn("recent", F.last("recent", ignorenulls=True).over(upto))
        .filter(F.col("__level") == 0)
        .select(*keys, period, *[F.col(f"recent.{name}").alias(name) for name in names])
    )
    return queries.join(answered, [*keys, period], "left").select(*queries.columns, *names)


def persistence_features_asof(
    queries: DataFrame,
    history_rows: DataFrame,
    keys: Sequence[str],
    period: str,
    label: str,
    tie: Sequence[str],
    high: str = HIGH,
    low: str = LOW,
) -> DataFrame:
    """Flags from one level per earlier period (the serving form).

    It differs from ``persistence_features`` on purpose: several rows of one
    period count once, and rows of the query's own period do not count.
    """
    levels = levels_per_period(history_rows, keys, period, label, tie)
    found = asof_previous(queries, levels, keys, period, label)
    flags = persistence_flags(F.col("asof1"), F.col("asof2"), F.col("asof3"), high, low)
    return found.withColumns(flags).select(*queries.columns, *FLAGS)


def trend_summary(
    series: DataFrame, keys: Sequence[str], period: str, value: str, lo=None, hi=None
) -> DataFrame:
    """Latest and previous point, change, extremes (earliest on ties) and trend class per key.

    ``series`` holds one row per key and period, for example from ``history``.
    """
    points = series.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if lo is not None:
        points = points.filter(F.col(period) >= lo)
    if hi is not None:
        points = points.filter(F.col(period) <= hi)
    order = Window.partitionBy(*keys).orderBy(period)
    earlier = F.lag(F.struct(F.col(period).alias("p"), F.col(value).alias("v"))).over(order)
    points = points.withColumn("__earlier", earlier)
    point = F.struct(F.col(value).alias("v"), F.col(period).alias("p"))
    found = points.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.min_by(value, period).alias("__first"),
        F.max_by(value, period).alias("latest"),
        F.max(period).alias("latest_period"),
        F.max_by("__earlier", period).alias("__earlier"),
        F.min(point).alias("__low"),
        F.max(value).alias("highest"),
    )
    tops = points.join(found.select(*keys, F.col("highest").alias("__top")), list(keys))
    first_top = tops.filter(F.col(value) == F.col("__top")).groupBy(*keys).agg(
        F.min(period).alias("highest_period")
    )
    return found.join(first_top, list(keys)).select(
        *keys,
        "points",
        "latest",
        "latest_period",
        F.col("__earlier.v").alias("previous"),
        F.col("__earlier.p").alias("previous_period"),
        percent_change(F.col("latest"), F.col("__earlier.v")).alias("change_percent"),
        "highest",
        "highest_period",
        F.col("__low.v").alias("lowest"),
        F.col("__low.p").alias("lowest_period"),
        trend_class(F.col("__first"), F.col("latest"), F.col("points")).alias("trend"),
    )
