"""Pearson correlation of all pairs of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.functions.numeric import correlation_band, null_if_nan
from panelmill.functions.params import fitted
from panelmill.operators.prepare import numeric_columns


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long matrix (feature, other, r); a pair uses the rows where both sides are present.

    A first pass fits the mean, the range and the number of values per column;
    the second sums products of the centred values, which needs no shuffle of
    rows and one multiplication per pair and row. Only pairs with missing
    values carry moments of their own. A constant column gives NULL, where the
    built-in ``corr`` would divide by zero.
    """
    columns = list(columns or numeric_columns(df))
    names = [f"c{i}" for i in range(len(columns))]
    values = df.select(
        [null_if_nan(F.col(f"`{c}`").cast("double")).alias(n) for c, n in zip(columns, names)]
    )
    known = fitted(
        values.agg(
            F.count("*").alias("rows"),
            *[F.count(n).alias(f"{n}_n") for n in names],
            *[F.avg(n).alias(f"{n}_mean") for n in names],
            *[(F.max(n) > F.min(n)).alias(f"{n}_varies") for n in names],
        )
    )
    complete = {n for n in names if known[f"{n}_n"] == known["rows"]}
    centred = values.select(*[(F.col(n) - F.lit(known[f"{n}_mean"])).alias(n) for n in names])

    sums = [F.count("*").cast("double").alias("n")]
    sums += [F.sum(n).alias(f"s_{n}") for n in names]
    sums += [F.sum(F.col(n) * F.col(n)).alias(f"q_{n}") for n in names]
    cells = []
    for (a, x), (b, y) in combinations(zip(columns, names), 2):
        sums.append(F.sum(F.col(x) * F.col(y)).alias(f"p_{x}{y}"))
        if not (known[f"{x}_varies"] and known[f"{y}_varies"]):
            r = F.lit(None).cast("double")
        elif x in complete and y in complete:
            r = _pearson("n", f"p_{x}{y}", f"s_{x}", f"s_{y}", f"q_{x}", f"q_{y}")
        else:
            sums.append(_pair_moments(x, y).alias(f"m_{x}{y}"))
            parts = [f"m_{x}{y}.{part}" for part in ("n", "sx", "sy", "qx", "qy")]
            r = _pearson(parts[0], f"p_{x}{y}", *parts[1:])
            r = F.when(F.col(f"m_{x}{y}.varies"), r)
        cells.append(_cell(a, b, r))
    for c, n in zip(columns, names):
        cells.append(_cell(c, c, F.lit(1.0 if known[f"{n}_varies"] else None).cast("double")))
    upper = centred.agg(*sums).select(F.inline(F.array(*cells)))
    both = F.array(
        F.struct(F.col("feature"), F.col("other"), F.col("r")),
        F.struct(F.col("other").alias("feature"), F.col("feature").alias("other"), F.col("r")),
    )
    mirrored = F.when(F.col("feature") == F.col("other"), F.slice(both, 1, 1)).otherwise(both)
    return upper.select(F.inline(mirrored))


def _pair_moments(x: str, y: str) -> Column:
    """Moments of both columns over the rows where both are present."""
    left, right = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.struct(
        F.count(left).cast("double").alias("n"),
        F.sum(left).alias("sx"),
        F.sum(right).alias("sy"),
        F.sum(left * left).alias("qx"),
        F.sum(right * right).alias("qy"),
        ((F.max(left) > F.min(left)) & (F.max(right) > F.min(right))).alias("varies"),
    )


def _pearson(n: str, product: str, sx: str, sy: str, qx: str, qy: str) -> Column:
    def centred(q: str, a: str, b: str) -> Column:
        return F.col(q) - F.try_divide(F.col(a) * F.col(b), F.col(n))

    spread = F.sqrt(centred(qx, sx, sx) * centred(qy, sy, sy))
    return F.try_divide(centred(product, sx, sy), spread)


def _cell(feature: str, other: str, r: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), F.lit(other).alias("other"), r.alias("r"))


def correlation_bands(matrix: DataFrame, shown_from: float = 0.3) -> DataFrame:
    """Strength class, sign and whether the coefficient is printed."""
    return matrix.withColumns(
        {
            "band": correlation_band(F.col("r")),
            "sign": F.when(F.col("r") > 0, "positive").when(F.col("r").isNotNull(), "negative"),
            "shown": F.coalesce(F.abs("r") >= shown_from, F.lit(False)),
        }
    )
