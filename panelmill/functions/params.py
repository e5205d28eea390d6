"""One-row aggregates as parameters of another query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F


def one_row(params: DataFrame) -> Column:
    """The only row of ``params`` as a struct, through an uncorrelated scalar subquery.

    Spark runs the subquery once and hands its value to every task as a
    literal, so no join and no broadcast of a table is involved. A frame
    without rows gives NULL, one with two rows fails.
    """
    return params.select(F.struct("*")).scalar()


def fitted(params: DataFrame) -> Row:
    """The only row of an aggregate as driver values: the fit step of a scaler or an imputer.

    The values become literals, so a frame that is used many times does not
    carry the aggregation into every plan.
    """
    return params.first()
