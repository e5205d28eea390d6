"""Global order without a global sort: running totals and exact quantiles.

A window without partitions runs in one task. Here the ordered column is cut
into ranges of about equal row count, every range is summed on its own, and a
small table with one row per range carries the totals of the earlier ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import ceil, floor
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelmill.functions.numeric import null_if_nan
from panelmill.session import durable

RANGE = "__range"
SAMPLED_ROWS = 1_000_000
RANGE_ROWS = 2_000_000
#: Bits of a value that one scan decides.
DIGIT = 13


def range_count(df: DataFrame, rows: int = 0) -> int:
    """As many ranges as the session has shuffle partitions, more if a range would exceed ``RANGE_ROWS``."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, partitions, ceil(rows / RANGE_ROWS))


def thinned(values: DataFrame, known: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``known`` rows in a few partitions, enough to place boundaries.

    A quantile sketch per input partition would add up to gigabytes where they
    are merged; a sample is as small for any table. Only boundaries come from
    it, results never do.
    """
    if known <= wanted:
        return values
    return values.sample(fraction=wanted / known, seed=17).repartition(range_count(values))


def split_points(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Approximate quantiles that cut the column in ranges; only these numbers reach the driver."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    rows = values.count()
    ranges = ranges or range_count(df, rows)
    sample = thinned(values, rows, max(SAMPLED_ROWS, 200 * ranges))
    probabilities = [i / ranges for i in range(1, ranges)]
    points = sample.approxQuantile("v", probabilities, 1 / (4 * ranges))
    return sorted(set(points))


def with_range(
    df: DataFrame, column: str, cuts: Sequence[float] | None = None, out: str = RANGE
) -> DataFrame:
    """Number of the range a numeric value falls in, rising with the value."""
    points = split_points(df, column) if cuts is None else list(cuts)
    if not points:
        return df.withColumn(out, F.lit(0))
    edges = [-float("inf"), *points, float("inf")]
    keyed = df.withColumn("__key", F.col(column).cast("double"))
    cutter = Bucketizer(splits=edges, inputCol="__key", outputCol=out, handleInvalid="keep")
    # An integer key keeps its hash partitioning through windows, groupings and joins.
    # Missing values sort before all others and form the range -1.
    ranged = cutter.transform(keyed).drop("__key")
    return ranged.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1)))


def ordinal(df: DataFrame, column: str) -> Column:
    """A number that never falls as the column rises, to cut ranges of columns of any type.

    Text is taken by the six bytes behind what its least and greatest value have
    in common. Types without an order of their own give 0 for every value.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return (value.cast("timestamp") if isinstance(kind, T.TimestampNTZType) else value.cast("int") if isinstance(kind, T.BooleanType) else value).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if not isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.lit(0.0))
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    common = len(commonprefix([(ends["low"] or "").encode(), (ends["high"] or "").encode()]))
    digits = F.substring(F.hex(value.cast("binary")), 2 * common + 1, 12)
    return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("double")


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    following: Mapping[str, str] | None = None,
    cuts: Sequence[float] | None = None,
    range_column: str | None = None,
) -> DataFrame:
    """Inclusive running totals in the order of a numeric column, per group of ``by``.

    ``df`` holds at most one row per group and order value. ``sums`` maps
    output to input columns; ``<output>_all`` is the total of the group.
    ``following`` maps output columns to columns whose value is taken from the
    next row. ``range_column`` names an existing range number that rises with
    ``order``. Otherwise the ranges are cut at ``cuts``, by default at quantiles
    of ``order`` over all groups together, so no range is large however uneven
    the groups are.
    """
    following = dict(following or {})
    rng = range_column or RANGE
    tagged = df if range_column else with_range(df, order, cuts)
    direction = F.desc if descending else F.asc
    last = F.min_by if descending else F.max_by
    first = F.max_by if descending else F.min_by

    inside = Window.partitionBy(*by, rng).orderBy(direction(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.withColumns(
        {f"__{out}": F.sum(source).over(upto) for out, source in sums.items()}
        | {f"__next_{out}": F.lead(source).over(inside) for out, source in following.items()}
        | {"__last": F.lead(F.lit(1)).over(inside).isNull()}
    )

    edges = local.groupBy(*by, rng).agg(
        *[last(f"__{out}", order).alias(f"__sum_{out}") for out in sums],
        *[first(source, order).alias(f"__first_{out}") for out, source in following.items()],
    )
    across = Window.partitionBy(*by).orderBy(direction(rng))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *by,
        rng,
        *[F.coalesce(F.sum(f"__sum_{o}").over(before), F.lit(0)).alias(f"__off_{o}") for o in sums],
        *[F.sum(f"__sum_{o}").over(Window.partitionBy(*by)).alias(f"{o}_all") for o in sums],
        *[F.lead(f"__first_{o}").over(across).alias(f"__over_{o}") for o in following],
    )
    joined = local.join(carried, [*by, rng])
    return joined.select(
        *df.columns,
        *[(F.col(f"__{o}") + F.col(f"__off_{o}")).alias(o) for o in sums],
        *[f"{o}_all" for o in sums],
        *[
            F.when(F.col("__last"), F.col(f"__over_{o}")).otherwise(F.col(f"__next_{o}")).alias(o)
            for o in following
        ],
    )


def _image(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _value(image: int) -> float:
    bits = image ^ (1 << 63) if image >> 63 else ~image & (1 << 64) - 1
    return float(np.array(bits, np.uint64).view(np.float64))


class _Sought(NamedTuple):
    """One wanted rank of a column: the leading digits of its value so far, and its rank among the values that share them."""

    column: int
    rank: int
    prefix: int


def _digit_counts(values: DataFrame, sought: Sequence[tuple[int, int]], shift: int, width: int) -> list[np.ndarray]:
    """For each (column, prefix) how many values have each next digit; a row per digit and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(sought), 1 << width), np.int64)
        for batch in batches:
            images = {}
            for t, (column, prefix) in enumerate(sought):
                if column not in images:
                    images[column] = _image(batch.column(column).drop_null().to_numpy(zero_copy_only=False))
                own = images[column]
                if shift + width < 64:
                    own = own[own >> np.uint64(shift + width) == np.uint64(prefix)]
                digit = (own >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                counts[t] += np.bincount(digit.astype(np.int64), minlength=1 << width)
        t, digit = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(digit, pa.int32()), pa.array(counts[t, digit])], names=["t", "digit", "n"])

    out = [np.zeros(1 << width, np.int64) for _ in sought]
    for r in values.mapInArrow(run, "t int, digit int, n long").groupBy("t", "digit").agg(F.sum("n").alias("n")).collect():
        out[r.t][r.digit] = r.n
    return out


def _candidates(values: DataFrame, sought: Sequence[tuple[int, int]], shift: int) -> list[np.ndarray]:
    """The sorted images of the values of each (column, prefix); the caller knows that they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, (column, prefix) in enumerate(sought):
                own = _image(batch.column(column).drop_null().to_numpy(zero_copy_only=False))
                own = own[own >> np.uint64(shift) == np.uint64(prefix)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t), pa.int32()), pa.array(own.view(np.int64))], names=["t", "image"])

    found = values.mapInArrow(run, "t int, image long").toArrow()
    t, image = found.column("t").to_numpy(), found.column("image").to_numpy().view(np.uint64)
    return [np.sort(image[t == i]) for i in range(len(sought))]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], q: float = 0.5, ordered_rows: int = 1 << 14
) -> dict[str, float | None]:
    """Exact, interpolated quantile of each column, None for an empty one.

    A fit step like ``approxQuantile``, by radix selection: doubles become
    64-bit numbers of the same order, and each scan counts the next ``DIGIT``
    bits of all columns at once among the values that share the leading bits of
    the wanted rank. There is no sample and no sort, at most five scans, and
    the same work for sparse, equal or skewed values. When no more than ``ordered_rows``
    values of a column share the leading bits, these come to the driver instead.
    """
    names = [f"c{i}" for i in range(len(columns))]
    values = durable(df.select([null_if_nan(F.col(f"`{c}`").cast("double")).alias(n) for c, n in zip(columns, names, strict=True)]))
    sought: list[_Sought] = []
    parts: dict[int, float] = {}
    shift = 64
    while shift:
        width = min(DIGIT, shift)
        shift -= width
        asked = [(i, 0) for i in range(len(columns))] if not parts else sorted({(s.column, s.prefix) for s in sought})
        counts = dict(zip(asked, _digit_counts(values, asked, shift, width), strict=True))
        if not parts:
            for (i, _), n in counts.items():
                position = (int(n.sum()) - 1) * q
                parts[i] = position - floor(position)
                sought += [_Sought(i, floor(position), 0), _Sought(i, ceil(position), 0)] if n.sum() else []
        inside, grown = 0, []
        for s in sought:
            upto = np.cumsum(counts[s.column, s.prefix])
            digit = int(np.searchsorted(upto, s.rank, side="right"))
            before = int(upto[digit - 1]) if digit else 0
            grown.append(_Sought(s.column, s.rank - before, s.prefix << width | digit))
            inside = max(inside, int(upto[digit]) - before)
        sought = grown
        if inside <= ordered_rows:
            break
    if not sought:
        return dict.fromkeys(columns)
    if shift:
        asked = sorted({(s.column, s.prefix) for s in sought})
        held = dict(zip(asked, _candidates(values, asked, shift), strict=True))
        ends = [_value(int(held[s.column, s.prefix][s.rank])) for s in sought]
    else:
        ends = [_value(s.prefix) for s in sought]
    found = dict.fromkeys(columns)
    for s, low, high in zip(sought[::2], ends[::2], ends[1::2], strict=True):
        found[columns[s.column]] = low if low == high else low + (high - low) * parts[s.column]
    return found
