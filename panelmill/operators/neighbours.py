"""Distances from a set of probe points to the nearest rows of a table.

Rows belong to cells of a small tree (``cells``). A probe first meets the rows of
the cell whose box is nearest; no row of a cell whose box lies farther away
than the best distance so far can be nearer, so a second scan compares it with the
cells that are left. A task folds its rows into one partial result per probe, so a
shuffle carries probes times tasks rows and no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelmill.functions.hashing import seeded_hash
from panelmill.operators import cells
from panelmill.session import durable

PROBES = 1 << 14  # probes of one pair of scans


def sampled_rows(df: DataFrame, key: Sequence[str], m: int, seed: int) -> DataFrame:
    """``m`` rows in the order of a seeded hash of their key: a reproducible sample."""
    return df.orderBy(seeded_hash(key, seed)).limit(m)


def row_key(key: Sequence[str]):
    """The key columns as one text."""
    return F.concat_ws("|", *[F.col(k).cast("string") for k in key])


def nearest_distance(
    probes: Sequence[tuple[str, Sequence[float]]],
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    exclude_self: bool = False,
    cell_count: int = cells.CELLS,
) -> DataFrame:
    """(probe, distance) to the nearest row, or to the nearest other row; any number of probes.

    The distance is infinite if there is no row to compare with.
    """
    spark = df.sparkSession
    if not probes:
        return spark.createDataFrame([], "probe string, distance double")
    stored = durable(df.select(row_key(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
    axes = [f"x{i}" for i in range(len(columns))]
    tree = cells.cut(stored, axes, cell_count)
    boxes = cells.boxes(stored, axes, tree)
    told = []
    for low in range(0, len(probes), PROBES):
        told += _nearest(stored, axes, tree, boxes, probes[low : low + PROBES], exclude_self)
    return spark.createDataFrame(told, "probe string, distance double")


def _nearest(stored: DataFrame, axes: Sequence[str], tree: cells.Tree, boxes: cells.Boxes, probes: Sequence[tuple[str, Sequence[float]]], exclude_self: bool) -> list[tuple[str, float]]:
    names, points = [name for name, _ in probes], np.array([point for _, point in probes], dtype=float)
    best = np.full(len(names), np.inf)
    if len(boxes.cell):
        bound = boxes.least_squares(points)
        nearest = np.arange(len(names)), bound.argmin(axis=1)
        first = np.zeros(bound.shape, bool)
        first[nearest] = True
        best = _met(stored, axes, tree, boxes, names, points, first, exclude_self)
        best = np.minimum(best, _met(stored, axes, tree, boxes, names, points, ~first & (bound < best[:, None]), exclude_self))
    return [(name, float(np.sqrt(b))) for name, b in zip(names, best, strict=True)]


def _met(stored: DataFrame, axes: Sequence[str], tree: cells.Tree, boxes: cells.Boxes, names: Sequence[str], points: np.ndarray, meets: np.ndarray, exclude_self: bool) -> np.ndarray:
    """Least squared distance of each probe to the rows of the cells that it meets (probes x cells)."""
    visitors = {int(c): np.flatnonzero(meets[:, i]) for i, c in enumerate(boxes.cell) if meets[:, i].any()}
    out = np.full(len(names), np.inf)
    if not visitors:
        return out
    position = {name: i for i, name in enumerate(names)} if exclude_self else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(names), np.inf)
        for table in cells.gathered(batches):
            x = cells.matrix(table, axes)
            own = np.array([position.get(k, -1) for k in table.column("key").to_pylist()]) if position else np.full(len(x), -1)
            for cell, places in cells.by_cell(tree.locate(x)):
                who = visitors.get(cell)
                if who is None:
                    continue
                squared = np.zeros((len(places), len(who)))
                for a in range(x.shape[1]):
                    squared += (x[places, a, None] - points[None, who, a]) ** 2
                squared[own[places, None] == who[None, :]] = np.inf
                least[who] = np.minimum(least[who], squared.min(axis=0))
        some = np.flatnonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(least[some])], names=["probe", "squared"])

    for r in stored.mapInArrow(run, "probe long, squared double").groupBy("probe").agg(F.min("squared").alias("squared")).collect():
        out[r.probe] = r.squared
    return out
