"""Cells of a space: a small tree that cuts it, and what the rows of each cell have in common.

The tree is cut at medians of a bounded sample, so it has the same size for any
table; it only decides which rows are summed up together, never a result. Boxes
and moments of the cells come from all rows in one scan that shuffles one row
per cell and task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CELLS = 1024
#: Sampled rows for each cell.
SAMPLE = 32
#: Rows that a task holds at a time, so that each cell has several of them.
HELD = 1 << 17


class Tree(NamedTuple):
    """Inner nodes: rows with x[axis] <= value go left; children below zero are ~cell."""

    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cells: int

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        if not len(self.axis):
            return np.zeros(len(x), np.int64)
        at = np.zeros(len(x), np.int64)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            low = x[open_, self.axis[node]] <= self.value[node]
            at[open_] = np.where(low, self.left[node], self.right[node])
        return ~at


def plant(points: np.ndarray, cells: int) -> Tree:
    """A tree that halves its most numerous part along the widest axis until there are ``cells`` or all parts are single points."""
    axis, value, left, right = [], [], [], []
    parts: list[tuple[np.ndarray, int, bool]] = [(points, -1, False)]  # points, parent, whether on its right
    done: list[tuple[int, bool]] = []
    while parts:
        grown = []
        for own, parent, side in sorted(parts, key=lambda p: -len(p[0])):
            wide = np.ptp(own, axis=0) if len(own) else np.zeros(points.shape[1])
            room = len(done) + len(parts) + len(grown) // 2 < cells
            if not room or not len(own) or wide.max(initial=0) <= 0:
                done.append((parent, side))
                continue
            a = int(np.argmax(wide))
            order = np.sort(own[:, a])
            cut = order[(len(order) - 1) // 2]
            if cut == order[-1]:
                cut = order[order < cut][-1]
            axis.append(a)
            value.append(cut)
            left.append(0)
            right.append(0)
            node = len(axis) - 1
            if parent >= 0:
                (right if side else left)[parent] = node
            low = own[:, a] <= cut
            grown += [(own[low], node, False), (own[~low], node, True)]
        parts = grown
    for cell, (parent, side) in enumerate(done):
        if parent >= 0:
            (right if side else left)[parent] = ~cell
    kind = np.int64
    return Tree(np.array(axis, kind), np.array(value, float), np.array(left, kind), np.array(right, kind), max(1, len(done)))


def cut(rows: DataFrame, columns: Sequence[str], cells: int = CELLS, seed: int = 42) -> Tree:
    """The tree of a table, from about ``SAMPLE`` rows for each cell; from all rows if there are fewer."""
    wanted = SAMPLE * cells
    total = rows.count()
    chosen = rows.select(*columns)
    if total > wanted:
        chosen = chosen.sample(fraction=wanted / total, seed=seed).limit(2 * wanted)
    return plant(matrix(chosen.toArrow(), columns), cells)


def matrix(batch: pa.RecordBatch | pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c), float) for c in columns], axis=1) if len(columns) else np.zeros((batch.num_rows, 0))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task in tables of about ``HELD`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def by_cell(cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell that occurs with the places of its rows."""
    order = np.argsort(cell, kind="stable")
    borders = np.flatnonzero(np.diff(cell[order])) + 1
    for places in np.split(order, borders) if len(order) else []:
        yield int(cell[places[0]]), places


class Boxes(NamedTuple):
    """Cells that hold rows, and the least and greatest value of each axis among these."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def least_squares(self, points: np.ndarray) -> np.ndarray:
        """Lower bound of the squared distance of each point to the rows of each cell."""
        out = np.zeros((len(points), len(self.cell)))
        for a in range(points.shape[1]):
            x = points[:, a, None]
            gap = np.maximum(np.maximum(self.low[None, :, a] - x, x - self.high[None, :, a]), 0.0)
            out += gap * gap
        return out


def boxes(rows: DataFrame, columns: Sequence[str], tree: Tree) -> Boxes:
    names, width = list(columns), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((tree.cells, width), np.inf), np.full((tree.cells, width), -np.inf)
        for batch in batches:
            x = matrix(batch, names)
            cell = tree.locate(x)
            np.minimum.at(low, cell, x)
            np.maximum.at(high, cell, x)
        some = np.flatnonzero(np.isfinite(low).all(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(c) for c in low[some].T], *[pa.array(c) for c in high[some].T]], names=["cell", *lows, *highs])

    lows, highs = [f"l{i}" for i in range(width)], [f"h{i}" for i in range(width)]
    schema = ", ".join(["cell int", *[f"{c} double" for c in (*lows, *highs)]])
    told = rows.select(*names).mapInArrow(run, schema).groupBy("cell").agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
    found = sorted(told.collect())
    return Boxes(np.array([r.cell for r in found], int), np.array([[r[c] for c in lows] for r in found]).reshape(-1, width), np.array([[r[c] for c in highs] for r in found]).reshape(-1, width))


class Moments(NamedTuple):
    """Per cell and label: rows, their mean, and their mean squared distance to it."""

    label: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def moments(rows: DataFrame, columns: Sequence[str], label: str, labels: Sequence, tree: Tree) -> Moments:
    """Moments of every cell and label; two scans, so that the spread is that around the mean."""
    names, width, place = list(columns), len(columns), {v: i for i, v in enumerate(labels)}
    sums = [f"s{i}" for i in range(width)]

    def slots(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(batch, names)
        own = np.array([place[v] for v in batch.column(label).to_pylist()], np.int64)
        return x, tree.locate(x) * len(labels) + own

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(tree.cells * len(labels), np.int64), np.zeros((tree.cells * len(labels), width))
        for batch in batches:
            x, slot = slots(batch)
            n += np.bincount(slot, minlength=len(n))
            np.add.at(total, slot, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *[pa.array(c) for c in total[some].T]], names=["slot", "n", *sums])

    rows = rows.select(label, *names)
    schema = ", ".join(["slot long", "n long", *[f"{s} double" for s in sums]])
    found = sorted(rows.mapInArrow(added, schema).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect())
    slot, n = np.array([r.slot for r in found], np.int64), np.array([r.n for r in found], np.int64)
    mean = np.array([[r[s] for s in sums] for r in found]).reshape(-1, width) / np.maximum(n, 1)[:, None]

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(slot))
        for batch in batches:
            x, own = slots(batch)
            at = np.searchsorted(slot, own)
            total += np.bincount(at, ((x - mean[at]) ** 2).sum(axis=1), len(slot))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total)], names=["slot", "d"])

    spread = {r.slot: r.d for r in rows.mapInArrow(apart, "slot long, d double").groupBy("slot").agg(F.sum("d").alias("d")).collect()}
    return Moments(slot % len(labels), n, mean, np.array([spread.get(s, 0.0) for s in slot.tolist()]) / np.maximum(n, 1))
