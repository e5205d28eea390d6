"""Fitted Spark ML forests as arrays, which score many rows at a time.

Spark walks every tree node by node for each row. Here the rows of a task go down a
tree together. A split only asks which of its feature's few cut points a number
passes, so features become small bin numbers once, and each node holds the set of
bins that go left as bits. Votes are added up tree by tree in Spark's order, so
the scores are those of the fitted model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelmill.session import ensure_checkpoint_dir, owned

#: Bins that the bits of a node can name.
BINS = 64
#: Rows that go down the trees together.
HELD = 1 << 15


class Forest(NamedTuple):
    """Nodes of all trees; the right child follows the left one, and a leaf leads to itself."""

    start: np.ndarray
    feature: np.ndarray
    goes_left: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    place: np.ndarray
    values: np.ndarray
    cuts: dict[int, np.ndarray | None]
    width: int

    def bins(self, at: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Bin of every (row, feature) from the entries that are told; the others are 0.0."""
        zero = np.array([0 if (c := self.cuts.get(f)) is None else np.searchsorted(c, 0.0) for f in range(self.width)], np.uint8)
        found = np.tile(zero, (rows, 1))
        order = np.argsort(feature, kind="stable")
        at, feature, value = at[order], feature[order], value[order]
        borders = np.searchsorted(feature, np.arange(self.width + 1))
        for f, cuts in self.cuts.items():
            part = slice(borders[f], borders[f + 1])
            found[at[part], f] = np.clip(value[part], 0, BINS - 1) if cuts is None else np.searchsorted(cuts, value[part])
        return found

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of all trees for each row."""
        total = np.zeros((len(bins), self.values.shape[1]))
        flat, base = bins.ravel(), np.arange(len(bins)) * self.width
        for low, high in zip(self.start[:-1], self.start[1:], strict=True):
            feature, goes_left, child, leaf = (a[low:high] for a in (self.feature, self.goes_left, self.child, self.leaf))
            node, row, origin = np.zeros(len(bins), np.intp), np.arange(len(bins)), base
            ended = np.zeros(len(bins), np.intp)
            while len(row):
                for _ in range(2):
                    left = (goes_left.take(node) >> flat.take(origin + feature.take(node))) & np.uint64(1)
                    node = child.take(node) + 1 - left.astype(np.intp)
                over = leaf.take(node)
                ended[row[over]] = node[over]
                on = np.flatnonzero(~over)
                node, row, origin = node.take(on), row.take(on), origin.take(on)
            total += self.values.take(self.place[low:high].take(ended), axis=0)
        return total


def _stage(model: PipelineModel) -> int | None:
    for i, s in enumerate(model.stages):
        if isinstance(s, RandomForestClassificationModel | RandomForestRegressionModel):
            return i
    return None


def read(spark: SparkSession, stage) -> Forest | None:
    """The nodes of a fitted forest; None where a feature has more bins than a node can name."""
    ensure_checkpoint_dir(spark)
    path = owned(spark, f"{spark.sparkContext.getCheckpointDir()}/panelmill-{uuid.uuid4().hex}")
    stage.write().save(path)
    told = spark.read.parquet(f"{path}/data").select(
        "treeID", *[F.col(f"nodeData.{c}").alias(c) for c in ("id", "prediction", "impurityStats", "leftChild", "rightChild")],
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("cut"),
        F.col("nodeData.split.numCategories").alias("categories"),
    )
    votes = isinstance(stage, RandomForestClassificationModel)
    table = told.drop("prediction" if votes else "impurityStats").toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")]).combine_chunks()
    get = lambda name: table.column(name).to_numpy()
    tree, left, right, feature, categories = (get(c) for c in ("treeID", "leftChild", "rightChild", "feature", "categories"))
    start = np.searchsorted(tree, np.arange(stage.getNumTrees + 1))
    leaf = left < 0
    if votes:
        stats = table.column("impurityStats").combine_chunks().flatten().to_numpy().reshape(len(tree), -1)
        total = stats.sum(axis=1, keepdims=True)
        values = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    else:
        values = get("prediction")[:, None]
    cut = table.column("cut").combine_chunks()
    offset, flat = cut.offsets.to_numpy(), cut.flatten().to_numpy()
    inner = np.flatnonzero(~leaf)
    goes_left, cuts = np.full(len(tree), ~np.uint64(0)), {}
    for f in np.unique(feature[inner]).tolist():
        own = inner[feature[inner] == f]
        if (categories[own] >= 0).any():
            if categories[own].max() > BINS:
                return None
            cuts[f] = None
            goes_left[own] = [sum(1 << int(c) for c in flat[offset[i] : offset[i + 1]]) for i in own]
        else:
            bounds, bin_ = np.unique(flat[offset[own]], return_inverse=True)
            if len(bounds) >= BINS:
                return None
            cuts[f] = bounds
            # Numbers up to bound number b fall in bins 0 to b.
            goes_left[own] = [(1 << (int(b) + 1)) - 1 for b in bin_]
    # New numbers within each tree: the root is 0, children of its inner nodes follow in pairs.
    new = np.zeros(len(tree), np.intp)
    first = start[tree[inner]]
    pair = 1 + 2 * (np.arange(len(inner)) - np.searchsorted(inner, first))
    new[first + left[inner]], new[first + right[inner]] = pair, pair + 1
    child = new.copy()
    child[inner] = pair
    to = start[tree] + new
    moved = lambda a: a[np.argsort(to)]
    kept = np.cumsum(moved(leaf)) - 1
    return Forest(
        start, moved(np.maximum(feature, 0)).astype(np.int32), moved(goes_left), moved(child).astype(np.int32), moved(leaf),
        kept.astype(np.int32), moved(values)[moved(leaf)], cuts, stage.numFeatures,
    )


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all numbers that a column of Spark's vectors tells."""
    kind, index, value = (vectors.field(i) for i in (0, 2, 3))
    sizes = np.diff(value.offsets.to_numpy())
    row = np.repeat(np.arange(len(vectors)), sizes)
    sparse = (kind.to_numpy(zero_copy_only=False) == 0)[row]
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    feature[sparse] = index.flatten().to_numpy()
    return row, feature, value.flatten().to_numpy()


def scored(df: DataFrame, model: PipelineModel, keys: Sequence[str]) -> DataFrame | None:
    """``keys``, ``votes`` (the sums over all trees of class shares, or the sum of predictions); None where there is no such forest."""
    at = _stage(model)
    forest = None if at is None else read(df.sparkSession, model.stages[at])
    if forest is None:
        return None
    features = model.stages[at].getFeaturesCol()
    ready = PipelineModel(model.stages[:at]).transform(df).select(*keys, F.col(features).alias("__features"))
    kept = [f"k{i}" for i in range(len(keys))]
    schema = df.select(*keys).toDF(*kept).schema.add("votes", T.ArrayType(T.DoubleType()))

    def told(batches: Sequence[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [entries(b.column(len(kept))) for b in batches]
        low = np.cumsum([0, *[b.num_rows for b in batches]])
        row = np.concatenate([r + a for (r, _, _), a in zip(found, low)])
        feature, value = (np.concatenate([x[i] for x in found]) for i in (1, 2))
        votes = forest.votes(forest.bins(row, feature, value, int(low[-1])))
        width = votes.shape[1]
        for b, a in zip(batches, low):
            own = votes[a : a + b.num_rows]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, width), pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], lists], names=[*kept, "votes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                yield from told(held)
                held, rows = [], 0
        if rows:
            yield from told(held)

    return ready.toDF(*kept, "__features").mapInArrow(run, schema).toDF(*keys, "votes")
