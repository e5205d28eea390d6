"""Vector codes: part-wise codebooks by Lloyd rounds that look at moved entries only.

Vectors become integers and are cut into equal consecutive parts; each part
position has a codebook of its own. A row keeps, for every part, its entry and
the exact squared distance to it. After a codebook update only some entries
have moved. A part whose entry stayed where it was still has its exact
distance, and no unmoved entry can have come closer, so it is compared with the
moved entries alone. A part whose entry moved is compared with all entries.
Both take the lower index among equals, so the codes are those of full rescans.

Rows with their state are a table in the shared folder; each round reads one,
writes the next and deletes the one before. The same pass adds up the parts of
every entry per task; these sums are combined on Spark and only the codebooks,
whose size does not depend on the rows, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelmill.llm.stores import Stores

#: Integer components are held in this range, so that squares and sums stay exact in 64 bits.
LARGEST = 1 << 25
_STEP = 1 << 13


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, within ``LARGEST``."""
    return F.transform(
        vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    )


def usable(vector: str) -> Column:
    """The vector is there, not empty, and every component is a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


class _Books:
    """The codebooks before and after an update: parts x entries x components."""

    def __init__(self, new: np.ndarray, old: np.ndarray | None):
        self.new = new
        self.moved = None if old is None else (new != old).any(axis=2)

    def _scan(self, x: np.ndarray, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest of some entries, the lower index among equals, and its distance."""
        best, least = np.full(len(x), entries[0]), None
        for e in entries:
            gap = x - self.new[part, e]
            distance = np.einsum("ij,ij->i", gap, gap)
            if least is None:
                least = distance
            else:
                closer = distance < least
                best[closer], least = e, np.where(closer, distance, least)
        return best, least

    def assign(self, x: np.ndarray, part: int, code: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New entry and exact distance of one part of all rows, from the entry and distance they had."""
        every = np.arange(self.new.shape[1])
        if self.moved is None:
            return self._scan(x, part, every)
        moved = self.moved[part]
        code, error = code.copy(), error.copy()
        stale = np.flatnonzero(moved[code])
        held = np.flatnonzero(~moved[code])
        if len(stale):
            code[stale], error[stale] = self._scan(x[stale], part, every)
        if len(held) and moved.any():
            other, distance = self._scan(x[held], part, np.flatnonzero(moved))
            take = (distance < error[held]) | (distance == error[held]) & (other < code[held])
            code[held[take]], error[held[take]] = other[take], distance[take]
        return code, error


def _round(books: _Books, width: int):
    """Assign every row, and give one row of sums per task and part."""
    parts, entries, length = books.new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, length), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            for low in range(0, batch.num_rows, _STEP):
                piece = batch.slice(low, _STEP)
                n = piece.num_rows
                x = piece.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, width)
                code = piece.column("codes").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts)
                error = piece.column("errors").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts)
                code, error = code.copy(), error.copy()
                for p in range(parts):
                    own = x[:, p * length : (p + 1) * length]
                    code[:, p], error[:, p] = books.assign(own, p, code[:, p], error[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(sums[p], code[:, p], own)
                made = {"codes": _lists(code, np.int32), "errors": _lists(error, np.int64)}
                columns = [made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) if f.name in ("part", "sums", "counts") else piece.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if schema is None:
            return
        told = {"part": list(range(parts)), "sums": [s.ravel().tolist() for s in sums], "counts": counts.tolist()}
        columns = [pa.array(told[f.name], f.type) if f.name in told else pa.nulls(parts, f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _lists(values: np.ndarray, kind: type) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().astype(kind)))


def _updated(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Every entry becomes the floor of the mean of its parts; an unused one stays."""
    told = state.where("part is not null")
    rows = told.select("part", F.posexplode("sums").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n")).collect()
    used = told.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n")).collect()
    sums, counts = np.zeros(book.shape, np.int64).reshape(len(book), -1), np.zeros(book.shape[:2], np.int64)
    for r in rows:
        sums[r.part, r.at] = r.n
    for r in used:
        counts[r.part, r.at] = r.n
    means = np.floor_divide(sums.reshape(book.shape), np.maximum(counts, 1)[:, :, None])
    return np.where(counts[:, :, None] > 0, means, book)


def digest(book: np.ndarray) -> str:
    """sha256 of all components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", columns: tuple[str, ...] = (), parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """(``key``, ``columns``, codes, errors) of every usable row, and the codebooks (parts x entries x components).

    codes holds the 0-based entry of each part, errors the exact squared
    distances. Rows are dropped whose vector is null, empty or holds null, NaN
    or infinite components, or whose length is not that of the row with the
    smallest key or not a multiple of ``parts``. Codebooks start from the
    ``entries`` smallest keys; of rows that repeat a key the smallest vector
    counts, and there are fewer entries if there are fewer keys. Rows without
    key are coded and count in the means, but start no entry unless no row has
    a key. Components beyond ``LARGEST`` after scaling are held there. An empty
    table gives no rows and empty codebooks. ``columns`` may have any names but
    those of this result.
    """
    spark = rows.sparkSession
    stores = Stores(spark)
    # Renamed first, so that no name of the caller can clash with a name used here.
    names = [f"c{i}" for i in range(len(columns))]
    kept = rows.select(F.col(key).alias("k"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col(vector).alias("v"))
    kept = kept.where(usable("v")).select("k", *names, integers("v", scale).alias("ints"))
    state = kept.select(
        "*",
        F.array_repeat(F.lit(0), parts).alias("codes"),
        F.array_repeat(F.lit(0).cast("long"), parts).alias("errors"),
        F.lit(None).cast("int").alias("part"),
        F.lit(None).cast("array<long>").alias("sums"),
        F.lit(None).cast("array<long>").alias("counts"),
    )
    state = stores.keep(state, "vectors")
    first = state.orderBy(F.col("k").isNull(), "k", "ints").select(F.size("ints").alias("n")).first()
    width = first.n if first else 0
    if width % parts:
        width = 0
    seeds = state.where(F.size("ints") == width).groupBy("k").agg(F.min("ints").alias("ints"))
    seeds = seeds.orderBy(F.col("k").isNull(), "k").limit(entries).collect() if width else []
    seeds = [s for s in seeds if s.k is not None] or seeds
    shown = [F.col("k").alias(key), *[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], "codes", "errors"]
    if not seeds:
        return state.limit(0).select(*shown), np.zeros((parts, 0, 0), np.int64)
    # parts x entries x components
    book = np.array([s.ints for s in seeds], np.int64).reshape(len(seeds), parts, -1).swapaxes(0, 1).copy()
    schema, before = state.schema, None
    for turn in range(rounds + 1):
        held = state.where(F.col("part").isNull() & (F.size("ints") == width))
        after = stores.keep(held.mapInArrow(_round(_Books(book, before), width), schema), "state")
        stores.drop(state)
        state = after
        if turn < rounds:
            before, book = book, _updated(state, book)
    return state.where("part is null").select(*shown), book


def coded(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """(``key``, code, error, label_error, codebooks_sha256) of every usable row.

    code holds two hex digits per part, error the sum of its squared distances,
    label_error the sum of error over the rows of an equal label (nulls
    together). Labels may be few and hot: their sums are combined per task, and
    the stored sums are small enough for Spark to send them to every task.
    """
    found, book = compressed(rows, key, vector, (label,), **options)
    stores = Stores(rows.sparkSession)
    total = F.aggregate("errors", F.lit(0).cast("long"), lambda s, x: s + x)
    hexes = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    # A label of NaN equals itself, a null label is a group of its own.
    told = found.select(F.col(key).alias("k"), F.col(label).alias("l"), hexes.alias("code"), total.alias("error"))
    sums = stores.keep(told.groupBy(F.col("l").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    both = told.join(sums, F.col("l").eqNullSafe(F.col("of")))
    return both.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
