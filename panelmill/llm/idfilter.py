"""A bit table of ids, to leave out rows before they are shuffled to a join.

The table has ``2 ** WORD_BITS`` words of 64 bits, 8 MB at every scale. It never
loses an id; the more ids it holds, the more others pass as well, which costs
time in the join that follows but changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WORD_BITS = 20


def _word(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << WORD_BITS) - 1))


def passing(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``column`` may be in the one column of ``ids`` (long, no nulls)."""
    hashed = F.xxhash64(F.col(ids.columns[0]))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {WORD_BITS}) & 63 as int))")
    made = ids.select(hashed.alias("h")).select(_word(F.col("h")).alias("word"), bit.alias("bits"))
    made = made.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << WORD_BITS, np.int64)
    table[made.column("word").to_numpy()] = made.column("bits").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            bits = held.value[h & ((1 << WORD_BITS) - 1)].view(np.uint64)
            found = bits >> ((h.view(np.uint64) >> np.uint64(WORD_BITS)) & np.uint64(63)) & np.uint64(1)
            kept = batch.filter(pa.array(found.astype(bool)))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    names = rows.columns
    return rows.where(F.col(column).isNotNull()).withColumn("__h", F.xxhash64(column)).mapInArrow(run, rows.schema)
