"""Resampling towards a target: hashed n-gram weights by bit planes, then the highest scores.

Texts of the raw table and of the target are counted in hashed buckets; a
bucket's gain says how much likelier it is in the target. Gains are whole
numbers, so a document's weight is an exact integer sum.

The sum is bit-sliced. The bucket counts of a document become planes of one bit
per bucket: plane i holds bit i of every count. The gains become planes as
well, in two's complement, the last one counting negative. The weight is the
sum over both kinds of planes of 2 ** (i + j) times the number of buckets that
both have set, so a block of documents is weighted by AND and popcount alone.

The draw adds noise derived from the document's id to its weight and takes the
highest scores: sampling without replacement in proportion to the exponential
of the weight. Ranks come from running totals over ranges of the score, so
nothing is sorted in one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelmill.llm import kernels as K
from panelmill.llm.stores import Stores
from panelmill.operators.ranks import running_totals

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Longer words are hashed one by one.
_LONG = 48
_TEXT_STEP = 1 << 21
#: Documents whose planes are in memory at once.
_BLOCK = 256


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_on(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, continued from the (final) values in ``state``."""
    size = ends - starts
    out = state ^ np.uint32(0xFFFFFFFF)
    some = np.flatnonzero(size <= _LONG)
    some = some[np.argsort(-size[some], kind="stable")]
    at, left, value = starts[some], size[some], out[some]
    live = len(some)
    for step in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left[:live], -step, side="left"))  # spans longer than step come first
        value[:live] = _CRC[(value[:live] ^ raw[at[:live] + step]) & np.uint32(0xFF)] ^ (value[:live] >> np.uint32(8))
    out[some] = value
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def _spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of every word; a row's border always separates words."""
    inside = _WORD[raw]
    fresh = np.ones(len(raw) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    stops = np.ones(len(raw), bool)
    stops[:-1] = ~inside[1:] | fresh[1:-1]
    return starts, np.flatnonzero(inside & stops) + 1


class Features(NamedTuple):
    """The features of some rows in row order: the row and the bucket of each; and the words of each row."""

    row: np.ndarray
    bucket: np.ndarray
    words: np.ndarray


def features(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, Features]]:
    """Slices of a batch as (first row, features): all runs of 1 to ``longest`` words, repeats included."""
    raw, offsets = K.text_bytes(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _TEXT_STEP, side="right")) - 1)
        part, at = _LOWER[raw[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        starts, ends = _spans(part, at)
        owner = np.searchsorted(at, starts, side="right") - 1
        words = np.bincount(owner, minlength=high - low)
        state = crc_on(np.zeros(len(starts), np.uint32), part, starts, ends)
        rows, found, last = [owner], [state], np.arange(len(starts))
        for k in range(1, longest):
            # The run that starts at word i goes on with a space and word i + k of the same row.
            some = np.flatnonzero(owner[: max(0, len(owner) - k)] == owner[k:])
            blank = state[np.searchsorted(last, some)] ^ np.uint32(0xFFFFFFFF)
            blank = _CRC[(blank ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (blank >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
            state, last = crc_on(blank, part, starts[some + k], ends[some + k]), some
            rows.append(owner[some])
            found.append(state)
        yield low, Features(np.concatenate(rows), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), words)
        low = high


_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; each task sends its non-zero counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in features(batch.column(0), longest, buckets):
                counts += np.bincount(found.bucket, minlength=buckets)
        some = np.flatnonzero(counts)
        yield K.batch_of(_COUNTS, some.astype(np.int32), counts[some])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in rows.collect():
        counts[r.bucket] = r.n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of add-one bucket shares, target to raw."""
    s, t = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def planes(bits: np.ndarray) -> np.ndarray:
    """Rows of one flag per bucket as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    lacking = -packed.shape[-1] % 8
    if lacking:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], lacking), np.uint8)], axis=-1)
    return packed.view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Two's-complement planes of the gains and the factor of each, the last one negative."""
    size = max(1, int(np.abs(gain).max(initial=0)).bit_length())
    bits = (gain[None, :] >> np.arange(size + 1)[:, None]) & 1
    return planes(bits.astype(bool)), [*(1 << j for j in range(size)), -(1 << size)]


def weights(found: Features, gain: np.ndarray, factors: list[int], buckets: int) -> np.ndarray:
    """Exact weight of every row, by AND and popcount of count planes with gain planes."""
    n = len(found.words)
    out = np.zeros(n, np.int64)
    cells, counts = np.unique(found.row * buckets + found.bucket, return_counts=True)
    border = np.searchsorted(cells, np.arange(0, n + _BLOCK, _BLOCK) * buckets)
    for block in range(len(border) - 1):
        cell, count = cells[border[block] : border[block + 1]], counts[border[block] : border[block + 1]]
        i = 0
        while len(cell):
            rows, place = np.unique(cell // buckets, return_inverse=True)
            odd = (count & 1).astype(bool)
            flags = np.zeros((len(rows), buckets), bool)
            flags[place[odd], cell[odd] % buckets] = True
            held = planes(flags)
            for plane, factor in zip(gain, factors, strict=True):
                out[rows] += np.bitwise_count(held & plane).sum(axis=1, dtype=np.int64) * (factor * (1 << i))
            left = count > 1
            cell, count, i = cell[left], count[left] >> 1, i + 1
    return out


def noise(ids: list, seed: str) -> np.ndarray:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256 of ``seed:id``."""
    out = np.empty(len(ids), np.int64)
    for i, x in enumerate(ids):
        h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).digest()[:4], "big")
        out[i] = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    return out


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("words", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, words, weight, score) of every row of ``docs``; the key is a long.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond
    ASCII. A null or wordless text has no features and weight 0. A null key
    takes the noise of an empty id. Repeated rows are scored alike. Empty
    tables are counted as such: gains then follow the other table alone.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    sliced, factors = gain_planes(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in features(batch.column(1), longest, buckets):
                n = len(found.words)
                ids = batch.column(0).slice(low, n)
                weight = weights(found, sliced, factors, buckets)
                total = np.bincount(found.row, minlength=n)
                yield K.batch_of(_SCORED, ids, total, found.words, weight, weight + noise(ids.to_pylist(), seed))

    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_features long, words long, weight long, score long")


def _ranked(rows: DataFrame, wanted: int, stores: Stores) -> tuple[DataFrame, int]:
    """The rows that may be among the ``wanted`` highest, with rank, and the least score of them.

    Ranks go by falling score, then rising doc_id (nulls last). Rows that agree
    in all columns are counted before they are ordered, so a repeated row is one.
    """
    per_score = stores.keep(rows.groupBy("score").agg(F.count("*").alias("here")), "scores")
    upto = running_totals(per_score, "score", {"upto": "here"}, descending=True)
    ahead = upto.select("score", (F.col("upto") - F.col("here")).alias("ahead")).where(F.col("ahead") < wanted)
    ahead = stores.keep(ahead, "ahead")
    least = ahead.agg(F.min("score")).first()[0]
    alike = rows.where(F.col("score") >= least).groupBy("score", "doc_id", "n_features", "weight").agg(F.count("*").alias("times"))
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").isNull(), "doc_id", "n_features")
    last = F.col("ahead") + F.sum("times").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = alike.join(ahead, "score").withColumn("last", last)
    numbered = numbered.withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("times") + 1, F.col("last"))))
    return numbered.drop("times", "ahead", "last"), least


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Of the N rows with ``least_words`` words or more the floor(percent * N / 100)
    highest scores are drawn, equal scores by the smaller doc_id, rows without
    doc_id after the others.
    """
    stores = Stores(docs.sparkSession)
    all_rows = stores.keep(scored(docs, target, **options), "scored")
    shown = ["doc_id", "n_features", "weight", "score"]
    fit = all_rows.where(F.col("words") >= least_words)
    wanted = fit.count() * percent // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return all_rows.select(*shown, undrawn)
    ranked, least = _ranked(fit, wanted, stores)
    drawn = F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank")
    rest = all_rows.where((F.col("words") < least_words) | (F.col("score") < least))
    return ranked.select(*shown, drawn).unionByName(rest.select(*shown, undrawn))
