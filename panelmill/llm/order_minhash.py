"""Order MinHash fingerprints: minimal k-mers kept in text order, sensitive to edit distance.

Every k-mer of code points is numbered by its occurrence, so repeats count. A
hash of (k-mer, number) deals the k-mers into ``SIGNATURES`` bins by its leading
bits; from each bin, and on through the next ones if it has too few, the ``TUPLE``
smallest are taken, put back into text order, and hashed together. One sort of
a text serves all signatures. Likeness is the share of equal signatures, taken
to the power 1 / TUPLE so that it reads as a share of common k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelmill.llm import kernels as K

KMER = 6
SIGNATURES = 64
TUPLE = 2
_PLACE = 21
_MASK = np.uint64((1 << _PLACE) - 1)
_STARTS = np.arange(SIGNATURES, dtype=np.uint64) << np.uint64(58)
_STEPS = np.arange(TUPLE)
_NUMBER = np.uint64(0xD6E8FEB86659FD93)
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _ordered(high: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``high`` (its top 43 bits) and ``places``, sorted by both."""
    if len(high) <= 1 << _PLACE:
        both = np.sort((high & ~_MASK) | places)
        return both >> np.uint64(_PLACE), both & _MASK
    order = np.lexsort((places, high >> np.uint64(_PLACE)))
    return high[order] >> np.uint64(_PLACE), places[order]


def signatures(text: str) -> np.ndarray:
    """The signatures of a text, 16 bits each; the empty text has signatures of its own."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return np.zeros(SIGNATURES, np.uint16)
    grams = K.ngrams(points, min(KMER, len(points)), stream=5)
    value, place = _ordered(grams, np.arange(len(grams), dtype=np.uint64))
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    index = np.arange(len(value))
    number = index - np.maximum.accumulate(np.where(fresh, index, 0))
    value, place = _ordered(K.mix(value + number.astype(np.uint64) * _NUMBER), place)
    first = np.searchsorted(value, _STARTS >> np.uint64(_PLACE))
    picked = (first[:, None] + _STEPS) % len(value)
    in_order = np.argsort(place[picked], axis=1, kind="stable")
    tuples = np.take_along_axis(value[picked], in_order, axis=1)
    return (K.mix((tuples * K.seeds(TUPLE, 6)).sum(axis=1, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b)) ** (1 / TUPLE)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, after, doc_id, text) in order: each row meets the one that follows it in its part."""
    waiting = None

    def told(row, following):
        part, doc, text, own = row
        text2, next_own = following
        changed = edited(text, text2)
        other = own if changed == text else signatures(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), digest, own.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(own, other), likeness(own, next_own)

    for batch in batches:
        rows = []
        for part, after, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if after and waiting is None:
                continue
            own = signatures(text)
            if waiting is not None:
                rows.append(told(waiting, (text, own)))
                waiting = None
            if not after:
                waiting = part, doc, text, own
        yield K.batch_of(_OUT, *(zip(*rows, strict=True) if rows else [()] * 7))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``docs`` (doc_id: long, text) and of its edited text.

    Rows follow each other by descending doc_id, equal doc_ids by text, rows
    without doc_id last; after the last comes the first. A null text is empty.
    Texts shorter than a k-mer are one k-mer. Equal texts have equal
    fingerprints. A table of one row follows itself; an empty one stays empty.
    Other columns are ignored.

    The ids are cut into ranges; the first row of each range also goes to the
    range before it, so that no range has to see another. Texts are shuffled
    once, and a task holds two texts at a time.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    inside = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    # Ranges count from the largest doc_ids; rows without doc_id share the last one.
    dealt = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(inside))
    heads = {r.part: r.head for r in dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    has_null = heads.pop(None, "absent") != "absent"
    order = sorted(heads)
    last = order[-1] if order else 0
    dealt = dealt.withColumn("part", F.coalesce("part", F.lit(last)))
    before = {part: order[i - 1] for i, part in enumerate(order)}
    wanted = [(heads[p], before[p]) for p in order]
    if wanted:
        to = F.create_map(*[F.lit(x) for pair in wanted for x in pair])
        after = rows.where(F.col("doc_id").isin([head for head, _ in wanted])).withColumn("part", to[F.col("doc_id")])
    else:
        after = rows.where(F.col("doc_id").isNull()).withColumn("part", F.lit(0)) if has_null else rows.limit(0).withColumn("part", F.lit(0))
    both = dealt.withColumn("after", F.lit(0)).unionByName(after.withColumn("after", F.lit(1)))
    both = both.select("part", "after", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sent = both.repartition("part").sortWithinPartitions("part", "after", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(_walk, schema)
