"""Find benchmark items in documents: SimHash of item-sized windows, Hamming blocks, exact verification.

Items of similar length form a class with a window and a step s. Documents are
fingerprinted at every step, items at every offset, so that some pair of windows
begins at the same word of the item. Two kinds of windows lead to candidates:

* Item-sized windows (``WHOLE``): as long as the shortest item of the class less the
  step. At similarity 0.75 a passage has some 2 to 6 of 100 words of its item
  changed, which flips 4 to 7 of the 64 bits, a share of arccos(cosine) / pi of
  them. So fingerprints within ``WHOLE_RADIUS`` are candidates: cut into one block
  more than that, two of them agree in at least one block, and looking up each
  block finds all within the radius. Items under ``WHOLE_WORDS`` words have no windows
  of this kind, as a single word is too large a part of them.
* Windows of an unchanged run (``RUNS``). A passage at similarity 0.75 of an item
  of M shingles that breaks off e times has at least 0.75 M + 3 e shingles in
  common with it: each break, be it changed, added, missing or moved words, costs
  both sides four shingles or more, as long as no words repeat right at it. So
  one of its e + 1 runs has ``_run_of`` words or more, and the window fits the
  smallest such run of the class. That run is found at distance 0, in four blocks for a radius of 3.

Candidates are aligned with the whole item; all passages around them, of every start
and length, are verified by the weighted Jaccard similarity of their five-word
shingles, each weighing as often as it occurs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelmill.llm import kernels as K

RUNS, WHOLE = "runs", "whole"
RADIUS = 3
WHOLE_RADIUS = 8
WHOLE_WORDS = 20
SHINGLE = 5
SIMILARITY = 0.75
#: Fingerprints of items in one broadcast index; more items take more passes over the documents.
INDEX_SIZE = 1 << 18
_CHUNK = 1 << 13
#: Words of a batch whose windows are in memory at once.
_WORDS = 1 << 19
_GROWTH = {RUNS: 1.4, WHOLE: 1.2}


class _Class(NamedTuple):
    """Items of one range of lengths: window, step, and their fingerprints by block value."""

    window: int
    step: int
    radius: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    heads: list[np.ndarray]  # per block, where the entries of each of its values begin
    entries: list[np.ndarray]


class Index(NamedTuple):
    ids: list
    words: list[np.ndarray]
    shingles: list[Counter]
    classes: list[_Class]


def _run_of(length: int) -> int:
    """Words that some unchanged run has at least, in any passage at ``SIMILARITY`` of an item of ``length`` words."""
    if length <= SHINGLE:
        return length
    shingles = length - SHINGLE + 1
    lost = SHINGLE - 1  # by each side at a break
    breaks = int(shingles * (1 - SIMILARITY) / (lost * (1 + SIMILARITY)))
    common = [SIMILARITY * (shingles + lost * e) / (e + 1) for e in range(breaks + 1)]
    return math.ceil(min(common) - 1e-9) + SHINGLE - 1


def _window_of(shortest: int, way: str) -> tuple[int, int]:
    """Window and step of the items from ``shortest`` words to the next class."""
    if way == WHOLE:
        step = max(1, shortest // 8)
        return shortest + 1 - step, step
    run = min(_run_of(n) for n in range(shortest, int(shortest * _GROWTH[RUNS]) + 1))
    step = max(1, (run + 1) // 3)
    return run + 1 - step, step


def _prints(hashes: np.ndarray, wanted: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """SimHash of the windows (rising starts, words) over the same hashes: bit by bit the majority of a window's words.

    Running totals of the 64 bits serve all windows, so the work hardly depends on their lengths.
    """
    out = [np.empty(len(starts), np.uint64) for starts, _ in wanted]
    longest = max((w for _, w in wanted), default=0)
    # Counters of 16 bits are added four at a time as one 64-bit number; no chunk is long enough for one to overflow.
    kind, chunk = (np.uint16, max(_CHUNK, longest)) if longest < 1 << 15 else (np.uint32, 4 * longest)
    for low in range(0, len(hashes), chunk):
        spans = [np.searchsorted(starts, [low, low + chunk]) for starts, _ in wanted]
        if not any(b > a for a, b in spans):
            continue
        bits = np.unpackbits(hashes[low : low + chunk + longest].view(np.uint8).reshape(-1, 8), axis=1).astype(kind).view(np.uint64)
        totals = np.zeros((len(bits) + 1, bits.shape[1]), np.uint64)
        np.cumsum(bits, axis=0, out=totals[1:])
        for (starts, window), (a, b), prints in zip(wanted, spans, out, strict=True):
            at = starts[a:b] - low
            sums = totals[at + window]
            sums -= totals[at]
            prints[a:b] = np.packbits(sums.view(kind) > window // 2, axis=1).view(np.uint64).ravel()
    return out


def _blocks(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """The values of ``radius`` + 1 blocks that cover the 64 bits, and how many values each can have."""
    borders = [64 * b // (radius + 1) for b in range(radius + 2)]
    return [(((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64), 1 << (b - a)) for a, b in zip(borders[:-1], borders[1:], strict=True)]


def _shingle_counts(hashes: np.ndarray) -> Counter:
    return Counter(K.ngrams(hashes, min(SHINGLE, len(hashes)), stream=4).tolist())


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: what both have over what either has."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def build(items: list[tuple[object, str]], ways: tuple[str, ...] = (RUNS, WHOLE)) -> Index:
    """The index of items (id, text) with at least one word."""
    column = pa.array([t for _, t in items], pa.large_string())
    hashes, first = K.words(column)
    kept = [(i, hashes[a:b]) for (i, _), a, b in zip(items, first[:-1], first[1:], strict=True) if b > a]
    classes = [c for way in ways for c in _classes([w for _, w in kept], way)]
    return Index([i for i, _ in kept], [w for _, w in kept], [_shingle_counts(w) for _, w in kept], classes)


def _classes(words: list[np.ndarray], way: str) -> Iterator[_Class]:
    least, radius = (WHOLE_WORDS, WHOLE_RADIUS) if way == WHOLE else (1, RADIUS)
    by_class: dict[int, list[int]] = {}
    for place, ws in enumerate(words):
        shortest = least
        while int(shortest * _GROWTH[way]) + 1 <= len(ws):
            shortest = int(shortest * _GROWTH[way]) + 1
        if len(ws) >= least:
            by_class.setdefault(shortest, []).append(place)
    for shortest, places in sorted(by_class.items()):
        window, step = _window_of(shortest, way)
        prints, item, offset = [], [], []
        for place in places:
            starts = np.arange(len(words[place]) - window + 1)
            prints += _prints(words[place], [(starts, window)])
            item.append(np.full(len(starts), place))
            offset.append(starts)
        prints, item, offset = np.concatenate(prints), np.concatenate(item), np.concatenate(offset)
        heads, entries = [], []
        for values, kinds in _blocks(prints, radius):
            entries.append(np.argsort(values, kind="stable"))
            heads.append(np.searchsorted(values[entries[-1]], np.arange(kinds + 1)))
        yield _Class(window, step, radius, prints, item, offset, heads, entries)


def _candidates(index: Index, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Different (row, item, aligned start in the row's words) whose fingerprints lie within the radius."""
    found, low = [], 0
    while low < len(first) - 1:
        high = max(low + 1, int(np.searchsorted(first, first[low] + _WORDS, side="right")) - 1)
        own = _near(index, hashes[first[low] : first[high]], first[low : high + 1] - first[low])
        found += [part + np.array([low, 0, 0]) for part in own]
        low = high
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _near(index: Index, hashes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    sizes = np.diff(first)
    wanted, rows = [], []
    for c in index.classes:
        counts = np.maximum(0, (sizes - c.window) // c.step + 1)
        row = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        wanted.append((first[row] + nth * c.step, c.window))
        rows.append(row)
    for c, row, (starts, _), prints in zip(index.classes, rows, wanted, _prints(hashes, wanted), strict=True):
        for b, (values, _) in enumerate(_blocks(prints, c.radius)):
            n = c.heads[b][values + 1] - c.heads[b][values]
            hit = np.flatnonzero(n)
            for low in range(0, len(hit), 1 << 18):
                some = hit[low : low + (1 << 18)]
                whose = np.repeat(some, n[some])
                step = np.arange(len(whose)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                entry = c.entries[b][c.heads[b][values[whose]] + step]
                near = np.bitwise_count(prints[whose] ^ c.prints[entry]) <= c.radius
                whose, entry = whose[near], entry[near]
                yield np.stack([row[whose], c.item[entry], starts[whose] - first[row[whose]] - c.offset[entry]], axis=1)


def _best(ws: np.ndarray, length: int, goal: Counter, low: int, high: int, threshold: float) -> tuple[float, int, int]:
    """The best similarity to the item of any passage within words ``low`` to ``high``; 0 if none reaches the threshold.

    Passages of every start and length are compared. The best one begins and ends
    with shingles of the item, so only those are tried as borders.
    """
    n, total = min(SHINGLE, length), sum(goal.values())
    low = max(0, low)
    found = K.ngrams(ws[low:high], n, stream=4)
    kinds = np.array(list(goal), np.uint64)
    kinds.sort()
    kind = np.minimum(np.searchsorted(kinds, found), len(kinds) - 1)
    at = np.flatnonzero(kinds[kind] == found) if len(found) else np.zeros(0, np.int64)
    kind, wanted = kind[at], np.array([goal[k] for k in kinds.tolist()])
    need, widest = total * threshold - 1e-9, total / threshold + 1e-9
    best = (0.0, 0, 0)
    if not len(at) or np.minimum(np.bincount(kind, minlength=len(kinds)), wanted).sum() < need:
        return best
    order = np.argsort(kind, kind="stable")
    sizes = np.bincount(kind, minlength=len(kinds))
    nth = np.empty(len(at), np.int64)  # how many of its kind stand before
    nth[order] = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passed = np.zeros(len(kinds), np.int64)
    ends = np.searchsorted(at, at + widest, side="left")
    for i in range(len(at)):
        if ends[i] - i >= need:
            own = kind[i : ends[i]]
            both = np.cumsum(nth[i : ends[i]] - passed[own] < wanted[own])
            near = both / (total + at[i : ends[i]] - at[i] + 1 - both)
            k = int(np.argmax(near))
            if near[k] > best[0]:
                best = float(near[k]), int(low + at[i]), int(low + at[i + k] + n)
                if near[k] == 1:
                    break
        passed[kind[i]] += 1
    return best if best[0] >= threshold else (0.0, 0, 0)


def _leaks(index: Index, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, end word): the best place of each item in each row of the batch."""
    hashes, first = K.words(column)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    regions: dict[tuple[int, int], list[list[int]]] = {}
    for row, item, start in _candidates(index, hashes, first).tolist():
        length = len(index.words[item])
        widest = int(length / threshold) + SHINGLE
        low, high = start - widest, start + length + widest
        own = regions.setdefault((row, item), [])
        if own and low <= own[-1][1]:  # starts come in order
            own[-1][1] = high
        else:
            own.append([low, high])
    for (row, item), spans in regions.items():
        for low, high in spans:
            now = _best(hashes[first[row] : first[row + 1]], len(index.words[item]), index.shingles[item], low, high, threshold)
            if now[0] > best.get((row, item), (0.0,))[0]:
                best[row, item] = now
                if now[0] == 1:
                    break
    for (row, item), place in sorted(best.items()):
        yield (row, item, *place)


def indexes(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """The benchmark, read in blocks of bounded size, each as one index."""
    block, size = [], 0
    for r in items.select(F.col(key).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        block.append((r.i, r.t))
        size += r.t.count(" ") + 1
        if size > INDEX_SIZE:
            yield build(block)
            block, size = [], 0
    if block:
        yield build(block)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word) of every document and item it holds, at its best place.

    Null and wordless texts and items hold nothing; items of fewer than five
    words are one shingle. Rows without a key and repeated rows are reported like any
    other; equal items are each reported. Other columns are ignored. The
    documents are read once per block of items and never shuffled.
    """
    spark = docs.sparkSession
    schema = docs.select(F.col(key).alias("doc_id")).schema.add(items.schema[item_key].name, items.schema[item_key].dataType)
    schema = schema.add("similarity", "double").add("first_word", "long").add("end_word", "long")
    out = None
    for index in indexes(items, item_key, text):
        found = docs.select(key, text).mapInArrow(_reporter(spark.sparkContext.broadcast(index), item_key, threshold), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _reporter(held, item_key: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_leaks(held.value, batch.column(1), threshold))
            rows, items, near, low, high = zip(*found, strict=True) if found else ((), (), (), (), ())
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            made = [pa.array([held.value.ids[i] for i in items], pa.int64()), pa.array(near, pa.float64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
            yield pa.RecordBatch.from_arrays([keys, *made], names=["doc_id", item_key, "similarity", "first_word", "end_word"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; nothing is shuffled."""
    place, names, spark = docs.columns.index(text), docs.columns, docs.sparkSession

    def cleaner(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _leaks(held.value, batch.column(place), threshold)]] = False
                kept = batch.filter(pa.array(clean))
                yield pa.RecordBatch.from_arrays(kept.columns, names=names)

        return run

    for index in indexes(items, item_key, text):
        docs = docs.mapInArrow(cleaner(spark.sparkContext.broadcast(index)), docs.schema)
    return docs
