"""NumPy kernels over Arrow text: word hashes, shingle hashes and their grouping by row.

Words follow one rule everywhere: bytes other than space and 0x09-0x0D, with
A-Z lower-cased. All work is vectorised over a whole Arrow batch in pieces of
bounded size; nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values (the splitmix64 steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=256)
def seeds(n: int, stream: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants of one stream; not to be changed in place."""
    start = np.uint64(stream << 32)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _lowered_values() -> np.ndarray:
    values = seeds(256, 1).copy()
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUE = _lowered_values()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(max(n, _STEP * 2), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and where each row starts; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if len(column) else pa.array([], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of every word; a row's border always separates words."""
    inside = ~_SPACE[raw]
    fresh = np.ones(len(raw) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    stops = np.ones(len(raw), bool)
    stops[:-1] = ~inside[1:] | fresh[1:-1] & inside[:-1]
    ends = np.flatnonzero(inside & stops) + 1
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each byte span (spans in order), letters A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _STEP, side="right")))
        high = ends[j - 1]
        up, down = _powers(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, np.uint64)
        np.cumsum(_VALUE[raw[low:high]] * up[: high - low], dtype=np.uint64, out=sums[1:])
        at = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[at]) * down[at]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each row (one more entry closes the last)."""
    raw, offsets = text_bytes(column)
    starts, ends = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, n: int, stream: int = 2) -> np.ndarray:
    """Hash of the ``n`` values that start at each position; the last n - 1 positions are cut."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k, factor in enumerate(seeds(n, stream)):
        total += hashes[k : k + len(total)] * factor
    return mix(total)


def shingles(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Per row the shingle hashes in text order; a short row is one shingle, an empty one none."""
    hashes, first = words(column)
    rolled = ngrams(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield rolled[a : b - size + 1]
        elif b > a:
            short = hashes[a:b]
            yield mix(np.sum(short * seeds(b - a, 16 + b - a), dtype=np.uint64, keepdims=True))
        else:
            yield rolled[:0]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
