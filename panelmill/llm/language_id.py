"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character 4-gram model: the highest order uses counts, the
lower ones the number of different characters seen before (continuation
counts), and every order gives part of its mass to the next. Counts come from
all training rows, and no n-gram is left out. A model is kept as sorted arrays of hashed n-grams with one
column of log probabilities per language, read by binary search. A text gets
the language of lowest cross-entropy per character; a text whose
cross-entropy lies far above what its language shows in training is marked as
rejected.

Characters are lower-cased letters; runs of anything else are one space. Three
border marks stand before a text, one end mark after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelmill.llm import kernels as K
from panelmill.llm.stores import Stores

#: Temperatures of the scores; that of the lowest log loss over the training rows is taken.
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
_SLICE = 1 << 21
_BORDER, _SPACE = 1, 32
_SHIFT = np.uint64(16)


def _letter_codes() -> np.ndarray:
    codes = np.full(1 << 16, _SPACE, np.uint16)
    letters = np.array([c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    codes[letters] = letters
    codes[_BORDER] = _BORDER
    return codes


_CODES = _letter_codes()


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The scored 4-grams of all texts in order, and the text each belongs to."""
    marks = "\x01\x01\x01"
    joined = marks + marks.join(t.replace("\x01", " ").lower() for t in texts) + marks
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    codes = _CODES[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):  # letters beyond the basic plane share the private area
        codes[i] = 0xE000 + points[i] % 0x1000 if chr(points[i]).isalpha() else _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    codes = codes[keep].astype(np.uint64)
    keys = (((codes[:-3] << _SHIFT | codes[1:-2]) << _SHIFT | codes[2:-1]) << _SHIFT) | codes[3:]
    scored = (codes[2:-1] != _BORDER) | (codes[3:] != _BORDER)
    begins = np.flatnonzero(codes == _BORDER)[: 3 * len(texts) : 3]
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, len(keys))))
    return keys[scored], owner[scored]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _SLICE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 3
    if first < len(texts):
        yield first, texts[first:]


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            parts = seen.setdefault(lang, [])
            for _, piece in _slices(texts):
                parts.append(np.unique(_grams(piece)[0], return_counts=True))
            if sum(len(k) for k, _ in parts) > 1 << 20:
                seen[lang] = [_merge(parts)]
    for lang, parts in seen.items():
        keys, n = _merge(parts)
        for low in range(0, len(keys), 1 << 16):
            some = slice(low, low + (1 << 16))
            yield K.batch_of(_COUNTS, [lang] * len(keys[some]), K.signed(keys[some]), n[some])


class Order(NamedTuple):
    """One order of the models: sorted hashes, the log probabilities of its n-grams, and those of its contexts' rest."""

    grams: np.ndarray
    probability: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


class Models(NamedTuple):
    langs: list[str]
    orders: list[Order]  # 4, 3, 2, 1
    temperature: float
    limits: np.ndarray


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed = K.mix(keys)
    order = np.argsort(hashed)
    return hashed[order], order


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed = K.mix(keys)
    at = np.minimum(np.searchsorted(table, hashed), max(0, len(table) - 1))
    return at, table[at] == hashed if len(table) else np.zeros(len(keys), bool)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def kneser_ney(langs: list[str], lang: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[Order]:
    """All orders of the models from 4-gram counts; ``lang`` gives the model of each entry."""
    size = len(np.unique(keys & np.uint64(0xFFFF))) + 1
    per_lang = []
    for i in range(len(langs)):
        own = lang == i
        k, n = keys[own], counts[own].astype(float)
        levels = []
        for order in (4, 3, 2, 1):
            levels.append((k, n))
            if order > 1:
                lower = k & np.uint64((1 << 16 * (order - 1)) - 1)
                k, n = np.unique(lower, return_counts=True)
                n = n.astype(float)
        per_lang.append(levels)
    floor = -np.log(size)
    tables: list[Order] = []
    for depth in (3, 2, 1, 0):  # from single characters upwards
        union = np.unique(np.concatenate([levels[depth][0] for levels in per_lang]))
        hashed, order = _sorted(union)
        above = np.unique(union >> _SHIFT)
        hashed_above, order_above = _sorted(above)
        union, above = union[order], above[order_above]
        probability = np.empty((len(union), len(langs)))
        rest = np.zeros((len(above), len(langs)))
        lower = union & np.uint64((1 << 16 * (3 - depth)) - 1)
        for i, levels in enumerate(per_lang):
            k, n = levels[depth]
            d = _discount(n)
            context, which = np.unique(k >> _SHIFT, return_inverse=True)
            total = np.bincount(which, n)
            share = d * np.bincount(which) / total
            at = np.searchsorted(context, above)
            at_safe = np.minimum(at, max(0, len(context) - 1))
            known = context[at_safe] == above if len(context) else np.zeros(len(above), bool)
            rest[known, i] = np.log(share[at_safe[known]])
            below = np.full(len(union), floor) if depth == 3 else scores(tables, lower)[:, i]
            place = np.searchsorted(above_sorted := np.sort(above), union >> _SHIFT)
            up = np.argsort(above)[place]
            assert (above_sorted[place] == union >> _SHIFT).all()
            p = np.exp(below + rest[up, i])
            own = np.searchsorted(k, union)
            own_safe = np.minimum(own, max(0, len(k) - 1))
            has = k[own_safe] == union if len(k) else np.zeros(len(union), bool)
            p[has] += np.maximum(n[own_safe[has]] - d, 0) / total[which[own_safe[has]]]
            probability[:, i] = np.log(p)
        tables.insert(0, Order(hashed, probability.astype(np.float32), hashed_above, rest.astype(np.float32)))
    return tables


def scores(tables: list[Order], keys: np.ndarray) -> np.ndarray:
    """Log probabilities (n-gram, language); an unseen n-gram takes its context's rest times the lower order."""
    table = tables[0]
    at, hit = _find(table.grams, keys)
    out = np.zeros((len(keys), table.probability.shape[1]), np.float32)
    out[hit] = table.probability[at[hit]]
    missed = np.flatnonzero(~hit)
    if len(missed):
        over, known = _find(table.contexts, keys[missed] >> _SHIFT)
        out[missed[known]] = table.rest[over[known]]
        if len(tables) > 1:
            width = np.uint64((1 << 16 * (len(tables) - 1)) - 1)
            out[missed] += scores(tables[1:], keys[missed] & width)
        else:
            out[missed] += np.float32(-np.log(len(table.grams) + 1))
    return out


def _entropies(models: Models, texts: list[str]) -> np.ndarray:
    """Cross-entropy per character (text, language); NaN for texts without letters."""
    out = np.full((len(texts), len(models.langs)), np.nan)
    for first, piece in _slices(texts):
        keys, owner = _grams(piece)
        total = scores(models.orders, keys)
        sums = np.stack([np.bincount(owner, column, len(piece)) for column in total.T], axis=1)
        n = np.maximum(1, np.bincount(owner, minlength=len(piece)))
        letters = np.bincount(owner, ((keys & np.uint64(0xFFFF)) > _SPACE), len(piece)) > 0
        out[first : first + len(piece)] = np.where(letters[:, None], -sums / n[:, None], np.nan)
    return out


def _decide(models: Models, entropies: np.ndarray) -> tuple[list, list, list, list]:
    none = np.isnan(entropies[:, 0])
    filled = np.where(none[:, None], 0.0, entropies)
    best = np.argmin(filled, axis=1)
    low = filled[np.arange(len(best)), best]
    chance = np.exp(-models.temperature * (filled - low[:, None]))
    score = np.where(none, 0.0, 1 / chance.sum(axis=1))
    names = ["und" if e else models.langs[b] for b, e in zip(best.tolist(), none.tolist(), strict=True)]
    return names, score, np.where(none, np.nan, low), none | (low > models.limits[best])


def fit(docs: DataFrame, text: str, lang: str, train: Column) -> Models:
    """Models of every non-null ``lang`` of the training rows; no rows give no languages."""
    spark = docs.sparkSession
    stores = Stores(spark)
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stores.keep(counts, "counts")
    table = counts.toArrow()
    stores.drop(counts)
    if not table.num_rows:
        return Models([], [], 1.0, np.zeros(0))
    coded = table.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    number = {name: i for i, name in enumerate(langs)}
    model = np.array([number[name] for name in names], np.int32)[coded.indices.to_numpy()]
    keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    orders = kneser_ney(langs, model[order], keys[order], n[order])
    del table, coded, model, keys, n, order
    models = Models(langs, orders, 1.0, np.full(len(langs), np.inf))
    return _calibrated(rows, models)


def _calibrated(rows: DataFrame, models: Models) -> Models:
    """``models`` with temperature and rejection limits from all ``rows`` (lang, text) that have letters.

    One row per language comes to the driver.
    """
    held = rows.sparkSession.sparkContext.broadcast(models)
    losses = [f"loss{i}" for i in range(len(TEMPERATURES))]
    schema = pa.schema([("lang", pa.int32()), ("own", pa.float64()), *((name, pa.float64()) for name in losses)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(held.value.langs)}
        for batch in batches:
            truth = np.array([number.get(name, -1) for name in batch.column(0).to_pylist()], int)
            entropies = _entropies(held.value, batch.column(1).to_pylist())
            usable = (truth >= 0) & ~np.isnan(entropies[:, 0])
            truth, entropies = truth[usable], entropies[usable]
            own = entropies[np.arange(len(truth)), truth]
            low = entropies.min(axis=1)
            loss = [np.log(np.exp(-t * (entropies - low[:, None])).sum(axis=1)) + t * (own - low) for t in TEMPERATURES]
            yield K.batch_of(schema, truth, own, *loss)

    measured = rows.mapInArrow(measure, "lang int, own double, " + ", ".join(f"{name} double" for name in losses))
    sums = [F.sum(name).alias(name) for name in losses]
    found = measured.groupBy("lang").agg(F.count("*").alias("n"), F.avg("own").alias("mean"), F.stddev_pop("own").alias("std"), *sums).collect()
    held.destroy()
    if not found:
        return models._replace(temperature=8.0)
    total = [sum(r[name] for r in found) for name in losses]
    limits = np.full(len(models.langs), np.inf)
    for r in found:
        if r.n > 1:
            limits[r.lang] = r.mean + 6 * r.std
    return models._replace(temperature=TEMPERATURES[int(np.argmin(total))], limits=limits)


def identify(docs: DataFrame, models: Models, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with lang_pred, score, cross_entropy and rejected.

    lang_pred is a learnt language, or ``und`` (score 0, rejected) where the
    text is null or has no letter, or nothing was learnt. Equal cross-entropies
    go to the first language by name. Rejection is only marked; the prediction
    stays.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    kept = docs.select(*columns, F.col(text).alias("__text"))
    schema = kept.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            if held.value.langs:
                names, score, low, far = _decide(held.value, _entropies(held.value, texts))
            else:
                n = len(texts)
                names, score, low, far = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            made = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64(), from_pandas=True), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*columns, "lang_pred", "score", "cross_entropy", "rejected"])

    return kept.mapInArrow(run, schema)
