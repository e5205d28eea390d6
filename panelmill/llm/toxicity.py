"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

Voters. A short seed lexicon, lexicons mined from labelled training rows (words
and word beginnings that occur almost only in toxic ones, dealt into several
lexicons by kind and hash), and patterns (address with an insult, masked
letters, shouting, runs of marks). Each votes or abstains.

Label model. All rows are voted on. From the voters' second moments alone, a
rank-one model of their covariance gives how strongly each one follows the
hidden class; pairs whose covariance the hidden class does not explain are
correlated, are left out of that fit, and share their weight in the posterior.

Classifier. A logistic model on lexicon words is trained on the posteriors of a
sample of training rows; its margins are scaled to chances on their labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from panelmill.llm import kernels as K
from panelmill.llm.linear import labelled_sample, platt, sigmoid

#: Labelled rows from which lexicons are mined and the classifier is trained.
SAMPLE_ROWS = 20_000
#: Lengths in bytes of the word beginnings that lexicons may hold; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7, 8, 9)
GROUPS = 3
#: A small lexicon of plain insults to begin with.
SEEDS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown jerk fool bastard filth vermin".split()

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_STEP = 1 << 21
_PATTERNS = (
    r"\byou(?:'re| are)? (?:an? |such an? |all )?(?:" + "|".join(SEEDS) + r")s?\b",
    r"\b[a-z]+[*#@]+[a-z]+\b",
    r"[?!]{4,}",
)


def _word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters; a row's border always separates words."""
    inside = _LETTER[raw]
    fresh = np.ones(len(raw) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    stops = np.ones(len(raw), bool)
    stops[:-1] = ~inside[1:] | fresh[1:-1]
    return starts, np.flatnonzero(inside & stops) + 1


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts as (feature hashes, text of each); words and their beginnings, repeats included."""
    raw, offsets = K.text_bytes(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _STEP, side="right")) - 1)
        part, at = raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends = _word_spans(part, at)
        owner = np.searchsorted(at, starts, side="right") - 1 + low
        made, whose = [], []
        for length in BEGINNINGS:
            some = ends - starts > length if length else np.ones(len(starts), bool)
            stop = starts[some] + length if length else ends
            made.append(K.span_hashes(part, starts[some], stop) ^ np.uint64(length))
            whose.append(owner[some])
        yield np.concatenate(made), np.concatenate(whose)
        low = high


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = np.diff(offsets) > 0
    if filled.any():
        out[filled] = np.add.reduceat(flags, offsets[:-1][filled], dtype=np.int64)
    return out


class _Distinct(NamedTuple):
    rows: np.ndarray
    keys: np.ndarray


def _known(column: pa.Array, table: np.ndarray) -> _Distinct:
    """Which entries of the sorted ``table`` each text has: (text, place in the table), each once."""
    rows, keys = [], []
    if len(table):
        gate = np.zeros(1 << 20, bool)  # most words are in no lexicon; a bit table says so faster than a search
        gate[(table >> np.uint64(44)).astype(np.int64)] = True
        for found, owner in _features(column):
            maybe = np.flatnonzero(gate[(found >> np.uint64(44)).astype(np.int64)])
            found, owner = found[maybe], owner[maybe]
            at = np.minimum(np.searchsorted(table, found), len(table) - 1)
            hit = table[at] == found
            both = np.unique(owner[hit].astype(np.int64) << 32 | at[hit])
            rows.append(both >> 32)
            keys.append(both & 0xFFFFFFFF)
    empty = np.zeros(0, np.int64)
    return _Distinct(np.concatenate(rows) if rows else empty, np.concatenate(keys) if keys else empty)


class Voters(NamedTuple):
    """A sorted table of lexicon entries, the voter of each entry (-1: none), and the number of voters."""

    table: np.ndarray
    voter: np.ndarray
    size: int

    def votes(self, column: pa.Array, known: _Distinct) -> np.ndarray:
        """One row per text, one column per voter: fires or not."""
        out = np.zeros((len(column), self.size), bool)
        mined = self.voter[known.keys]
        out[known.rows[mined >= 0], mined[mined >= 0]] = True
        lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
        for i, pattern in enumerate(_PATTERNS):
            out[:, self.size - 4 + i] = pc.match_substring_regex(lowered, pattern).to_numpy(zero_copy_only=False)
        raw, offsets = K.text_bytes(column)
        capitals, letters = _sums((raw >= 65) & (raw <= 90), offsets), _sums(_LETTER[raw], offsets)
        out[:, self.size - 1] = capitals > 0.6 * np.maximum(20, letters)
        return out


def _seed_keys() -> np.ndarray:
    raw = np.frombuffer(" ".join(SEEDS).encode(), np.uint8)
    starts, ends = _word_spans(raw, np.array([0, len(raw)]))
    return K.span_hashes(raw, starts, ends)


_ROWS = pa.schema([("key", pa.int64()), ("y", pa.int32())])


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for found, owner in _features(batch.column(0)):
            order = np.lexsort((found, owner))
            found, owner = found[order], owner[order]
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            yield K.batch_of(_ROWS, K.signed(found[fresh]), y[owner[fresh]].astype(np.int32))


def _counts_of(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(table.value), np.int64)
        for batch in batches:
            counts += np.bincount(_known(batch.column(0), table.value).keys, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield K.batch_of(_ROWS, some, counts[some].astype(np.int32))

    return run


def mine(sample: DataFrame) -> Voters:
    """The voters; their table holds every entry that the classifier may use.

    Its size follows from the rows of the sample, which are bounded.
    """
    spark = sample.sparkSession
    toxic = sample.where("y = 1")
    positive, negative = toxic.count(), sample.where("y = 0").count()
    seeds = _seed_keys()
    candidates, hits = seeds, np.zeros(len(seeds))
    if positive:
        least = max(2, positive // 500)
        seen = toxic.mapInArrow(_distinct_features, "key long, y int").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        seen = seen.toPandas()
        candidates, hits = seen.key.to_numpy().view(np.uint64), seen.n.to_numpy().astype(float)
    order = np.argsort(candidates)
    candidates, hits = candidates[order], hits[order]
    held = spark.sparkContext.broadcast(candidates)
    clean = sample.where("y = 0").select("text").mapInArrow(_counts_of(held), "key long, y int").groupBy("key").agg(F.sum("y").alias("n")).toPandas()
    misses = np.zeros(len(candidates))
    misses[clean.key.to_numpy().astype(np.int64)] = clean.n.to_numpy()
    rate = np.log((hits + 0.5) / (positive + 1)) - np.log((misses + 0.5) / (negative + 1))
    strength = rate * np.sqrt(hits + misses)
    chosen = (rate > 1.5) & (strength > 6)
    kept = np.flatnonzero(chosen)
    table = np.unique(np.concatenate([candidates[kept], seeds]))
    size = 1 + len(BEGINNINGS) * GROUPS + 4
    voter = np.full(len(table), -1)
    firm = kept[(rate[kept] > 3) & (misses[kept] <= 0.002 * negative + 1)]
    place = np.searchsorted(table, candidates[firm])
    voter[place] = 1 + (candidates[firm] % np.uint64(len(BEGINNINGS) * GROUPS)).astype(np.int64)
    voter[np.searchsorted(table, seeds)] = 0
    return Voters(table, voter, size)


_MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])


def moments(docs: DataFrame, text: str, voters) -> tuple[np.ndarray, int]:
    """How often each pair of voters fires together over all rows, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = voters.value.size
        both = np.zeros((size + 1, size + 1), np.int64)
        for batch in batches:
            column = batch.column(0)
            fired = voters.value.votes(column, _known(column, voters.value.table)).astype(np.float32)
            fired = np.hstack([fired, np.ones((len(fired), 1), np.float32)])
            both += np.rint(fired.T.astype(np.float64) @ fired).astype(np.int64)
        i, j = np.nonzero(both)
        yield K.batch_of(_MOMENTS, i.astype(np.int32), j.astype(np.int32), both[i, j])

    size = voters.value.size
    sums = docs.select(text).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((size + 1, size + 1))
    for r in sums:
        both[r.i, r.j] = r.n
    return both, int(both[size, size])


class LabelModel(NamedTuple):
    prior: float
    toxic: np.ndarray  # chance that a voter fires on a toxic text
    clean: np.ndarray
    weight: np.ndarray  # share of a voter that its correlated ones leave to it

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = self.weight * np.log(self.toxic / self.clean)
        silent = self.weight * np.log((1 - self.toxic) / (1 - self.clean))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ fired + (1 - votes) @ silent)


def _start(correlation: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Loads that a few dependent pairs cannot move.

    Three independent voters give load_i ** 2 = c_ij * c_ik / c_jk. Copies of a
    voter raise this for themselves, so a low quantile over all pairs (j, k) is
    the start; then each load is the weighted median of c_ij / load_j, the least
    sum of absolute gaps, to which only the majority of a voter's pairs counts.
    """
    size = len(correlation)
    load = np.full(size, np.nan)
    for i in range(size):
        j, k = np.triu_indices(size, 1)
        some = usable[i, j] & usable[i, k] & (correlation[j, k] > 0.01)
        if some.any():
            load[i] = np.sqrt(np.quantile(np.maximum(correlation[i, j] * correlation[i, k], 0)[some] / correlation[j, k][some], 0.25))
    load = np.clip(np.where(np.isnan(load), 0.5, load), 0.02, 0.99)
    for _ in range(50):
        moved = load.copy()
        for i in range(size):
            some = np.flatnonzero(usable[i] & (load > 0))
            if len(some):
                ratio = correlation[i, some] / load[some]
                order = np.argsort(ratio)
                upto = np.cumsum(load[some][order])
                moved[i] = np.clip(ratio[order][np.searchsorted(upto, upto[-1] / 2)], 0.0, 0.99)
        load = 0.5 * load + 0.5 * moved
    return load


def label_model(both: np.ndarray, rows: int, prior: float) -> LabelModel:
    """Accuracies and correlations of the voters from their second moments, given the share of toxic rows.

    Pairs are marked as dependent where the robust start leaves more covariance
    than the usual gap; loads are fitted on the other pairs, and pairs are marked
    again. A voter that several others copy shares its weight with them.
    """
    size = len(both) - 1
    prior = min(0.5, max(0.01, prior))
    mean = both[:size, size] / max(1, rows)
    covariance = both[:size, :size] / max(1, rows) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    correlation = covariance / np.outer(scale, scale)
    usable = ~np.eye(size, dtype=bool) & (scale[:, None] > 1e-5) & (scale[None, :] > 1e-5)
    load = _start(correlation, usable)
    for _ in range(4):
        rest = np.where(usable, correlation - np.outer(load, load), 0.0)
        usual = float(np.median(np.abs(rest[usable]))) if usable.any() else 0.0
        dependent = np.abs(rest) > max(0.05, 6 * usual)
        open_ = usable & ~dependent
        for _ in range(200):
            below = (open_ * load**2).sum(axis=1)
            fitted = np.clip((open_ * correlation * load).sum(axis=1) / np.maximum(below, 1e-9), 0, 0.99)
            load = np.where(below > 1e-9, 0.5 * load + 0.5 * fitted, load)
    rest = np.where(dependent, np.abs(rest) / np.sqrt(np.outer(1 - load**2, 1 - load**2)), 0.0)
    weight = 1 / (1 + np.clip(rest, 0, 1).sum(axis=1))
    gap = load * scale / np.sqrt(prior * (1 - prior))
    toxic = np.clip(mean + (1 - prior) * gap, 1e-4, 0.999)
    clean = np.clip(mean - prior * gap, 1e-4, 0.999)
    return LabelModel(prior, toxic, np.minimum(clean, toxic), np.where(scale > 1e-5, weight, 0.0))


class Model(NamedTuple):
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, n: int, known: _Distinct) -> np.ndarray:
        return np.bincount(known.rows, self.weights[known.keys], n) + self.bias


def _logistic(rows: np.ndarray, keys: np.ndarray, target: np.ndarray, dims: int, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on 0/1 features with soft targets, by Adam over all rows."""
    w, grad1, grad2 = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    n = max(1, len(target))
    for step in range(1, steps + 1):
        error = sigmoid(np.bincount(rows, w[keys], n)[: len(target)] + w[-1]) - target
        grad = np.append(np.bincount(keys, error[rows], dims), error.sum()) / n
        grad[:-1] += penalty * w[:-1] / 10
        grad1, grad2 = 0.9 * grad1 + 0.1 * grad, 0.99 * grad2 + 0.01 * grad * grad
        w -= 0.1 * (grad1 / (1 - 0.9**step)) / (np.sqrt(grad2 / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


_SAMPLE = pa.schema([("keys", pa.binary()), ("votes", pa.binary()), ("y", pa.int32())])


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model; lexicons and classifier see about ``sample_rows`` labelled training rows, the label model all rows.

    Without toxic training rows only the seed lexicon and the patterns vote.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, key, text, label, train, sample_rows)
    voters = mine(sample)
    held = spark.sparkContext.broadcast(voters)
    both, rows = moments(docs, text, held)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            known = _known(column, held.value.table)
            votes = held.value.votes(column, known)
            at = np.searchsorted(known.rows, np.arange(len(column) + 1))  # rows rise
            keys = [known.keys[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield K.batch_of(_SAMPLE, keys, [v.tobytes() for v in votes], batch.column(1))

    got = sample.mapInArrow(measure, "keys binary, votes binary, y int").toArrow()
    y = np.array(got.column("y").to_pylist(), int)
    share = float(y.mean()) if len(y) else 0.1
    model = label_model(both, rows, share)
    found = [np.frombuffer(k, "<i4") for k in got.column("keys").to_pylist()]
    votes = np.array([np.frombuffer(v, bool) for v in got.column("votes").to_pylist()]).reshape(len(y), voters.size)
    target = model.posterior(votes.astype(float))
    at = np.repeat(np.arange(len(found)), [len(f) for f in found]) if found else np.zeros(0, int)
    keys = np.concatenate(found) if found else np.zeros(0, int)
    weights, bias = _logistic(at, keys, target, len(voters.table))
    margins = np.bincount(at, weights[keys], len(y))[: len(y)] + bias if len(y) else np.zeros(0)
    slope, offset = platt(margins, y)
    return Model(voters, model, weights.astype(np.float32), bias, slope, offset)


def scored(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with score, predicted and the label model's posterior.

    Null and empty texts get the score of a text without lexicon words. A
    column of the caller that has a name of the result is left out. Broadcast:
    the model, whose size the fitting sample bounds.
    """
    columns = [c for c in columns if c not in ("score", "predicted", "posterior")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns, F.col(text).alias("__text"))
    schema = kept.drop("__text").schema.add("score", "double").add("predicted", "integer").add("posterior", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            known = _known(column, m.voters.table)
            score = sigmoid(m.slope * m.margins(len(column), known) + m.offset)
            posterior = m.labels.posterior(m.voters.votes(column, known).astype(float))
            made = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32()), pa.array(posterior, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*columns, "score", "predicted", "posterior"])

    return kept.mapInArrow(run, schema)
