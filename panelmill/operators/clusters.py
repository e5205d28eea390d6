"""Clustering: features, tendency, K-means, silhouettes, profiles and quality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelmill.functions.numeric import separation_band
from panelmill.functions.params import fitted, one_row
from panelmill.operators import cells, kmeans, neighbours
from panelmill.operators.groups import dominant_value, group_share
from panelmill.operators.scaling import min_max_scale, standard_scale
from panelmill.session import durable

UNIFORM = "uniform point "
BANDS = (0.35, 0.5)


def cluster_features(df: DataFrame, columns: Sequence[str], log_columns: Sequence[str]) -> DataFrame:
    """``log1p`` of the skewed columns, then all of them to 0..1.

    A missing value is an error: the query fails on the first one it meets.
    """
    complete = {}
    for c in columns:
        value = F.col(c).cast("double")
        missing = value.isNull() | F.isnan(value)
        stop = F.raise_error(F.lit(f"clustering column {c} has missing values")).cast("double")
        checked = F.when(missing, stop).otherwise(value)
        complete[c] = F.log1p(checked) if c in log_columns else checked
    return min_max_scale(df.withColumns(complete), columns)


def hopkins(df: DataFrame, columns: Sequence[str], key: Sequence[str], m: int = 500, seed: int = 42) -> DataFrame:
    """Hopkins statistic in one row: above 0.5 means a tendency to cluster.

    Distances from m uniform points and from m sampled rows to their nearest
    rows; m is at most a tenth of the rows. Only the bounds and the m sampled
    rows reach the driver.
    """
    spark = df.sparkSession
    bounds = df.agg(
        F.count("*").alias("n"),
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    size = min(m, max(1, bounds["n"] // 10))
    if bounds["n"] <= 1:
        return spark.range(1).select(F.lit(0.5).alias("hopkins"), F.lit(0).cast("long").alias("probes"))
    picked = neighbours.sampled_rows(df, key, size, seed).select(
        neighbours.row_key(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]
    )
    real = [(row["key"], [row[c] for c in columns]) for row in picked.collect()]
    uniform = []
    for i in range(size):
        point = []
        for j in range(len(columns)):
            low, high = bounds[f"lo_{j}"], bounds[f"hi_{j}"]
            point.append(low + _unit(f"{seed}|{i}|{j}") * (high - low))
        uniform.append((f"{UNIFORM}{i}", point))
    # One pass serves both kinds: a sampled row skips itself, a uniform point has no row of its own.
    nearest = neighbours.nearest_distance(real + uniform, df, columns, key, exclude_self=True)
    free = F.col("probe").startswith(UNIFORM)
    sums = nearest.agg(
        F.sum(F.when(free, F.col("distance"))).alias("u"),
        F.sum(F.when(~free, F.col("distance"))).alias("w"),
        F.count_if(free).alias("probes"),
    )
    ratio = F.coalesce(F.try_divide(F.col("u"), F.col("u") + F.col("w")), F.lit(0.5))
    return sums.select(ratio.alias("hopkins"), "probes")


def _unit(text: str) -> float:
    """A number in [0, 1) from a text: eight hex digits of its md5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def kmeans_fit(
    df: DataFrame, columns: Sequence[str], k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300
) -> kmeans.Model:
    """The model with the lowest inertia of ``n_init`` starts, all of them fitted in the same scans."""
    found = kmeans.fit_all(kmeans.blocks(df, columns), len(columns), [k], n_init, seed, max_iter)
    return found.get(k, kmeans.Model(np.zeros((0, len(columns))), 0.0, 0))


def sorted_centroids(model) -> list[list[float]]:
    """Centroids in ascending order, which makes cluster numbers reproducible."""
    return sorted([float(x) for x in centre] for centre in model.clusterCenters())


def assign_nearest(
    df: DataFrame, centroids: Sequence[Sequence[float]], columns: Sequence[str], out: str = "cluster"
) -> DataFrame:
    """Number of the nearest centroid, the lower one on ties; K centroids are literals of the plan."""
    distances = []
    for number, centre in enumerate(centroids):
        gaps = [(F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, centre)]
        squared = reduce(lambda a, b: a + b, gaps)
        distances.append(F.struct(squared.alias("d"), F.lit(number).alias("id")))
    return df.withColumn(out, F.array_min(F.array(*distances))["id"])


def kmeans_sweep(
    df: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int] = tuple(range(2, 11)),
    selected: int = 8,
    n_init: int = 10,
    seed: int = 42,
    max_iter: int = 300,
) -> DataFrame:
    """Inertia and mean silhouette of squared distances per K; one row per fitted model.

    All K and starts share one scan per iteration, and all silhouettes three more.
    """
    stored = kmeans.blocks(df, columns)
    models = kmeans.fit_all(stored, len(columns), ks, n_init, seed, max_iter)
    means = kmeans.mean_silhouettes(stored, [m.centres for m in models.values()])
    rows = [(k, float(m.inertia), s, k == selected) for (k, m), s in zip(models.items(), means, strict=True)]
    return kmeans.frame(df.sparkSession, rows)


def silhouette_sq(
    df: DataFrame, columns: Sequence[str], label: str, out: str = "silhouette_sq"
) -> DataFrame:
    """Silhouette of every row with squared Euclidean distances.

    The mean squared distance of a row to a cluster follows from the size, the
    means and the mean squared norm of the cluster, so the work is rows times
    clusters and only K summary rows are shuffled. A cluster of one row scores
    0; with a single cluster there is no score.
    """
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns])
    summary = df.groupBy(F.col(label).alias("id")).agg(
        F.count("*").alias("n"), F.avg(norm).alias("norm"), *[F.avg(c).alias(c) for c in columns]
    )
    clusters = one_row(summary.agg(F.collect_list(F.struct("id", "n", "norm", *columns)).alias("all")))["all"]
    rows = df.withColumn("__clusters", clusters)

    def mean_distance(cluster: Column) -> Column:
        product = reduce(lambda a, b: a + b, [F.col(c) * cluster[c] for c in columns])
        return F.struct(
            cluster["id"].alias("id"),
            cluster["n"].alias("n"),
            F.greatest(norm + cluster["norm"] - 2.0 * product, F.lit(0.0)).alias("d"),
        )

    rows = rows.withColumn("__all", F.transform("__clusters", mean_distance))
    own = F.filter("__all", lambda c: c["id"] == F.col(label))[0]
    others = F.array_min(F.transform(F.filter("__all", lambda c: c["id"] != F.col(label)), lambda c: c["d"]))
    rows = rows.withColumns({"__own": own, "__b": others})
    a = F.try_divide(F.col("__own.d") * F.col("__own.n"), F.col("__own.n") - 1)
    score = _score(a, F.col("__b"), F.col("__own.n"))
    return rows.withColumn(out, score).select(*[c for c in df.columns if c != out], out)


def silhouette(
    df: DataFrame, columns: Sequence[str], label: str, out: str = "silhouette", cell_count: int = cells.CELLS
) -> DataFrame:
    """Silhouette of every row with Euclidean distances, and ``<out>_error``: how far it can be from the exact one.

    Rows are summed up per cell of the space and cluster. For a row x and n rows
    with mean m and mean squared distance v to it, the sum of their distances to
    x lies between n |x - m| and n sqrt(|x - m|^2 + v). So the work is rows times
    cells, each row's score comes with a bound, and the bound is 0 where
    a cell holds one point. More cells make the bounds narrower. A cluster of
    one row scores 0; with a single cluster there is no score. Rows without
    label or with missing values have none and count nowhere.
    """
    spark = df.sparkSession
    names = [f"__x{i}" for i in range(len(columns))]
    kept = [c for c in df.columns if c not in (out, f"{out}_error")]
    numbers = {n: F.col(c).cast("double") for n, c in zip(names, columns, strict=True)}
    rows = durable(df.select(*kept).withColumns({"__label": F.col(label)} | numbers))
    usable = F.col("__label").isNotNull()
    for n in names:
        usable = usable & F.col(n).isNotNull() & ~F.isnan(n)
    known = rows.filter(usable)
    labels = sorted(r[0] for r in known.select("__label").distinct().collect())
    tree = cells.cut(known, names, cell_count)
    found = cells.moments(known, names, "__label", labels, tree)
    by_label = np.argsort(found.label, kind="stable")
    # About the middle of all rows, where the products of the squared distances keep most digits.
    middle = np.average(found.mean, axis=0, weights=found.n) if len(found.n) else np.zeros(len(names))
    found = cells.Moments(found.label[by_label], found.n[by_label].astype(float), found.mean[by_label] - middle, found.spread[by_label])
    sizes = np.bincount(found.label, found.n, len(labels))
    place = {v: i for i, v in enumerate(labels)}
    schema = rows.select(*kept).schema.add(out, "double").add(f"{out}_error", "double")
    told = [*kept, out, f"{out}_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // max(1, len(found.n)))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                score, error = np.full(part.num_rows, np.nan), np.full(part.num_rows, np.nan)
                own = np.array([place.get(v, -1) for v in part.column("__label").to_pylist()], np.int64)
                x = cells.matrix(part, names)
                some = np.flatnonzero((own >= 0) & ~np.isnan(x).any(axis=1))
                if len(labels) > 1 and len(some):
                    score[some], error[some] = _bounded_scores(x[some] - middle, own[some], found, sizes)
                columns_of = [*[part.column(c) for c in kept], pa.array(score, from_pandas=True), pa.array(error, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns_of, names=told)

    return rows.mapInArrow(run, schema)


def _squares(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Squared distances by one product; those that are small beside the norms are taken from the differences, as they would lose digits."""
    norm, other = (x * x).sum(axis=1), (mean * mean).sum(axis=1)
    squared = x @ (-2.0 * mean.T)
    squared += other
    squared += norm[:, None]
    row, cell = np.nonzero(squared < 1e-5 * (norm[:, None] + other))
    for low in range(0, len(row), 1 << 15):
        part = slice(low, low + (1 << 15))
        squared[row[part], cell[part]] = ((x[row[part]] - mean[cell[part]]) ** 2).sum(axis=1)
    return squared


def _bounded_scores(x: np.ndarray, own: np.ndarray, found: cells.Moments, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Silhouettes halfway between the bounds of the distance sums, and the largest gap to what these allow.

    ``found`` is in the order of its labels.
    """
    squared = _squares(x, found.mean)
    at = np.arange(len(x))
    borders = np.searchsorted(found.label, np.arange(len(sizes) + 1))

    def means(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([gaps[:, a:b] @ found.n[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)], axis=1)
        a = sums[at, own] / np.maximum(sizes[own] - 1, 1)
        others = sums / sizes
        others[at, own] = np.inf
        return a, others.min(axis=1)

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.maximum(a, b)
        return np.where((sizes[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)

    a_low, b_low = a_high, b_high = means(np.sqrt(squared))
    if found.spread.any():
        squared += found.spread
        a_high, b_high = means(np.sqrt(squared, out=squared))
    middle = score((a_low + a_high) / 2, (b_low + b_high) / 2)
    return middle, np.maximum(score(a_low, b_high) - middle, middle - score(a_high, b_low))


def _score(a: Column, b: Column, n: Column) -> Column:
    """(b - a) / max(a, b); 0 for a cluster of one row."""
    ratio = F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    return F.when(b.isNull(), F.lit(None).cast("double")).when(n <= 1, 0.0).otherwise(ratio)


def cluster_distribution(df: DataFrame, label: str) -> DataFrame:
    return group_share(df, [label])


def cluster_profile(
    df: DataFrame,
    label: str,
    means: Sequence[str],
    levels: Sequence[str],
    categories: Sequence[str],
) -> DataFrame:
    """Size, share, means, HIGH/LOW against the table and dominant categories per cluster."""
    measured = sorted({*means, *levels})
    overall = fitted(df.agg(F.count("*").alias("__n"), *[F.avg(c).alias(c) for c in levels]))
    grouped = df.groupBy(label).agg(F.count("*").alias("count"), *[F.avg(c).alias(f"mean_{c}") for c in measured])
    profile = grouped.select(
        label,
        "count",
        (F.col("count") / overall["__n"] * 100.0).alias("percent"),
        *[f"mean_{c}" for c in means],
        *[
            F.when(F.col(f"mean_{c}") >= overall[c], "HIGH").otherwise("LOW").alias(f"level_{c}")
            for c in levels
        ],
    )
    dominant = dominant_value(df, [label], categories)
    renamed = dominant.select(label, *[F.col(c).alias(f"dominant_{c}") for c in categories])
    return profile.join(renamed, label, "left")


def cluster_rules(
    profile: DataFrame, label: str, levels: Sequence[str], roles: Mapping[str, str]
) -> DataFrame:
    """Per cluster its level conditions and its dominant values by role.

    ``conditions`` is an array of ``column level`` texts in the order of
    ``levels``; ``typical`` a struct with a field per role of ``roles`` (role to
    column), NULL where a cluster has no known value.
    """
    conditions = F.array(*[F.concat_ws(" ", F.lit(c), F.lower(f"level_{c}")) for c in levels])
    typical = F.struct(*[F.col(f"dominant_{c}").cast("string").alias(role) for role, c in roles.items()])
    return profile.select(label, conditions.alias("conditions"), typical.alias("typical"))


def cluster_quality(
    scored: DataFrame,
    label: str,
    score: str = "silhouette_sq",
    bands: Sequence[float] = BANDS,
) -> DataFrame:
    """Mean silhouette per cluster with its band, weak and poor flags and the strongest cluster.

    ``bands`` are the lower bounds of fair and strong. The default ones are
    customary for plain Euclidean distances; silhouettes of squared distances
    are larger in size, so their words are not comparable with those.
    """
    means = scored.groupBy(label).agg(F.count("*").alias("count"), F.avg(score).alias("mean_silhouette"))
    best = one_row(means.agg(F.min(F.struct((-F.col("mean_silhouette")).alias("s"), F.col(label).alias("id"))).alias("b")))
    value = F.col("mean_silhouette")
    return means.withColumns(
        {
            "quality": separation_band(value, *bands),
            "weak": value < bands[0],
            "poor": value < 0,
            "strongest": F.col(label) == best["b"]["id"],
        }
    )


def overall_quality(
    scored: DataFrame, score: str = "silhouette_sq", bands: Sequence[float] = BANDS
) -> DataFrame:
    return scored.agg(F.avg(score).alias("overall_silhouette")).withColumn(
        "quality", separation_band(F.col("overall_silhouette"), *bands)
    )


def evaluate_in_space(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Silhouettes of given labels in the standardised space of other columns."""
    return silhouette_sq(standard_scale(df, columns), columns, label)
