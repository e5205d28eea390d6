import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelmill.operators import cells, clusters, kmeans, neighbours

POINTS = [(0, 0.0, 0.0, 0), (1, 1.0, 0.0, 0), (2, 0.0, 2.0, 0), (3, 5.0, 5.0, 1), (4, 6.0, 5.0, 1), (5, 9.0, 1.0, 2)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id int, x double, y double, c int")


def brute(metric):
    out = {}
    for i, x, y, c in POINTS:
        mean = {}
        for other in (0, 1, 2):
            ds = [metric(math.hypot(x - a, y - b)) for j, a, b, k in POINTS if k == other and j != i]
            mean[other] = sum(ds) / len(ds) if ds else None
        a, b = mean[c], min(v for k, v in mean.items() if k != c)
        out[i] = 0.0 if a is None else (b - a) / max(a, b)
    return out


def test_silhouette_of_squared_distances(points):
    found = {r.id: r.silhouette_sq for r in clusters.silhouette_sq(points, ["x", "y"], "c").collect()}
    assert found == pytest.approx(brute(lambda d: d * d))
    assert sum(found.values()) / 6 == pytest.approx(0.783974, abs=1e-6) and found[5] == 0.0


def test_single_cluster_has_no_silhouette(points):
    one = points.withColumn("c", F.lit(0))
    assert clusters.silhouette_sq(one, ["x", "y"], "c").filter("silhouette_sq is not null").count() == 0


def test_nearest_distances(points):
    rows = [(str(i), [x, y]) for i, x, y, _ in POINTS]
    other = {r.probe: r.distance for r in neighbours.nearest_distance(rows, points, ["x", "y"], ["id"], True).collect()}
    assert other["0"] == 1.0 and other["5"] == pytest.approx(5.0)
    self_too = neighbours.nearest_distance(rows, points, ["x", "y"], ["id"]).agg(F.max("distance")).first()[0]
    assert self_too == 0.0
    many = [(f"p{i}", [i * 0.01, 0.0]) for i in range(neighbours.PROBES + 500)]
    assert neighbours.nearest_distance(many, points, ["x", "y"], ["id"]).count() == neighbours.PROBES + 500


def test_hopkins_tells_clusters_from_noise(spark):
    rng = np.random.default_rng(1)
    tight = np.concatenate([rng.normal(m, 0.01, (200, 2)) for m in (0.1, 0.9)])
    flat = rng.uniform(0, 1, (400, 2))
    values = []
    for cloud in (tight, flat):
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cloud)], "id int, x double, y double")
        values.append(clusters.hopkins(df, ["x", "y"], ["id"], 40).first().hopkins)
    assert values[0] > 0.9 and 0.3 < values[1] < 0.7
    wide = spark.range(20000).selectExpr("cast(id as int) id", "rand(1) x", "rand(2) y")
    assert clusters.hopkins(wide, ["x", "y"], ["id"], 1900).first().probes == 1900
    assert clusters.hopkins(df.limit(1), ["x", "y"], ["id"]).first().hopkins == 0.5


def test_features_reject_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(Exception, match="missing values"):
        clusters.cluster_features(df, ["x"], []).collect()
    ok = clusters.cluster_features(spark.createDataFrame([(0.0,), (math.e - 1,), (math.e**2 - 1,)], "x double"), ["x"], ["x"])
    assert [r.x for r in ok.collect()] == pytest.approx([0, 0.5, 1])


def test_kmeans_and_profile(spark):
    rows = [(i, float(i % 2) + i * 1e-4, "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, k string")
    model = clusters.kmeans_fit(df, ["x"], 2, n_init=2)
    labelled = clusters.assign_nearest(df, clusters.sorted_centroids(model), ["x"])
    assert {r.id: r.cluster for r in labelled.collect()} == {i: i % 2 for i, _, _ in rows}
    profile = clusters.cluster_profile(labelled, "cluster", ["x"], ["x"], ["k"])
    by_cluster = {r.cluster: (r["count"], r.percent, r.level_x, r.dominant_k) for r in profile.collect()}
    assert by_cluster == {0: (20, 50.0, "LOW", "b"), 1: (20, 50.0, "HIGH", "a")}
    told = clusters.cluster_rules(profile, "cluster", ["x"], {"kind": "k"}).filter("cluster = 1").first()
    assert told.conditions == ["x high"] and told.typical.kind == "a"
    sweep = {r.k: r for r in clusters.kmeans_sweep(df, ["x"], (2, 3), 2, 1).collect()}
    assert sweep[2].selected and not sweep[3].selected and sweep[3].inertia <= sweep[2].inertia


def test_quality(spark):
    df = spark.createDataFrame([(0, 0.6), (1, 0.6), (2, -0.1), (3, 0.4)], "c int, silhouette_sq double")
    rows = {r.c: (r.quality, r.weak, r.poor, r.strongest) for r in clusters.cluster_quality(df, "c").collect()}
    assert rows == {
        0: ("Strong", False, False, True),
        1: ("Strong", False, False, False),
        2: ("Poor", True, True, False),
        3: ("Fair", False, False, False),
    }
    assert clusters.overall_quality(df).first().quality == "Fair"


def _lloyd(x, centres, turns):
    for _ in range(turns):
        label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(len(centres))])
    return centres, ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()


def test_all_models_of_one_scan_equal_separate_fits(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.08, (300, 3)) for m in ((0, 0, 0), (1, 0, 1), (0, 1, 1), (1, 1, 0))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double, c double").repartition(3)
    stored = kmeans.blocks(df, "abc")
    models = kmeans.fit_all(stored, 3, [2, 4, 6], 3, 7, 300, tol=0.0)  # until the centres stand, as below
    points = kmeans.sketch(stored, 3, 7)
    assert sorted(map(tuple, points)) == sorted(map(tuple, x))
    for k, model in models.items():
        costs = [_lloyd(x, kmeans.start(points, k, 7 + 1000 * k + run), 100)[1] for run in range(3)]
        assert model.inertia == pytest.approx(min(costs), rel=1e-3)
    means = kmeans.mean_silhouettes(stored, [m.centres for m in models.values()])
    for (k, model), mean in zip(models.items(), means):
        labelled = clusters.assign_nearest(df, clusters.sorted_centroids(model), list("abc"))
        expected = clusters.silhouette_sq(labelled, list("abc"), "cluster").agg(F.avg("silhouette_sq")).first()[0]
        assert mean == pytest.approx(expected, abs=1e-9)


def test_kmeans_of_few_rows(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,)], "x double")
    model = clusters.kmeans_fit(df, ["x"], 3, n_init=2)
    assert model.inertia == 0 and {float(c[0]) for c in model.clusterCenters()} == {0.0, 1.0}
    assert clusters.kmeans_fit(df.limit(0), ["x"], 3).clusterCenters() == []
    assert clusters.kmeans_sweep(df.limit(0), ["x"]).count() == 0


def test_a_centre_without_rows_takes_the_farthest_row():
    found = kmeans._Sums(np.array([3, 0]), 4.0, np.array([[3.0], [0.0]]), [4.0, 9.0])
    assert kmeans._moved(np.array([[0.0], [50.0]]), found).tolist() == [[1.0], [9.0]]


def test_nearest_by_cells_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.05, (400, 3)) for m in (0.2, 0.8)] + [np.full((50, 3), 0.5)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double, c double").repartition(3)
    probes = [(str(i), x[i].tolist()) for i in (0, 7, 500, 820)] + [(f"u{i}", rng.random(3).tolist()) for i in range(40)]
    counted = []
    met = neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda *a: counted.append(a[6].sum()) or met(*a))
    for self_too in (True, False):
        found = {r.probe: r.distance for r in neighbours.nearest_distance(probes, df, list("abc"), ["id"], not self_too, 64).collect()}
        for name, point in probes:
            gaps = ((x - np.array(point)) ** 2).sum(axis=1)
            if not self_too and not name.startswith("u"):
                gaps[int(name)] = np.inf
            assert found[name] == pytest.approx(math.sqrt(gaps.min()), abs=1e-12)
    assert sum(counted) < 0.5 * 2 * len(probes) * 64
    assert neighbours.nearest_distance(probes[:1], df.limit(0), list("abc"), ["id"]).first().distance == math.inf


def test_trees_cut_every_point():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (300, 2)).astype(float)
    tree = cells.plant(x, 1000)
    assert tree.cells == len(np.unique(x, axis=0))
    assert len({(c, *p) for c, p in zip(tree.locate(x).tolist(), map(tuple, x))}) == tree.cells
    assert cells.plant(x, 7).cells <= 7 and set(cells.plant(x, 7).locate(x)) == set(range(cells.plant(x, 7).cells))
    assert cells.plant(np.zeros((0, 2)), 8).locate(x).max() == 0


@pytest.mark.parametrize("cell_count", [1, 8, 64, 5000])
def test_euclidean_silhouettes_lie_within_their_bound(spark, cell_count):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.1, (60, 2)) for m in (0.2, 0.5, 0.9)] + [[[3.0, 3.0]]])
    label = [*np.repeat([0, 1, 2], 60).tolist(), 9]
    rows = [(i, lab, float(a), float(b)) for i, (lab, (a, b)) in enumerate(zip(label, x))]
    df = spark.createDataFrame([*rows, (500, None, 0.0, 0.0), (501, 1, None, 0.0)], "id int, c int, x double, y double").repartition(3)
    found = {r.id: (r.silhouette, r.silhouette_error) for r in clusters.silhouette(df, ["x", "y"], "c", cell_count=cell_count).collect()}
    assert found.pop(500) == found.pop(501) == (None, None)
    gaps, label = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.array(label)
    for i in range(len(x)):
        means = {k: gaps[i][label == k].sum() / max(1, (label == k).sum() - (k == label[i])) for k in set(label.tolist())}
        a, b = means.pop(label[i]), min(means.values())
        exact = 0.0 if label[i] == 9 else (b - a) / max(a, b)
        assert abs(found[i][0] - exact) <= found[i][1] + 1e-9
    worst = max(e for _, e in found.values())
    assert worst < {1: 2.1, 8: 0.8, 64: 0.3, 5000: 1e-9}[cell_count]
    one = clusters.silhouette(df.filter("c = 1"), ["x", "y"], "c")
    assert one.filter("silhouette is not null").count() == 0


def test_scans_of_many_models_agree_with_separate_ones_and_cost_less():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.random((6000, 8)), np.zeros((9, 8))])
    models = [rng.random((k, 8)) for k in (2, 3, 8, 9) for _ in range(10)]
    models[1][1] = models[1][0]  # every row is as far from both: the first has all
    batch = pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["n", "x"])

    def alone():
        for m in models:
            gaps = (m**2).sum(axis=1) - 2 * (x @ m.T)
            label = gaps.argmin(axis=1)
            own = np.zeros((len(x), len(m)))
            own[np.arange(len(x)), label] = 1.0
            least = gaps[np.arange(len(x)), label] + (x * x).sum(axis=1)
            yield own.sum(axis=0), least.sum(), own.T @ x, least.max()

    found = next(kmeans._scan(models)([batch])).to_pydict()
    sums = np.array([found[f"s{i}"] for i in range(8)]).T
    at = 0
    for m, (n, cost, moved, far) in zip(models, alone()):
        own = slice(at, at + len(m))
        assert found["n"][own] == n.tolist() and sum(found["cost"][own]) == pytest.approx(cost)
        assert sums[own] == pytest.approx(moved) and found["far"][at][0] == pytest.approx(far)
        at += len(m)

    def least(work):
        times = []
        for _ in range(5):
            begin = time.thread_time()
            list(work())
            times.append(time.thread_time() - begin)
        return min(times)

    assert least(lambda: kmeans._scan(models)([batch])) < 0.75 * least(alone)


@pytest.mark.parametrize("tasks", [0, 64])
def test_sums_are_the_same_on_the_driver_and_on_spark(spark, monkeypatch, tasks):
    x = np.random.default_rng(1).random((500, 2))
    stored = kmeans.blocks(spark.createDataFrame(x.tolist(), "a double, b double").repartition(5), "ab")
    monkeypatch.setattr(kmeans, "DRIVER_TASKS", tasks)
    models = [x[:3], x[:2] + 9]
    for m, found in zip(models, kmeans._totals(stored, models), strict=True):
        gaps = ((x[:, None] - m) ** 2).sum(axis=2)
        assert found.n.sum() == 500 and found.cost == pytest.approx(gaps.min(axis=1).sum())
        assert found.far == pytest.approx([gaps.min(axis=1).max(), *x[gaps.min(axis=1).argmax()]])
        assert found.sums.sum(axis=0) == pytest.approx(x.sum(axis=0))


def test_scores_of_many_cells_agree_with_differences_and_cost_less():
    rng = np.random.default_rng(6)
    mean, x, own = rng.normal(0, 1, (4000, 64)) + 50, rng.normal(0, 1, (60, 64)) + 50, rng.integers(0, 10, 60)
    x[:20] = mean[:20]  # nil distances stay nil
    label = np.sort(rng.integers(0, 10, 4000))
    found = cells.Moments(label, rng.integers(1, 9, 4000).astype(float), mean, np.zeros(4000))
    sizes = np.bincount(label, found.n, 10)

    def by_differences():
        squared = np.zeros((len(x), len(mean)))
        for a in range(64):
            squared += (x[:, a, None] - mean[None, :, a]) ** 2
        return squared

    squared = by_differences()
    assert clusters._squares(x, mean) == pytest.approx(squared, rel=1e-8, abs=1e-20)
    score, error = clusters._bounded_scores(x, own, found, sizes)
    sums = np.stack([np.sqrt(squared[:, label == k]) @ found.n[label == k] for k in range(10)], axis=1)
    a = sums[np.arange(60), own] / (sizes[own] - 1)
    others = sums / sizes
    others[np.arange(60), own] = np.inf
    assert score == pytest.approx((others.min(axis=1) - a) / np.maximum(a, others.min(axis=1)), abs=1e-9) and not error.any()

    def least(work):
        times = []
        for _ in range(3):
            begin = time.perf_counter()
            work()
            times.append(time.perf_counter() - begin)
        return min(times)

    assert least(lambda: clusters._bounded_scores(x, own, found, sizes)) < 0.6 * least(by_differences)
