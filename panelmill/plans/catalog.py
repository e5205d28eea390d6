"""One query per operator over the driver tables; every query reads whole tables."""

from __future__ import annotations

import dataclasses
import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelmill.functions.items import joined
from panelmill.functions.labels import level, level_flag
from panelmill.functions import params
from panelmill.functions.numeric import finite_or_null, rounded
from panelmill.operators import (
    clusters,
    correlation,
    curves,
    folds,
    groups,
    history,
    itemsets,
    metrics,
    models,
    prepare,
    ranks,
    rules,
    scaling,
    sequences,
    summary,
)
from panelmill.plans import features, views
from panelmill.plans.views import GROUP, KEY, LOGGED, MEASURES, MINED
from panelmill.session import durable, ensure_checkpoint_dir, large_step, owned, side_by_side, stored_alone
from panelmill.sources import observations as observation_files, reports as reports_files, rules as files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SUPPORT = 0.05
CONFIDENCE = 0.6
CENTROIDS = [[0.25] * 8, [0.75] * 8, [0.25] * 4 + [0.75] * 4, [0.75] * 4 + [0.25] * 4]
PROFILED = ["region", "item", "segment", "source"]
SPACE = ["area", "production", "o_totalprice", "p_retailprice", "l_discount", "l_tax", "yield_value"]
LEVELS = ["High", "Low"]
#: Labelled rows that a model of these queries is fitted on, chosen by a hash of their key.
FIT_ROWS = 6_000
#: Rows that each leaf of the regression trees holds at least; it follows the fitting rows, which bounds the nodes.
LEAF_ROWS = FIT_ROWS // 1000
SPEC = features.FeatureSpec(
    keys=KEY,
    label="level",
    categories=["item", "season", "source"],
    numbers=["area", "o_totalprice", "p_retailprice"],
    period="yr",
    group=GROUP,
    tie=KEY,
    interactions={"item_x_season": ("item", "season"), "item_x_source": ("item", "source")},
    logs={"log_area": "area"},
    rule_columns=MINED,
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(value: Column | str, digits: int = 4) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits)


# Projections, labels and checks


@query
def observations(spark, sf):
    rows = views.observations(spark, sf)
    return rows.withColumn("yield_value", r("yield_value", 8))


@query
def label_threshold(spark, sf):
    rows = prepare.label_threshold(views.observations(spark, sf), "yield_value", 2000.0)
    return rows.groupBy("region", "yr", "level").agg(F.count("*").alias("rows"))


@query
def label_by_train_median(spark, sf):
    rows = views.labelled(spark, sf, ["region"])
    return rows.groupBy("region", "level").agg(
        F.count("*").alias("rows"), r(F.max("threshold")).alias("threshold")
    )


@query
def interactions(spark, sf):
    pairs = {"item_x_season": ("item", "season"), "item_x_source": ("item", "source")}
    rows = prepare.add_interactions(views.observations(spark, sf), pairs)
    return rows.groupBy(*pairs).agg(F.count("*").alias("rows"))


@query
def log1p_clipped(spark, sf):
    wanted = {"log_balance": "c_acctbal", "log_area": "area"}
    rows = prepare.log1p_clipped(views.observations(spark, sf), wanted)
    return rows.groupBy("region").agg(*[r(F.avg(c), 6).alias(c) for c in wanted])


@query
def period_split(spark, sf):
    train, test = prepare.period_split(views.observations(spark, sf), "yr", views.TRAIN_END)
    parts = groups.stack([train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test"))])
    return parts.groupBy("part", "region").agg(
        F.count("*").alias("rows"), F.min("yr").alias("first"), F.max("yr").alias("last")
    )


@query
def trimmed_filter(spark, sf):
    rows = prepare.filter_trimmed_equal(
        views.observations(spark, sf), {"region": " ASIA ", "source": "O "}
    )
    return rows.groupBy("region", "source", "yr").agg(F.count("*").alias("rows"))


@query
def feature_selection(spark, sf):
    rows = prepare.normalize_columns(
        views.observations(spark, sf).withColumnRenamed("yield_value", "yieldValue")
    )
    picked = prepare.select_features(
        prepare.drop_columns(rows, ["production", "not_there"]),
        {"region": "string", "yield_value": "double", "production": "double", "yr": "int"},
    )
    return picked.groupBy("region", "yr").agg(
        r(F.avg("yield_value")).alias("yield_value"), F.count("production").alias("production")
    )


@query
def constraint_check(spark, sf):
    limits = {
        "area": prepare.range_rule("area", 5, 45),
        "balance": prepare.range_rule("c_acctbal", low=0),
        "discount": prepare.range_rule("l_discount", high=0.08),
        "segment": prepare.vocabulary_rule("segment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]),
    }
    return prepare.check_constraints(views.observations(spark, sf), limits)


@query
def outside_typical(spark, sf):
    rows = views.observations(spark, sf)
    train, test = prepare.period_split(rows, "yr", 1995)
    measured = ["o_totalprice", "yield_value", "c_acctbal"]
    flagged = prepare.flag_outside_typical(test, train, measured)
    return flagged.groupBy("region").agg(
        *[F.count_if(F.col(f"{c}_outside")).alias(f"{c}_outside") for c in measured]
    )


@query
def override_else_lookup(spark, sf):
    rows = views.observations(spark, sf)
    macro = history.macro_by_period(rows, "yr", ["o_totalprice"])
    own = rows.withColumn("o_totalprice", F.when(F.col("lot") == "S", F.col("o_totalprice")))
    filled = prepare.override_else_lookup(own, macro, "yr", ["o_totalprice"])
    return filled.groupBy("yr", "lot").agg(r(F.avg("o_totalprice")).alias("total"))


# Profiles


@query
def dataset_overview(spark, sf):
    return summary.dataset_overview(views.observations(spark, sf), "yr", ["region", "item", "segment", "season"])


@query
def period_counts(spark, sf):
    return summary.period_counts(views.observations(spark, sf), "yr")


@query
def numeric_profile(spark, sf):
    profile = summary.numeric_profile(views.stored(spark, sf, MEASURES), MEASURES)
    return profile.select("column", "count", *[r(c).alias(c) for c in ("mean", "median", "std", "min", "max")])


@query
def category_distribution(spark, sf):
    found = summary.category_distribution(views.observations(spark, sf), [*MINED, "segment"])
    return found.withColumn("share", r("share", 8))


@query
def top_categories(spark, sf):
    shares = summary.category_distribution(views.table(spark, sf, "documents"), ["lang", "source"])
    return summary.top_categories(shares, 3).drop("share")


@query
def category_cardinality(spark, sf):
    return summary.category_cardinality(views.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query
def missing_counts(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    gaps = lines.withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax"))).withColumn(
        "l_discount", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    )
    return summary.missing_counts(gaps, ["l_tax", "l_discount", "l_returnflag"])


@query
def duplicate_rows(spark, sf):
    """Copies of whole rows: order lines, and documents without their number."""
    tables = {
        "lineitem": views.table(spark, sf, "lineitem"),
        "documents": views.table(spark, sf, "documents").drop("doc_id"),
    }
    return groups.stack(
        [summary.duplicate_rows(rows).withColumn("table", F.lit(name)) for name, rows in tables.items()]
    )


@query
def correlation_matrix(spark, sf):
    found = correlation.correlation_matrix(views.stored(spark, sf, ["yr", *MEASURES]), ["yr", *MEASURES])
    return found.withColumn("r", r("r", 6))


@query
def correlation_bands(spark, sf):
    found = correlation.correlation_matrix(views.stored(spark, sf, ["yr", *MEASURES]), ["yr", *MEASURES])
    return correlation.correlation_bands(found).select("feature", "other", "band", "sign", "shown")


@query
def mean_by(spark, sf):
    cells = groups.mean_by(views.observations(spark, sf), [*GROUP, "yr"], "yield_value")
    return cells.withColumn("yield_value", r("yield_value"))


@query
def group_share(spark, sf):
    return groups.group_share(views.observations(spark, sf), ["segment"]).withColumn("percent", r("percent", 6))


@query
def level_vs_global(spark, sf):
    return groups.level_vs_global(views.observations(spark, sf), ["item"], ["area", "production", "yield_value"])


@query
def dominant_value(spark, sf):
    return groups.dominant_value(views.observations(spark, sf), ["region"], ["item", "season", "segment"])


@query
def match_on_keys(spark, sf):
    orders = views.table(spark, sf, "orders")
    wanted = views.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    found = groups.match_on_keys(orders, wanted, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return found.select("o_custkey", "o_orderkey", "o_totalprice")


@query
def top_k_per_group(spark, sf):
    rows = views.observations(spark, sf).withColumn("yield_value", r("yield_value", 8))
    order = [F.desc("yield_value"), *KEY]
    return groups.top_k_per_group(rows, ["region"], order, 5).select("region", "rank", "yield_value", *KEY)


@query
def exact_median(spark, sf):
    orders = views.table(spark, sf, "orders")
    found = ranks.exact_quantiles(orders, ["o_totalprice"])
    above = F.count_if(F.col("o_totalprice") > found["o_totalprice"])
    return orders.agg(r(F.lit(found["o_totalprice"])).alias("median"), above.alias("above"))


# History


@query
def history_means(spark, sf):
    found = history.history(
        views.observations(spark, sf), GROUP, "yr", {"yields": "yield_value", "areas": "area", "totals": "o_totalprice"}
    )
    return found.select(*GROUP, "yr", r("yields").alias("yields"), r("areas", 6).alias("areas"), r("totals", 7).alias("totals"))


@query
def history_overview(spark, sf):
    found = history.history_overview(views.observations(spark, sf), "region", "item", "yr", "yield_value")
    return found.withColumn("value", r("value"))


@query
def nested_series(spark, sf):
    cells = groups.mean_by(views.observations(spark, sf), [*GROUP, "yr"], "area")
    nested = history.nested_series(cells, GROUP, "yr", "area")
    years = F.array_join(F.transform("points", lambda p: p["yr"].cast("string")), "|")
    return nested.select(*GROUP, years.alias("years"), F.size("points").alias("points"))


@query
def macro_by_period(spark, sf):
    found = history.macro_by_period(views.observations(spark, sf), "yr", ["o_totalprice", "c_acctbal"])
    return found.select("yr", *[r(c).alias(c) for c in ("o_totalprice", "c_acctbal")])


@query
def period_macro_join(spark, sf):
    rows = views.observations(spark, sf)
    macro = history.macro_by_period(rows, "yr", ["o_totalprice"]).withColumnRenamed("o_totalprice", "macro")
    joined_rows = history.join_period_macro(rows, macro, "yr")
    return joined_rows.groupBy("region", "yr").agg(
        F.count_if(F.col("o_totalprice") > F.col("macro")).alias("above"), r(F.max("macro")).alias("macro")
    )


@query
def trend_summary(spark, sf):
    series = history.history(views.observations(spark, sf), GROUP, "yr", {"value": "yield_value"})
    rounded = series.withColumn("value", r("value", 6))
    found = history.trend_summary(rounded, GROUP, "yr", "value", 1995, 2001)
    return found.withColumn("change_percent", r("change_percent"))


@query
def lag_levels(spark, sf):
    rows = views.user_events(spark, sf)
    return history.lag_levels(rows, ["user_id"], "day", "level", ["event_id"]).select(
        "event_id", "lag1", "lag2", "lag3"
    )


@query
def persistence_features(spark, sf):
    rows = views.labelled(spark, sf, [*GROUP, *KEY])
    return history.persistence_features(rows, GROUP, "yr", "level", KEY).select(*KEY, *history.FLAGS)


@query
def asof_previous(spark, sf):
    rows = views.user_events(spark, sf)
    found = history.asof_previous(rows, views.daily_levels(spark, sf), ["user_id"], "day", "level")
    return found.select("event_id", "asof1", "asof2", "asof3")


@query
def persistence_asof(spark, sf):
    rows = views.user_events(spark, sf)
    found = history.persistence_features_asof(rows, rows, ["user_id"], "day", "level", ["event_id"])
    return found.select("event_id", *history.FLAGS)


# Patterns


@query
def sequence_patterns_2(spark, sf):
    found = sequences.sequence_patterns(
        views.user_events(spark, sf), ["user_id"], "day", "value", views.DAILY_THRESHOLD, 2
    )
    return found.withColumn("support", r("support", 8))


@query
def sequence_patterns_3(spark, sf):
    found = sequences.sequence_patterns(
        views.user_events(spark, sf), ["user_id"], "day", "value", views.DAILY_THRESHOLD, 3
    )
    return found.withColumn("support", r("support", 8))


@query
def sequence_patterns_cells(spark, sf):
    """Threshold at the median of the cell means, so both levels occur."""
    rows = views.stored(spark, sf, [*GROUP, "yr", "yield_value"])
    cells = groups.mean_by(rows, [*GROUP, "yr"], "yield_value")
    middle = ranks.exact_quantiles(cells, ["yield_value"])["yield_value"]
    found = sequences.sequence_patterns(rows, GROUP, "yr", "yield_value", middle, 2)
    return found.withColumn("support", r("support", 8))


@query
def sequence_count(spark, sf):
    return sequences.sequence_count(views.user_events(spark, sf), ["user_id"], "day")


def _mined(spark, sf) -> DataFrame:
    return itemsets.frequent_itemsets(views.labelled(spark, sf, MINED), [*MINED, "level"], SUPPORT)


def _flat_rules(found: DataFrame) -> DataFrame:
    return found.select(
        joined(F.col("antecedent")).alias("antecedent"),
        joined(F.col("consequent")).alias("consequent"),
        *[r(c, 8).alias(c) for c in ("support", "confidence", "lift")],
    )


@query
def transactions(spark, sf):
    rows = itemsets.transactions(views.observations(spark, sf), MINED)
    return rows.groupBy(joined(F.col("items")).alias("items")).agg(F.count("*").alias("rows"))


@query
def frequent_itemsets(spark, sf):
    found = _mined(spark, sf)
    return found.select(joined(F.col("items")).alias("items"), "size", "count", r("support", 8).alias("support"))


@query
def candidate_counts(spark, sf):
    rows = views.labelled(spark, sf, MINED)
    columns = [*MINED, "level"]
    sets = itemsets.frequent_itemsets(rows, columns, SUPPORT)
    return itemsets.itemset_totals(sets, itemsets.candidate_counts(rows, columns, sets))


@query
def itemset_report(spark, sf):
    found = itemsets.frequent_itemsets(views.observations(spark, sf), MINED, 0.03)
    report = itemsets.itemset_report(found, 8)
    return report.select(F.array_join("itemset", "|").alias("itemset"), "size", "count", "support")


@query
def association_rules(spark, sf):
    return _flat_rules(rules.association_rules(_mined(spark, sf), CONFIDENCE))


@query
def target_rules(spark, sf):
    found = rules.association_rules(_mined(spark, sf), CONFIDENCE)
    return _flat_rules(rules.ordered_rules(rules.target_rules(found, "level", 1.0)))


@query
def target_rules_lot(spark, sf):
    """Rules for a category at lower support and confidence, any lift."""
    sets = itemsets.frequent_itemsets(views.observations(spark, sf), MINED, 0.03)
    return _flat_rules(rules.target_rules(rules.association_rules(sets, 0.5), "lot"))


def _train_rules(rows: DataFrame) -> DataFrame:
    """Mined once and stored, as rules are before rows are matched."""
    mined = rules.train_only_rules(rows, views.is_train(), [*MINED, "level"], "level", SUPPORT, CONFIDENCE)
    return durable(mined)


@query
def train_only_rules(spark, sf):
    return _flat_rules(_train_rules(views.labelled(spark, sf, MINED)))


@query
def match_rules(spark, sf):
    rows = views.labelled(spark, sf, MINED)
    found = rules.match_rules(rows, _train_rules(rows), MINED)
    return found.groupBy(joined(F.col("items")).alias("items")).agg(
        F.count("*").alias("rules"), r(F.max("lift"), 8).alias("lift")
    )


@query
def rule_features(spark, sf):
    rows = views.labelled(spark, sf, [*MINED, *KEY])
    found = rules.rule_features(rows, _train_rules(rows), MINED, "level")
    return found.select(
        *KEY,
        *[r(c, 8).alias(c) for c in rules.RULE_FEATURES[:4]],
        F.col("assoc_rule_count").cast("long").alias("assoc_rule_count"),
    )


@query
def basket_itemsets(spark, sf):
    lines = views.table(spark, sf, "lineitem").join(
        views.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    found = itemsets.frequent_itemsets_baskets(lines, "l_orderkey", "p_type", 0.02)
    return found.select(joined(F.col("items")).alias("items"), "size", "count", r("support", 8).alias("support"))


# Metrics


def _season_guess(spark, sf) -> DataFrame:
    guess = F.when(F.col("lot") == "S", "A").when(F.col("lot") == "M", "N").otherwise("R")
    return views.observations(spark, sf).withColumn("guess", guess)


def _level_guess(spark, sf) -> DataFrame:
    return views.labelled(spark, sf, ["area"]).withColumn("guess", level(-F.col("area"), -22.0))


TOLERANCES = [0.0001, 0.1, 10.0, 1000.0, 100000.0]
GUESSED = ["region", "item", "lot", "yr", "yield_value", *KEY]
VARIANTS = {"by_region": ["region"], "by_item": ["item"], "by_lot": ["lot"]}


def _guesses(spark, sf) -> DataFrame:
    """Test rows with the training mean of three groupings as predictions."""
    train, test = prepare.period_split(views.stored(spark, sf, GUESSED), "yr", views.TRAIN_END)
    parts = []
    for name, keys in VARIANTS.items():
        means = train.groupBy(*keys).agg(F.avg("yield_value").alias("guess"))
        parts.append(test.join(means, keys, "left").withColumn("variant", F.lit(name)))
    return groups.stack(parts)


def _variant_metrics(spark, sf) -> DataFrame:
    measured = metrics.regression_metrics(_guesses(spark, sf), "yield_value", "guess", ["variant"])
    return metrics.metric_rows(measured, ["r2", "rmse", "mae"], ["variant"])


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_season_guess(spark, sf), "season", "guess", dense=True)


@query
def classification_metrics(spark, sf):
    found = metrics.classification_metrics(_season_guess(spark, sf), "season", "guess")
    return found.select(*[r(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


@query
def binary_metrics(spark, sf):
    found = metrics.binary_metrics(_level_guess(spark, sf), "level", "guess", by=["yr"])
    return found.select("yr", *[r(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


@query
def regression_metrics(spark, sf):
    found = metrics.regression_metrics(_guesses(spark, sf), "yield_value", "guess", ["variant"])
    return found.select("variant", *[r(c, 6).alias(c) for c in ("r2", "rmse", "mae")], "n")


@query
def metric_diff(spark, sf):
    """Sales per item type in two periods; a type without sales in the second has no counterpart."""
    rows = views.observations(spark, sf).select("item", "yr", "yield_value")
    first, second = prepare.period_split(rows, "yr", views.TRAIN_END)
    means = [part.groupBy(F.col("item").alias("metric")).agg(F.avg("yield_value").alias("value")) for part in (first, second)]
    found = metrics.metric_diff(*means, 5.0)
    return found.select("metric", *[r(c, 5).alias(c) for c in ("expected", "actual", "diff")], "within")


@query
def metrics_pass(spark, sf):
    """Whether two variants agree, at several tolerances."""
    rows = durable(_variant_metrics(spark, sf))
    one, two = (rows.filter(F.col("variant") == v).drop("variant") for v in ("by_region", "by_lot"))
    passed = [
        metrics.metrics_pass(metrics.metric_diff(one, two, tolerance)).withColumn("tolerance", F.lit(tolerance))
        for tolerance in TOLERANCES
    ]
    return groups.stack(passed)


@query
def compare_variants(spark, sf):
    found = metrics.compare_variants(_variant_metrics(spark, sf), list(VARIANTS))
    return found.select("metric", *[r(v, 5).alias(v) for v in VARIANTS])


@query
def best_variant(spark, sf):
    return metrics.best_variant(_variant_metrics(spark, sf), list(VARIANTS), "r2")


@query
def best_per_metric(spark, sf):
    found = metrics.best_per_metric(_variant_metrics(spark, sf))
    return found.withColumn("best", r("best", 5))


@query
def actual_vs_predicted(spark, sf):
    rows = _guesses(spark, sf).filter("variant = 'by_lot'")
    found = metrics.actual_vs_predicted(rows, "yield_value", "guess", ["yr", "item", *KEY], 8)
    return found.withColumn("predicted", r("predicted"))


# Curves


def _flat_curve(curve: DataFrame) -> DataFrame:
    return curve.withColumns({"fpr": r("fpr", 8), "tpr": r("tpr", 8)})


@query
def roc_curve(spark, sf):
    return _flat_curve(curves.roc_curve(views.document_scores(spark, sf), "quality", "score", drop_intermediate=False))


@query
def roc_curve_corners(spark, sf):
    return _flat_curve(curves.roc_curve(views.document_scores(spark, sf), "quality", "score"))


@query
def roc_curve_by_lang(spark, sf):
    return _flat_curve(curves.roc_curve(views.document_scores(spark, sf), "toxic", "score", ["lang"], False))


@query
def auc(spark, sf):
    found = curves.auc(views.document_scores(spark, sf), "quality", "score")
    return found.withColumn("auc", r("auc", 8))


@query
def curve_downsample(spark, sf):
    curve = curves.roc_curve(views.document_scores(spark, sf), "quality", "score", drop_intermediate=False)
    return _flat_curve(curves.curve_downsample(curve))


@query
def ovr_auc(spark, sf):
    found = curves.ovr_auc(views.centroid_scores(spark, sf))
    return found.withColumn("auc", r("auc", 8))


@query
def ovr_roc(spark, sf):
    return _flat_curve(curves.ovr_roc(views.centroid_scores(spark, sf), drop_intermediate=False))


def _means(areas: DataFrame) -> DataFrame:
    found = curves.macro_weighted_auc(areas)
    return found.select(*[r(c, 8).alias(c) for c in ("macro_auc", "weighted_auc")])


@query
def macro_weighted_auc(spark, sf):
    return _means(curves.ovr_auc(views.centroid_scores(spark, sf)))


@query
def roc_summary(spark, sf):
    variants = {"distance": False, "angle": True}
    return groups.stack(
        [
            _means(curves.ovr_auc(views.centroid_scores(spark, sf, cosine))).withColumn("variant", F.lit(name))
            for name, cosine in variants.items()
        ]
    )


@query
def compare_class_auc(spark, sf):
    both = [curves.ovr_auc(views.centroid_scores(spark, sf, cosine)) for cosine in (False, True)]
    rounded = [areas.withColumn("auc", r("auc", 8)) for areas in both]
    return curves.compare_class_auc(*rounded, "distance", "angle")


@query
def verify_auc(spark, sf):
    both = [curves.ovr_auc(views.centroid_scores(spark, sf, cosine)) for cosine in (False, True)]
    found = curves.verify_auc(*both)
    return found.select(*[r(c, 8).alias(c) for c in found.columns])


@query
def curve_downsample_by_class(spark, sf):
    curve = curves.ovr_roc(views.centroid_scores(spark, sf), drop_intermediate=False)
    return _flat_curve(curves.curve_downsample(curve, ["class"]))


# Clusters


def _space(spark, sf) -> DataFrame:
    return clusters.cluster_features(views.stored(spark, sf, [*KEY, *MEASURES]), MEASURES, LOGGED)


def _clustered(spark, sf) -> DataFrame:
    """Labels are stored, as diagnostics pass over them several times."""
    return durable(clusters.assign_nearest(_space(spark, sf), CENTROIDS, MEASURES))


def _raw_clustered(spark, sf) -> DataFrame:
    """Cluster labels beside the unscaled columns."""
    rows = views.stored(spark, sf, [*MEASURES, *PROFILED])
    kept = rows.withColumns({f"raw_{c}": F.col(c) for c in MEASURES})
    scaled = clusters.cluster_features(kept, MEASURES, LOGGED)
    labelled = clusters.assign_nearest(scaled, CENTROIDS, MEASURES)
    return durable(labelled.drop(*MEASURES).withColumnsRenamed({f"raw_{c}": c for c in MEASURES}))


@query
def cluster_features(spark, sf):
    return _space(spark, sf).select(*KEY, *[r(c, 8).alias(c) for c in MEASURES])


@query
def assign_nearest(spark, sf):
    return _clustered(spark, sf).select(*KEY, "cluster")


@query
def silhouette_sq(spark, sf):
    scored = clusters.silhouette_sq(_clustered(spark, sf), MEASURES, "cluster")
    return scored.select(*KEY, "cluster", r("silhouette_sq", 6).alias("silhouette_sq"))


@query
def silhouette(spark, sf):
    """Euclidean silhouettes of the embeddings by label; ``exact`` where the bound on the error is nil."""
    vectors = views.table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    width = vectors.select(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    axes = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(width)]
    found = clusters.silhouette(vectors.select("vec_id", "label", *axes), [f"x{i}" for i in range(width)], "label", cell_count=1 << 12)
    return found.select("vec_id", "label", r("silhouette", 6).alias("silhouette"), (F.col("silhouette_error") < 1e-7).alias("exact"))


@query
def cluster_distribution(spark, sf):
    found = clusters.cluster_distribution(_clustered(spark, sf), "cluster")
    return found.withColumn("percent", r("percent", 6))


@query
def cluster_profile(spark, sf):
    found = clusters.cluster_profile(
        _raw_clustered(spark, sf), "cluster", MEASURES, SPACE, PROFILED
    )
    means = {f"mean_{c}": r(f"mean_{c}") for c in MEASURES}
    return found.withColumns({"percent": r("percent", 6)} | means)


@query
def cluster_rules(spark, sf):
    found = clusters.cluster_profile(
        _raw_clustered(spark, sf), "cluster", MEASURES, SPACE, PROFILED
    )
    roles = {"kind": "item", "place": "region", "market": "segment", "origin": "source"}
    told = clusters.cluster_rules(found, "cluster", ["area", "production", "yield_value"], roles)
    return told.select("cluster", F.array_join("conditions", ", ").alias("conditions"), "typical.*")


@query
def cluster_quality(spark, sf):
    scored = clusters.silhouette_sq(_clustered(spark, sf), MEASURES, "cluster")
    found = clusters.cluster_quality(scored, "cluster")
    return found.withColumn("mean_silhouette", r("mean_silhouette", 6))


@query
def evaluate_in_space(spark, sf):
    scored = clusters.evaluate_in_space(_raw_clustered(spark, sf), SPACE, "cluster")
    return clusters.overall_quality(scored).withColumn("overall_silhouette", r("overall_silhouette", 6))


@query
def hopkins(spark, sf):
    found = clusters.hopkins(_space(spark, sf), MEASURES, KEY)
    return found.withColumn("hopkins", r("hopkins", 6))


@query
def kmeans_fit(spark, sf):
    """K, rows, and whether every row lies nearest to the centroid of its own cluster."""
    rows = durable(_space(spark, sf).select(*MEASURES))
    model = clusters.kmeans_fit(rows, MEASURES, 8)
    labelled = clusters.assign_nearest(rows, clusters.sorted_centroids(model), MEASURES)
    counted = clusters.cluster_distribution(labelled, "cluster")
    nearest = abs(model.inertia - _inertia(labelled, model)) <= 1e-3 * model.inertia
    return counted.agg(F.count("*").alias("k"), F.sum("count").alias("rows")).withColumn("nearest", F.lit(nearest))


def _inertia(labelled: DataFrame, model) -> float:
    """Sum of squared distances of the rows to the centroid of their label."""
    centres = clusters.sorted_centroids(model)
    picked = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])[F.col("cluster")]
    gap = sum(((F.col(c) - picked[i]) * (F.col(c) - picked[i]) for i, c in enumerate(MEASURES)), F.lit(0.0))
    return labelled.agg(F.sum(gap).alias("s")).first()["s"]


@query
def kmeans_sweep(spark, sf):
    """Ten K, ten starts each; whether a larger K fits better and silhouettes are in range."""
    found = clusters.kmeans_sweep(_space(spark, sf), MEASURES)
    before = F.lag("inertia").over(Window.orderBy("k"))
    return found.select(
        "k", "selected", F.coalesce(F.col("inertia") <= before, F.lit(True)).alias("falls"), F.col("silhouette_sq").between(-1, 1).alias("in_range")
    )


# Scaling, folds and models


@query
def min_max_scale(spark, sf):
    rows = views.observations(spark, sf)
    train, test = prepare.period_split(rows, "yr", views.TRAIN_END)
    found = scaling.min_max_scale(test, ["area", "production"], train)
    return found.select(*KEY, r("area", 8).alias("area"), r("production", 8).alias("production"))


@query
def standard_scale(spark, sf):
    found = scaling.standard_scale(views.observations(spark, sf), ["area", "c_acctbal"])
    return found.select(*KEY, r("area", 6).alias("area"), r("c_acctbal", 6).alias("c_acctbal"))


@query
def imputed(spark, sf):
    rows = views.observations(spark, sf)
    gaps = rows.withColumns(
        {
            "area": F.when(F.col("lot") != "S", F.col("area")),
            "season": F.when(F.col("source") == "O", F.col("season")),
        }
    )
    filled = scaling.impute_most_frequent(scaling.impute_median(gaps, ["area"]), ["season"])
    return filled.groupBy("season", "lot").agg(F.count("*").alias("rows"), r(F.avg("area"), 6).alias("area"))


@query
def stratified_folds(spark, sf):
    rows = views.labelled(spark, sf, KEY).select(*KEY, "level")
    return folds.stratified_folds(rows, "level", KEY, 5)


USED = [*KEY, *GROUP, *MINED, "area", "o_totalprice", "p_retailprice", "segment"]


@query
def build_features(spark, sf):
    """The serving form: rules and history of the training years, rows of the test year."""
    rows = views.labelled(spark, sf, USED)
    train, test = prepare.period_split(rows, "yr", views.TRAIN_END)
    found = features.build_features(test, SPEC, features.ADVANCED, _train_rules(rows), train)
    rounded = [*rules.RULE_FEATURES, "log_area", "area", "o_totalprice", "p_retailprice"]
    return found.withColumns({c: r(c, 8) for c in rounded if c in found.columns})


def _features(spark, sf, variant: str, extra: Sequence[str] = (), tested: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training rows, bounded for fitting, and all test rows of a variant (none unless ``tested``), with ``extra`` columns kept.

    Features come from all rows; those of training rows that no model is fitted on are not stored.
    """
    spec = dataclasses.replace(SPEC, keys=[*KEY, *extra])
    total = 0

    def make() -> DataFrame:
        nonlocal total
        rows = views.labelled(spark, sf, USED)
        mined = _train_rules(rows) if variant == features.ADVANCED else None
        total = prepare.period_split(rows, "yr", views.TRAIN_END)[0].count()
        wanted = views.is_train() & models.fitting_choice(KEY, FIT_ROWS, total)
        if tested:
            wanted = wanted | (F.col("yr") > views.TRAIN_END)
        return features.build_features(rows, spec, variant, mined).filter(wanted)

    made = stored_alone(make)
    train, test = prepare.period_split(made, "yr", views.TRAIN_END)
    return models.fitting_rows(train, KEY, FIT_ROWS, total=total), test


def _forest(variant: str, label: str = "level", labels: Sequence[str] = tuple(LEVELS)):
    return models.forest_classifier(SPEC.categories_of(variant), SPEC.numbers_of(variant), label, list(labels))


def _classified(test: DataFrame, model) -> DataFrame:
    """Rows per level; whether each prediction is the class of the largest probability, and whether more are right than the largest class has."""
    scored = models.score(test, model, ["level"], LEVELS)
    best = F.array_position("probability", F.array_max("probability"))
    told = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), best.cast("int"))
    judged = durable(scored.select("level", (F.col("prediction") == told).alias("likeliest"), (F.col("prediction") == F.col("level")).cast("int").alias("right")))
    per_level = judged.groupBy("level").agg(F.count("*").alias("rows"), F.bool_and("likeliest").alias("likeliest"), F.sum("right").alias("right"))
    every = params.one_row(per_level.agg(F.sum("right").alias("right"), F.max("rows").alias("largest")))
    return per_level.select("level", "rows", "likeliest", (every["right"] > every["largest"]).alias("useful"))


@query
def forest_classifier(spark, sf):
    train, test = _features(spark, sf, features.ADVANCED)
    return _classified(test, _forest(features.ADVANCED).fit(train))


@query
def forest_regressor(spark, sf):
    """Yield by three feature sets: rows, whether the metrics are finite, and which set has the best R2."""

    def measured_on(variant: str) -> DataFrame:
        with large_step(spark):
            train, test = _features(spark, sf, variant, ["yield_value"])
        model = models.forest_regressor(SPEC.categories_of(variant), SPEC.numbers_of(variant), "yield_value", min_rows_per_leaf=LEAF_ROWS)
        scored = durable(models.predict(test, model.fit(train), ["yield_value"]))
        measured = metrics.regression_metrics(scored, "yield_value", "prediction")
        return measured.withColumn("variant", F.lit(variant))

    variants = (features.BASELINE, features.ENGINEERED, features.ADVANCED)
    measured = durable(groups.stack(side_by_side([functools.partial(measured_on, v) for v in variants], 3)))
    rows = metrics.metric_rows(measured, ["r2", "rmse", "mae"], ["variant"])
    best = metrics.best_per_metric(rows).filter("metric = 'r2'").select(F.col("best").alias("top"))
    joined = measured.join(best, measured["r2"] == best["top"], "left")
    return joined.groupBy("variant").agg(
        F.max("n").alias("n"),
        F.bool_and(F.col("rmse").isNotNull() & (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1)).alias("plausible"),
        F.bool_and(F.col("top").isNull() | (F.col("r2") == F.col("top"))).alias("compared"),
        F.bool_and(F.col("r2") > 0).alias("useful"),
    )


@query
def network_classifier(spark, sf):
    train, test = _features(spark, sf, features.ENGINEERED)
    categories, numbers = SPEC.categories_of(features.ENGINEERED), SPEC.numbers_of(features.ENGINEERED)
    inputs = models.vector_length(train, categories, numbers)
    network = models.network_classifier(categories, numbers, "level", LEVELS, inputs)
    return _classified(test, network.fit(train))


def _segments(train: DataFrame) -> list[str]:
    return sorted(row.segment for row in train.select("segment").distinct().collect())


@query
def score_top_k(spark, sf):
    """The five likeliest segments per row: ranks, and whether probabilities fall with the rank and stay within one."""
    train, test = _features(spark, sf, features.ENGINEERED, ["segment"])
    labels = _segments(train)
    scored = models.score(test, _forest(features.ENGINEERED, "segment", labels).fit(train), KEY, labels)
    top = models.top_classes(scored, KEY, labels, 5)
    per_row = top.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("rank", "probability"))).alias("p"), F.sum("probability").alias("total")
    )
    falls = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.col("p")[i - 1]["probability"] >= F.col("p")[i]["probability"])
    return per_row.agg(
        F.count("*").alias("rows"), F.sum(F.size("p")).alias("ranks"), F.bool_and((F.size("p") < 2) | falls).alias("falls"),
        F.bool_and(F.col("total") < 1 + 1e-9).alias("within"),
    )


@query
def model_roc(spark, sf):
    """A model of three lot sizes and its one-vs-rest areas: support per class, and whether each class is told apart."""
    train, test = _features(spark, sf, features.ENGINEERED, ["lot"])
    labels = sorted(row.lot for row in train.select("lot").distinct().collect())
    model = _forest(features.ENGINEERED, "lot", labels).fit(train)
    scored = durable(models.score(test, model, ["lot"], labels))
    areas = curves.ovr_auc(curves.ovr_scores(scored, "lot", "probability", labels, labels))
    return areas.select("class", "support", F.col("auc").between(0.75, 1).alias("told_apart"))


@query
def feature_importance(spark, sf):
    """Features in the model, whether their shares sum to one, and which one leads: the area, by which the yield is divided."""
    variant = features.ADVANCED
    train, _ = _features(spark, sf, variant, tested=False)
    model = _forest(variant).fit(train)
    found = durable(models.feature_importance(model, SPEC.categories_of(variant), SPEC.numbers_of(variant), spark))
    total = found.agg(F.sum("importance").alias("s"), F.max("importance").alias("top")).first()
    return found.select(
        "feature", F.col("importance").between(0, 1).alias("is_share"), F.lit(abs(total["s"] - 1) < 1e-6).alias("whole"), (F.col("importance") == total["top"]).alias("leads")
    )


def _validated(dealt: DataFrame, variant: str) -> DataFrame:
    """Five folds over all years; the advanced variant mines its rules from each training part alone."""
    spec = dataclasses.replace(SPEC, keys=[*KEY, "fold"])
    categories, numbers = SPEC.categories_of(variant), SPEC.numbers_of(variant)
    # Other features are made where they are read, as storing them for all rows takes more than making them.
    rows = dealt if variant == features.ADVANCED else features.build_features(dealt, spec, variant)

    def prepared(train: DataFrame, held_out: DataFrame) -> tuple[DataFrame, DataFrame]:
        if variant != features.ADVANCED:
            return models.fitting_rows(train, KEY, FIT_ROWS), held_out
        mined = durable(rules.train_only_rules(train, F.lit(True), [*MINED, "level"], "level", SUPPORT, CONFIDENCE))
        total = train.count()
        made = [features.build_features(part, spec, variant, mined) for part in (train, held_out)]
        return models.fitting_rows(made[0], KEY, FIT_ROWS, total=total), made[1]

    def network(train: DataFrame):
        inputs = models.vector_length(train, categories, numbers)
        return models.network_classifier(categories, numbers, "level", LEVELS, inputs)

    found = models.cross_validate(rows, network, "level", LEVELS, prepare=prepared, stored=True)
    return found.withColumn("variant", F.lit(variant))


@query
def cross_validate(spark, sf):
    """Rows held out per fold, the number of metrics, whether all are between 0 and 1, and whether the model ranks better than chance."""
    dealt = stored_alone(lambda: folds.stratified_folds(views.labelled(spark, sf, USED), "level", KEY, 5))
    variants = (features.ENGINEERED, features.ADVANCED)
    found = groups.stack(side_by_side([functools.partial(_validated, dealt, v) for v in variants], 2))
    sizes = dealt.groupBy("fold").agg(F.count("*").alias("held_out"))
    checked = found.groupBy("fold", "variant").agg(
        F.count("*").alias("metrics"), F.bool_and(F.col("value").between(0, 1)).alias("in_range"),
        F.max(F.when(F.col("metric") == "auc", F.col("value"))).alias("area"),
    )
    return sizes.join(checked, "fold").withColumn("better_than_chance", F.col("area") > 0.5).drop("area")


# Labels, encodings and files


@query
def encode_label(spark, sf):
    rows = views.labelled(spark, sf, ["region"])
    coded = rows.withColumn("code", level_flag(F.col("level")))
    return coded.groupBy("region", "code").agg(F.count("*").alias("rows"))


@query
def one_hot(spark, sf):
    """Rows per slot of two encoded categories, fitted on the training years."""
    rows = views.observations(spark, sf).select("yr", "segment", "season")
    train, test = prepare.period_split(rows, "yr", views.TRAIN_END)
    model = Pipeline(stages=scaling.one_hot_stages(["segment", "season"])).fit(train)
    names = model.stages[0].labelsArray
    hot = model.transform(test)
    slots = [
        F.struct(F.lit(c).alias("column"), F.lit(value).alias("value"), vector_to_array(f"{c}_hot")[i].alias("on"))
        for c, values in zip(("segment", "season"), names)
        for i, value in enumerate(values)
    ]
    return hot.select(F.inline(F.array(*slots))).groupBy("column", "value").agg(F.sum("on").cast("long").alias("rows"))


@query
def finite_report(spark, sf):
    """Ratios with zero divisors: not finite ones are missing, the others rounded."""
    rows = views.table(spark, sf, "lineitem")
    ratio = F.try_divide(F.col("l_extendedprice"), F.col("l_discount"))
    value = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(ratio)
    kept = rows.withColumn("ratio", rounded(finite_or_null(value), 3))
    return kept.groupBy("l_returnflag").agg(F.count("ratio").alias("known"), F.count("*").alias("rows"), r(F.max("ratio"), 3).alias("largest"))


def _folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted with the scope of the query."""
    ensure_checkpoint_dir(spark)
    return owned(spark, f"{spark.sparkContext.getCheckpointDir()}/panelmill-files-{uuid.uuid4().hex}")


@query
def read_observations(spark, sf):
    """Observations written as CSV with a header and read back with their schema."""
    path = f"{_folder(spark)}/rows.csv"
    rows = views.observations(spark, sf).select("region", "item", "yr", "area", "production")
    rows.write.option("header", True).csv(path)
    again = observation_files.read_observations(spark, path, rows.schema)
    return again.groupBy("region", "yr").agg(F.count("*").alias("rows"), r(F.sum("area")).alias("area"), r(F.avg("production")).alias("production"))


@query
def rules_round_trip(spark, sf):
    """Rules written and read back."""
    path = f"{_folder(spark)}/rules"
    files.write_rules(rules.association_rules(_mined(spark, sf), CONFIDENCE), path)
    return _flat_rules(files.read_rules(spark, path))


@query
def metric_table(spark, sf):
    """Metrics stored under display headers and read back under plain names."""
    path = f"{_folder(spark)}/metrics.csv"
    found = metrics.regression_metrics(_guesses(spark, sf), "yield_value", "guess", ["variant"])
    shown = found.select(F.col("variant").alias("Variant"), *[r(c, 6).alias(n) for c, n in (("r2", "R2-score"), ("rmse", "RMSE"), ("mae", "MAE"))])
    shown.write.option("header", True).csv(path)
    return reports_files.read_metric_table(spark, path, "variant string, r2 double, rmse double, mae double")


@query
def report_sections(spark, sf):
    """Two sections of a report committed together as JSON and read back through the manifest."""
    path = f"{_folder(spark)}/report"
    rows = views.observations(spark, sf)
    reports_files.commit_report({"periods": summary.period_counts(rows, "yr"), "shares": groups.group_share(rows, ["segment"])}, path)
    periods = reports_files.read_section(spark, path, "periods", "yr int, count long")
    shares = reports_files.read_section(spark, path, "shares", "segment string, count long, percent double")
    return groups.stack(
        [
            periods.select(F.lit("periods").alias("section"), F.col("yr").cast("string").alias("name"), "count"),
            shares.select(F.lit("shares").alias("section"), F.col("segment").alias("name"), "count"),
        ]
    )


@query
def auc_comparison_file(spark, sf):
    """The comparison of areas written with six decimals and read back."""
    path = f"{_folder(spark)}/areas"
    both = [curves.ovr_auc(views.centroid_scores(spark, sf, cosine)) for cosine in (False, True)]
    reports_files.write_auc_comparison(curves.compare_class_auc(*both, "distance", "angle"), path)
    again = spark.read.option("header", True).csv(path)
    return again.select("class", F.col("distance_auc").cast("double").alias("distance_auc"), F.col("angle_auc").cast("double").alias("angle_auc"))


@query
def ngrams(spark, sf):
    """Runs of two daily levels per user, counted."""
    found = sequences.ngrams(views.daily_levels(spark, sf), ["user_id"], "day", "level", 2)
    return found.groupBy(*[c for c in found.columns if c.startswith("step")]).agg(F.count("*").alias("rows"))
