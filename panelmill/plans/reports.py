"""Reports as named sections, each a flat lazy frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelmill.operators import clusters, correlation, curves, itemsets, rules, sequences, summary
from panelmill.operators.groups import stack
from panelmill.session import durable


def data_statistics(df: DataFrame, period: str, dims: Sequence[str]) -> dict[str, DataFrame]:
    """Overview, periods, numeric and categorical profiles and data quality."""
    return {
        "overview": summary.dataset_overview(df, period, dims),
        "periods": summary.period_counts(df, period),
        "numeric": summary.numeric_profile(df),
        "categories": summary.category_distribution(df),
        "cardinality": summary.category_cardinality(df),
        "missing": summary.missing_counts(df),
        "duplicates": summary.duplicate_rows(df),
    }


def pattern_sections(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    min_support: float,
    min_confidence: float,
    min_lift: float | None,
) -> dict[str, DataFrame]:
    """Item sets and rules of one target; the sets are mined once and kept."""
    sets = durable(itemsets.frequent_itemsets(df, columns, min_support))
    found = rules.association_rules(sets, min_confidence)
    candidates = itemsets.candidate_counts(df, columns, sets)
    return {
        "rules": rules.target_rules(found, target, min_lift),
        "itemsets": itemsets.itemset_report(sets),
        "totals": itemsets.itemset_totals(sets, candidates),
    }


def descriptive_mining(
    df: DataFrame,
    targets: Mapping[str, dict],
    keys: Sequence[str],
    period: str,
    value: str,
    threshold,
    min_support: float = 0.10,
) -> dict[str, DataFrame]:
    """Correlations, patterns of each target and sequences of levels.

    ``targets`` maps a section name to the arguments of ``pattern_sections``.
    """
    report = {"correlation": correlation.correlation_matrix(df)}
    for name, arguments in targets.items():
        for part, frame in pattern_sections(df, **arguments).items():
            report[f"{name}_{part}"] = frame
    for n in (2, 3):
        report[f"sequences_{n}"] = sequences.sequence_patterns(
            df, keys, period, value, threshold, n, min_support
        )
    report["sequence_count"] = sequences.sequence_count(df, keys, period)
    return report


def clustering(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    log_columns: Sequence[str],
    evaluation: Sequence[str],
    levels: Sequence[str],
    categories: Sequence[str],
    k: int = 8,
    n_init: int = 10,
    ks: Sequence[int] = tuple(range(2, 11)),
) -> dict[str, DataFrame]:
    """Tendency, K sweep, profiles and silhouettes in both feature spaces."""
    unscaled = [F.col(c).alias(f"raw_{c}") for c in dict.fromkeys([*columns, *evaluation, *levels])]
    kept = dict.fromkeys([*key, *categories])
    rows = clusters.cluster_features(df.select(*kept, *columns, *unscaled), columns, log_columns)
    rows = durable(rows)
    model = clusters.kmeans_fit(rows, columns, k, n_init)
    labelled = clusters.assign_nearest(rows, clusters.sorted_centroids(model), columns)
    labelled = durable(labelled)
    scored = clusters.silhouette_sq(labelled, columns, "cluster")
    other = clusters.evaluate_in_space(labelled, [f"raw_{c}" for c in evaluation], "cluster")
    raw = labelled.select(
        "cluster", *categories, *[F.col(f"raw_{c}").alias(c) for c in dict.fromkeys([*columns, *levels])]
    )
    return {
        "hopkins": clusters.hopkins(rows, columns, key),
        "optimal_k": clusters.kmeans_sweep(rows, columns, ks, k, n_init),
        "distribution": clusters.cluster_distribution(labelled, "cluster"),
        "profiles": clusters.cluster_profile(raw, "cluster", columns, levels, categories),
        "quality": clusters.cluster_quality(scored, "cluster"),
        "overall": clusters.overall_quality(scored),
        "evaluation_quality": clusters.cluster_quality(other, "cluster"),
        "evaluation_overall": clusters.overall_quality(other),
    }


def roc_report(scores: DataFrame, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Curves, areas and means of a one-vs-rest score table, checked against stored areas."""
    areas = curves.ovr_auc(scores)
    report = {
        "curves": curves.curve_downsample(curves.ovr_roc(scores), ["class"]),
        "class_auc": areas,
        "means": curves.macro_weighted_auc(areas),
    }
    if stored is not None:
        report["verification"] = curves.verify_auc(areas, stored)
    return report


def roc_summary(variants: Mapping[str, DataFrame]) -> DataFrame:
    """One row per variant with its mean areas; ``variants`` maps names to score tables."""
    return stack(
        [
            curves.macro_weighted_auc(curves.ovr_auc(scores)).withColumn("variant", F.lit(name))
            for name, scores in variants.items()
        ]
    )
