"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores. ``python bench.py NAME ...`` times only the
named queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelmill.plans import catalog  # noqa: E402
from panelmill.session import local_session, scope  # noqa: E402

HEADLINE = [
    "label_by_train_median",
    "dataset_overview",
    "numeric_profile",
    "category_distribution",
    "duplicate_rows",
    "correlation_matrix",
    "history_means",
    "trend_summary",
    "lag_levels",
    "persistence_features",
    "persistence_asof",
    "sequence_patterns_3",
    "frequent_itemsets",
    "candidate_counts",
    "association_rules",
    "train_only_rules",
    "rule_features",
    "basket_itemsets",
    "classification_metrics",
    "regression_metrics",
    "roc_curve",
    "ovr_auc",
    "curve_downsample",
    "cluster_features",
    "silhouette_sq",
    "cluster_profile",
    "hopkins",
    "kmeans_fit",
    "stratified_folds",
    "build_features",
    "forest_classifier",
    "score_top_k",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", "16g")
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["period_counts"](spark, sf).collect()  # start the JVM code before the clock
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        with scope():
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name:26s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
