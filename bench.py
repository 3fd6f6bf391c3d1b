"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from breathline.catalog import all_queries
from breathline.session import build_session

HEADLINE = [
    "pf_pairs_locf", "pf_onset", "pf_sustained_anchor", "pf_admission_or_course", "peep_violation_anti",
    "cohort_funnel_counts", "interval_join_stats", "feature_wide", "whole_course_statistics", "outcome_labels",
    "interval_containment", "flag_merge", "star_left_join", "semi_and_anti", "text_predicates",
    "union_sources", "unpivot_measures", "impute_mean", "scale_minmax", "box_stats",
    "mortality_by_band", "roc_points", "auc_ks", "mean_roc", "model_compare",
    "best_split_all", "boosted_stumps", "gaussian_bayes", "knn_vote", "gbt_classifier", "random_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "breathline-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = all_queries(), {}
    # start the JVM's readers and one Python worker before the clock runs
    spark.read.parquet(f"{folder}/nation.parquet").mapInPandas(lambda it: it, "n_nationkey int, n_name string, n_regionkey int").count()
    for name in HEADLINE:
        start = time.perf_counter()
        # every row and column is computed, nothing is collected
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
