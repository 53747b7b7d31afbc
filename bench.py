"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the cores. Each query is timed until all of its rows are
computed (a no-op sink). Stage tables are timed on their own first, so later
queries show what they cost on a written feature table.
"""

from __future__ import annotations

import json
import os
import time

from driftline.plans import tables
from driftline.plans.catalog import QUERIES
from driftline.session import local_session

HEADLINE = (
    "clean", "retention_funnel", "cleaning_summary", "build_features", "validate", "verify_targets",
    "check_leakage", "prepare_training", "season_split", "storm_split", "forecast_rows",
    "run_baselines", "score_split", "track_error_stats", "evaluate_models", "evaluate_by_basin",
    "comparison_table", "skill_vs_reference", "bootstrap_ci", "paired_bootstrap", "forecast_track",
    "storm_lead_path", "live_features", "dataset_summary", "displacement_by_lead",
    "split_at_antimeridian", "error_distribution", "error_by_intensity", "error_map_by_lead",
    "linear_regression", "fit_random_forest", "permutation_importance",
)
STAGES = {"stage_clean": tables.clean_table, "stage_features": tables.feature_table,
          "stage_split": tables.split_table, "stage_forecast_rows": tables.forecast_row_table,
          "stage_baselines": tables.baseline_table}


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors

    def drain(query):
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name, build in STAGES.items():
        times[name] = timed(lambda: build(spark, sf_dir))
    for name in HEADLINE:
        times[name] = timed(lambda: drain(QUERIES[name]))
    print(json.dumps({"metric": "total wall time of headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
