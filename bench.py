"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from quotalens.plans.catalog import QUERIES
from quotalens.session import local_session

HEADLINE = (
    "four_cells", "four_cells_bucketed", "decomposition", "protocols", "comparisons", "cohort_counts", "ranked_sliced", "capture_curve",
    "kth_scores", "threshold_transport", "model_diagnostics_bucketed", "fixed_width_parse", "bootstrap_cells", "block_bootstrap_cells",
    "block_bootstrap_protocols", "grid_audit", "grid_summary", "feature_parameters", "frozen_transform", "fit_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores)
    QUERIES["four_cells"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
