"""Headline queries at one scale, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs in full
into a sink that discards rows; the best of BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from panelcore import catalog
from panelcore.session import local_session

HEADLINE = [
    "customer_month_panel",
    "quality_report_customers",
    "clean_panel_customers",
    "feature_design_customers",
    "lag_features",
    "mad_outliers",
    "quality_report",
    "clean_panel",
    "rolling_features",
    "feature_design",
    "window_sequences",
    "fold_metrics",
    "seasonal_trend_metrics",
    "ridge_metrics",
    "conformal_width",
    "quantile_thresholds",
    "recommendations",
    "watchlist",
    "what_if_summary",
    "project_seasonal_months",
    "project_recursive",
    "linear_attribution",
    "grid_to_entity",
    "normalise_entity",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    spark.read.parquet(f"{d}/nation.parquet").count()
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
