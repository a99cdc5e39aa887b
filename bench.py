"""Time the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wxspark.catalog import QUERIES  # noqa: E402
from wxspark.session import build  # noqa: E402

HEADLINE = [
    "latest_row",
    "agg_quality",
    "win_lag",
    "win_rolling",
    "pipe_train",
    "fz_backtest",
    "mdl_ar",
    "mdl_ar_fit_metrics",
    "ts_decompose",
    "en_adaptive",
    "en_combine",
    "agg_metrics_detailed",
    "join_nearest_city",
    "join_band",
    "search_locations",
    "fc_forecast",
    "fc_forecast_all",
    "mdl_window_moments",
    "st_panel",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM code paths and the Python workers.
    QUERIES["mdl_ar"](spark, path).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
