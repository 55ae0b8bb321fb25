"""Time the headline queries: one warm-up, then the median of BENCH_RUNS runs, results written to noop.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8), BENCH_RUNS (3),
BENCH_QUERIES (comma separated; default the headline list; "all" for every query).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "q_shape", "q_describe", "q_quantiles", "q_missing_counts", "q_column_info", "q_value_counts", "q_topk_values",
    "q_correlation", "q_impute_median", "q_impute_mode", "q_dedupe", "q_dedupe_documents", "q_cap_outliers",
    "q_title_case", "q_clean_table", "q_before_after", "q_histogram", "q_crosstab", "q_box_stats",
    "q_violin_density", "q_line_bucketed", "q_area_stacked", "q_radar", "q_treemap", "q_date_rate_detect",
    "q_row_index", "q_csv_ingest", "q_numbered_sections", "q_chart_plan",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tablewise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablewise-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
