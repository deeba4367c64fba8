"""Time the headline queries on the test tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Warm runs of each query.
RUNS = 3

HEADLINE = (
    "detect_quiet",
    "activity_sessions",
    "merge_intervals",
    "apply_margin_shrink",
    "keep_intervals",
    "cut_summary",
    "trim",
    "retime",
    "interval_join",
    "resample",
    "envelope",
    "parameter_sweep",
    "ema",
    "throttle",
    "stall_report",
    "telemetry_limits",
    "sort_catalog_date",
    "recent_top_k",
    "starts_agree",
    "reusable_parts",
    "dedupe_by_url",
    "redact_texts",
    "read_pcm",
    "stream_quiet",
    "stream_resume",
    "interval_cache",
    "read_quiet_log",
    "dominant_frequency",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from lullmap.bindings import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lullmap-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        # The first run starts workers and compiles code; the median of the others counts.
        taken = []
        for _ in range(1 + RUNS):
            at = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - at)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
