"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from netloom.plans.catalog import QUERIES

HEADLINE = [
    "user_stats", "extract_users", "still_present", "rule_report", "protocol_share", "system_port_top",
    "user_port_hist", "ip_occurrence_curve", "ip_volume_curve", "histogram_cut", "js_scorecard",
    "density_hist", "hist2d", "acf", "autocorrelation", "pearson", "mse_same_row", "mse_temporal",
    "inter_arrival", "encode_flows", "context_window", "prepare_windows", "cumulative_clock",
    "decode_flows", "sample_flows", "ordinal_encode", "write_user_flows", "mixture_nll",
    "shuffled_batches", "read_one_user", "flow_classifier", "streaming_user_stats", "streaming_rule_rates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("netloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["user_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
