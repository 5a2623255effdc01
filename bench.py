"""Time the headline queries: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tripwright.plans import load_registry  # noqa: E402

HEADLINES = (
    "s1_csv_scan", "m23_phase_feature_build", "flagship_delay_rate_by_origin_hour", "a1_conflict_aware_imputation",
    "w1_group_median_fill", "w2_slot_counts", "j1_asof_join", "j2_latency_sweep_asof", "j5_fingerprint_match_counts",
    "j6_partial_key_match", "j21_key_masking_diagnostic", "a42_year_attribution", "a5_bins_long", "a11_score_metrics",
    "a15_equal_frequency_bins_ece", "a16_overlapping_group_metrics", "m4_oof_target_encode", "m14_threshold_sweep",
    "w10_merge_intervals", "w11_subtract_intervals", "a47_rollup_dimensions",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()
    registry["a6_confusion_counts"].build(spark, sf).write.format("noop").mode("overwrite").save()  # warm the JVM
    timings = {}
    for name in HEADLINES:
        start = time.perf_counter()
        registry[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
