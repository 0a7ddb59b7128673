"""Headline queries at one scale; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_waveform_metrics", "a2_scalar_error_summary", "a3_beat_errors", "a4_min_shift_errors",
    "a5_patient_waveform_metrics", "a8_bootstrap_ci", "e2_fixed_windows", "f1_detect_peaks",
    "f5_pair_ptt", "j1_transit_benchmark", "j2_evaluate_waveforms", "j3_patient_metrics_waveform",
    "j4_patient_metrics_scalar", "j5_prepare_minmax", "j6_embedding_probe",
]


def main():
    from pyspark.sql import SparkSession
    from checks import QUERIES

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pulsemill-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, d).write.format("noop").mode("overwrite").save()
        seconds[n] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
