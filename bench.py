"""Time the headline queries; prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (comma list)."""

from __future__ import annotations

import json
import os
import time

from gridmeter.queries import QUERIES
from gridmeter.session import build_session

HEADLINE = [
    "s1_meter_log_scan", "a1_hourly_rollup", "a2_hourly_zero_filled", "a4_percentiles_raw", "a6_hourly_profile", "a9_heatmap",
    "a13_daily_consumption", "a21_feature_correlations", "a22_autocorrelation", "a25_energy_insights", "a28_eda_summary",
    "q8_hour_coverage", "q10_preprocess_report", "q11_validate_uploads", "q12_sampling_interval", "q15_profile",
    "j1_complete_index", "j6_uploads_in_period", "j7_user_period_data", "j9_period_comparison", "w1_gap_islands_users",
    "w2_fill_short_gaps", "w6_basic_features", "w8_rolling_strict", "w10_exponential_means", "w12_advanced_features",
    "w17_chronological_split", "m2_seasonal_ar_fit", "m13_regression_metrics", "m14_extended_metrics", "g1_peak_forecast",
    "g2_tou_cost", "g3_load_shifts", "g4_shift_sensitivity", "g5_daily_savings", "g6_recommendations", "g9_dashboard_month",
    "g11_cost_analytics", "b6_parse_bills", "s7_forecast_for_horizon",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "")
    chosen = names.split(",") if names else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["q2_time_bounds"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
