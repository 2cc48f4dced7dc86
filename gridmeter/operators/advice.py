"""Recommendations and the summary of a forecast, one row or a few rows per household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S, TS, E = "series_id", "ts", "energy_kwh"

# Rule limits and the texts shown to users.
WEEKEND_FACTOR = 1.10
OVERNIGHT_FACTOR = 1.15
MIN_REPEATED_PEAKS = 2
ADVICE = {
    "evening": (
        "Shift flexible loads away from the evening peak.",
        "Forecasted evening demand meets or exceeds the high-demand threshold.", "High",
    ),
    "weekend": (
        "Review appliance usage during high-consumption weekend periods.",
        "Measured weekend consumption is materially higher than weekday consumption.", "Medium",
    ),
    "repeated": (
        "Consider shifting flexible loads away from repeated high-demand periods.",
        "Multiple predicted periods exceed the high-demand threshold.", "Medium",
    ),
    "overnight": (
        "Review always-on loads during overnight hours.",
        "Measured overnight consumption is unusually high relative to the household average.", "Low",
    ),
}


def _two(col: Column) -> Column:
    """Two decimals; the tiny shift keeps halves stable whatever order a mean was added up in."""
    return F.format_string("%.2f", F.round(col + 1e-9, 2))


def recommendations(history: DataFrame, peaks: DataFrame) -> DataFrame:
    """Rules that hold for each household, with the metric behind them.

    `history`: hourly readings; `peaks`: output of `peak_forecast`. Two keyed aggregates and one join; the rules are
    column conditions.
    """
    weekend = F.dayofweek(TS).isin(1, 7)
    past = history.filter(F.col(E).isNotNull()).groupBy(S).agg(
        F.avg(F.when(weekend, F.col(E))).alias("_weekend"), F.avg(F.when(~weekend, F.col(E))).alias("_weekday"),
        F.avg(F.when(F.hour(TS) < 6, F.col(E))).alias("_overnight"), F.avg(E).alias("_overall"),
    )
    future = peaks.groupBy(S).agg(
        F.avg(F.when(F.hour(TS).between(17, 21), F.col("predicted_consumption"))).alias("_evening"),
        F.count_if("is_peak").alias("_peaks"), F.max("threshold").alias("_threshold"),
    )
    c = F.col
    metric = {
        "evening": F.concat(F.lit("Mean predicted evening demand = "), _two(c("_evening")), F.lit(" kWh")),
        "weekend": F.concat(F.lit("Weekend average = "), _two(c("_weekend")), F.lit(" vs weekday = "),
                            _two(c("_weekday")), F.lit(" kWh/hour")),
        "repeated": F.concat(F.lit("Predicted peak periods = "), c("_peaks").cast("string")),
        "overnight": F.concat(F.lit("Overnight average = "), _two(c("_overnight")), F.lit(" vs overall = "),
                              _two(c("_overall")), F.lit(" kWh/hour")),
    }
    holds = {
        "evening": c("_evening") >= c("_threshold"),
        "weekend": c("_weekend") > c("_weekday") * WEEKEND_FACTOR,
        "repeated": c("_peaks") >= MIN_REPEATED_PEAKS,
        "overnight": (c("_overall") != 0) & (c("_overnight") > c("_overall") * OVERNIGHT_FACTOR),
    }
    entries = [
        F.when(holds[rule], F.struct(
            F.lit(i + 1).alias("rule_order"), F.lit(text).alias("recommendation"), F.lit(reason).alias("reason"),
            F.lit(priority).alias("priority"), metric[rule].alias("supporting_metric"),
        ))
        for i, (rule, (text, reason, priority)) in enumerate(ADVICE.items())
    ]
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return past.join(future, S, "full").select(S, F.explode(kept).alias("_e")).select(S, "_e.*")


def grid_summary(history: DataFrame, peaks: DataFrame, costs: DataFrame, shifts: DataFrame) -> DataFrame:
    """One row per series: averages, thresholds, peaks, baseline and optimised cost, savings."""
    past = history.groupBy(S).agg(
        F.avg(E).alias("historical_average"), F.max(E).alias("historical_maximum"),
        F.percentile(E, F.lit(0.99)).alias("critical_threshold"),
    )
    first_top = F.struct(F.col("predicted_consumption"), -F.unix_timestamp(TS))
    future = peaks.groupBy(S).agg(
        F.avg("predicted_consumption").alias("forecast_average"), F.max("threshold").alias("peak_threshold"),
        F.count_if("is_peak").alias("predicted_peak_count"),
        F.max("predicted_consumption").alias("highest_predicted_demand"),
        F.max_by(TS, first_top).alias("highest_predicted_demand_ts"),
    )
    baseline = costs.groupBy(S).agg(F.sum("simulated_cost").alias("tou_baseline_cost"))
    moved = shifts.groupBy(S).agg(
        F.count("*").alias("_n"), F.sum("shiftable_energy_kwh").alias("_energy"), F.sum("estimated_savings").alias("_savings"),
    )
    savings = F.coalesce("_savings", F.lit(0.0))
    return past.join(future, S).join(baseline, S).join(moved, S, "left").select(
        S, "historical_average", "historical_maximum", "critical_threshold", "forecast_average", "peak_threshold",
        "predicted_peak_count", "highest_predicted_demand", "highest_predicted_demand_ts", "tou_baseline_cost",
        F.coalesce("_n", F.lit(0)).alias("load_shift_count"),
        F.coalesce("_energy", F.lit(0.0)).alias("total_shiftable_energy"),
        savings.alias("potential_savings"),
        (F.col("tou_baseline_cost") - savings).alias("potential_optimized_cost"),
        F.when(F.col("tou_baseline_cost") > 0, savings / F.col("tou_baseline_cost") * 100).otherwise(F.lit(0.0))
        .alias("potential_savings_percentage"),
    )


def highest_demand(pred: DataFrame, value: str = "predicted") -> DataFrame:
    """Highest row of each series and its timestamp; the earliest wins a tie."""
    order = F.struct(F.col(value), -F.unix_timestamp(TS))
    return pred.groupBy(S).agg(F.max(value).alias("highest_value"), F.max_by(TS, order).alias("highest_ts"))
