"""Data-quality reports and guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmeter.operators.chunks import hour_index
from gridmeter.operators.cleaning import clean_hourly, drop_null_ts, fill_short_gaps, outlier_bounds
from gridmeter.operators.rollup import complete_index, exact_sum
from gridmeter.operators.stats import exact_percentiles
from gridmeter.session import cut_lineage

# Fixed values of the forecast and readiness rules.
MIN_HOURLY_HISTORY = 169
NEXT_DAY_EXTRA_HOURS = 23
READINESS_DAYS = {"Insufficient history": 7, "Basic": 30, "Good": 90}
EXPECTED_READINGS_PER_HOUR = 60


def _nulls(col: str) -> Column:
    return F.count_if(F.col(col).isNull())


def unpivot_counts(wide: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(list(keys), list(cols), name, value)


def null_counts(df: DataFrame, cols: Sequence[str], series: str = "series_id") -> DataFrame:
    """Null count per column in one pass, in long form."""
    wide = df.groupBy(series).agg(*[_nulls(c).alias(c) for c in cols])
    return unpivot_counts(wide, [series], cols, "column_name", "null_count")


def bounds(df: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    return df.groupBy(series).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_rows"),
    )


def partition_count(df: DataFrame) -> int:
    """Number of partitions that hold rows, a run statistic of the processing summary."""
    return df.agg(F.countDistinct(F.spark_partition_id())).first()[0]


def duplicate_timestamps(df: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Per series: timestamps that occur more than once, and the surplus rows behind them."""
    groups = df.groupBy(series, ts).agg(F.count("*").alias("_n"))
    return groups.groupBy(series).agg(
        F.count_if(F.col("_n") > 1).alias("duplicate_timestamps"),
        F.sum(F.col("_n") - 1).alias("surplus_rows"),
    )


def negative_count(df: DataFrame, col: str = "energy_kwh", series: str = "series_id") -> DataFrame:
    return df.groupBy(series).agg(F.count_if(F.col(col) < 0).alias("negative_values"))


def hour_coverage(
    df: DataFrame, expected: int = EXPECTED_READINGS_PER_HOUR, series: str = "series_id", ts: str = "ts",
) -> DataFrame:
    """How many readings the hours of a series hold."""
    per_hour = df.groupBy(series, F.date_trunc("hour", F.col(ts)).alias("_hour")).agg(F.count("*").alias("_n"))
    return per_hour.groupBy(series).agg(
        F.count("*").alias("hours"),
        F.count_if(F.col("_n") == expected).alias("full_hours"),
        F.count_if(F.col("_n") < expected).alias("partial_hours"),
        F.min("_n").alias("min_readings"),
        F.max("_n").alias("max_readings"),
        F.avg("_n").alias("avg_readings"),
    )


def reconcile(stages: Mapping[str, DataFrame], series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Rows and time bounds of every stage, so that each reduction can be explained."""
    parts = None
    for order, (name, df) in enumerate(stages.items()):
        part = bounds(df, series, ts).select(
            F.lit(order).alias("stage_order"), F.lit(name).alias("stage"), series, "n_rows",
            F.col("start_ts").cast("timestamp").alias("start_ts"), F.col("end_ts").cast("timestamp").alias("end_ts"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def preprocess_report(
    hourly: DataFrame, series: str = "series_id", ts: str = "ts", scale: int | None = None,
) -> DataFrame:
    """Counts before and after every cleaning step, one row per series.

    The hourly table is read once: one aggregate over (series, timestamp) both removes duplicates and counts them. The filled
    series is settled as well, since its bounds are needed before its outliers can be counted. A series without any valid
    timestamp has no row.
    """
    index, valid = hour_index(ts), F.col(ts).isNotNull()
    unique = cut_lineage(hourly.groupBy(series, ts).agg(
        F.count("*").alias("_n"), exact_sum(F.col("energy_kwh"), scale).alias("energy_kwh"),
    ))
    raw = unique.groupBy(series).agg(
        F.sum("_n").alias("input_records"),
        F.coalesce(F.sum(F.when(~valid, F.col("_n"))), F.lit(0)).alias("null_timestamps_removed"),
        F.coalesce(F.sum(F.when(valid, F.col("_n"))), F.lit(0)).alias("records_before_dedup"),
        F.count_if(valid & (F.col("_n") > 1)).alias("duplicate_timestamps"),
        F.count_if(valid).alias("records_after_dedup"),
        (F.max(index) - F.min(index) + 1).alias("expected_hourly_records"),
    ).withColumn("missing_hourly_records", F.col("expected_hourly_records") - F.col("records_after_dedup"))
    complete = complete_index(drop_null_ts(unique, ts).drop("_n"), series, ts)
    filled = cut_lineage(
        fill_short_gaps(complete.withColumn("_was_null", F.col("energy_kwh").isNull()), series=series, ts=ts)
    )
    energy = F.col("energy_kwh")
    outside = (energy > F.col("upper_bound")) | (energy < F.col("lower_bound"))
    cleaned = filled.join(outlier_bounds(filled, series=series), series).groupBy(series).agg(
        F.count_if("_was_null").alias("missing_energy_before"),
        _nulls("energy_kwh").alias("missing_energy_after"),
        F.sum("is_long_gap").alias("long_gap_hours"),
        F.count_if(outside).alias("outlier_count"),
        F.count_if(energy < 0).alias("negative_energy_values"),
        F.count("*").alias("output_records"),
        F.first("lower_bound").alias("outlier_lower_bound"),
        F.first("upper_bound").alias("outlier_upper_bound"),
    )
    return raw.join(cleaned, series)


def readiness(days: Column) -> Column:
    """How much a history of so many days is good for."""
    chain = None
    for label, limit in READINESS_DAYS.items():
        chain = F.when(days < limit, label) if chain is None else chain.when(days < limit, label)
    return chain.otherwise("Strong")


def forecast_eligibility(hourly: DataFrame, horizon: int = 1, series: str = "series_id") -> DataFrame:
    """Whether a series is long enough to forecast 1 or 24 hours ahead."""
    available = hourly.groupBy(series).agg(F.count("*").alias("available_hours"))
    return with_eligibility(available, horizon).select(series, "horizon", "required_hours", "available_hours", "status")


def with_eligibility(series: DataFrame, horizon: int = 1) -> DataFrame:
    """Adds horizon, required hours and status to one row a series, by its number of hours `available_hours`."""
    if horizon not in (1, 24):
        raise ValueError("horizon must be 1 or 24")
    required = MIN_HOURLY_HISTORY + (NEXT_DAY_EXTRA_HOURS if horizon == 24 else 0)
    return series.withColumns({
        "horizon": F.lit(horizon), "required_hours": F.lit(required).cast("long"),
        "status": F.when(F.col("available_hours") < required, "insufficient_history").otherwise("complete"),
    })


def profile(df: DataFrame, cols: Sequence[str], series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Rows, nulls, date range, type and the five-number summary with mean of numeric columns, in long form.

    Raw tables have no bound on rows per series, so the quartiles come from the bucketed exact percentiles.
    """
    types = dict(df.dtypes)
    numbers = df.select(series, ts, *[F.col(c).cast("double").alias(c) for c in cols])
    long = numbers.unpivot([series, ts], list(cols), "column_name", "value")
    base = long.groupBy(series, "column_name").agg(
        F.count("*").alias("n_rows"), _nulls("value").alias("null_count"),
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
        F.min("value").alias("min_value"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"),
    )
    quarters = exact_percentiles(long, [series, "column_name"], "value", {"q25": 0.25, "median_value": 0.5, "q75": 0.75})
    kind = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    return base.join(quarters, [series, "column_name"]).withColumn("data_type", kind[F.col("column_name")])


def feature_violations(features: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Repeated timestamps and null cells of a feature table, per series."""
    cells = None
    for c in features.columns:
        one = F.col(c).isNull().cast("int")
        cells = one if cells is None else cells + one
    repeated = features.groupBy(series, ts).agg(F.count("*").alias("_n"), F.sum(cells).alias("_nulls"))
    return repeated.groupBy(series).agg(
        F.count_if(F.col("_n") > 1).alias("repeated_timestamps"), F.sum("_nulls").alias("null_cells"),
    )


def prediction_violations(
    pred: DataFrame, threshold: Column | float, critical: Column | float, series: str = "series_id",
) -> DataFrame:
    """Null or negative predictions, and thresholds in the wrong order, per series."""
    high = threshold if isinstance(threshold, Column) else F.lit(threshold)
    top = critical if isinstance(critical, Column) else F.lit(critical)
    return pred.groupBy(series).agg(
        _nulls("predicted").alias("null_predictions"),
        F.count_if(F.col("predicted") < 0).alias("negative_predictions"),
        F.count_if(top < high).alias("misordered_thresholds"),
    )


def assert_clean(violations: DataFrame, series: str = "series_id") -> None:
    """Fail when any violation count is above zero; only one aggregated row reaches the driver."""
    counts = [c for c in violations.columns if c != series]
    totals = violations.agg(*[F.sum(c).alias(c) for c in counts]).first().asDict()
    broken = {name: n for name, n in totals.items() if n}
    if broken:
        raise ValueError(f"guard failed: {broken}")


def assert_features(features: DataFrame) -> None:
    assert_clean(feature_violations(features))


def assert_predictions(pred: DataFrame, threshold: Column | float, critical: Column | float) -> None:
    assert_clean(prediction_violations(pred, threshold, critical))


__all__ = [
    "assert_features", "assert_predictions", "bounds", "clean_hourly", "duplicate_timestamps", "feature_violations",
    "forecast_eligibility", "hour_coverage", "negative_count", "null_counts", "partition_count", "prediction_violations",
    "preprocess_report", "profile", "readiness", "reconcile", "with_eligibility",
]
