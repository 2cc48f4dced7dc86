"""Consumption profiles and summaries. All are keyed aggregates with partial sums on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.calendar import day_band, season, with_eda_calendar
from gridmeter.functions.scalars import demand_class
from gridmeter.operators.stats import adjusted_skewness, autocorrelation, pair_corr, percentiles

S, T, E = "series_id", "ts", "energy_kwh"

# Weekday names in the order of dayofweek (1 = Sunday), and the percentiles of the reports.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
REPORT_PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _known(df: DataFrame) -> DataFrame:
    return df.filter(F.col(E).isNotNull())


def _weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), number)


def describe_energy(df: DataFrame) -> DataFrame:
    """Count, bounds, mean, spread and extremes."""
    return df.groupBy(S).agg(
        F.count("*").alias("n_rows"), F.min(T).alias("start_ts"), F.max(T).alias("end_ts"),
        F.avg(E).alias("mean_kwh"), F.stddev_samp(E).alias("stddev_kwh"), F.var_samp(E).alias("variance_kwh"),
        F.min(E).alias("min_kwh"), F.max(E).alias("max_kwh"),
    )


def target_distribution(df: DataFrame) -> DataFrame:
    """Shape of the target: moments, skewness, zeros and percentiles."""
    known = _known(df)
    moments = known.groupBy(S).agg(
        F.count("*").alias("n_rows"), F.avg(E).alias("mean_kwh"), F.stddev_samp(E).alias("stddev_kwh"),
        adjusted_skewness(E).alias("skewness"), F.count_if(F.col(E) == 0).alias("zeros"),
        F.count_if(F.col(E) < 0.05).alias("near_zero"), F.min(E).alias("min_kwh"), F.max(E).alias("max_kwh"),
    )
    return moments.join(percentiles(known, REPORT_PERCENTILES), S)


def hourly_profile(df: DataFrame, dense: bool = False) -> DataFrame:
    """Mean by hour of day; `dense` adds the hours without readings as zero."""
    means = df.groupBy(S, F.hour(T).alias("hour")).agg(F.avg(E).alias("avg_energy_kwh"))
    if not dense:
        return means
    grid = df.select(S).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(means, [S, "hour"], "left").fillna(0.0, ["avg_energy_kwh"])


def weekday_profile(df: DataFrame) -> DataFrame:
    return df.groupBy(S, F.dayofweek(T).alias("dayofweek_num")).agg(F.avg(E).alias("avg_energy_kwh")).withColumn(
        "day_name", _weekday_name(F.col("dayofweek_num"))
    )


def weekend_comparison(df: DataFrame) -> DataFrame:
    flag = F.dayofweek(T).isin(1, 7).cast("int").alias("is_weekend")
    return df.groupBy(S, flag).agg(
        F.avg(E).alias("mean_kwh"), F.percentile(E, F.lit(0.5)).alias("median_kwh"),
        F.sum(E).alias("total_kwh"), F.max(E).alias("max_kwh"),
    )


def heatmap(df: DataFrame, dense: bool = True) -> DataFrame:
    """Mean by weekday and hour; the dense form has all 168 cells, empty ones as zero."""
    means = df.groupBy(S, F.dayofweek(T).alias("dayofweek_num"), F.hour(T).alias("hour")).agg(
        F.avg(E).alias("avg_energy_kwh")
    )
    if not dense:
        return means
    cells = df.select(S).distinct().withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(167)))).select(
        S, (F.floor(F.col("_cell") / 24) + 1).cast("int").alias("dayofweek_num"), (F.col("_cell") % 24).alias("hour"),
    )
    return cells.join(means, [S, "dayofweek_num", "hour"], "left").fillna(0.0, ["avg_energy_kwh"])


def profile_by_daytype(df: DataFrame) -> DataFrame:
    """Weekday and weekend means side by side for each hour of day."""
    weekend = F.dayofweek(T).isin(1, 7)
    means = df.groupBy(S, F.hour(T).alias("hour")).agg(
        F.avg(F.when(~weekend, F.col(E))).alias("weekday_kwh"), F.avg(F.when(weekend, F.col(E))).alias("weekend_kwh"),
    )
    grid = df.select(S).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(means, [S, "hour"], "left").fillna(0.0, ["weekday_kwh", "weekend_kwh"])


def band_share(df: DataFrame) -> DataFrame:
    """Energy in each six-hour band of the day and its rounded share of the total."""
    totals = _known(df).groupBy(S, day_band(F.hour(T)).alias("day_band")).agg(F.sum(E).alias("total_kwh"))
    whole = F.sum("total_kwh").over(Window.partitionBy(S))
    return totals.withColumn("share_percent", F.round(100 * F.col("total_kwh") / F.nullif(whole, F.lit(0.0))))


def daily_consumption(df: DataFrame) -> DataFrame:
    return df.groupBy(S, F.to_date(T).alias("date")).agg(
        F.sum(E).alias("total_energy_kwh"), F.avg(E).alias("mean_energy_kwh"),
        F.max(E).alias("max_energy_kwh"), F.min(E).alias("min_energy_kwh"),
    )


def monthly_consumption(df: DataFrame) -> DataFrame:
    """Totals by month of year, all years pooled."""
    return df.groupBy(S, F.month(T).alias("month")).agg(
        F.sum(E).alias("total_energy_kwh"), F.avg(E).alias("avg_hourly_energy_kwh"), F.max(E).alias("max_energy_kwh"),
    )


def long_term(df: DataFrame) -> DataFrame:
    return df.groupBy(S, F.date_format(T, "yyyy-MM").alias("period")).agg(F.sum(E).alias("energy_kwh"))


def seasonal(df: DataFrame) -> DataFrame:
    return df.groupBy(S, season(F.month(T)).alias("season")).agg(F.avg(E).alias("avg_energy_kwh"))


def submeter_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Total of every sub-meter and its share of their sum (0 when that is 0)."""
    wide = df.groupBy(S).agg(*[F.sum(c).alias(c) for c in cols])
    whole = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return wide.withColumn("_all", whole).unpivot([S, "_all"], list(cols), "sub_meter", "total").select(
        S, "sub_meter", "total",
        F.when(F.col("_all") > 0, F.col("total") / F.nullif("_all", F.lit(0.0))).otherwise(F.lit(0.0))
        .alias("relative_contribution"),
    )


def _with_percentiles(df: DataFrame, ps: dict[str, float]) -> DataFrame:
    return df.join(percentiles(df, ps), S)


def demand_counts(df: DataFrame) -> DataFrame:
    """Hours per demand class, with the thresholds taken from the series itself."""
    level = demand_class(F.col(E), F.col("p90"), F.col("p95")).alias("demand_level")
    return _with_percentiles(df, {"p90": 0.9, "p95": 0.95}).groupBy(S, level).agg(F.count("*").alias("n_hours"))


def peak_events(df: DataFrame) -> DataFrame:
    """High-demand hours counted by hour of day and by weekday, in one pass with grouping sets."""
    high = _with_percentiles(df, {"p90": 0.9}).filter(F.col(E) >= F.col("p90")).select(
        S, F.hour(T).alias("hour"), F.dayofweek(T).alias("dayofweek_num"),
    )
    hour, day = F.col("hour"), F.col("dayofweek_num")
    return high.groupingSets([[F.col(S), hour], [F.col(S), day]], S, "hour", "dayofweek_num").agg(
        F.count("*").alias("n_events")
    )


def variability(df: DataFrame) -> DataFrame:
    return df.groupBy(S).agg(
        F.stddev_samp(E).alias("stddev_kwh"),
        (F.stddev_samp(E) / F.nullif(F.avg(E), F.lit(0.0))).alias("coefficient_of_variation"),
    )


def severity_counts(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy(S, "demand_level").agg(F.count("*").alias("n_hours"))


def profile_extremes(df: DataFrame, digits: int = 9) -> DataFrame:
    """Hour and weekday with extreme means, month with extreme total; the smaller key wins a tie.

    One pass with grouping sets. Values are compared after rounding: sums of doubles differ in the last bits between runs.
    """
    keyed = df.select(S, E, F.hour(T).alias("hour"), F.dayofweek(T).alias("weekday"), F.month(T).alias("month"))
    names = ["hour", "weekday", "month"]
    sets = [[F.col(S), F.col(name)] for name in names]
    profiles = keyed.groupingSets(sets, S, *names).agg(F.avg(E).alias("_mean"), F.sum(E).alias("_sum"))
    value = F.when(F.col("month").isNotNull(), F.col("_sum")).otherwise(F.col("_mean"))
    dimension = F.coalesce(*[F.when(F.col(name).isNotNull(), F.lit(name)) for name in names])
    k, v = F.col("k"), F.col("v")
    return profiles.select(
        S, dimension.alias("dimension"), F.coalesce(*names).alias("k"), F.round(value, digits).alias("v")
    ).groupBy(S, "dimension").agg(
        F.max_by(k, F.struct(v, -k)).alias("highest_key"), F.max(v).alias("highest_value"),
        F.min_by(k, F.struct(v, k)).alias("lowest_key"), F.min(v).alias("lowest_value"),
    )


def energy_insights(df: DataFrame, top_n: int = 5, digits: int = 9) -> DataFrame:
    """Household statistics per series; the peak threshold comes in as column `threshold`.

    Day totals and hour-of-day means come from one pass with grouping sets, the rest from one keyed aggregate.
    """
    known = _known(df)
    weekend = F.dayofweek(T).isin(1, 7)
    base = known.groupBy(S).agg(
        F.count("*").alias("record_count"), F.avg(E).alias("average_hourly"),
        F.max(E).alias("maximum_hourly"), F.min(E).alias("minimum_hourly"),
        F.avg(F.when(~weekend, F.col(E))).alias("weekday_average"),
        F.avg(F.when(weekend, F.col(E))).alias("weekend_average"),
        F.avg((F.col(E) >= F.col("threshold")).cast("double")).alias("peak_demand_frequency"),
    )
    keyed = known.select(S, E, F.to_date(T).alias("date"), F.hour(T).alias("hour"))
    sets = keyed.groupingSets([[F.col(S), F.col("date")], [F.col(S), F.col("hour")]], S, "date", "hour").agg(
        F.sum(E).alias("_sum"), F.round(F.avg(E), digits).alias("_mean")
    )
    hour, mean = F.col("hour"), F.col("_mean")
    daily_and_hourly = sets.groupBy(S).agg(
        F.avg(F.when(hour.isNull(), F.col("_sum"))).alias("average_daily"),
        F.max_by(hour, F.when(hour.isNotNull(), F.struct(mean, -hour))).alias("highest_hour"),
        F.min_by(hour, F.when(hour.isNotNull(), F.struct(mean, hour))).alias("lowest_hour"),
    )
    tops = top_hours(known, top_n).groupBy(S).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "highest", F.struct("rank", T, E)))).alias("top_highest"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "lowest", F.struct("rank", T, E)))).alias("top_lowest"),
    )
    return base.join(daily_and_hourly, S).join(tops, S)


def top_hours(df: DataFrame, n: int = 5) -> DataFrame:
    """The `n` highest and `n` lowest hours of each series, ties by time.

    Each side is a rank filter, which Spark prunes inside every task before the shuffle.
    """
    sides = []
    for kind, order in (("highest", F.desc(E)), ("lowest", F.asc(E))):
        rank = F.row_number().over(Window.partitionBy(S).orderBy(order, T))
        sides.append(
            _known(df).withColumn("rank", rank).filter(F.col("rank") <= n).select(S, F.lit(kind).alias("kind"), "rank", T, E)
        )
    return sides[0].unionByName(sides[1])


def error_by_hour(pred: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    return pred.filter(error.isNotNull()).groupBy(S, "model", "horizon", F.hour(T).alias("hour")).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def eda_summary(df: DataFrame, corr_cols: Sequence[str] = ()) -> DataFrame:
    """All headline numbers of the exploratory report, in long form (section, metric, value).

    Four passes over the hourly table: everything that is a plain aggregate in the first, then demand counts (which need
    the percentiles), profile extremes, autocorrelation.
    """
    weekend = F.dayofweek(T).isin(1, 7)
    seconds = F.unix_timestamp(F.max(T)) - F.unix_timestamp(F.min(T))
    points = F.array(*[F.lit(p) for p in REPORT_PERCENTILES.values()])
    plain = {
        "dataset_overview": {"n_rows": F.count("*"), "duration_days": F.round(seconds / 86400, 2)},
        "consumption_statistics": {
            "mean_kwh": F.avg(E), "stddev_kwh": F.stddev_samp(E), "variance_kwh": F.var_samp(E),
            "min_kwh": F.min(E), "max_kwh": F.max(E),
        },
        "weekday_weekend_analysis": {
            "weekday_average": F.avg(F.when(~weekend, F.col(E))), "weekend_average": F.avg(F.when(weekend, F.col(E))),
        },
        "variability_analysis": {
            "stddev_kwh": F.stddev_samp(E), "coefficient_of_variation": F.stddev_samp(E) / F.nullif(F.avg(E), F.lit(0.0)),
        },
        "correlation_analysis": {c: pair_corr(F.col(E), F.col(c)) for c in corr_cols},
    }
    cells = {(section, metric): agg for section, metrics in plain.items() for metric, agg in metrics.items()}
    first = df.groupBy(S).agg(
        *[agg.cast("double").alias(f"c{i}") for i, agg in enumerate(cells.values())], F.percentile(E, points).alias("_q")
    )
    values = [(*key, F.col(f"c{i}")) for i, key in enumerate(cells)]
    values += [("percentiles", name, F.col("_q")[i]) for i, name in enumerate(REPORT_PERCENTILES)]
    out = _long(first, values)

    levels = df.join(percentiles(df, {"p90": 0.9, "p95": 0.95}), S).groupBy(S).agg(
        F.count_if((F.col(E) >= F.col("p90")) & (F.col(E) < F.col("p95"))).alias("high_hours"),
        F.count_if(F.col(E) >= F.col("p95")).alias("critical_hours"),
    )
    out = out.unionByName(_long(levels, [("peak_demand_analysis", c, F.col(c)) for c in ("high_hours", "critical_hours")]))
    ends = ["highest_key", "lowest_key", "highest_value", "lowest_value"]
    extremes = profile_extremes(df)
    section = F.concat(F.col("dimension"), F.lit("_analysis"))
    out = out.unionByName(_long(extremes, [(section, c, F.col(c)) for c in ends]))
    lags = autocorrelation(df)
    return out.unionByName(_long(lags, [("autocorrelation_analysis", c, F.col(c)) for c in lags.columns if c != S]))


def _long(wide: DataFrame, values: Sequence[tuple]) -> DataFrame:
    """One row per (section, metric, value) entry."""
    rows = F.array(*[
        F.struct(
            (section if isinstance(section, Column) else F.lit(section)).alias("section"),
            F.lit(metric).alias("metric"), value.cast("double").alias("value"),
        )
        for section, metric, value in values
    ])
    return wide.select(S, F.explode(rows).alias("_r")).select(S, "_r.*")


__all__ = [
    "band_share", "daily_consumption", "demand_counts", "describe_energy", "eda_summary", "energy_insights",
    "error_by_hour", "heatmap", "hourly_profile", "long_term", "monthly_consumption", "peak_events", "profile_by_daytype",
    "profile_extremes", "seasonal", "severity_counts", "submeter_share", "target_distribution", "top_hours",
    "variability", "weekday_profile", "weekend_comparison", "with_eda_calendar",
]
