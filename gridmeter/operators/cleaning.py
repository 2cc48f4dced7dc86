"""Cleaning of hourly series: duplicates, gaps, outliers, negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.scalars import non_negative
from gridmeter.operators.chunks import CHUNK, chunk_of, chunk_window, gather, hour_index, spread
from gridmeter.operators.rollup import complete_index, exact_sum
from gridmeter.operators.stats import exact_percentiles
from gridmeter.session import cut_lineage

# Fixed values of the cleaning rules.
MAX_GAP_HOURS = 3
IQR_FACTOR = 1.5


def drop_null_ts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).isNotNull())


def dedup_measures(df: DataFrame, series: str = "series_id", ts: str = "ts", scale: int | None = None) -> DataFrame:
    """One row per series and timestamp: energy and totals are summed, every other measure averaged."""
    measures = [c for c in df.columns if c not in (series, ts)]
    summed = [c for c in measures if c == "energy_kwh" or c.startswith("total_")]
    aggs = [exact_sum(F.col(c), scale).alias(c) if c in summed else F.avg(c).alias(c) for c in measures]
    return df.groupBy(series, ts).agg(*aggs)


def gap_islands(df: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Number the runs of missing hours on a complete hourly index.

    `gap_group` is the running count of present hours, built from in-chunk counts plus the total of earlier chunks;
    `gap_size` is the number of missing hours in the group (0 on present rows).
    """
    present = F.col("energy_kwh").isNotNull().cast("long")
    tagged = df.withColumn(CHUNK, chunk_of(hour_index(ts))).withColumn("is_missing", 1 - present)
    per_chunk = tagged.groupBy(series, CHUNK).agg(F.sum(1 - F.col("is_missing")).alias("_present"))
    before = per_chunk.select(
        series, CHUNK,
        (F.sum("_present").over(Window.partitionBy(series).orderBy(CHUNK)) - F.col("_present")).alias("_before"),
    )
    inside = F.sum(1 - F.col("is_missing")).over(chunk_window(series, ts).rowsBetween(Window.unboundedPreceding, 0))
    numbered = tagged.join(before, [series, CHUNK]).withColumn("gap_group", inside + F.col("_before"))
    missing = F.sum("is_missing").over(Window.partitionBy(series, "gap_group"))
    return (
        numbered.withColumn("gap_size", F.when(F.col("is_missing") == 1, missing).otherwise(F.lit(0)))
        .withColumn("is_long_gap", (F.col("gap_size") > MAX_GAP_HOURS).cast("int"))
        .drop(CHUNK, "_before")
    )


def fill_short_gaps(df: DataFrame, max_gap: int = MAX_GAP_HOURS, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Fill gaps of up to `max_gap` hours with the midpoint of their neighbours; flag longer ones.

    Expects a complete hourly index. Only `max_gap + 1` hours on either side matter, so the windows are bounded and run
    per chunk. Gaps at the ends of a series have one neighbour only and stay null.
    """
    reach = max_gap + 1
    index = hour_index(ts)
    w = chunk_window(series, ts)
    behind, ahead = w.rowsBetween(-reach, 0), w.rowsBetween(0, reach)
    seen = F.when(F.col("energy_kwh").isNotNull(), F.col("_h"))
    rows = spread(df.withColumn("_h", index), F.col("_h"), reach, reach).withColumns({
        "_left": F.coalesce(F.last(seen, True).over(behind), F.min("_h").over(behind) - 1),
        "_right": F.coalesce(F.first(seen, True).over(ahead), F.max("_h").over(ahead) + 1),
        "_before": F.last("energy_kwh", True).over(behind),
        "_after": F.first("energy_kwh", True).over(ahead),
    })
    missing = F.col("energy_kwh").isNull()
    size = F.col("_right") - F.col("_left") - 1
    filled = gather(rows).withColumns({
        "is_long_gap": (missing & (size > max_gap)).cast("int"),
        "energy_kwh": F.when(missing & (size <= max_gap), (F.col("_before") + F.col("_after")) / 2)
        .otherwise(F.col("energy_kwh")),
    })
    return filled.drop("_h", "_left", "_right", "_before", "_after")


def outlier_bounds(df: DataFrame, factor: float = IQR_FACTOR, series: str = "series_id", raw: bool = False) -> DataFrame:
    """Lower and upper IQR bound per series.

    Exact percentiles of an hourly series hold at most one value per hour of its calendar span. For `raw` readings, whose
    series have no bound, the values of a series are split over tasks; a series without a value then has no bounds.
    """
    if raw:
        quartiles, q1, q3 = exact_percentiles(df, [series], "energy_kwh", {"_q1": 0.25, "_q3": 0.75}), F.col("_q1"), F.col("_q3")
    else:
        quartiles = df.groupBy(series).agg(F.percentile("energy_kwh", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
        q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return quartiles.select(
        series, (q1 - factor * (q3 - q1)).alias("lower_bound"), (q3 + factor * (q3 - q1)).alias("upper_bound"),
    )


def flag_outliers(df: DataFrame, factor: float = IQR_FACTOR, series: str = "series_id", raw: bool = False) -> DataFrame:
    """Flag readings outside the IQR bounds of their series; null is no outlier and no row is removed.

    The bounds join carries no broadcast hint: with millions of series they may be large, so the choice is left to the
    sizes measured at run time.
    """
    outside = (F.col("energy_kwh") > F.col("upper_bound")) | (F.col("energy_kwh") < F.col("lower_bound"))
    return (
        df.join(outlier_bounds(df, factor, series, raw), series, "left")
        .withColumn("is_energy_outlier", F.coalesce(outside, F.lit(False)).cast("int"))
        .drop("lower_bound", "upper_bound")
    )


def floor_negatives(df: DataFrame, col: str = "energy_kwh") -> DataFrame:
    return df.withColumn(col, non_negative(F.col(col)))


def clean_hourly(hourly: DataFrame, series: str = "series_id", ts: str = "ts", scale: int | None = None) -> DataFrame:
    """The whole cleaning chain: null timestamps, duplicates, complete index, short gaps, outliers, negatives.

    Both tables that are read twice are settled in the shared folder, so raw readings are scanned once.
    """
    unique = cut_lineage(dedup_measures(drop_null_ts(hourly, ts), series, ts, scale))
    filled = cut_lineage(fill_short_gaps(complete_index(unique, series, ts), MAX_GAP_HOURS, series, ts))
    return floor_negatives(flag_outliers(filled, IQR_FACTOR, series))
