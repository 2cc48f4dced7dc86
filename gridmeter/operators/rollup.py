"""Roll-ups to the hour and the complete hourly index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.operators.chunks import CHUNK_ROWS, chunk_of, hour_index
from gridmeter.session import cut_lineage


def exact_sum(col: Column, scale: int | None = None) -> Column:
    """Sum that does not depend on the order of rows when a decimal scale is given.

    Double addition is not associative, so a re-run task may give another last digit; decimals are exact.
    """
    if scale is None:
        return F.sum(col)
    return F.sum(col.cast(f"decimal(18,{scale})")).cast("double")


def hourly_rollup(
    df: DataFrame, sums: Sequence[str] = ("energy_kwh",), averages: Sequence[str] = (), series: str = "series_id",
    ts: str = "ts", scale: int | None = None, count: bool = False,
) -> DataFrame:
    """Sum energies and average levels per series and hour.

    A plain keyed aggregate: partial sums on the map side make a hot series harmless, and an hour without any value
    stays null. Averages get an `avg_` prefix, sums other than energy a `total_` prefix.
    """
    aggs = [exact_sum(F.col(c), scale).alias(c if c == "energy_kwh" else f"total_{c}") for c in sums]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in averages]
    if count:
        aggs.append(F.count("*").alias("n_readings"))
    return df.groupBy(series, F.date_trunc("hour", F.col(ts)).alias(ts)).agg(*aggs)


def complete_index(hourly: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Every hour between the first and last one of each series with its data; missing hours become all-null rows.

    A row also stands for the missing hours up to the next row of its series, which are made after the only shuffle: only
    known hours are moved, and rows stay partitioned by series. Hours are generated chunk by chunk, so no array is longer
    than one chunk however long a gap is. Rows of no series, and rows that are not on the hour, count as hours without data.
    """
    data = hourly.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull()).withColumn("_h", hour_index(ts))
    data = data.withColumn("_known", F.col(series).isNotNull() & (F.col(ts) == F.timestamp_seconds(F.col("_h") * 3600)))
    in_order = Window.partitionBy(series).orderBy("_h", "_known")
    data = data.withColumn("_next", F.coalesce(F.lead("_h").over(in_order), F.col("_h") + 1))
    # Rows of the same hour: all with data are kept, the last one stands for the gap.
    data = data.filter(F.col("_known") | (F.col("_next") > F.col("_h"))).withColumn("_to", F.greatest("_h", F.col("_next") - 1))
    chunks = data.withColumn("_c", F.explode(F.sequence(chunk_of(F.col("_h")), chunk_of(F.col("_to")))))
    first = F.greatest(F.col("_h"), F.col("_c") * CHUNK_ROWS)
    last = F.least(F.col("_to"), F.col("_c") * CHUNK_ROWS + CHUNK_ROWS - 1)
    rows = chunks.withColumn("_at", F.explode(F.sequence(first, last)))
    here = F.col("_known") & (F.col("_at") == F.col("_h"))
    values = [F.when(here, F.col(c)).alias(c) for c in hourly.columns if c not in (series, ts)]
    return rows.select(series, F.timestamp_seconds(F.col("_at") * 3600).alias(ts), *values)


def index_report(hourly: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Expected, actual and missing hours per series, from one aggregate."""
    index = hour_index(ts)
    expected = F.max(index) - F.min(index) + 1
    return hourly.filter(F.col(ts).isNotNull()).groupBy(series).agg(
        expected.alias("expected_hours"),
        F.count("*").alias("actual_hours"),
        (expected - F.count("*")).alias("missing_hours"),
    )


def hourly_zero_filled(df: DataFrame, series: str = "series_id", ts: str = "ts", scale: int | None = None) -> DataFrame:
    """User hourly series: interval energies summed per hour, hours without readings count as zero."""
    hourly = cut_lineage(hourly_rollup(df, ["energy_kwh"], (), series, ts, scale))
    return complete_index(hourly, series, ts).withColumn("energy_kwh", F.coalesce("energy_kwh", F.lit(0.0)))
