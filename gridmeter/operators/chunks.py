"""Split long series into time chunks, so that no window ever needs a whole series in one task.

A window with a bounded reach (lags, rolling statistics, short gaps) is computed per (series, chunk) after every
row has been copied into the neighbouring chunks whose reach it lies in; the copies are dropped afterwards. What
has unbounded reach (row numbers, carried values) is computed inside chunks and joined with a running total over
one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
OWN = "_own"
CHUNK_ROWS = 24 * 7 * 8


def hour_index(ts: str = "ts") -> Column:
    return F.floor(F.unix_timestamp(F.col(ts)) / 3600)


def chunk_of(index: Column, size: int = CHUNK_ROWS) -> Column:
    return F.floor(index / size)


def spread(df: DataFrame, index: Column, back: int = 0, ahead: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Copy rows into every chunk whose windows reach them: `back` rows behind, `ahead` rows in front."""
    first, last = chunk_of(index - ahead, size), chunk_of(index + back, size)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(OWN, F.col(CHUNK) == chunk_of(index, size))


def chunk_window(series: str = "series_id", ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(series, CHUNK).orderBy(ts)


def gather(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN)).drop(CHUNK, OWN)


def with_positions(df: DataFrame, series: str = "series_id", ts: str = "ts", size: int = CHUNK_ROWS) -> DataFrame:
    """Add `pos` (1-based row number in time order) and `n_rows` per series without sorting a whole series in one task."""
    tagged = df.withColumn(CHUNK, chunk_of(hour_index(ts), size))
    counts = tagged.groupBy(series, CHUNK).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(series).orderBy(CHUNK)
    offsets = counts.select(
        series, CHUNK,
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(series)).alias("n_rows"),
    )
    inside = F.row_number().over(chunk_window(series, ts))
    return (
        tagged.join(offsets, [series, CHUNK])
        .withColumn("pos", inside + F.col("_before"))
        .drop(CHUNK, "_before")
    )
