"""Chronological splits, look-ahead targets and series tails, by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.operators.chunks import CHUNK, gather, spread, with_positions

S, TS, E = "series_id", "ts", "energy_kwh"

# Fixed values of the evaluation protocol.
TRAIN_SHARE, VALIDATION_SHARE = 0.70, 0.15
DIRECT_STEPS = 23


def chronological_split(
    features: DataFrame, train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE,
) -> DataFrame:
    """Label rows train, validation or test by their position in time; shares are floored, the rest is test."""
    train_end = F.floor(F.col("n_rows") * F.lit(train))
    validation_end = train_end + F.floor(F.col("n_rows") * F.lit(validation))
    label = F.when(F.col("pos") <= train_end, "train").when(F.col("pos") <= validation_end, "validation").otherwise("test")
    return with_positions(features, S, TS).withColumn("split", label).drop("n_rows")


def split_report(split: DataFrame) -> DataFrame:
    return split.groupBy(S, "split").agg(
        F.count("*").alias("n_rows"), F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"),
    )


def with_target(split: DataFrame, steps: int = DIRECT_STEPS, target: str = "target") -> DataFrame:
    """Value `steps` rows ahead inside the same split; rows without one are dropped.

    Row positions are known, so the look-ahead runs per chunk of positions with a short overlap.
    """
    rows = spread(split, F.col("pos"), ahead=steps)
    w = Window.partitionBy(S, "split", CHUNK).orderBy("pos")
    return gather(rows.withColumn(target, F.lead(E, steps).over(w))).filter(F.col(target).isNotNull())


def tail_per_series(df: DataFrame, n: int, series: str = S, ts: str = TS) -> DataFrame:
    """Last `n` rows per series; the rank filter is pruned inside every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(series).orderBy(F.desc(ts)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def head_per_series(df: DataFrame, n: int, series: str = S, ts: str = TS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(series).orderBy(ts))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
