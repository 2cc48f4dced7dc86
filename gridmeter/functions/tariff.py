"""Time-of-use tariff: period and price of an hour of the day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tariff:
    # The illustrative tariff the published costs were simulated with.
    off_peak_rate: float = 3.0
    normal_rate: float = 6.0
    peak_rate: float = 10.0
    peak_start: int = 17
    peak_end: int = 22
    night_end: int = 6

    @property
    def period_rates(self) -> dict[str, float]:
        return {"off_peak": self.off_peak_rate, "normal": self.normal_rate, "peak": self.peak_rate}


DEFAULT_TARIFF = Tariff()


def tou_period(hour: Column, tariff: Tariff = DEFAULT_TARIFF) -> Column:
    return (
        F.when((hour >= tariff.peak_start) & (hour < tariff.peak_end), "peak")
        .when((hour < tariff.night_end) | (hour >= tariff.peak_end), "off_peak")
        .otherwise("normal")
    )


def tou_rate(hour: Column, tariff: Tariff = DEFAULT_TARIFF) -> Column:
    period = tou_period(hour, tariff)
    rate = F.when(period == "peak", tariff.peak_rate).when(period == "off_peak", tariff.off_peak_rate)
    return rate.otherwise(tariff.normal_rate)


def with_rate_table(df: DataFrame, rates: DataFrame, ts: str = "ts") -> DataFrame:
    """Price rows with a user-supplied table (hour, tou_period, rate).

    Grouping by an hour restricted to 0-23 bounds the table at 24 rows; Spark broadcasts it when it sees its size.
    """
    table = (
        rates.filter(F.col("hour").between(0, 23))
        .groupBy(F.col("hour").alias("_hour"))
        .agg(F.min("tou_period").alias("tou_period"), F.min("rate").alias("rate"))
    )
    return df.withColumn("_hour", F.hour(ts)).join(table, "_hour", "left").drop("_hour")
