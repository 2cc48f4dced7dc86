"""Demand levels and time-of-use costs of a forecast or a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions.tariff import DEFAULT_TARIFF, Tariff, tou_period, tou_rate
from gridmeter.operators.stats import percentiles

S, TS = "series_id", "ts"


def with_critical(pred: DataFrame) -> DataFrame:
    """Default critical threshold: 99th percentile of the predictions, never below the high threshold."""
    tops = percentiles(pred, {"_p99": 0.99}, "predicted")
    return pred.join(tops, S).withColumn("critical", F.greatest("_p99", "threshold")).drop("_p99")


def peak_forecast(pred: DataFrame) -> DataFrame:
    """Demand level of every predicted hour; expects column `threshold`, adds `critical` when it is missing."""
    if "critical" not in pred.columns:
        pred = with_critical(pred)
    value = F.col("predicted")
    level = F.when(value >= F.col("critical"), "Critical").when(value >= F.col("threshold"), "High").otherwise("Normal")
    return pred.select(
        S, TS, value.alias("predicted_consumption"), level.alias("demand_level"),
        (value >= F.col("threshold")).alias("is_peak"), "threshold",
    )


def tou_cost(df: DataFrame, value: str = "predicted", tariff: Tariff = DEFAULT_TARIFF) -> DataFrame:
    """Price every hour by the tariff; a narrow projection, no shuffle."""
    hour = F.hour(TS)
    rate = tou_rate(hour, tariff)
    return df.select(
        S, TS, F.col(value).alias("consumption_kwh"), tou_period(hour, tariff).alias("tou_period"),
        rate.alias("rate_per_kwh"), (F.col(value) * rate).alias("simulated_cost"),
    )


def tou_summary(costs: DataFrame, tariff: Tariff = DEFAULT_TARIFF) -> DataFrame:
    """Energy and cost per tariff period and in total, one row per series from one aggregate."""
    aggs = []
    for period in tariff.period_rates:
        here = F.col("tou_period") == period
        aggs.append(F.sum(F.when(here, F.col("consumption_kwh")).otherwise(0.0)).alias(f"{period}_energy_kwh"))
        aggs.append(F.sum(F.when(here, F.col("simulated_cost")).otherwise(0.0)).alias(f"{period}_cost"))
    return costs.groupBy(S).agg(
        *aggs, F.sum("consumption_kwh").alias("total_energy_kwh"), F.sum("simulated_cost").alias("total_simulated_cost"),
    )


def tariff_table(spark, tariff: Tariff = DEFAULT_TARIFF) -> DataFrame:
    """Period and rate of each hour of the day."""
    hour = F.col("id").cast("int")
    return spark.range(24).select(
        hour.alias("hour"), tou_period(hour, tariff).alias("tou_period"), tou_rate(hour, tariff).alias("rate"),
    )
