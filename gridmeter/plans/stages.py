"""The batch chain from raw readings to demand analytics, as lazy DataFrames of one session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions import kw_to_kwh, with_timestamp
from gridmeter.operators.cleaning import clean_hourly
from gridmeter.operators.features import basic_features, drop_incomplete
from gridmeter.operators.rollup import hourly_rollup
from gridmeter.operators.split import chronological_split
from gridmeter.sources import read_stage, write_stage


@dataclass(frozen=True)
class Stages:
    raw: DataFrame
    hourly: DataFrame
    clean: DataFrame
    features: DataFrame
    split: DataFrame


def from_meter_log(raw: DataFrame) -> DataFrame:
    """Minute readings of a meter log to the hourly table of nine columns."""
    typed = with_timestamp(raw).withColumn("energy_kwh", kw_to_kwh(F.col("Global_active_power")))
    hourly = hourly_rollup(
        typed, ["energy_kwh", "Sub_metering_1", "Sub_metering_2", "Sub_metering_3"],
        ["Global_active_power", "Global_reactive_power", "Voltage", "Global_intensity"],
    )
    return hourly.select(*[F.col(c).alias(c.lower()) for c in hourly.columns])


def build_stages(raw: DataFrame, folder: str | None = None) -> Stages:
    """Chain all stages; with a folder each stage table is written by the executors and read back.

    Written stages keep later ones from recomputing earlier ones and survive the loss of executors.
    """

    def settle(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return df
        path = f"{folder.rstrip('/')}/{name}"
        write_stage(df, path)
        return read_stage(df.sparkSession, path).drop("series_bucket")

    hourly = settle(from_meter_log(raw), "hourly")
    clean = settle(clean_hourly(hourly), "clean")
    features = settle(drop_incomplete(basic_features(clean)), "features")
    return Stages(raw, hourly, clean, features, chronological_split(features))
