"""The hourly roll-up over a stream of readings: the batch operator unchanged, behind a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridmeter.operators.rollup import hourly_rollup


def stream_hourly(
    readings: DataFrame, late: str = "2 hours", sums: Sequence[str] = ("energy_kwh",), averages: Sequence[str] = (),
) -> DataFrame:
    """Hourly rows of a streaming DataFrame; state of an hour is dropped once the watermark has passed it."""
    return hourly_rollup(readings.withWatermark("ts", late), sums, averages)
