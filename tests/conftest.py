from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridmeter.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hours(spark):
    """Hourly series from {series: [values from 2024-01-01 00:00 on]}."""

    def build(series: dict[str, list[float | None]], start: str = "2024-01-01 00:00:00"):
        import datetime as dt

        first = dt.datetime.fromisoformat(start)
        rows = [(s, first + dt.timedelta(hours=i), None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, energy_kwh double")
        return df.withColumn("ts", df.ts.cast("timestamp"))

    return build
