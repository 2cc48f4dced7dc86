from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gridmeter.functions import bill_month_key, format_timedelta, parse_ts, period_bounds, previous_period
from gridmeter.operators.uploads import sampling_interval, user_hourly, validate_uploads
from gridmeter.sources import parse_user_lines, read_user_csv

ROWS = "upload_id string, timestamp string, energy_consumption string"


def verdict(spark, rows, **kw):
    return {r.upload_id: r for r in validate_uploads(spark.createDataFrame(rows, ROWS), **kw).collect()}


def test_interval_tie_takes_the_smaller_gap(spark):
    start = dt.datetime(2024, 1, 1, 23)
    steps = [0, 900, 1800, 5400, 9000]
    df = spark.createDataFrame([("u", start + dt.timedelta(seconds=s)) for s in steps], "upload_id string, ts timestamp")
    row = sampling_interval(df).first()
    assert (row.interval_seconds, row.consistency_percent, row.gap_count) == (900, 50.0, 2)
    assert row.detected_interval == "0 days 00:15:00"


def test_single_timestamp_has_no_interval(spark):
    row = verdict(spark, [("u", "2024-01-01 00:00", "1"), ("u", "2024-01-01 00:00", "2")])["u"]
    assert (row.status, row.detected_interval, row.interval_seconds) == ("VALID_WITH_WARNINGS", "N/A", None)
    assert row.warnings == ["1 duplicate timestamps detected.", "Insufficient history for forecasting (less than 7 days)."]


def test_verdicts(spark):
    hourly = [("good", f"2024-01-{d:02d} {h:02d}:00", "0.5") for d in range(1, 9) for h in range(24)]
    rows = hourly + [
        ("badtime", "2024-13-45", "1"), ("badtime", None, "1"),
        ("notime", None, "1"), ("notime", "2024-01-01", "x"),
        ("badkwh", "2024-01-01", "x"), ("badkwh", "2024-01-02", "-1"), ("badkwh", "2024-01-02", None),
    ]
    got = verdict(spark, rows)
    assert (got["good"].status, got["good"].forecasting_readiness, got["good"].records) == ("VALID", "Basic", 192)
    assert got["badtime"].errors == ["Found 1 invalid unparseable timestamps."]
    assert got["notime"].errors == ["Found 1 missing timestamps."] and got["notime"].start_ts is None
    assert got["badkwh"].errors == ["Found 1 invalid non-numeric energy values.", "Found 1 negative energy consumption values."]
    assert got["badkwh"].warnings == ["1 duplicate timestamps detected."] and got["badkwh"].forecasting_readiness == "Unknown"


def test_missing_columns_and_empty_files(spark):
    rows = spark.createDataFrame([("u", "1", "2", ["when", "kwh"])], ROWS + ", header array<string>")
    files = spark.createDataFrame([("u", 10), ("empty", 0), ("bare", 30)], "upload_id string, file_size long")
    got = {r.upload_id: r for r in validate_uploads(rows, files).collect()}
    assert got["u"].errors == ["Missing required column: timestamp", "Missing required column: energy_consumption"]
    assert got["empty"].errors == ["File is empty."] and got["bare"].errors == ["CSV has no data rows."]
    assert {r.status for r in got.values()} == {"INVALID"}


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "u1.csv").write_text("extra,energy_consumption,timestamp\nx,NA,2024-01-01\n\n\"y,z\",1.5,NaN\n")
    (tmp_path / "u2.csv").write_text("timestamp,energy_consumption\r\n2024-01-02,2.5\r\ntimestamp,energy_consumption\r\n2024-01-03\r\n")
    (tmp_path / "u3.csv").write_text("timestamp,kwh\n2024-01-04,3\n")
    rows = read_user_csv(spark, str(tmp_path))
    got = sorted((r.upload_id, r.timestamp or "-", r.energy_consumption or "-") for r in rows.collect())
    assert got == [
        ("u1", "-", "1.5"), ("u1", "2024-01-01", "-"), ("u2", "2024-01-02", "2.5"), ("u2", "2024-01-03", "-"),
        ("u2", "timestamp", "energy_consumption"), ("u3", "2024-01-04", "-"),
    ]
    verdicts = {r.upload_id: r.errors for r in validate_uploads(rows).collect()}
    assert verdicts["u3"] == ["Missing required column: energy_consumption"]
    assert verdicts["u2"] == ["Found 1 invalid unparseable timestamps."]
    lines = spark.createDataFrame([("2024-01-01,",)], "line string")
    assert tuple(parse_user_lines(lines).first()) == ("2024-01-01", None)


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_timestamp_texts(spark):
    cases = {
        "2026-08-01 00:15": dt.datetime(2026, 8, 1, 0, 15), "2026/08/01T01:02:03": dt.datetime(2026, 8, 1, 1, 2, 3),
        "08/13/2026": dt.datetime(2026, 8, 13), "13/08/2026 7:05": dt.datetime(2026, 8, 13, 7, 5),
        "03/04/2026": dt.datetime(2026, 3, 4), "2026-08-01 25:00": None, "x 2026-08-01": None, "": None, "99/99/2026": None,
    }
    for text, expected in cases.items():
        assert one(spark, parse_ts(F.lit(text))) == expected, text
    assert one(spark, parse_ts(F.lit("03/04/2026"), day_first=True)) == dt.datetime(2026, 4, 3)


def test_periods(spark):
    bounds = one(spark, period_bounds(F.lit("2024-02")))
    assert (bounds.start, bounds.end) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 29, 23, 59, 59))
    assert one(spark, period_bounds(F.lit("2023"))).end == dt.datetime(2023, 12, 31, 23, 59, 59)
    assert one(spark, period_bounds(F.lit("2024-13"))).start is None
    assert one(spark, previous_period(F.lit("2024-01"))) == "2023-12"
    assert one(spark, previous_period(F.lit("2024"))) == "2023"
    assert one(spark, bill_month_key(F.lit("August 2026"))) == 2026 * 12 + 8
    assert one(spark, bill_month_key(F.lit("soon"))) is None
    assert one(spark, format_timedelta(F.lit(93784))) == "1 days 02:03:04"


def test_hourly_series_of_usable_uploads_only(spark):
    rows = [
        ("ok", "2024-01-01 00:10", "1"), ("ok", "2024-01-01 00:40", "2"), ("ok", "2024-01-01 02:10", "4"),
        ("dup", "2024-01-01", "1"), ("dup", "2024-01-01", "1"), ("neg", "2024-01-01", "-1"), ("text", "2024-01-01", "x"),
        ("time", "soon", "1"), ("time", "2024-01-01", "1"),
    ]
    got = user_hourly(spark.createDataFrame(rows, ROWS)).orderBy("ts").collect()
    assert [(r.series_id, r.ts.hour, r.energy_kwh) for r in got] == [("ok", 0, 3.0), ("ok", 1, 0.0), ("ok", 2, 4.0)]
