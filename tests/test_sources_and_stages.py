from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridmeter.operators.quality import assert_features, assert_predictions, hour_coverage, reconcile
from gridmeter.plans import build_stages
from gridmeter.sources import read_meter_log, read_stage, write_json, write_stage
from gridmeter.streaming import stream_hourly

HEADER = "Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3"


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    """Nine days of quarter-hour lines with unknown values, one missing hour and one long gap."""
    rng = random.Random(8)
    lines, t = [HEADER], dt.datetime(2007, 12, 16, 17, 0)
    for i in range(9 * 96):
        now = t + dt.timedelta(minutes=15 * i)
        if 400 <= i < 404 or 600 <= i < 640:
            continue
        power = "?" if rng.random() < 0.02 else f"{rng.random() * 4:.3f}"
        lines.append(f"{now.day}/{now.month}/{now.year};{now:%H:%M:%S};{power};0.1;240.5;4.0;1.0;2.0;{'?' if power == '?' else '3.0'}")
    path = tmp_path_factory.mktemp("log") / "log.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_meter_log_scan(spark, log):
    df = read_meter_log(spark, log)
    assert dict(df.dtypes)["Voltage"] == "double" and df.filter("Global_active_power IS NULL").count() > 0
    assert df.first().Date == "16/12/2007"


def test_stages_from_raw_to_split(spark, log, tmp_path):
    raw = read_meter_log(spark, log).withColumn("series_id", F.lit("home"))
    lazy, written = build_stages(raw), build_stages(raw, str(tmp_path))
    for name in ("hourly", "clean", "features"):
        a, b = getattr(lazy, name), getattr(written, name)
        assert sorted(a.columns) == sorted(b.columns) and a.count() == b.count() > 0
    assert len(written.hourly.columns) == 10
    assert written.clean.filter("is_long_gap = 1").count() == 10
    assert written.clean.filter("energy_kwh IS NULL").count() == 10
    rows = {r.stage: r.n_rows for r in reconcile({"hourly": written.hourly, "clean": written.clean}).collect()}
    assert rows["clean"] - rows["hourly"] == 11
    assert_features(written.features.select("series_id", "ts", "energy_kwh"))


def test_guards_fail_on_bad_predictions(spark):
    bad = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), -1.0)], "series_id string, ts timestamp, predicted double")
    with pytest.raises(ValueError, match="negative_predictions"):
        assert_predictions(bad, 1.0, 2.0)
    with pytest.raises(ValueError, match="misordered_thresholds"):
        assert_predictions(bad.withColumn("predicted", F.lit(1.0)), 2.0, 1.0)


def test_hour_coverage(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, m)) for m in range(60)] + [("a", dt.datetime(2024, 1, 1, 1, 5))]
    row = hour_coverage(spark.createDataFrame(rows, "series_id string, ts timestamp")).first()
    assert (row.hours, row.full_hours, row.partial_hours, row.min_readings, row.max_readings) == (2, 1, 1, 1, 60)


def test_stage_table_prunes_by_bucket(spark, hours, tmp_path):
    df = hours({f"s{i}": [1.0, 2.0] for i in range(20)})
    write_stage(df, str(tmp_path / "t"), buckets=4)
    back = read_stage(spark, str(tmp_path / "t"))
    assert back.count() == 40 and back.select("series_bucket").distinct().count() == 4


def test_json_keeps_nulls(spark, tmp_path):
    write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1,"b":null}'


def test_stream_gives_the_batch_rollup(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, h, 30), float(h)) for h in range(10)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, energy_kwh double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly_stream").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.ts.hour: r.energy_kwh for r in spark.table("hourly_stream").collect()}
    assert got == {h: float(h) for h in range(10)}
