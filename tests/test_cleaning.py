from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from gridmeter.operators.chunks import CHUNK_ROWS, with_positions
from gridmeter.operators.cleaning import clean_hourly, dedup_measures, fill_short_gaps, flag_outliers, gap_islands
from gridmeter.operators.rollup import complete_index, hourly_rollup, hourly_zero_filled


def column(df, name, series="a"):
    return [r[name] for r in df.filter(F.col("series_id") == series).orderBy("ts").collect()]


def test_gap_of_two_gets_the_midpoint(hours):
    df = fill_short_gaps(hours({"a": [1.0, None, None, 3.0]}))
    assert column(df, "energy_kwh") == [1.0, 2.0, 2.0, 3.0]
    assert column(df, "is_long_gap") == [0, 0, 0, 0]


def test_gap_of_four_stays_null(hours):
    df = fill_short_gaps(hours({"a": [1.0, None, None, None, None, 3.0]}))
    assert column(df, "energy_kwh") == [1.0, None, None, None, None, 3.0]
    assert column(df, "is_long_gap") == [0, 1, 1, 1, 1, 0]


def test_gaps_at_the_ends_have_no_second_neighbour(hours):
    df = fill_short_gaps(hours({"a": [None, 1.0, None], "b": [None] * 4 + [1.0]}))
    assert column(df, "energy_kwh") == [None, 1.0, None]
    assert column(df, "is_long_gap") == [0, 0, 0]
    assert column(df, "is_long_gap", "b") == [1, 1, 1, 1, 0]


def greedy_gaps(values):
    """Gap group and gap size per row, counted one by one."""
    groups, group = [], 0
    for v in values:
        group += v is not None
        groups.append(group)
    missing = [v is None for v in values]
    sizes = [sum(m for g2, m in zip(groups, missing) if g2 == g) if is_missing else 0 for g, is_missing in zip(groups, missing)]
    return groups, sizes


def test_gaps_across_chunks(hours):
    """A series longer than two chunks, with gaps of many lengths and one over a whole chunk."""
    rng = random.Random(5)
    values = []
    while len(values) < 2 * CHUNK_ROWS:
        values += [float(rng.randint(1, 9)) for _ in range(rng.randint(1, 60))] + [None] * rng.choice([1, 2, 3, 4, 7])
    values += [None] * (CHUNK_ROWS + 100) + [5.0] * 30
    groups, sizes = greedy_gaps(values)
    islands = gap_islands(hours({"a": values}))
    assert column(islands, "gap_group") == groups
    assert column(islands, "gap_size") == sizes
    filled = fill_short_gaps(hours({"a": values}))
    assert column(filled, "is_long_gap") == [int(n > 3) for n in sizes]
    expected = list(values)
    for i, v in enumerate(values):
        if v is None and sizes[i] <= 3:
            before = next((x for x in reversed(values[:i]) if x is not None), None)
            after = next((x for x in values[i:] if x is not None), None)
            expected[i] = None if before is None or after is None else (before + after) / 2
    assert column(filled, "energy_kwh") == expected


def test_duplicates_sum_energy_and_average_levels(spark):
    rows = [("a", dt.datetime(2024, 1, 1), 1.0, 10.0), ("a", dt.datetime(2024, 1, 1), 2.0, 20.0)]
    df = dedup_measures(spark.createDataFrame(rows, "series_id string, ts timestamp, energy_kwh double, avg_voltage double"))
    assert [(r.energy_kwh, r.avg_voltage) for r in df.collect()] == [(3.0, 15.0)]


def test_null_hour_stays_null_in_the_rollup(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 5), None), ("a", dt.datetime(2024, 1, 1, 1, 5), 2.0), ("a", dt.datetime(2024, 1, 1, 1, 6), None)]
    df = hourly_rollup(spark.createDataFrame(rows, "series_id string, ts timestamp, energy_kwh double"))
    assert column(df, "energy_kwh") == [None, 2.0]


def test_zero_filled_differs_from_gaps(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 5), 1.0), ("a", dt.datetime(2024, 1, 1, 2, 5), 2.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, energy_kwh double")
    assert column(hourly_zero_filled(df), "energy_kwh") == [1.0, 0.0, 2.0]
    assert column(complete_index(hourly_rollup(df)), "energy_kwh") == [1.0, None, 2.0]


def test_null_is_no_outlier(hours):
    df = flag_outliers(hours({"a": [1, 1, 2, 2, 1, 2, None, 50]}))
    assert column(df, "is_energy_outlier") == [0, 0, 0, 0, 0, 0, 0, 1]


def test_cleaning_chain_floors_negatives(hours):
    df = clean_hourly(hours({"a": [1.0, -0.5, None, 1.0]}))
    assert column(df, "energy_kwh") == [1.0, 0.0, 0.25, 1.0]


def test_positions_across_chunks(hours):
    n = 3 * CHUNK_ROWS + 17
    df = with_positions(hours({"a": range(n), "b": [1, 2]}))
    assert column(df, "pos") == list(range(1, n + 1))
    assert column(df, "pos", "b") == [1, 2]
    assert {r.n_rows for r in df.filter("series_id = 'a'").select("n_rows").distinct().collect()} == {n}


def test_report_counts_every_step_and_reads_the_hours_once(spark, tmp_path):
    from gridmeter.operators.quality import preprocess_report

    hour = [f"2024-01-01 {h:02d}:00:00" for h in range(12)]
    rows = [("a", hour[h], float(h % 3)) for h in (0, 1, 3, 4, 5, 11)] + [("a", hour[1], 2.0), ("a", None, 9.0), ("a", hour[4], 1000.0)]
    rows += [("b", hour[0], -1.0), ("lost", None, 1.0)]
    path = str(tmp_path / "hours")
    spark.createDataFrame(rows, "series_id string, t string, energy_kwh double").selectExpr(
        "series_id", "cast(t AS timestamp) AS ts", "energy_kwh").write.parquet(path)
    report = preprocess_report(spark.read.parquet(path))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Scan parquet" not in plan
    got = {r.series_id: r.asDict() for r in report.collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["input_records"], a["null_timestamps_removed"], a["records_before_dedup"], a["duplicate_timestamps"]) == (9, 1, 8, 2)
    assert (a["records_after_dedup"], a["expected_hourly_records"], a["missing_hourly_records"], a["output_records"]) == (6, 12, 6, 12)
    assert (a["missing_energy_before"], a["missing_energy_after"], a["long_gap_hours"], a["outlier_count"]) == (6, 5, 5, 1)
    assert a["outlier_upper_bound"] < 1001 and got["b"]["negative_energy_values"] == 1 and got["b"]["output_records"] == 1


def test_complete_index_moves_known_hours_only(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 03:00:00", 2.0), ("a", "2024-01-01 03:00:00", 3.0), ("a", "2024-01-01 03:30:00", 9.0),
            ("a", "2024-06-01 05:30:00", 4.0), ("a", None, 5.0), ("b", "2024-01-01 00:30:00", 6.0), ("b", "2024-01-01 01:00:00", None),
            (None, "2024-01-01 00:00:00", 7.0), (None, "2024-01-01 02:00:00", 8.0), ("c", None, 1.0)]
    data = spark.createDataFrame(rows, "series_id string, ts string, energy_kwh double").withColumn("ts", F.to_timestamp("ts"))
    ends = data.filter("ts IS NOT NULL").groupBy("series_id").agg(F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi"))
    hours = ends.select("series_id", F.explode(F.expr("sequence(lo, hi, INTERVAL 1 HOUR)")).alias("ts"))
    found = complete_index(data)
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(found) == key(hours.join(data, ["series_id", "ts"], "left"))
    plan = found.groupBy("series_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
