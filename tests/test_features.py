from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmeter.operators import features as f
from gridmeter.operators.chunks import CHUNK_ROWS
from gridmeter.operators.split import chronological_split, with_target
from gridmeter.operators.stats import autocorrelation


def frame(df, series="a"):
    return df.filter(F.col("series_id") == series).orderBy("ts").toPandas()


def test_lenient_and_strict_windows_differ(hours):
    grid = hours({"a": [1, 2, 5]})
    assert frame(f.with_rolling(grid))["rolling_mean_3"].tolist()[2] == 1.5
    assert frame(f.strict_rolling(grid))["roll_mean_3"].isna().all()


def test_ewm_weight_decays_across_a_null(hours):
    got = frame(f.with_ewm(hours({"a": [1, None, 3, 9]}), [3]))["ewm_3"].tolist()
    assert np.isnan(got[0])
    assert got[1:] == pytest.approx([1, 1, 7 / 3])


def long_values(seed=3, n=3 * CHUNK_ROWS):
    """More than three chunks: random nulls, null runs, and a whole chunk without any value."""
    rng = random.Random(seed)
    values = [None if rng.random() < 0.2 else round(rng.random() * 5, 2) for _ in range(n)]
    values[:3] = [None, None, None]
    return values + [None] * (CHUNK_ROWS + 300) + [round(rng.random() * 5, 2) for _ in range(400)]


def test_ewm_equals_one_pass_over_the_whole_series(hours):
    values = long_values()
    got = frame(f.with_ewm(hours({"a": values, "b": [None, 1, 2]})))
    series = pd.Series([np.nan if v is None else v for v in values])
    for span in f.EWM_SPANS:
        expected = series.ewm(span=span, adjust=False).mean().shift(1)
        np.testing.assert_allclose(got[f"ewm_{span}"], expected, rtol=1e-12, equal_nan=True)


def test_exponential_means_run_without_python_and_join_chunks_only(hours):
    got = f.with_ewm(hours({"a": [1.0, None, 3.0] * 20}).withColumn("note", F.lit("kept")), [3])
    assert got.columns == ["series_id", "ts", "energy_kwh", "note", "ewm_3"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Pandas", "Arrow", "Python")) and plan.count("Join") == 1
    # The join lies below the explode: it meets one row a chunk.
    assert plan.index("Generate explode") < plan.index("Join")


def test_chunked_windows_equal_whole_series_windows(hours):
    values = long_values(7, 2 * CHUNK_ROWS)
    series = pd.Series([np.nan if v is None else v for v in values])
    got = frame(f.strict_rolling(f.with_lags(hours({"a": values}), [1, 168])))
    np.testing.assert_array_equal(got["lag_168"], series.shift(168))
    np.testing.assert_allclose(got["roll_mean_6"], series.shift(1).rolling(6).mean(), rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(got["roll_std_12"], series.shift(1).rolling(12).std(), rtol=1e-6, atol=1e-9, equal_nan=True)
    lenient = frame(f.with_rolling(hours({"a": values})))
    np.testing.assert_allclose(lenient["rolling_mean_24"], series.shift(1).rolling(24, min_periods=1).mean(), rtol=1e-9, equal_nan=True)
    auto = autocorrelation(hours({"a": values})).first()
    assert auto.lag_24 == pytest.approx(series.corr(series.shift(24)))


def test_features_never_look_at_their_own_hour_or_later(hours):
    values = [float((i * 37) % 11) for i in range(400)]
    changed = list(values)
    changed[300] = 99.0
    p90 = F.lit(5.0)
    before, after = (
        frame(f.advanced_features(hours({"a": v}).withColumn("p90", p90), "p90").drop("p90")) for v in (values, changed)
    )
    features = [c for c in before.columns if c not in ("series_id", "ts", "energy_kwh")]
    pd.testing.assert_frame_equal(before.loc[:300, features], after.loc[:300, features])
    assert not before.loc[301, features].equals(after.loc[301, features])


def test_advanced_table_has_65_features(hours):
    df = f.advanced_features(hours({"a": [1.0] * 200}))
    assert len(f.feature_columns(df)) == 65


def test_history_quirks(hours):
    row = frame(f.advanced_features(hours({"a": list(range(200))}))).iloc[180]
    assert row.trend_1h == 1 and row.trend_3h == 3
    assert row.prev_day_total == (180 - 36) + (180 - 48)
    assert row.same_hour_avg_14d == row.same_hour_avg_7d == 180 - 96
    assert row.prev_week_same_hour == 12


def test_unknown_previous_hour(hours):
    grid = hours({"a": [9, None, 9, 9]}).withColumn("p90", F.lit(5.0))
    lagged = f.with_lags(grid, f.ADVANCED_LAGS)
    assert frame(f.with_trend(lagged))["is_high_demand_previous_hour"].tolist() == [0, 1, 0, 1]
    flags = frame(f.history_features(lagged))["is_peak_prev_hour"]
    assert [None if pd.isna(x) else int(x) for x in flags] == [None, 1, None, 1]


def test_locf_across_chunks(hours):
    values = [None, 4.0] + [None] * (2 * CHUNK_ROWS) + [7.0, None]
    got = frame(f.locf_zero(hours({"a": values})))["energy_kwh"].tolist()
    assert got == [0.0] + [4.0] * (2 * CHUNK_ROWS + 1) + [7.0, 7.0]


def test_split_and_target_stay_inside_the_split(hours):
    n = 2 * CHUNK_ROWS + 60
    split = chronological_split(hours({"a": range(n)}))
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    train, validation = int(n * 0.7), int(n * 0.15)
    assert counts == {"train": train, "validation": validation, "test": n - train - validation}
    ahead = with_target(split)
    assert ahead.filter("target <> energy_kwh + 23").count() == 0
    kept = {r.split: r["count"] for r in ahead.groupBy("split").count().collect()}
    assert kept == {k: v - 23 for k, v in counts.items()}


def test_moving_averages(spark):
    rows = [("a", f"2024-01-{d:02d}", float(d)) for d in range(1, 9)]
    daily = spark.createDataFrame(rows, "series_id string, date string, total_energy_kwh double")
    strict = [r.rolling_7d for r in f.ma7_strict(daily).orderBy("date").collect()]
    partial = [r.avg7 for r in f.ma7_partial(daily).orderBy("date").collect()]
    assert strict == [None] * 6 + [4.0, 5.0]
    assert partial[:3] == [1.0, 1.5, 2.0] and partial[7] == 5.0


def test_exponential_mean_after_a_silence_of_years(spark, hours):
    values = [1.0, None, 5.0] + [None] * 30_000 + [9.0, None, 2.0, 4.0]
    got = [r.ewm_5000 for r in f.with_ewm(hours({"s": values}), [5000]).orderBy("ts").collect()]
    want = pd.Series(values, dtype="float64").ewm(span=5000, adjust=False).mean().shift(1)
    assert np.allclose(np.array(got, dtype="float64"), want.to_numpy(), rtol=1e-9, equal_nan=True)


def test_last_hours_of_the_advanced_table(spark, hours):
    rng = random.Random(5)
    grid = hours({"a": [rng.randint(0, 90) / 8 for _ in range(CHUNK_ROWS + 60)], "b": [rng.choice([None, 1, 2, 5]) for _ in range(400)], "c": [3] * 20})
    ends = grid.groupBy("series_id").agg(F.max("ts").alias("end"))
    whole = f.advanced_features(grid).join(ends, "series_id").filter("ts > end - INTERVAL 24 HOURS").drop("end")
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(f.advanced_features(grid, last=24)) == key(whole)


def test_features_of_the_hour_after_the_last_one(spark, hours):
    rng = random.Random(6)
    values = {"a": [rng.random() for _ in range(CHUNK_ROWS + 80)], "b": [rng.choice([None, 1.5, 0, 5.25]) for _ in range(260)], "c": [0.1] * 200,
              "hole": [rng.random() for _ in range(300)] + [None] + [rng.random() for _ in range(30)], "new": [2.5], "dark": [None, None]}
    ends = hours(values).groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    future = hours({s: [*v, None] for s, v in values.items()})
    whole = f.advanced_features(future).join(ends, "series_id").filter("ts > last_ts - INTERVAL 23 HOURS")
    got = f.end_features(f.series_ends(hours(values), 23))
    assert got.columns == whole.columns
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(got) == key(whole) and len(key(got)) == 24 * 4 + 2 + 3


def test_ends_need_no_complete_rows(spark):
    rows = [("a", None, 1.0), (None, 3, 2.0), ("b", None, None), ("b", 5, float("nan")), ("b", 5, 1.0)]
    grid = spark.createDataFrame(rows, "series_id string, h int, energy_kwh double").selectExpr("series_id", "timestamp_seconds(h * 3600) AS ts", "energy_kwh")
    ends = f.series_ends(grid, 23)
    assert {r.series_id: (r.available_hours, len(r._last)) for r in ends.collect()} == {"a": (1, 0), None: (1, 1), "b": (3, 2)}
    assert sorted(str(r.series_id) for r in f.end_features(ends).collect()) == ["b", "b", "b"]
