from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridmeter.operators import features as f
from gridmeter.operators import forecast as fc
from gridmeter.operators.boosting import BoostedTrees, Tree
from gridmeter.operators.split import chronological_split


def daily_pattern(n, noise=0.2, seed=0):
    rng = np.random.default_rng(seed)
    return [round(2 + np.sin(i / 24 * 2 * np.pi) + noise * rng.random(), 3) for i in range(n)]


def test_seasonal_ar_recovers_its_parameters(hours):
    rng = np.random.default_rng(4)
    y = np.zeros(5000)
    for i in range(25, 5000):
        y[i] = 0.5 * y[i - 1] + 0.3 * y[i - 24] - 0.15 * y[i - 25] + rng.normal()
    rows = f.with_lags(hours({"a": y.tolist()}), fc.AR_LAGS)
    fit = fc.seasonal_ar_fit(rows).first()
    assert fit.phi == pytest.approx(0.5, abs=0.03) and fit.seasonal == pytest.approx(0.3, abs=0.03)
    path = fc.seasonal_ar_forecast(hours({"a": y.tolist()}), fc.seasonal_ar_fit(rows)).orderBy("ts").collect()
    expected = fit.phi * y[-1] + fit.seasonal * y[-24] - fit.phi * fit.seasonal * y[-25]
    assert len(path) == 24 and path[0].predicted == pytest.approx(expected)


class LastDay:
    """Stand-in model that repeats yesterday."""

    def transform(self, df):
        return df.withColumn("prediction", F.col("lag_24"))


def test_recursive_forecast_feeds_back_its_predictions(hours):
    values = daily_pattern(200)
    rows = fc.recursive_forecast(LastDay(), hours({"a": values, "short": values[:100]}), 30).orderBy("ts").collect()
    assert {r.series_id for r in rows} == {"a"} and len(rows) == 30
    assert rows[0].ts == dt.datetime(2024, 1, 1) + dt.timedelta(hours=200)
    assert [r.predicted for r in rows] == pytest.approx(values[-24:] + values[-24:-18])


def test_recursive_features_equal_the_feature_table(hours):
    values = daily_pattern(400)
    table = f.basic_features(hours({"a": values})).filter(F.hour("ts") == 3).orderBy(F.desc("ts")).first()
    history = values[: int((table.ts - dt.datetime(2024, 1, 1)).total_seconds() // 3600)]
    seen = {}

    class Spy:
        def transform(self, df):
            seen.update(df.drop("values", "_path").first().asDict())
            return df.withColumn("prediction", F.lit(0.0))

    fc.recursive_forecast(Spy(), hours({"a": history}), 1).collect()
    for c in f.feature_columns(f.basic_features(hours({"a": values}))):
        if c != "is_high_demand_previous_hour":
            assert seen[c] == pytest.approx(table[c]), c


def test_next_day_rows_line_up(hours):
    values = daily_pattern(250)
    rows = fc.next_day_rows(hours({"a": values})).orderBy("ts").collect()
    last = dt.datetime(2024, 1, 1) + dt.timedelta(hours=249)
    assert [r.target_ts for r in rows] == [last + dt.timedelta(hours=k) for k in range(1, 25)]
    assert rows[-1].lag_1 == values[-1] and rows[-1].energy_kwh is None


def test_models_train_predict_and_persist(spark, hours, tmp_path):
    clean = hours({"a": daily_pattern(420), "b": daily_pattern(420, seed=1), "new": daily_pattern(100)})
    rows = chronological_split(f.drop_incomplete(f.advanced_features(clean)))
    cols = f.feature_columns(rows, ["pos", "split"])
    train, validation = rows.filter("split = 'train'").persist(), rows.filter("split = 'validation'").persist()
    model, errors = fc.tune_gbt(train, validation, cols, fc.GRID_24H, rounds=3)
    assert len(errors) == 2 and min(errors) < 1
    fc.save_model(model, str(tmp_path / "m"))
    again = fc.load_model(str(tmp_path / "m"))
    assert isinstance(again, PipelineModel)
    ranked = fc.feature_importance(again, spark).collect()
    assert len(ranked) == 65 and sum(r.gain for r in ranked) == pytest.approx(1)
    got = fc.forecast_households(clean, again, 24).collect()
    by_series = {s: [r for r in got if r.series_id == s] for s in ("a", "b", "new")}
    assert len(by_series["a"]) == len(by_series["b"]) == 24 and all(r.predicted >= 0 for r in by_series["a"])
    assert [(r.status, r.predicted, r.required_hours) for r in by_series["new"]] == [("insufficient_history", None, 192)]
    hour = fc.forecast_households(clean, again, 1).filter("series_id = 'a'").collect()
    assert len(hour) == 1 and hour[0].ts == dt.datetime(2024, 1, 1) + dt.timedelta(hours=420)


def test_feature_exclusion(hours):
    clean = hours({"a": [1.0] * 3}).withColumns({"avg_voltage": F.lit(1.0), "is_long_gap": F.lit(0), "is_energy_outlier": F.lit(0)})
    cols = f.feature_columns(f.basic_features(clean))
    assert not set(cols) & {"energy_kwh", "avg_voltage", "is_long_gap", "is_energy_outlier", "ts", "series_id"} and len(cols) == 34


def test_household_forecast_reads_all_hours_once(spark, hours):
    values = {"a": daily_pattern(220), "hole": [*daily_pattern(219), None], "new": daily_pattern(100)}
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    tree = Tree([0, -1, -1], [0, 0, 0], [1, 0, 0], [2, 0, 0], [0.0, 2.0, 3.0], [1.0, 0.0, 0.0])
    model = BoostedTrees(["lag_24"], [[1.0]], 0.5, False, [tree])
    got = fc.forecast_households(hours(values).withColumn("energy_kwh", counted("energy_kwh")), model, 24).collect()
    assert read.value == 540
    by_series = {s: sorted((r for r in got if r.series_id == s), key=lambda r: str(r.ts)) for s in values}
    assert [r.predicted for r in by_series["a"]] == [3.5 if v >= 1 else 2.5 for v in values["a"][173:197]]
    assert {r.status for r in by_series["hole"]} == {"complete"} and len(by_series["hole"]) == 24
    assert [(r.status, r.available_hours, r.ts) for r in by_series["new"]] == [("insufficient_history", 100, None)]
    assert by_series["a"][0].threshold == pytest.approx(np.percentile(values["a"], 90))
