from __future__ import annotations

import datetime as dt

import pytest

from gridmeter.operators.evaluate import (
    full_metrics, improvement_pct, improvement_vs_naive, peak_metrics, regression_metrics, residual_histogram, select_model,
)
from pyspark.sql import functions as F

SCHEMA = "series_id string, ts timestamp, actual double, predicted double, horizon int, model string"


def predictions(spark, pairs, model="Naive_1h", horizon=1):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), a, p, horizon, model) for i, (a, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def test_regression_metrics(spark):
    row = regression_metrics(predictions(spark, [(1.0, 2.0), (2.0, 2.0), (0.0, 1.0), (3.0, None)])).first()
    assert row.model == "Naive" and row.prediction_count == 3
    assert row.mae == pytest.approx(2 / 3) and row.rmse == pytest.approx((2 / 3) ** 0.5)
    assert row.mape == pytest.approx(50) and row.r2 == pytest.approx(1 - 2 / 2)


def test_extended_metrics(spark):
    row = full_metrics(predictions(spark, [(1.0, 1.1), (2.0, 1.0), (0.0, 0.0)])).first()
    assert row.smape == pytest.approx((0.2 / 2.1 + 2 / 3) / 2 * 100)
    assert row.acc_5 == pytest.approx(100 / 3) and row.acc_50 == pytest.approx(100)


def test_peaks_are_strictly_above_the_threshold(spark):
    df = predictions(spark, [(2.0, 3.0), (3.0, 3.0), (3.0, 2.0), (1.0, 1.0)]).withColumn("threshold", F.lit(2.0))
    row = peak_metrics(df).first()
    assert (row.true_positives, row.false_positives, row.false_negatives) == (1, 1, 1)
    assert row.precision == row.recall == row.f1_score == 0.5


def test_no_peaks_gives_zeros(spark):
    row = peak_metrics(predictions(spark, [(1.0, 1.0)]).withColumn("threshold", F.lit(2.0))).first()
    assert row.precision == row.recall == row.f1_score == 0


def test_published_improvement(spark):
    df = spark.createDataFrame([(0.38738504058496, 0.319969038189464), (0.0, 1.0), (None, 1.0)], "b double, m double")
    got = [r[0] for r in df.select(improvement_pct(F.col("b"), F.col("m"))).collect()]
    assert got == pytest.approx([17.4028409289363, 0, 0])


def test_selection_prefers_the_day_horizon(spark):
    rows = [("a", "Naive", 1, 1.0, 1.0, 1.0), ("a", "X", 1, 0.5, 0.5, 1.0), ("a", "Naive", 24, 2.0, 2.0, 1.0), ("a", "Y", 24, 1.0, 1.5, 1.0),
            ("b", "Naive", 1, 1.0, 1.0, 1.0)]
    metrics = spark.createDataFrame(rows, "series_id string, model string, horizon int, mae double, rmse double, mape double")
    got = {r.series_id: r for r in select_model(metrics).collect()}
    assert (got["a"].selected_model, got["a"].best_horizon_1_model, got["a"].beats_naive) == ("Y", "X", True)
    assert (got["b"].selected_model, got["b"].best_horizon_24_model, got["b"].beats_naive) == ("Naive", None, False)
    better = {(r.model, r.horizon): r.mae_improvement_vs_naive for r in improvement_vs_naive(metrics).filter("series_id = 'a'").collect()}
    assert better[("Y", 24)] == 50 and better[("Naive", 1)] == 0


def test_residual_histogram_covers_every_row(spark):
    pairs = [(float(i), 3.0) for i in range(11)]
    bins = residual_histogram(predictions(spark, pairs), 10).collect()
    assert sum(b.n for b in bins) == 11 and len(bins) == 10 and min(b.bin_start for b in bins) == -3.0
