from __future__ import annotations

import datetime as dt
import random

import pytest

from gridmeter.operators.advice import grid_summary, recommendations
from gridmeter.operators.costs import peak_forecast, tou_cost, tou_summary
from gridmeter.operators.shifting import daily_savings, load_shifts, shift_sensitivity

SCHEMA = "series_id string, ts timestamp, predicted double, threshold double"
START = dt.datetime(2024, 1, 1)


def forecast(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rate(ts):
    return 10.0 if 17 <= ts.hour < 22 else 3.0 if ts.hour < 6 or ts.hour >= 22 else 6.0


def greedy(rows, fraction=0.2):
    """Highest source first; each takes the first unused destination of a cheaper rate."""
    sources = sorted((r for r in rows if r[2] > r[3]), key=lambda r: (-r[2], r[1]))
    targets = sorted((r for r in rows if r[2] < r[3] and rate(r[1]) < 10), key=lambda r: (rate(r[1]), r[2], r[1]))
    used, out = set(), []
    for s in sources:
        choice = next((d for d in targets if d[1] not in used and rate(d[1]) < rate(s[1])), None)
        if choice is None or min(s[2] * fraction, s[2] - s[3], choice[2] * fraction) <= 0:
            continue
        used.add(choice[1])
        out.append((s[0], s[1], choice[1], round(min(s[2] * fraction, s[2] - s[3], choice[2] * fraction), 9)))
    return out


def test_same_pairs_as_the_greedy(spark):
    rng = random.Random(11)
    rows, expected = [], []
    for case in range(300):
        top = rng.choice([3, 6])
        mine = [
            (f"s{case}", START + dt.timedelta(hours=h), float(rng.randint(0 if case % 3 == 0 else 1, top)), rng.choice([2.0, 3.0]))
            for h in range(rng.choice([5, 24, 48]))
        ]
        threshold = mine[0][3]
        mine = [(s, t, p, threshold) for s, t, p, _ in mine]
        rows += mine
        expected += greedy(mine)
    got = [
        (r.series_id, r.source_ts, r.destination_ts, round(r.shiftable_energy_kwh, 9))
        for r in load_shifts(forecast(spark, rows)).collect()
    ]
    assert sorted(got) == sorted(expected) and expected


def test_published_first_shift(spark):
    rows = [
        ("a", dt.datetime(2010, 1, 1, 19), 3.85324716567993, 2.34504),
        ("a", dt.datetime(2010, 1, 1, 2), 0.155270531773567, 2.34504),
    ]
    shift = load_shifts(forecast(spark, rows)).first()
    assert shift.shiftable_energy_kwh == pytest.approx(0.0310541063547134, rel=1e-12)
    assert shift.estimated_savings == pytest.approx(0.217378744482994, rel=1e-12)


def test_hour_at_the_threshold_is_a_peak_but_cannot_shift(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 18), 2.0, 2.0), ("a", dt.datetime(2024, 1, 1, 3), 1.0, 2.0)]
    pred = forecast(spark, rows)
    assert {r.ts.hour: r.is_peak for r in peak_forecast(pred).collect()} == {18: True, 3: False}
    assert load_shifts(pred).count() == 0


def test_empty_head_destination_stops_its_rate_unless_skipped(spark):
    rows = [
        ("a", dt.datetime(2024, 1, 1, 18), 5.0, 2.0), ("a", dt.datetime(2024, 1, 1, 3), 0.0, 2.0),
        ("a", dt.datetime(2024, 1, 1, 4), 1.0, 2.0),
    ]
    assert load_shifts(forecast(spark, rows)).count() == 0
    assert [r.destination_ts.hour for r in load_shifts(forecast(spark, rows), skip_empty=True).collect()] == [4]


def test_costs_savings_and_summary(spark):
    rows = [("a", START + dt.timedelta(hours=h), 1.0 + (h % 24 == 18) * 4, 2.0) for h in range(48)]
    pred = forecast(spark, rows)
    costs, shifts = tou_cost(pred), load_shifts(pred)
    total = tou_summary(costs).first()
    assert total.total_simulated_cost == pytest.approx(sum(r[2] * rate(r[1]) for r in rows))
    assert total.peak_cost == total.peak_energy_kwh * 10
    daily = {r.date.day: r for r in daily_savings(costs, shifts).collect()}
    assert sum(d.baseline_cost for d in daily.values()) == pytest.approx(total.total_simulated_cost)
    assert daily[1].estimated_savings == pytest.approx(0.2 * 10 - 0.2 * 3)
    by_fraction = {r.shiftable_fraction: r.energy_shifted_kwh for r in shift_sensitivity(pred).collect()}
    assert by_fraction == pytest.approx({0.1: 0.2, 0.2: 0.4, 0.3: 0.6})
    history = pred.selectExpr("series_id", "ts", "predicted AS energy_kwh")
    summary = grid_summary(history, peak_forecast(pred), costs, shifts).first()
    assert summary.load_shift_count == 2 and summary.predicted_peak_count == 2
    assert summary.highest_predicted_demand_ts == START + dt.timedelta(hours=18)


def test_recommendation_rules(spark):
    night = [("a", START + dt.timedelta(hours=h), 9.0 if h % 24 < 6 else 1.0, 0.5) for h in range(24 * 7)]
    pred = forecast(spark, night)
    history = pred.selectExpr("series_id", "ts", "predicted AS energy_kwh")
    got = {r.rule_order: r for r in recommendations(history, peak_forecast(pred)).collect()}
    assert set(got) == {1, 3, 4}
    assert got[4].supporting_metric == "Overnight average = 9.00 vs overall = 3.00 kWh/hour"
    assert got[3].supporting_metric == "Predicted peak periods = 168"
