from __future__ import annotations

import datetime as dt
import random

import pytest

from gridmeter.operators import households as h

CATALOG = "id string, user_id long, start_timestamp timestamp, end_timestamp timestamp"


def ts(text):
    return dt.datetime.fromisoformat(text)


def random_uploads(spark, seed=2):
    """Readings and catalog of overlapping uploads, and the plain answer: every covered hour of a user with its mean over uploads."""
    rng = random.Random(seed)
    rows, uploads = [], {}
    for user in (1, 2, 3):
        for upload in range(4):
            first = ts("2024-01-25") + dt.timedelta(hours=rng.randint(0, 900))
            stamps = [first + dt.timedelta(minutes=rng.randint(0, 9000)) for _ in range(rng.randint(1, 25))]
            uploads[user, upload] = [(t, float(rng.randint(0, 9))) for t in stamps]
            rows += [(f"{user}-{upload}", user, t, v) for t, v in uploads[user, upload]]
    readings = spark.createDataFrame(rows, "id string, user_id long, ts timestamp, energy_kwh double")
    spans = [(f"{u}-{n}", u, min(r)[0], max(r)[0]) for (u, n), r in uploads.items()]
    catalog = spark.createDataFrame(spans + [("lost", 1, None, None)], CATALOG)
    hours = {}
    for (user, _), read in uploads.items():
        hour = min(read)[0].replace(minute=0)
        while hour <= max(read)[0]:
            hours.setdefault((user, hour), []).append(sum(v for t, v in read if t.replace(minute=0) == hour))
            hour += dt.timedelta(hours=1)
    return readings, catalog, {k: sum(v) / len(v) for k, v in hours.items()}


@pytest.mark.parametrize("seed", [2, 5])
def test_merged_and_covered_hours_equal_the_dense_merge(spark, seed):
    readings, catalog, dense = random_uploads(spark, seed)
    merged = h.merge_uploads(readings, catalog)
    sparse = {(r.user_id, r.ts): r.energy_kwh for r in merged.collect()}
    assert set(sparse) <= set(dense) and len(dense) > len(sparse)
    for key, value in dense.items():
        assert sparse.get(key, 0.0) == pytest.approx(value)
    requests = spark.createDataFrame([(1, "2024"), (2, "2024"), (3, "2024-02"), (3, "2024-02"), (2, "never")], "user_id long, period string")
    got = {(r.user_id, r.ts): r.energy_kwh for r in h.user_period_data(merged, catalog, requests).collect()}
    assert got == {k: pytest.approx(v) for k, v in dense.items() if k[0] != 3 or k[1].month == 2}


def test_covered_runs_and_months_equal_a_plain_union(spark):
    rng = random.Random(9)
    spans = [(rng.randint(1, 3), f, f + rng.randint(-1, 6)) for f in (rng.randint(-40, 60) for _ in range(60))]
    runs = h.covered_runs(spark.createDataFrame(spans, "user_id long, _first long, _last long")).collect()
    got = [(r.user_id, x) for r in runs for x in range(r._first, r._last + 1)]
    assert len(got) == len(set(got)) and set(got) == {(u, x) for u, a, b in spans for x in range(a, b + 1)}
    edges = {(r.user_id, r._first) for r in runs}
    assert not any((r.user_id, r._last + 1) in edges for r in runs)  # runs that touch are one
    _, catalog, dense = random_uploads(spark)
    months = [(r.user_id, r.month) for r in h.covered_months(catalog).collect()]
    assert sorted(months) == sorted({(u, t.strftime("%Y-%m")) for u, t in dense})


def test_month_dashboard_counts_zero_hours_without_making_them(spark):
    readings, catalog, dense = random_uploads(spark)
    asked = [(u, m) for u in (1, 2, 3, 4) for m in ("2024-01", "2024-02", "2024-03", "1999-12")]
    result = h.dashboard_month(h.merge_uploads(readings, catalog), catalog, spark.createDataFrame(asked, "user_id long, period string"))
    got = {(r.user_id, r.asked_period, r.period, r.section, r.label): r.energy_kwh for r in result.collect()}
    expected = {}
    for user, month in asked:
        having = sorted({t.strftime("%Y-%m") for u, t in dense if u == user})
        period = month if month in having else having[-1] if having else None
        rows = [(t, v) for (u, t), v in dense.items() if u == user and t.strftime("%Y-%m") == period]
        for section, style, mean in (("total", "%Y-%m", False), ("daily", "%Y-%m-%d", False), ("hourly", "%H:00", True)):
            for label in {t.strftime(style) for t, _ in rows}:
                values = [v for t, v in rows if t.strftime(style) == label]
                expected[user, month, period, section, label] = sum(values) / len(values) if mean else sum(values)
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_overlap_counts_each_pair_once(spark):
    catalog = spark.createDataFrame([
        ("a", 1, ts("2023-11-20"), ts("2024-03-05")), ("b", 1, ts("2024-02-29 23:59:59"), ts("2024-03-01")),
        ("c", 1, ts("2024-04-01"), ts("2024-04-02")), ("d", 2, ts("2024-02-01"), ts("2024-02-02")), ("e", 1, None, ts("2024-02-02")),
    ], CATALOG)
    requests = spark.createDataFrame([(1, "2024-02"), (1, "2024"), (1, "2024"), (1, "soon")], "user_id long, period string")
    got = sorted((r.period, r.id) for r in h.uploads_in_period(catalog, requests).collect())
    assert got == [("2024", "a"), ("2024", "b"), ("2024", "c"), ("2024-02", "a"), ("2024-02", "b")]


def test_periods_and_latest_upload(spark):
    catalog = spark.createDataFrame([
        ("z", 1, ts("2023-12-31"), ts("2024-02-01")), ("a", 1, ts("2024-01-01"), ts("2024-02-01")), ("b", 2, None, None),
    ], CATALOG)
    rows = h.user_periods(catalog).collect()
    assert len(rows) == 1
    assert rows[0].periods == ["2024-02", "2024-01", "2023-12"] and rows[0].years == ["2024", "2023"]
    assert (rows[0].latest_period, rows[0].latest_upload_id) == ("2024-02", "a")


def test_comparison_needs_the_period_before(spark):
    totals = spark.createDataFrame(
        [(1, "2024-01", 0.0, 0.0), (1, "2024-02", 5.0, 35.0), (1, "2024-04", 6.0, 42.0), (1, "2024", 11.0, 77.0), (1, "2023", 22.0, 154.0)],
        "user_id long, period string, consumption_kwh double, cost double")
    got = {r.period: r for r in h.period_comparison(totals).collect()}
    assert got["2024-02"].cost_difference == 35.0 and got["2024-02"].cost_change_percent == 0
    assert got["2024-04"].previous_period is None and got["2024-04"].cost_change_percent is None
    assert got["2024"].cost_change_percent == -50


def test_cost_average_counts_listed_months_without_data(spark):
    catalog = spark.createDataFrame([("a", 1, ts("2024-01-01"), ts("2024-04-30"))], CATALOG)
    totals = spark.createDataFrame([(1, "2024-01", 10.0, 70.0), (1, "2024-03", 10.0, 70.0)],
                                   "user_id long, period string, consumption_kwh double, cost double")
    row = h.cost_analytics(totals, catalog).first()
    assert row.average_monthly_cost == 35.0 and row.months_analyzed == 4
    assert row.highest_cost_month == row.lowest_cost_month == "2024-03"


def test_year_without_data_falls_back_to_the_latest_period(spark):
    totals = spark.createDataFrame([(1, "2024-01", 10.0, 70.0), (1, "2024-03", 4.0, 28.0), (1, "2024", 14.0, 98.0)],
                                   "user_id long, period string, consumption_kwh double, cost double")
    latest = spark.createDataFrame([(1, "2024-03")], "user_id long, latest_period string")
    asked = spark.createDataFrame([(1, "2020"), (1, "2024")], "user_id long, period string")
    got = h.dashboard_year(totals, latest, asked).collect()
    assert sorted((r.asked_period, r.period, r.month, r.months_with_data) for r in got) == [
        ("2020", "2024-03", "2024-03", 1), ("2024", "2024", "2024-01", 2), ("2024", "2024", "2024-03", 2)]


def test_one_bill_per_month(spark):
    bills = spark.createDataFrame([(1, "May 2024")], "user_id long, bill_date string")
    incoming = spark.createDataFrame([(1, "May 2024"), (1, "June 2024"), (2, "May 2024")], "user_id long, bill_date string")
    accepted, rejected = h.new_bills(incoming, bills)
    assert sorted(map(tuple, accepted.collect())) == [(1, "June 2024"), (2, "May 2024")]
    assert list(map(tuple, rejected.collect())) == [(1, "May 2024")]


def test_covered_months_without_readings_are_zero(spark):
    import datetime as dt

    stamp = dt.datetime
    catalog = spark.createDataFrame(
        [("u-1", "u", stamp(2024, 1, 31, 5), stamp(2024, 4, 1, 7))], "id string, user_id string, start_timestamp timestamp, end_timestamp timestamp")
    merged = spark.createDataFrame([("u", stamp(2024, 1, 31, 5), 2.0), ("u", stamp(2024, 4, 1, 7), 3.0)], "user_id string, ts timestamp, energy_kwh double")
    totals = h.period_totals(merged, catalog)
    assert {r.period: r.consumption_kwh for r in totals.collect()} == {"2024-01": 2.0, "2024-02": 0.0, "2024-03": 0.0, "2024-04": 3.0, "2024": 5.0}
    april = h.period_comparison(totals).filter("period = '2024-04'").first()
    assert (april.previous_period, april.cost_difference, april.cost_change_percent) == ("2024-03", 21.0, 0.0)
    costs = h.cost_analytics(totals, catalog).first()
    assert (costs.lowest_cost, costs.lowest_cost_month, costs.months_analyzed) == (0.0, "2024-03", 4)


def test_period_totals_move_months_once_and_as_numbers(spark):
    catalog = spark.createDataFrame([("a", 1, ts("2023-11-05"), ts("2024-02-03")), ("b", 2, ts("0999-12-31"), ts("0999-12-31"))], CATALOG)
    merged = spark.createDataFrame([(1, ts("2023-12-01"), 2.0), (1, ts("2024-01-31"), 3.0), (1, ts("2024-01-01"), 0.5), (1, None, 4.0)],
                                   "user_id long, ts timestamp, energy_kwh double")
    totals = h.period_totals(merged, catalog, rate=2.0)
    want = {(1, "2023-11"): 0.0, (1, "2023-12"): 2.0, (1, "2024-01"): 3.5, (1, "2024-02"): 0.0, (1, "2023"): 2.0, (1, "2024"): 3.5, (2, "0999-12"): 0.0,
            (2, "0999"): 0.0, (1, None): 8.0}
    assert {(r.user_id, r.period): r.consumption_kwh for r in totals.collect()} == want
    assert all(r.cost == 2 * r.consumption_kwh for r in totals.collect())
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and "period" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
