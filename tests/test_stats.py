from __future__ import annotations

import numpy as np
import pytest

from gridmeter.operators import stats
from gridmeter.operators.profiles import submeter_share, target_distribution
from gridmeter.operators.stats import corr_matrix, exact_percentiles, histogram


def test_exact_percentiles_of_skewed_groups(spark):
    """One key holds most rows, one value holds a third of them."""
    rng = np.random.default_rng(1)
    groups = {
        "hot": np.concatenate([rng.normal(size=20000).round(3), np.full(10000, 0.25)]),
        "small": np.array([1.0, 2.0, 4.0]), "one": np.array([7.0]), "equal": np.full(500, 3.0),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("small", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    ps = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", ps).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in ps.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), abs=1e-12)


def test_buckets_are_cut_until_they_are_small(spark, monkeypatch):
    """Thousands of different values, five to a bucket: several rounds give what one sort gives."""
    monkeypatch.setattr(stats, "BUCKET_VALUES", 5)
    rng = np.random.default_rng(2)
    groups = {"wide": np.concatenate([rng.normal(size=9000), np.full(4000, 0.5)]), "few": np.array([3.0, 1.0]), "same": np.full(50, 2.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    ps = {"p00": 0.0, "p37": 0.37, "p50": 0.5, "p99": 0.99}
    got = {r.k: r for r in stats.exact_percentiles(df, ["k"], "v", ps).collect()}
    for k, vs in groups.items():
        assert [got[k][name] for name in ps] == pytest.approx(np.quantile(vs, list(ps.values())), abs=1e-12)
    assert stats.exact_percentiles(df.filter("false"), ["k"], "v", ps).count() == 0


def test_sketches_merge_to_any_period(spark, hours):
    """A year of one series in daily sketches, a short one, and one without a known value."""
    rng = np.random.default_rng(5)
    values = np.round(rng.gamma(2, 1.5, 24 * 365), 3)
    table = hours({"a": values.tolist(), "short": [4.0, None, 1.0, 2.0], "none": [None] * 30})
    daily = stats.daily_sketches(table)
    assert daily.filter("series_id = 'a'").count() == 365 and daily.filter("series_id = 'none'").count() == 0
    ps = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r.series_id: r for r in stats.sketch_percentiles(daily, ["series_id"], ps).collect()}
    assert got["a"].n == len(values) and got["short"].n == 3 and got["short"].p50 == 2.0
    for name, p in ps.items():
        below, upto = np.mean(values < got["a"][name]), np.mean(values <= got["a"][name])
        assert below - stats.SKETCH_RANK_ERROR <= p <= upto + stats.SKETCH_RANK_ERROR
    few = stats.percentiles(table, ps, approx=True).filter("series_id = 'short'").first()
    assert (few.p10, few.p50, few.p99) == (1.0, 2.0, 4.0)


def test_correlation_with_a_constant_column_is_null(spark):
    rows = [("a", float(i), 1.0, float(-i) if i % 3 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id string, x double, c double, y double")
    got = {r.column_name: r for r in corr_matrix(df, ["x", "c", "y"]).collect()}
    assert got["x"].x == pytest.approx(1) and got["x"].y == pytest.approx(-1) and got["y"].x == pytest.approx(-1)
    assert got["x"].c is None and got["c"].c is None


def test_histogram_of_zeros(hours):
    bins = {r.bin_index: (r.bin_start, r.n) for r in histogram(hours({"a": [0, 0]})).collect()}
    assert bins[0] == (0.0, 2) and bins[1] == (1.0, 0) and len(bins) == 12


def test_histogram_keeps_the_maximum(hours):
    bins = {r.bin_index: r.n for r in histogram(hours({"a": [0, 6, 12]})).collect()}
    assert (bins[0], bins[6], bins[11]) == (1, 1, 1)


def test_skewness_is_adjusted(hours):
    x = np.array([1.0, 2.0, 2.0, 3.0, 9.0])
    n, d = len(x), x - x.mean()
    expected = np.sqrt(n * (n - 1)) / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5
    assert target_distribution(hours({"a": x.tolist() + [None]})).first().skewness == pytest.approx(expected)


def test_share_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0)], "series_id string, m1 double, m2 double")
    assert {r.relative_contribution for r in submeter_share(df, ["m1", "m2"]).collect()} == {0.0}
