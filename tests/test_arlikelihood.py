from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmeter.operators import features as f
from gridmeter.operators import forecast as fc
from gridmeter.operators.arlikelihood import fit_window, innovations, seasonal_ar_likelihood


def simulate(n, phi=0.5, big=0.4, seed=3):
    rng = np.random.default_rng(seed)
    y = np.zeros(n + 600)
    for i in range(25, len(y)):
        y[i] = phi * y[i - 1] + big * y[i - 24] - phi * big * y[i - 25] + rng.normal()
    return y[-n:]


def dense_log_likelihood(y, phi, big):
    """Density of the known hours under their whole covariance matrix, which is summed term by term from moving averages."""
    n = len(y)
    psi = np.zeros(6000)
    psi[0] = 1
    for i in range(1, len(psi)):
        psi[i] = phi * psi[i - 1] + (big * psi[i - 24] if i >= 24 else 0) - (phi * big * psi[i - 25] if i >= 25 else 0)
    gamma = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])
    known = np.flatnonzero(~np.isnan(y))
    cov = gamma[np.abs(known[:, None] - known[None, :])]
    x, squares, logs = y[known].copy(), 0.0, 0.0
    for k in range(len(x)):  # plain elimination
        pivot, column = cov[0, 0], cov[1:, 0] / cov[0, 0]
        squares, logs = squares + x[0] ** 2 / pivot, logs + np.log(pivot)
        x, cov = x[1:] - column * x[0], cov[1:, 1:] - column[:, None] * cov[0, 1:]
    n = len(known)
    return -0.5 * (n * np.log(2 * np.pi * squares / n) + logs + n)


def gaps(y):
    y = y.copy()
    y[[3, 40, 41, 42, 90]] = np.nan
    y[120:160] = np.nan
    return y


@pytest.mark.parametrize("change", [lambda y: y, gaps])
@pytest.mark.parametrize("phi, big", [(0.5, 0.4), (-0.3, 0.8), (0.0, 0.0)])
def test_innovations_give_the_dense_likelihood(change, phi, big):
    y = change(simulate(220))
    squares, logs = innovations(y, np.array([phi, 0.9]), np.array([big, 0.1]))
    n = np.count_nonzero(~np.isnan(y))
    for k, pair in enumerate([(phi, big), (0.9, 0.1)]):
        got = -0.5 * (n * np.log(2 * np.pi * squares[k] / n) + logs[k] + n)
        assert got == pytest.approx(dense_log_likelihood(y, *pair), abs=1e-6)


@pytest.mark.parametrize("change", [lambda y: y, gaps])
def test_fit_is_the_maximum_of_the_dense_likelihood(change):
    y = change(simulate(220))
    _, phi, big, _, likelihood, status = fit_window(y, 0.0, 0.0)
    assert status == "likelihood" and likelihood == pytest.approx(dense_log_likelihood(y, phi, big), abs=1e-6)
    for a, b in [(1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)]:
        assert dense_log_likelihood(y, phi + a, big + b) < likelihood


def test_windows_start_and_status(spark, hours):
    y = simulate(500)
    table = hours({"a": y.tolist(), "gaps": gaps(y).tolist(), "zero": [0.0] * 400, "short": y[:20].tolist(), "none": [None] * 30})
    rows = f.with_lags(table, fc.AR_LAGS)
    got = {r.series_id: r for r in seasonal_ar_likelihood(rows).collect()}
    again = {r.series_id: r for r in seasonal_ar_likelihood(rows.unionByName(rows).repartition(5)).collect()}
    assert set(got) == {"a", "gaps", "zero", "short"}  # no known hour, no row
    assert got["a"].n_known == 336 and got["a"].status == "likelihood"
    whole = fit_window(y[-336:], 0.0, 0.0)
    assert (got["a"].phi, got["a"].seasonal) == pytest.approx(whole[1:3], abs=1e-5)
    assert again["a"].phi == pytest.approx(got["a"].phi, abs=1e-5) and again["a"].n_known == 336
    assert got["zero"].status == got["short"].status == "least_squares" and got["zero"].sigma2 is None
    assert (got["zero"].phi, got["zero"].seasonal) == (0.0, 0.0)
    assert seasonal_ar_likelihood(rows.filter("false")).count() == 0


def test_null_hours_inside_the_window_are_skipped(hours):
    y = gaps(simulate(300))
    rows = f.with_lags(hours({"a": y.tolist()}), fc.AR_LAGS)
    fit = seasonal_ar_likelihood(rows).first()
    missing_rows = seasonal_ar_likelihood(rows.filter(F.col("energy_kwh").isNotNull())).first()
    assert fit.n_known == np.count_nonzero(~np.isnan(y)) and fit.status == "likelihood"
    assert missing_rows.log_likelihood == pytest.approx(fit.log_likelihood, abs=1e-6)
    assert fit.log_likelihood == pytest.approx(dense_log_likelihood(y, fit.phi, fit.seasonal), abs=1e-6)
