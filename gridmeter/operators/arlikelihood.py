"""Exact Gaussian likelihood of the seasonal autoregression (1,0,0)(1,0,0)[24] without mean.

The window of one series is a bounded array (two weeks of hours), so Spark gathers the windows in one aggregate and every
task fits its own series, batch by batch. Unknown hours are skipped by the innovations recursion, not imputed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmeter.operators.chunks import hour_index
from gridmeter.operators.forecast import AR_LAGS, AR_TRAINING_ROWS, seasonal_ar_fit

S, TS, E = "series_id", "ts", "energy_kwh"
SEASON = 24
ORDER = SEASON + 1
ROUNDS = 60
STENCIL = 1e-3
EDGE = 6.0
SETTLED = 1e-9

FITTED = T.StructType([
    T.StructField("n_known", T.LongType()), T.StructField("phi", T.DoubleType()), T.StructField("seasonal", T.DoubleType()),
    T.StructField("sigma2", T.DoubleType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("status", T.StringType()),
])


def _step(a: np.ndarray, p: np.ndarray, phi: np.ndarray, big: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the last 25 values one hour on, for many parameter pairs at once."""
    both = phi * big

    def ahead(x: np.ndarray) -> np.ndarray:
        shape = (-1,) + (1,) * (x.ndim - 2)
        return phi.reshape(shape) * x[:, 0] + big.reshape(shape) * x[:, SEASON - 1] - both.reshape(shape) * x[:, SEASON]

    row = ahead(p)
    mean, cov = np.empty_like(a), np.empty_like(p)
    mean[:, 0], mean[:, 1:] = ahead(a), a[:, :-1]
    cov[:, 1:, 1:] = p[:, :-1, :-1]
    cov[:, 0, 1:] = cov[:, 1:, 0] = row[:, :-1]
    cov[:, 0, 0] = ahead(row) + 1
    return mean, cov


def _stationary(phi: np.ndarray, big: np.ndarray) -> np.ndarray:
    """Covariance of 25 successive values at unit noise: (phi^h + Phi phi^(24-h)) / ((1 - phi^24 Phi)(1 - phi^2)(1 - Phi^2))."""
    h = np.arange(ORDER)
    scale = (1 - phi**SEASON * big) * (1 - phi**2) * (1 - big**2)
    gamma = (phi[:, None] ** h + big[:, None] * phi[:, None] ** (SEASON - h)) / scale[:, None]
    return gamma[:, np.abs(h[:, None] - h[None, :])]


def innovations(y: np.ndarray, phi: np.ndarray, big: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sum of squared one-step errors and sum of log variances at unit noise, per parameter pair.

    After 25 known hours in a row the next error needs no covariance; the filter runs only at the start and behind unknown hours.
    """
    known = ~np.isnan(y)
    filled = np.where(known, y, 0.0)
    at = np.arange(len(y))
    last_unknown = np.maximum.accumulate(np.where(known, -1, at))
    settled = (at >= ORDER) & (at - 1 - np.concatenate(([-1], last_unknown[:-1])) >= ORDER)
    easy = at[settled & known]
    errors = (
        filled[easy] - phi[:, None] * filled[easy - 1] - big[:, None] * filled[easy - SEASON]
        + (phi * big)[:, None] * filled[easy - ORDER]
    )
    squares, logs = (errors**2).sum(axis=1), np.zeros(len(phi))
    a, p = np.zeros((len(phi), ORDER)), _stationary(phi, big)
    for t in at[~settled]:
        if t and settled[t - 1]:
            # The hour before is the first unknown one behind a stretch of known hours.
            a, p = np.tile(filled[t - 1 - ORDER:t - 1][::-1], (len(phi), 1)), np.zeros_like(p)
            a, p = _step(a, p, phi, big)
        if t:
            a, p = _step(a, p, phi, big)
        if known[t]:
            variance, error = p[:, 0, 0].copy(), y[t] - a[:, 0]
            gain = p[:, :, 0] / variance[:, None]
            squares += error**2 / variance
            logs += np.log(variance)
            a = a + gain * error[:, None]
            p = p - gain[:, :, None] * p[:, None, 0, :]
    return squares, logs


def _deviance(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Minus twice the log-likelihood without its constants, noise variance concentrated out; z are inverse hyperbolic tangents."""
    n = np.count_nonzero(~np.isnan(y))
    squares, logs = innovations(y, np.tanh(z[:, 0]), np.tanh(z[:, 1]))
    return n * np.log(squares / n) + logs


def fit_window(y: np.ndarray, phi: float, seasonal: float) -> tuple[int, float, float, float, float, str]:
    """Newton steps with halving from the least-squares fit; where they do not settle, the least-squares fit is returned."""
    n = int(np.count_nonzero(~np.isnan(y)))
    fallback = (n, phi, seasonal, None, None, "least_squares")
    if n <= ORDER or not np.nanmax(np.abs(y)) > 0:
        return fallback
    z = np.arctanh(np.clip([phi, seasonal], -0.98, 0.98))
    grid = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], dtype=float) * STENCIL
    halves = 0.5 ** np.arange(12)
    for _ in range(ROUNDS):
        f = _deviance(y, z + grid).reshape(3, 3)
        if not np.isfinite(f).all():
            return fallback
        slope = np.array([f[2, 1] - f[0, 1], f[1, 2] - f[1, 0]]) / (2 * STENCIL)
        cross = (f[2, 2] - f[2, 0] - f[0, 2] + f[0, 0]) / 4
        curve = np.array([[f[2, 1] - 2 * f[1, 1] + f[0, 1], cross], [cross, f[1, 2] - 2 * f[1, 1] + f[1, 0]]]) / STENCIL**2
        size, axes = np.linalg.eigh(curve)
        move = -axes @ ((axes.T @ slope) / np.maximum(np.abs(size), 1e-3))
        move /= max(1.0, float(np.linalg.norm(move)))
        tried = _deviance(y, z + halves[:, None] * move)
        best = int(np.nanargmin(tried)) if np.isfinite(tried).any() else 0
        gain = f[1, 1] - tried[best]
        if gain > 0:
            z = z + halves[best] * move
        if np.abs(z).max() > EDGE:
            return fallback
        if not gain > SETTLED:
            if np.linalg.norm(move) > 1e-3 or size.min() <= 0:
                return fallback
            break
    else:
        return fallback
    squares, logs = innovations(y, np.tanh(z[:1]), np.tanh(z[1:]))
    sigma2 = float(squares[0]) / n
    likelihood = -0.5 * (n * np.log(2 * np.pi * sigma2) + float(logs[0]) + n)
    return n, float(np.tanh(z[0])), float(np.tanh(z[1])), sigma2, likelihood, "likelihood"


def seasonal_ar_likelihood(rows: DataFrame, hours: int = AR_TRAINING_ROWS) -> DataFrame:
    """Maximum-likelihood parameters of each series on the last `hours` hours up to its last row.

    `rows` holds the energy and its lags 1, 24 and 25. Hours without a row, or with a null, are unknown. Returns n_rows (rows of
    the least-squares start), n_known, phi, seasonal, sigma2, log_likelihood and status: `likelihood`, or `least_squares` where
    no interior maximum was found, the window has 25 known hours or fewer, or holds only zeros; then sigma2 and
    log_likelihood are null and parameters are those of the least-squares fit. Repeated hours keep their smallest value.
    """
    index = rows.withColumn("_h", hour_index(TS))
    ends = index.groupBy(S).agg(F.max("_h").alias("_end"))
    recent = index.join(ends, S).filter(F.col("_h") > F.col("_end") - hours)
    start = seasonal_ar_fit(recent.select(S, E, *[f"lag_{k}" for k in AR_LAGS]))
    place = (F.col("_h") - F.col("_end") + hours - 1).cast("int")
    windows = recent.filter(F.col(E).isNotNull()).groupBy(S).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("i"), F.col(E).cast("double").alias("y")))).alias("_w")
    ).select(S, F.transform("_w", lambda w: w["i"]).alias("_i"), F.transform("_w", lambda w: w["y"]).alias("_y"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, values, phi, seasonal in zip(batch["_i"], batch["_y"], batch["phi"], batch["seasonal"]):
                y = np.full(hours, np.nan)
                # Rows are sorted by hour, then value: written backwards, the smallest value of an hour stays.
                y[np.asarray(i)[::-1]] = np.asarray(values, dtype=float)[::-1]
                out.append(fit_window(y[int(i[0]):], phi, seasonal))
            fitted = pd.DataFrame(out, columns=FITTED.names, index=batch.index)
            yield pd.concat([batch[[S, "n_rows"]], fitted], axis=1)

    joined = windows.join(start, S, "left").select(
        S, "_i", "_y", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
        F.coalesce("phi", F.lit(0.0)).alias("phi"), F.coalesce("seasonal", F.lit(0.0)).alias("seasonal"),
    )
    schema = T.StructType([joined.schema[S], joined.schema["n_rows"], *FITTED.fields])
    return joined.mapInPandas(fit, schema)
