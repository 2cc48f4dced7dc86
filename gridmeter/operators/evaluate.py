"""Forecast evaluation: error metrics, peak classification, comparison with the naive baseline, model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmeter.operators.stats import range_histogram

S, TS = "series_id", "ts"
KEYS = [S, "model", "horizon"]

# Fixed values of the published metrics.
MAPE_EPS = 1e-8
EXTENDED_EPS = 1e-4
TOLERANCES = [5, 10, 15, 20, 25, 30, 40, 50]
BASELINE = "Naive"
COMPARED = ["mae", "rmse", "mape"]


def scored(pred: DataFrame) -> DataFrame:
    """Complete pairs only; the model name is the part before the first underscore."""
    return pred.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull()).withColumn(
        "model", F.substring_index("model", "_", 1)
    )


def _base_metrics(eps: float) -> dict[str, Column]:
    a, p = F.col("actual"), F.col("predicted")
    error = a - p
    spread = F.var_pop(a) * F.count("*")
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.when(a > eps, F.abs(error / F.when(a > eps, a)))) * 100,
        "r2": 1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0)),
    }


def regression_metrics(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """MAE, RMSE, MAPE, R2 and count per model and horizon, in one aggregate."""
    metrics = _base_metrics(MAPE_EPS)
    return scored(pred).groupBy(*keys).agg(
        *[m.alias(n) for n, m in metrics.items()], F.count("*").alias("prediction_count")
    )


def _within(tolerance: int) -> Column:
    a, p = F.col("actual"), F.col("predicted")
    relative = F.abs(a - p) / F.greatest(F.abs(a), F.lit(EXTENDED_EPS))
    return F.avg((relative <= tolerance / 100).cast("double")) * 100


def full_metrics(pred: DataFrame, keys: Sequence[str] = KEYS, tolerances: Sequence[int] = TOLERANCES) -> DataFrame:
    """Extended metrics: symmetric MAPE and the share of predictions within relative tolerances."""
    a, p = F.col("actual"), F.col("predicted")
    size = F.abs(a) + F.abs(p)
    metrics = _base_metrics(EXTENDED_EPS)
    metrics["smape"] = F.avg(F.when(size > EXTENDED_EPS, 2 * F.abs(a - p) / F.when(size > EXTENDED_EPS, size))) * 100
    metrics |= {f"acc_{t}": _within(t) for t in tolerances}
    return scored(pred).groupBy(*keys).agg(*[m.alias(n) for n, m in metrics.items()], F.count("*").alias("n"))


def peak_metrics(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision, recall and F1 of hours above column `threshold` (strictly above, unlike the demand levels)."""
    real, called = F.col("actual") > F.col("threshold"), F.col("predicted") > F.col("threshold")
    counts = scored(pred).groupBy(*keys).agg(
        F.count_if(real & called).alias("true_positives"),
        F.count_if(~real & called).alias("false_positives"),
        F.count_if(real & ~called).alias("false_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(0.0))

    rates = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), both))


def improvement_pct(baseline: Column, model: Column) -> Column:
    """Improvement over a lower-is-better baseline in percent; 0 without a usable baseline."""
    usable = F.when(baseline != 0, baseline)
    return F.coalesce((usable - model) / usable * 100, F.lit(0.0))


def improvement_vs_naive(metrics: DataFrame, series: str = S) -> DataFrame:
    """Each model next to the naive one of the same horizon. Metric tables have one row per model and horizon."""
    naive = metrics.filter(F.col("model") == BASELINE).select(
        series, "horizon", *[F.col(c).alias(f"_naive_{c}") for c in COMPARED]
    )
    return metrics.join(naive, [series, "horizon"], "left").withColumns({
        f"{c}_improvement_vs_naive": improvement_pct(F.col(f"_naive_{c}"), F.col(c)) for c in COMPARED
    }).drop(*[f"_naive_{c}" for c in COMPARED])


def best_by(metrics: DataFrame, keys: Sequence[str], metric: str = "rmse", name: str = "model") -> DataFrame:
    """Row with the lowest metric per key; the first name wins a tie."""
    known = metrics.filter(F.col(metric).isNotNull())
    return known.groupBy(*keys).agg(
        F.min_by(name, F.struct(metric, name)).alias(f"best_{name}"), F.min(metric).alias(f"best_{metric}")
    )


def select_model(metrics: DataFrame, series: str = S) -> DataFrame:
    """Best model per horizon by RMSE; the 24-hour one is selected when there is one."""
    compared = improvement_vs_naive(metrics, series)
    rank = F.struct("rmse", "model")

    def at(h: int, value: Column) -> Column:
        return F.min_by(value, F.when((F.col("horizon") == h) & F.col("rmse").isNotNull(), rank))

    gain = F.struct("model", "mae_improvement_vs_naive")
    chosen = compared.groupBy(series).agg(
        at(1, F.col("model")).alias("best_horizon_1_model"),
        at(24, F.col("model")).alias("best_horizon_24_model"),
        at(24, gain).alias("_gain"),
    )
    return chosen.select(
        series, F.coalesce("best_horizon_24_model", "best_horizon_1_model").alias("selected_model"),
        "best_horizon_1_model", "best_horizon_24_model",
        F.coalesce(F.col("_gain.mae_improvement_vs_naive") > 0, F.lit(False)).alias("beats_naive"),
    )


def before_after(base: DataFrame, final: DataFrame, metrics: Sequence[str] = ("mae", "rmse", "r2"), series: str = S) -> DataFrame:
    """Original and optimised metrics of each horizon side by side."""
    left = base.select(series, "horizon", *[F.col(c).alias(f"original_{c}") for c in metrics])
    right = final.select(series, "horizon", *[F.col(c).alias(f"optimized_{c}") for c in metrics])
    return left.join(right, [series, "horizon"])


def residuals(pred: DataFrame) -> DataFrame:
    return scored(pred).withColumn("residual", F.col("actual") - F.col("predicted"))


def residual_histogram(pred: DataFrame, bins: int = 50) -> DataFrame:
    return range_histogram(residuals(pred), bins, "residual")
