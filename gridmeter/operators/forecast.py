"""Forecasts: naive, seasonal autoregression, Spark ML tree ensembles, recursive and direct horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.calendar import with_cyclical, with_feature_calendar
from gridmeter.functions.scalars import flat_cost, from_log, to_log
from gridmeter.operators.boosting import BoostConfig, BoostedTrees, with_prediction
from gridmeter.operators.features import BASIC_LAGS, BASIC_ROLLING, HISTORY, end_features, feature_columns, series_ends, with_trend
from gridmeter.operators.quality import MIN_HOURLY_HISTORY, NEXT_DAY_EXTRA_HOURS, with_eligibility
from gridmeter.operators.stats import percentiles
from gridmeter.session import cut_lineage

S, TS, E = "series_id", "ts", "energy_kwh"
PREDICTION_COLUMNS = [S, TS, "actual", "predicted", "horizon", "model"]


# --- naive -----------------------------------------------------------------------------------------------------
def naive(features: DataFrame) -> DataFrame:
    """Last hour for the next hour, same hour of yesterday for the next day; one pass, two rows per feature row."""
    variants = F.array(
        F.struct(F.col("lag_1").alias("predicted"), F.lit(1).alias("horizon"), F.lit("Naive_1h").alias("model")),
        F.struct(F.col("lag_24").alias("predicted"), F.lit(24).alias("horizon"), F.lit("Naive_24h").alias("model")),
    )
    return features.select(S, TS, F.col(E).alias("actual"), F.explode(variants).alias("_v")).select(
        S, TS, "actual", "_v.predicted", "_v.horizon", "_v.model"
    )


# --- seasonal autoregression (1,0,0)(1,0,0)[24] without mean ------------------------------------------------------
AR_LAGS = [1, 24, 25]
AR_TRAINING_ROWS = 336
AR_ITERATIONS = 200


def seasonal_ar_fit(rows: DataFrame) -> DataFrame:
    """Conditional least squares of y = phi*y[1] + Phi*y[24] - phi*Phi*y[25] per series.

    The data enter only through sums of products, so one partial-and-final aggregate serves any number of series; the
    two parameters are then improved in turn, each by its closed form.
    """
    cols = [E, *[f"lag_{k}" for k in AR_LAGS]]
    known = rows.dropna(subset=cols)
    short = dict(zip(cols, ("y", "a", "b", "c")))
    sums = [
        F.sum(F.col(u) * F.col(v)).alias(short[u] + short[v])
        for i, u in enumerate(cols) for v in cols[i:]
    ]
    gram = known.groupBy(S).agg(F.count("*").alias("n_rows"), *sums)

    def quotient(num: Column, den: Column) -> Column:
        return F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0))

    def improve(state: Column, _: Column) -> Column:
        g = F.col
        big = state["seasonal"]
        phi = quotient(
            g("ya") - big * (g("yc") + g("ab")) + big * big * g("bc"),
            g("aa") - 2 * big * g("ac") + big * big * g("cc"),
        )
        seasonal = quotient(
            g("yb") - phi * (g("yc") + g("ab")) + phi * phi * g("ac"),
            g("bb") - 2 * phi * g("bc") + phi * phi * g("cc"),
        )
        return F.struct(phi.alias("phi"), seasonal.alias("seasonal"))

    start = F.struct(F.lit(0.0).alias("phi"), F.lit(0.0).alias("seasonal"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(AR_ITERATIONS)), start, improve)
    return gram.withColumn("_p", fitted).select(S, "n_rows", "_p.phi", "_p.seasonal")


def seasonal_ar_predict(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One-step predictions with fixed parameters (columns phi and seasonal per series)."""
    phi, seasonal = F.col("phi"), F.col("seasonal")
    step = phi * F.col("lag_1") + seasonal * F.col("lag_24") - phi * seasonal * F.col("lag_25")
    return rows.join(params.select(S, "phi", "seasonal"), S).select(
        S, TS, F.col(E).alias("actual"), step.alias("predicted"), F.lit(1).alias("horizon"), F.lit("SARIMA").alias("model"),
    )


def seasonal_ar_day_ahead(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Predictions made 24 hours before, without a recursion: y - Phi*y[24] is a plain AR(1), which fades by phi^24 in a day."""
    phi, seasonal = F.col("phi"), F.col("seasonal")
    day = F.col("lag_24")
    faded = F.pow(phi, F.lit(24.0)) * (day - seasonal * F.col("lag_48"))
    return rows.join(params.select(S, "phi", "seasonal"), S).select(
        S, TS, F.col(E).alias("actual"), (seasonal * day + faded).alias("predicted"), F.lit(24).alias("horizon"),
        F.lit("SARIMA_24h").alias("model"),
    )


def seasonal_ar_forecast(history: DataFrame, params: DataFrame, steps: int = 24) -> DataFrame:
    """Forecast `steps` hours past the end of each series from its last 25 values."""
    tail = _last_values(history, 25)
    phi, seasonal = F.col("phi"), F.col("seasonal")

    def extend(values: Column, _: Column) -> Column:
        following = (
            phi * F.element_at(values, -1) + seasonal * F.element_at(values, -24)
            - phi * seasonal * F.element_at(values, -25)
        )
        return F.concat(values, F.array(following))

    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("values"), extend), 26, steps)
    ready = tail.filter(F.size("values") == 25).join(params.select(S, "phi", "seasonal"), S)
    return ready.select(S, "last_ts", F.posexplode(path).alias("_i", "predicted")).select(
        S, F.timestamp_seconds(F.unix_timestamp("last_ts") + 3600 * (F.col("_i") + 1)).alias(TS), "predicted",
        F.lit(24).alias("horizon"), F.lit("SARIMA_24h").alias("model"),
    )


def _last_values(history: DataFrame, n: int) -> DataFrame:
    """Last `n` values of each series as an array in time order; a bounded array per series."""
    rank = F.row_number().over(Window.partitionBy(S).orderBy(F.desc(TS)))
    tail = history.select(S, TS, E).withColumn("_rank", rank).filter(F.col("_rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct(TS, E)))
    return tail.groupBy(S).agg(ordered.alias("_rows"), F.max(TS).alias("last_ts")).select(
        S, "last_ts", F.transform("_rows", lambda r: r[E]).alias("values")
    )


# --- tree ensembles ----------------------------------------------------------------------------------------------
def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="error").transform(df)


def _fit(regressor, df: DataFrame, cols: Sequence[str]) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="error")
    rows = assembler.transform(df).select("features", regressor.getLabelCol()).persist()
    model = regressor.fit(rows)
    rows.unpersist()
    return PipelineModel(stages=[assembler, model])


def train_rf(train: DataFrame, cols: Sequence[str], trees: int = 50, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Random forest on the pooled series."""
    return _fit(RandomForestRegressor(labelCol=E, numTrees=trees, maxDepth=depth, seed=seed), train, cols)


def train_gbt(train: DataFrame, cols: Sequence[str], rounds: int = 100, eta: float = 0.1, depth: int = 6) -> PipelineModel:
    """Boosted trees without tuning."""
    return _fit(GBTRegressor(labelCol=E, maxIter=rounds, stepSize=eta, maxDepth=depth, seed=42), train, cols)


# The searched settings of the next-hour and the next-day model.
GRID_1H = [
    BoostConfig(0.02, 6, 3, 0.80, 0.80, 0.0, 0.10, 1.0),
    BoostConfig(0.01, 5, 5, 0.85, 0.75, 0.1, 0.05, 2.0),
    BoostConfig(0.03, 7, 3, 0.75, 0.85, 0.0, 0.00, 0.5),
]
GRID_24H = [
    BoostConfig(0.01, 6, 5, 0.80, 0.80, 0.1, 0.10, 2.0),
    BoostConfig(0.02, 5, 3, 0.85, 0.75, 0.0, 0.05, 1.0),
]


def tune_gbt(
    train: DataFrame, validation: DataFrame, cols: Sequence[str], grid: Sequence[BoostConfig] = tuple(GRID_1H),
    target: str = E, rounds: int = 2000,
) -> tuple[PipelineModel, list[float]]:
    """Boosted trees of Spark ML on log(1 + kWh) with early stopping; the setting with the lowest validation MAE in kWh wins.

    Spark ML knows no penalties on leaves and stops at the first small gain; `boosting.tune` has both, and patience.
    Returns the model and the validation error of every setting. Only those error numbers reach the driver.
    """
    tagged = train.withColumn("_validation", F.lit(False)).unionByName(validation.withColumn("_validation", F.lit(True)))
    rows = assemble(tagged.withColumn("_label", to_log(F.col(target))), cols).select("features", "_label", "_validation", target)
    rows = rows.persist()
    held_out = rows.filter("_validation")
    best, best_error, errors = None, None, []
    for config in grid:
        regressor = GBTRegressor(
            labelCol="_label", maxIter=rounds, stepSize=config.eta, maxDepth=config.depth, minInstancesPerNode=config.min_rows,
            subsamplingRate=config.subsample, featureSubsetStrategy=str(config.column_share), minInfoGain=config.min_gain,
            validationIndicatorCol="_validation", validationTol=1e-4, seed=42,
        )
        model = regressor.fit(rows)
        error = model.transform(held_out).agg(F.avg(F.abs(F.col(target) - from_log(F.col("prediction"))))).first()[0]
        errors.append(error)
        if best_error is None or error < best_error:
            best, best_error = model, error
    rows.unpersist()
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="error")
    return PipelineModel(stages=[assembler, best]), errors


def _scored(model: PipelineModel | BoostedTrees, df: DataFrame, log_scale: bool = True) -> DataFrame:
    """Adds `_kwh`, the prediction in kWh; null where boosted trees lack a feature."""
    if isinstance(model, BoostedTrees):
        return with_prediction(df, model, "_kwh")
    value = F.col("prediction")
    return model.transform(df).withColumn("_kwh", from_log(value) if log_scale else value)


def predict(model: PipelineModel | BoostedTrees, df: DataFrame, horizon: int, name: str, log_scale: bool = False, actual: str = E) -> DataFrame:
    value = F.col("_kwh")
    return _scored(model, df, log_scale).select(
        S, TS, F.col(actual).alias("actual"), value.alias("predicted"), F.lit(horizon).alias("horizon"), F.lit(name).alias("model"),
    )


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Features ranked by gain; one number per feature."""
    gains = model.stages[-1].featureImportances.toArray().tolist()
    names = model.stages[0].getInputCols()
    ranked = sorted(zip(names, gains), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame([(i + 1, n, float(g)) for i, (n, g) in enumerate(ranked)], "rank int, feature string, gain double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- recursive forecast -------------------------------------------------------------------------------------------
def _mean(values: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n


def _next_basic_features(state: DataFrame) -> DataFrame:
    """Basic features of the next hour from the array of the last 168 values of a series."""
    v = F.col("values")
    cols = {f"lag_{k}": F.element_at(v, -k) for k in BASIC_LAGS}
    for w in BASIC_ROLLING:
        cols[f"rolling_mean_{w}"] = _mean(F.slice(v, HISTORY - w + 1, w), w)
    day = F.slice(v, HISTORY - 23, 24)
    mean = _mean(day, 24)
    squares = F.aggregate(day, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    cols |= {"rolling_std_24": F.sqrt(squares / 23), "rolling_min_24": F.array_min(day), "rolling_max_24": F.array_max(day)}
    return with_trend(with_cyclical(with_feature_calendar(state.withColumns(cols), TS)), "p90")


def recursive_forecast(
    model: PipelineModel, history: DataFrame, steps: int = 24, name: str = "RandomForest", p90: DataFrame | None = None,
) -> DataFrame:
    """Forecast hour by hour for all series at once, feeding each prediction back as the newest reading.

    A series is one row holding its last 168 values, so a step is a narrow projection and a model transform without any
    shuffle. The plan is cut every six steps.
    """
    thresholds = p90 if p90 is not None else percentiles(history, {"p90": 0.9})
    tail = _last_values(history, HISTORY).filter(F.size("values") == HISTORY)
    state = tail.join(thresholds, S).select(
        S, "p90", "values", (F.col("last_ts") + F.expr("INTERVAL 1 HOUR")).alias(TS), F.lit(0).alias("_step"),
        F.array().cast("array<double>").alias("_path"),
    )
    keep = [S, "p90", "values", TS, "_step", "_path"]
    for step in range(steps):
        predicted = model.transform(_next_basic_features(state))
        state = predicted.select(
            S, "p90",
            F.concat(F.slice("values", 2, HISTORY - 1), F.array("prediction")).alias("values"),
            (F.col(TS) + F.expr("INTERVAL 1 HOUR")).alias(TS),
            (F.col("_step") + 1).alias("_step"),
            F.concat("_path", F.array("prediction")).alias("_path"),
        ).select(*keep)
        if step % 6 == 5:
            state = cut_lineage(state)
    rows = state.select(S, TS, "_step", F.posexplode("_path").alias("_i", "predicted"))
    start = F.unix_timestamp(TS) - 3600 * F.col("_step")
    return rows.select(
        S, F.timestamp_seconds(start + 3600 * F.col("_i")).alias(TS), "predicted",
        F.lit(24).alias("horizon"), F.lit(name).alias("model"),
    )


# --- direct forecast for many households ---------------------------------------------------------------------------
def recursive_evaluation(models: dict[str, PipelineModel], history: DataFrame, steps: int = 24) -> DataFrame:
    """Recursive forecasts of the last `steps` hours of every series from the hours before them, beside what was read."""
    back = F.row_number().over(Window.partitionBy(S).orderBy(F.desc(TS)))
    rows = cut_lineage(history.select(S, TS, E).withColumn("_back", back))
    before, actual = rows.filter(F.col("_back") > steps).drop("_back"), rows.filter(F.col("_back") <= steps).select(S, TS, F.col(E).alias("actual"))
    paths = None
    for name, model in models.items():
        path = recursive_forecast(model, before, steps, name)
        paths = path if paths is None else paths.unionByName(path)
    return paths.join(actual, [S, TS], "left").select(*PREDICTION_COLUMNS)


def _ends(history: DataFrame, n: int) -> DataFrame:
    return series_ends(history.select(S, TS, E), n - 1)


def _last_feature_rows(ends: DataFrame, n: int) -> DataFrame:
    """Feature rows of the hour after the last one of each series, with unknown energy, and of the hours before it, `n` in all."""
    ahead = F.unix_timestamp(TS) - F.unix_timestamp("last_ts")
    return end_features(ends).filter((ahead <= 3600) & (ahead > 3600 - n * 3600))


def next_hour_rows(history: DataFrame) -> DataFrame:
    return _last_feature_rows(_ends(history, 1), 1)


def next_day_rows(history: DataFrame) -> DataFrame:
    """Feature rows behind the next 24 hours: hour k comes from the row 23 hours before it."""
    return _next_day_rows(_ends(history, 24))


def _next_day_rows(ends: DataFrame) -> DataFrame:
    rows = _last_feature_rows(ends, 24)
    return rows.withColumn("target_ts", F.timestamp_seconds(F.unix_timestamp(TS) + 3600 * NEXT_DAY_EXTRA_HOURS))


def predict_next_hour(history: DataFrame, model: PipelineModel | BoostedTrees) -> DataFrame:
    return _predict_ends(_ends(history, 1), model, 1)


def predict_next_day(history: DataFrame, model: PipelineModel | BoostedTrees) -> DataFrame:
    return _predict_ends(_ends(history, 24), model, 24)


def _predict_ends(ends: DataFrame, model: PipelineModel | BoostedTrees, horizon: int) -> DataFrame:
    rows, at = (_last_feature_rows(ends, 1), TS) if horizon == 1 else (_next_day_rows(ends), "target_ts")
    return _scored(model, rows).select(S, F.col(at).alias(TS), F.col("_kwh").alias("predicted"), F.lit(horizon).alias("horizon"))


def forecast_households(history: DataFrame, model: PipelineModel | BoostedTrees, horizon: int = 1) -> DataFrame:
    """Forecast every household that has enough history; the others come back with their status only.

    An hour whose features are not all known, as after a gap, has the status incomplete_features and no prediction. All hours
    are read once: a household's length, threshold and features come from its row of `series_ends`.
    """
    ends = cut_lineage(with_eligibility(_ends(history, horizon), horizon).filter(F.col(S).isNotNull()))
    forecast = _predict_ends(ends.filter(F.col("status") == "complete"), model, horizon)
    priced = forecast.withColumn("estimated_cost", flat_cost(F.col("predicted")) if horizon == 24 else F.lit(None).cast("double"))
    households = ends.select(S, "horizon", "status", "required_hours", "available_hours", "threshold")
    return households.join(priced.drop("horizon"), S, "left").select(
        S, "horizon", F.when(F.col(TS).isNotNull() & F.col("predicted").isNull(), "incomplete_features").otherwise(F.col("status")).alias("status"),
        "required_hours", "available_hours", TS, "predicted", "estimated_cost",
        "threshold", F.lit("User Dataset Threshold").alias("threshold_type"),
    )


__all__ = [
    "BoostConfig", "GRID_1H", "GRID_24H", "MIN_HOURLY_HISTORY", "assemble", "feature_columns", "feature_importance",
    "forecast_households", "load_model", "naive", "next_day_rows", "next_hour_rows", "predict", "predict_next_day",
    "predict_next_hour", "recursive_evaluation", "recursive_forecast", "save_model", "seasonal_ar_fit", "seasonal_ar_forecast",
    "seasonal_ar_predict", "train_gbt", "train_rf", "tune_gbt",
]
