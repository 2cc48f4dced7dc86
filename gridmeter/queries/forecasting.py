from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.operators import boosting
from gridmeter.operators import features as f
from gridmeter.operators import forecast as fc
from gridmeter.operators.arlikelihood import seasonal_ar_likelihood
from gridmeter.operators.boosting import BoostedTrees
from gridmeter.operators.forest import train_forest
from gridmeter.operators.quality import null_counts
from gridmeter.operators.split import chronological_split, tail_per_series, with_target
from gridmeter.queries.registry import Tables, query
from gridmeter.queries.windows import BASIC_SQL, SPLIT_SQL, split_rows
from gridmeter.session import cut_lineage, models_folder

COVARIATES = ["total_k", "avg_k"]

AR_SQL = SPLIT_SQL.rstrip() + """,
lagged AS (SELECT series_id, ts, energy_kwh AS y, lag(energy_kwh, 1) OVER w AS a, lag(energy_kwh, 24) OVER w AS b, lag(energy_kwh, 25) OVER w AS c,
    row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
fitted AS (SELECT l.*, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rank FROM lagged l JOIN split s USING (series_id, ts) WHERE s.split = 'train'),
gram AS (SELECT series_id, count(*) AS n_rows, sum(y * a) AS ya, sum(y * b) AS yb, sum(y * c) AS yc, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac,
    sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM fitted WHERE rank <= 336 AND y + a + b + c IS NOT NULL GROUP BY 1),
params AS (WITH RECURSIVE r AS (
  SELECT series_id, 0 AS i, 0.0::DOUBLE AS phi, 0.0::DOUBLE AS seasonal FROM gram
  UNION ALL
  SELECT series_id, i + 1, phi, (yb - phi * (yc + ab) + phi * phi * ac) / (bb - 2 * phi * bc + phi * phi * cc) FROM (
    SELECT g.*, r.i, (ya - r.seasonal * (yc + ab) + r.seasonal * r.seasonal * bc) / (aa - 2 * r.seasonal * ac + r.seasonal * r.seasonal * cc) AS phi
    FROM r JOIN gram g USING (series_id) WHERE r.i < 200))
  SELECT g.series_id, n_rows, phi, seasonal FROM r JOIN gram g USING (series_id) WHERE i = 200)
"""


def _ar_part(t: Tables, part: str, lags: list[int] = fc.AR_LAGS) -> DataFrame:
    """Rows of one part of the chronological split."""
    split = split_rows(t).filter(F.col("split") == part).select("series_id", "ts")
    rows = f.with_lags(t.clean().select("series_id", "ts", "energy_kwh"), lags)
    return rows.join(split, ["series_id", "ts"], "left_semi")


def evaluated(t: Tables) -> DataFrame:
    """Predictions of the test hours: naive and seasonal AR, both horizons."""
    rows = cut_lineage(_ar_part(t, "test", [*fc.AR_LAGS, 48]))
    params = cut_lineage(_ar_params(t))
    return fc.naive(rows).unionByName(fc.seasonal_ar_predict(rows, params)).unionByName(fc.seasonal_ar_day_ahead(rows, params))


EVALUATED_SQL = AR_SQL + """
, kept AS (SELECT l.*, lag(y, 48) OVER (PARTITION BY series_id ORDER BY ts) AS e FROM lagged l),
tested AS (SELECT k.*, p.phi, p.seasonal FROM kept k JOIN split s USING (series_id, ts) LEFT JOIN params p USING (series_id) WHERE s.split = 'test'),
models AS (SELECT * FROM (
  SELECT series_id, ts, 1 AS horizon, y AS actual, a AS predicted, 'Naive' AS model FROM tested UNION ALL
  SELECT series_id, ts, 24, y, b, 'Naive' FROM tested UNION ALL
  SELECT series_id, ts, 1, y, phi * a + seasonal * b - phi * seasonal * c, 'SARIMA' FROM tested UNION ALL
  SELECT series_id, ts, 24, y, seasonal * b + phi ** 24 * (b - seasonal * e), 'SARIMA' FROM tested)
  WHERE actual IS NOT NULL AND predicted IS NOT NULL)
"""


def _ar_params(t: Tables) -> DataFrame:
    """Fitted on the end of the training part; validation and test hours stay unseen."""
    return fc.seasonal_ar_fit(tail_per_series(_ar_part(t, "train"), fc.AR_TRAINING_ROWS))


@query("m2_seasonal_ar_fit", needs="clean", doubles="phi seasonal", sql=AR_SQL + "SELECT * FROM params")
def _(t: Tables) -> DataFrame:
    return _ar_params(t)


@query("m2_seasonal_ar_predict", needs="clean", digits=6, doubles="actual predicted", sql=AR_SQL + """
SELECT series_id, ts, y AS actual, phi * a + seasonal * b - phi * seasonal * c AS predicted, 1 AS horizon, 'SARIMA' AS model
FROM lagged JOIN params USING (series_id) JOIN split s USING (series_id, ts) WHERE s.split = 'test'""")
def _(t: Tables) -> DataFrame:
    return fc.seasonal_ar_predict(_ar_part(t, "test"), _ar_params(t))


@query("m2_seasonal_ar_forecast", needs="clean", digits=6, doubles="predicted", sql=AR_SQL + """
, tail AS (SELECT series_id, 26 - back AS pos, y, ts FROM lagged WHERE back <= 25),
start AS (SELECT series_id, list(y ORDER BY pos) AS vals, max(ts) AS last_ts FROM tail GROUP BY 1),
path AS (WITH RECURSIVE r AS (
  SELECT series_id, 0 AS i, vals, last_ts FROM start
  UNION ALL
  SELECT r.series_id, i + 1, list_append(vals, phi * vals[-1] + seasonal * vals[-24] - phi * seasonal * vals[-25]), last_ts FROM r JOIN params p
    ON p.series_id = r.series_id WHERE i < 24)
  SELECT series_id, last_ts + i * INTERVAL 1 HOUR AS ts, vals[-1] AS predicted FROM r WHERE i > 0)
SELECT *, 24 AS horizon, 'SARIMA_24h' AS model FROM path""")
def _(t: Tables) -> DataFrame:
    return fc.seasonal_ar_forecast(t.clean(), _ar_params(t))


def _ar_likelihood(t: Tables) -> DataFrame:
    return seasonal_ar_likelihood(_ar_part(t, "train"))


@query("m2_likelihood_fit", digits=4)
def _(t: Tables) -> DataFrame:
    return _ar_likelihood(t)


@query("m2_likelihood_predict", digits=4)
def _(t: Tables) -> DataFrame:
    params = cut_lineage(_ar_likelihood(t))
    return fc.seasonal_ar_predict(_ar_part(t, "test"), params).join(params.select("series_id", "status"), "series_id")


def training_rows(t: Tables) -> tuple[DataFrame, list[str]]:
    """Basic features labelled by chronological split, and the columns a model may use."""
    split = cut_lineage(chronological_split(t.features()))
    return split, f.feature_columns(split, [*COVARIATES, "pos", "split"])


@query("m5_feature_columns", needs="p90", sql=BASIC_SQL + """
, kept AS (SELECT * FROM basic WHERE lag_168 IS NOT NULL AND energy_kwh IS NOT NULL AND total_k IS NOT NULL AND
  lag_1 + lag_3 + lag_6 + lag_12 + lag_24 + lag_48 + lag_72 IS NOT NULL)
SELECT series_id, column_name, count(*) FILTER (v IS NULL) AS null_count FROM (
  UNPIVOT (SELECT series_id, CAST(COLUMNS(* EXCLUDE (series_id, ts, energy_kwh, total_k, avg_k, is_long_gap, is_energy_outlier, p90)) AS DOUBLE) FROM kept)
  ON COLUMNS(* EXCLUDE (series_id)) INTO NAME column_name VALUE v) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.features()
    return null_counts(rows, f.feature_columns(rows, COVARIATES))


@query("m3_random_forest")
def _(t: Tables) -> DataFrame:
    split, cols = training_rows(t)
    model = train_forest(split.filter("split = 'train'"), cols)
    return fc.predict(model, split.filter("split = 'test'"), 1, "RandomForest")


@query("m4_boosted_trees")
def _(t: Tables) -> DataFrame:
    split, cols = training_rows(t)
    model = fc.train_gbt(split.filter("split = 'train'"), cols)
    return fc.predict(model, split.filter("split = 'test'"), 1, "GBT")


@query("m6_recursive_forecast")
def _(t: Tables) -> DataFrame:
    split, cols = training_rows(t)
    train = split.filter("split = 'train'")
    return fc.recursive_evaluation({"RandomForest": fc.train_rf(train, cols), "GBT": fc.train_gbt(train, cols)}, t.clean())


def advanced_rows(t: Tables) -> tuple[DataFrame, list[str]]:
    """Advanced features of the hours of the basic feature table, holes filled with the last known value or zero, split as that table is."""
    clean = t.clean().select("series_id", "ts", "energy_kwh")
    keys = cut_lineage(chronological_split(t.features()).select("series_id", "ts", "split"))
    rows = f.locf_zero(f.align_to(keys.select("series_id", "ts"), f.advanced_features(clean)))
    rows = cut_lineage(rows.join(keys, ["series_id", "ts"]))
    order = Window.partitionBy("series_id").orderBy("ts")
    return rows.withColumn("pos", F.row_number().over(order)), f.feature_columns(rows, ["split"])


def tuned(t: Tables, horizon: int) -> tuple[BoostedTrees, dict, DataFrame]:
    """The tuned model of a horizon with its manifest, and its table; fitted once for a table and its settings, and kept.

    It predicts the row's own hour, or for the next day the hour 23 rows ahead.
    """
    rows, cols = advanced_rows(t)
    target, grid = "energy_kwh", fc.GRID_1H
    if horizon == 24:
        rows, target, grid = cut_lineage(with_target(rows)), "target", fc.GRID_24H
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")

    def fit() -> tuple[BoostedTrees, dict]:
        model, told = boosting.tune(train, validation, cols, grid, target)
        p90 = train.agg(F.percentile_approx("energy_kwh", 0.9, 10_000)).first()[0]
        return model, {"horizon": horizon, "p90": p90, "settings": told}

    told = repr((horizon, cols, grid, boosting.ROUNDS, boosting.PATIENCE, boosting.BINS))
    key = f"tuned-{horizon}h-{boosting.table_hash(train.unionByName(validation))}-{zlib.crc32(told.encode()):08x}"
    model, manifest = boosting.kept_model(t.spark, models_folder(t.spark), key, fit)
    return model, manifest, rows


@query("m7_tuned_boosted_trees")
def _(t: Tables) -> DataFrame:
    model, _, rows = tuned(t, 24)
    return fc.predict(model, rows.filter("split = 'test'"), 24, "GBT-24H", actual="target")


@query("m7_tuned_next_hour")
def _(t: Tables) -> DataFrame:
    model, _, rows = tuned(t, 1)
    return fc.predict(model, rows.filter("split = 'test'"), 1, "GBT-1H")


@query("m7_tuning_report")
def _(t: Tables) -> DataFrame:
    told = [(h, i, s["eta"], s["depth"], s["rounds_run"], s["rounds_kept"], s["validation_mae"])
            for h in (1, 24) for i, s in enumerate(tuned(t, h)[1]["settings"])]
    return t.spark.createDataFrame(told, "horizon int, setting int, eta double, depth int, rounds_run int, rounds_kept int, validation_mae double")


@query("m11_feature_importance")
def _(t: Tables) -> DataFrame:
    return tuned(t, 1)[0].importance(t.spark)


@query("m12_saved_model")
def _(t: Tables) -> DataFrame:
    tuned(t, 1)
    model, manifest, rows = tuned(t, 1)  # read back
    return fc.predict(model, rows.filter("split = 'test'"), 1, "GBT-1H").withColumn("threshold", F.lit(manifest["p90"]))


FUTURE_SQL = """
, extended AS (SELECT series_id, ts, energy_kwh FROM clean UNION ALL SELECT series_id, max(ts) + INTERVAL 1 HOUR, NULL FROM clean GROUP BY 1),
f AS (SELECT series_id, ts, lag(energy_kwh, 1) OVER w AS lag_1, lag(energy_kwh, 24) OVER w AS lag_24, lag(energy_kwh, 168) OVER w AS lag_168,
  row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM extended WINDOW w AS (PARTITION BY series_id ORDER BY ts))
"""


@query("m8_next_hour_rows", needs="clean", doubles="lag_1 lag_24 lag_168", sql=FUTURE_SQL + """
SELECT series_id, ts, lag_1, lag_24, lag_168 FROM f WHERE back = 1""")
def _(t: Tables) -> DataFrame:
    return fc.next_hour_rows(t.clean()).select("series_id", "ts", "lag_1", "lag_24", "lag_168")


@query("m9_next_day_rows", needs="clean", doubles="lag_1 lag_24 lag_168", sql=FUTURE_SQL + """
SELECT series_id, ts, ts + INTERVAL 23 HOUR AS target_ts, lag_1, lag_24, lag_168 FROM f WHERE back <= 24""")
def _(t: Tables) -> DataFrame:
    return fc.next_day_rows(t.clean()).select("series_id", "ts", "target_ts", "lag_1", "lag_24", "lag_168")


@query("m8_predict_next_hour")
def _(t: Tables) -> DataFrame:
    return fc.predict_next_hour(t.clean(), tuned(t, 1)[0])


@query("m9_predict_next_day")
def _(t: Tables) -> DataFrame:
    return fc.predict_next_day(t.clean(), tuned(t, 24)[0])


@query("m10_forecast_households")
def _(t: Tables) -> DataFrame:
    return fc.forecast_households(t.zero_filled(), tuned(t, 24)[0], 24)
