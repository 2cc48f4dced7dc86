from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions.tariff import tou_period, tou_rate
from gridmeter.operators import advice, costs, shifting
from gridmeter.operators.evaluate import (
    full_metrics, peak_metrics, regression_metrics, residual_histogram, residuals, select_model,
)
from gridmeter.operators.stats import percentiles
from gridmeter.queries.forecasting import evaluated
from gridmeter.queries.joins import MODELS_SQL
from gridmeter.queries.registry import Tables, query


@query("m1_naive_forecasts", needs="naive", doubles="actual predicted", sql="SELECT * FROM naive")
def _(t: Tables) -> DataFrame:
    return t.predictions()


@query("m13_regression_metrics", needs="clean", digits=6, doubles="mae rmse mape r2", sql=MODELS_SQL + "SELECT * FROM metrics")
def _(t: Tables) -> DataFrame:
    return regression_metrics(evaluated(t))


TOLERANCES = [5, 10, 15, 20, 25, 30, 40, 50]


@query("m14_extended_metrics", needs="clean", digits=6, doubles="mae rmse mape r2 smape " + " ".join(f"acc_{x}" for x in TOLERANCES),
       sql=MODELS_SQL + """
SELECT series_id, model, horizon, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  avg(CASE WHEN actual > 1e-4 THEN abs((actual - predicted) / actual) END) * 100 AS mape,
  1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r2, count(*) AS n,
  avg(CASE WHEN abs(actual) + abs(predicted) > 1e-4 THEN 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100 AS smape, """
       + ", ".join(f"avg(CASE WHEN abs(actual - predicted) / greatest(abs(actual), 1e-4) <= {x} / 100.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS acc_{x}"
                   for x in TOLERANCES) + " FROM models GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return full_metrics(evaluated(t))


@query("m15_peak_classification", needs="clean p90", doubles="precision recall f1_score", sql=MODELS_SQL + """
, c AS (SELECT series_id, model, horizon, count(*) FILTER (actual > p90 AND predicted > p90) AS tp, count(*) FILTER (actual <= p90 AND predicted > p90) AS fp,
  count(*) FILTER (actual > p90 AND predicted <= p90) AS fn FROM models JOIN p90 USING (series_id) GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c)
SELECT series_id, model, horizon, tp AS true_positives, fp AS false_positives, fn AS false_negatives, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1_score FROM r""")
def _(t: Tables) -> DataFrame:
    threshold = percentiles(t.clean(), {"threshold": 0.9})
    return peak_metrics(evaluated(t).join(threshold, "series_id"))


@query("m16_model_selection", needs="clean", sql=MODELS_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY rmse, model) AS rn FROM metrics),
b AS (SELECT series_id, max(model) FILTER (horizon = 1) AS b1, max(model) FILTER (horizon = 24) AS b24, max(mae) FILTER (horizon = 24) AS mae24
      FROM r WHERE rn = 1 GROUP BY 1)
SELECT b.series_id, coalesce(b24, b1) AS selected_model, b1 AS best_horizon_1_model, b24 AS best_horizon_24_model,
       coalesce(n.mae > mae24, false) AS beats_naive
FROM b LEFT JOIN metrics n ON n.series_id = b.series_id AND n.model = 'Naive' AND n.horizon = 24""")
def _(t: Tables) -> DataFrame:
    return select_model(regression_metrics(evaluated(t)))


@query("m17_residuals", needs="scored", doubles="residual", sql="SELECT series_id, ts, model, horizon, actual - predicted AS residual FROM scored")
def _(t: Tables) -> DataFrame:
    return residuals(t.predictions()).select("series_id", "ts", "model", "horizon", "residual")


@query("m17_residual_histogram", needs="scored", digits=6, doubles="bin_start", sql="""
, h AS (SELECT * FROM scored WHERE horizon = 1),
w AS (SELECT series_id, min(actual - predicted) AS lo, (max(actual - predicted) - min(actual - predicted)) / 50 AS width FROM h GROUP BY 1),
b AS (SELECT series_id, least(49, CAST(floor((actual - predicted - lo) / width) AS INTEGER)) AS bin_index, count(*) AS n
      FROM h JOIN w USING (series_id) GROUP BY 1, 2)
SELECT e.series_id, e.bin_index, e.lo + e.bin_index * e.width AS bin_start, coalesce(b.n, 0) AS n
FROM (SELECT series_id, lo, width, CAST(unnest(range(50)) AS INTEGER) AS bin_index FROM w) e
LEFT JOIN b ON b.series_id = e.series_id AND b.bin_index = e.bin_index""")
def _(t: Tables) -> DataFrame:
    return residual_histogram(t.predictions().filter("horizon = 1"))


@query("g1_peak_forecast", needs="forecast", doubles="predicted_consumption threshold", sql="""
SELECT series_id, ts, predicted AS predicted_consumption, CASE WHEN predicted >= greatest(p99, threshold) THEN 'Critical'
       WHEN predicted >= threshold THEN 'High' ELSE 'Normal' END AS demand_level, predicted >= threshold AS is_peak, threshold
FROM forecast JOIN (SELECT series_id, quantile_cont(predicted, 0.99) AS p99 FROM forecast GROUP BY 1) USING (series_id)""")
def _(t: Tables) -> DataFrame:
    return costs.peak_forecast(t.forecast())


@query("g2_tou_cost", needs="priced", doubles="consumption_kwh simulated_cost", sql="""
SELECT series_id, ts, predicted AS consumption_kwh, tou_period, rate AS rate_per_kwh, predicted * rate AS simulated_cost FROM priced""")
def _(t: Tables) -> DataFrame:
    return costs.tou_cost(t.forecast())


# The greedy pairing as ranks, written for the two cheaper rates; no destination of these series is predicted at zero.
SHIFT_SQL = """
, src AS (SELECT * FROM priced WHERE predicted > threshold),
dst AS (SELECT *, row_number() OVER (PARTITION BY series_id, rate ORDER BY predicted, ts) AS rk FROM priced WHERE predicted < threshold AND tou_period <> 'peak'),
room AS (SELECT series_id, count(*) FILTER (rate = 3) AS n3 FROM dst GROUP BY 1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY predicted DESC, ts) AS rk FROM src WHERE rate > 3),
s6 AS (SELECT s.* EXCLUDE (rk), row_number() OVER (PARTITION BY series_id ORDER BY predicted DESC, ts) AS rk
       FROM s3 s JOIN room USING (series_id) WHERE s.rk > n3 AND rate > 6),
pairs AS (
  SELECT s.series_id, s.ts AS source_ts, s.predicted AS sp, s.threshold, s.rate AS sr, d.ts AS destination_ts, d.predicted AS dp, d.rate AS dr
  FROM s3 s JOIN dst d ON d.series_id = s.series_id AND d.rate = 3 AND d.rk = s.rk
  UNION ALL SELECT s.series_id, s.ts, s.predicted, s.threshold, s.rate, d.ts, d.predicted, d.rate
  FROM s6 s JOIN dst d ON d.series_id = s.series_id AND d.rate = 6 AND d.rk = s.rk),
fractions AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS fraction),
shifts AS (SELECT *, least(sp * fraction, sp - threshold, dp * fraction) AS amount FROM pairs, fractions)
"""


@query("g3_load_shifts", needs="priced", digits=6, doubles="source_predicted_kwh threshold destination_predicted_kwh shiftable_energy_kwh estimated_cost_before "
       "estimated_cost_after estimated_savings", sql=SHIFT_SQL + """
SELECT series_id, source_ts, sp AS source_predicted_kwh, threshold, sr AS source_rate, dr AS destination_rate, destination_ts,
       dp AS destination_predicted_kwh, amount AS shiftable_energy_kwh, amount * sr AS estimated_cost_before, amount * dr AS estimated_cost_after,
       amount * sr - amount * dr AS estimated_savings FROM shifts WHERE fraction = 0.2 AND amount > 0""")
def _(t: Tables) -> DataFrame:
    return shifting.load_shifts(t.forecast())


@query("g4_shift_sensitivity", needs="priced", digits=6, doubles="energy_shifted_kwh simulated_savings savings_percentage", sql=SHIFT_SQL + """
, base AS (SELECT series_id, sum(predicted * rate) AS baseline FROM priced GROUP BY 1)
SELECT b.series_id, f.fraction AS shiftable_fraction, coalesce(sum(amount), 0.0) AS energy_shifted_kwh, coalesce(sum(amount * (sr - dr)), 0.0) AS simulated_savings,
       coalesce(sum(amount * (sr - dr)), 0.0) / any_value(baseline) * 100 AS savings_percentage
FROM base b CROSS JOIN fractions f LEFT JOIN shifts s ON s.series_id = b.series_id AND s.fraction = f.fraction AND amount > 0 GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return shifting.shift_sensitivity(t.forecast())


DAILY = "baseline_cost optimized_simulated_cost estimated_savings savings_percentage energy_shifted"


@query("g5_daily_savings", needs="priced", digits=6, doubles=DAILY, sql=SHIFT_SQL + """
, d AS (SELECT series_id, CAST(ts AS DATE) AS date, sum(predicted * rate) AS baseline_cost FROM priced GROUP BY 1, 2),
s AS (SELECT series_id, CAST(source_ts AS DATE) AS date, sum(amount * (sr - dr)) AS saved, sum(amount) AS moved FROM shifts
      WHERE fraction = 0.2 AND amount > 0 GROUP BY 1, 2)
SELECT d.series_id, d.date, baseline_cost, baseline_cost - coalesce(saved, 0) AS optimized_simulated_cost, coalesce(saved, 0.0) AS estimated_savings,
       coalesce(saved, 0) / baseline_cost * 100 AS savings_percentage, coalesce(moved, 0.0) AS energy_shifted
FROM d LEFT JOIN s ON s.series_id = d.series_id AND s.date = d.date""")
def _(t: Tables) -> DataFrame:
    pred = t.forecast()
    return shifting.daily_savings(costs.tou_cost(pred), shifting.load_shifts(pred))


def user_forecast(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Zero-filled household history, and same-hour-yesterday predictions of its hours."""
    from gridmeter.operators.features import with_lags

    history = t.zero_filled()
    pred = with_lags(history, [24]).filter("lag_24 IS NOT NULL").select("series_id", "ts", F.col("lag_24").alias("predicted"))
    return history, pred.join(percentiles(history, {"threshold": 0.9}), "series_id")


USER_SQL = """
, uthr AS (SELECT series_id, quantile_cont(energy_kwh, 0.9) AS threshold, quantile_cont(energy_kwh, 0.99) AS p99h FROM ugrid GROUP BY 1),
ufc AS (SELECT series_id, ts, predicted, threshold FROM (
  SELECT series_id, ts, lag(energy_kwh, 24) OVER (PARTITION BY series_id ORDER BY ts) AS predicted FROM ugrid) JOIN uthr USING (series_id)
  WHERE predicted IS NOT NULL),
past AS (SELECT series_id, avg(energy_kwh) FILTER (dayofweek(ts) IN (0, 6)) AS we, avg(energy_kwh) FILTER (dayofweek(ts) NOT IN (0, 6)) AS wd,
  avg(energy_kwh) FILTER (hour(ts) < 6) AS night, avg(energy_kwh) AS overall FROM ugrid GROUP BY 1),
future AS (SELECT series_id, avg(predicted) FILTER (hour(ts) BETWEEN 17 AND 21) AS evening, count(*) FILTER (predicted >= threshold) AS peaks,
  max(threshold) AS threshold FROM ufc GROUP BY 1),
facts AS (SELECT * FROM past LEFT JOIN future USING (series_id))
"""


@query("g6_recommendations", needs="ugrid", sql=USER_SQL + """
SELECT series_id, 1 AS rule_order, 'Shift flexible loads away from the evening peak.' AS recommendation,
  'Forecasted evening demand meets or exceeds the high-demand threshold.' AS reason, 'High' AS priority,
  printf('Mean predicted evening demand = %.2f kWh', round(evening + 1e-9, 2)) AS supporting_metric FROM facts WHERE evening >= threshold
UNION ALL SELECT series_id, 2, 'Review appliance usage during high-consumption weekend periods.',
  'Measured weekend consumption is materially higher than weekday consumption.', 'Medium',
  printf('Weekend average = %.2f vs weekday = %.2f kWh/hour', round(we + 1e-9, 2), round(wd + 1e-9, 2)) FROM facts WHERE we > wd * 1.1
UNION ALL SELECT series_id, 3, 'Consider shifting flexible loads away from repeated high-demand periods.',
  'Multiple predicted periods exceed the high-demand threshold.', 'Medium', 'Predicted peak periods = ' || peaks FROM facts WHERE peaks >= 2
UNION ALL SELECT series_id, 4, 'Review always-on loads during overnight hours.',
  'Measured overnight consumption is unusually high relative to the household average.', 'Low',
  printf('Overnight average = %.2f vs overall = %.2f kWh/hour', round(night + 1e-9, 2), round(overall + 1e-9, 2)) FROM facts WHERE overall <> 0 AND night > overall * 1.15""")
def _(t: Tables) -> DataFrame:
    history, pred = user_forecast(t)
    return advice.recommendations(history, costs.peak_forecast(pred))


@query("g7_grid_summary", needs="priced", digits=6, doubles="historical_average historical_maximum critical_threshold forecast_average peak_threshold "
       "highest_predicted_demand tou_baseline_cost total_shiftable_energy potential_savings potential_optimized_cost potential_savings_percentage",
       sql=SHIFT_SQL + """
, past AS (SELECT series_id, avg(energy_kwh) AS historical_average, max(energy_kwh) AS historical_maximum,
           quantile_cont(energy_kwh, 0.99) AS critical_threshold FROM clean GROUP BY 1),
future AS (SELECT series_id, avg(predicted) AS forecast_average, max(threshold) AS peak_threshold, count(*) FILTER (predicted >= threshold) AS predicted_peak_count,
           max(predicted) AS highest_predicted_demand, sum(predicted * rate) AS tou_baseline_cost FROM priced GROUP BY 1),
top AS (SELECT series_id, ts AS highest_predicted_demand_ts FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY predicted DESC, ts) AS rn FROM priced) WHERE rn = 1),
moved AS (SELECT series_id, count(*) AS load_shift_count, sum(amount) AS total_shiftable_energy, sum(amount * (sr - dr)) AS potential_savings FROM shifts
          WHERE fraction = 0.2 AND amount > 0 GROUP BY 1)
SELECT *, tou_baseline_cost - potential_savings AS potential_optimized_cost, potential_savings / tou_baseline_cost * 100 AS potential_savings_percentage
FROM past JOIN future USING (series_id) JOIN top USING (series_id) JOIN moved USING (series_id)""")
def _(t: Tables) -> DataFrame:
    pred = t.forecast()
    return advice.grid_summary(t.clean(), costs.peak_forecast(pred), costs.tou_cost(pred), shifting.load_shifts(pred))


@query("g8_rates_by_hour", needs="readings", doubles="energy_kwh", sql="""
SELECT CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN hour(ts) BETWEEN 17 AND 21 THEN 'peak' WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 'off_peak' ELSE 'normal' END AS tou_period,
  (CASE WHEN hour(ts) BETWEEN 17 AND 21 THEN 10.0 WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 3.0 ELSE 6.0 END)::DOUBLE AS rate, sum(energy_kwh) AS energy_kwh
FROM readings GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    """The rate table of the day with the energy read at each hour."""
    hour = F.col("hour")
    return t.readings().groupBy(F.hour("ts").alias("hour")).agg(F.sum("energy_kwh").alias("energy_kwh")).select(
        "hour", tou_period(hour).alias("tou_period"), tou_rate(hour).alias("rate"), "energy_kwh")
