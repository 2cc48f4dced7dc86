from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions import kw_to_kwh, with_timestamp
from gridmeter.operators import profiles as p
from gridmeter.operators import stats
from gridmeter.operators.advice import highest_demand
from gridmeter.operators.costs import peak_forecast, tou_cost, tou_summary
from gridmeter.operators.rollup import hourly_rollup
from gridmeter.queries.registry import Tables, query
from gridmeter.session import shared_folder
from gridmeter.queries.sources import meter_log

DOW = "CAST(dayofweek(ts) + 1 AS INTEGER)"
HOUR = "CAST(hour(ts) AS INTEGER)"


@query("a1_hourly_rollup", needs="readings", digits=6, doubles="energy_kwh avg_Global_active_power avg_Global_reactive_power "
       "avg_Voltage avg_Global_intensity total_Sub_metering_1 total_Sub_metering_2 total_Sub_metering_3", sql="""
SELECT series_id, date_trunc('hour', ts) AS ts, sum(power / 60) AS energy_kwh, avg(power) AS "avg_Global_active_power",
       avg(k / 100) AS "avg_Global_reactive_power", avg(k + 200) AS "avg_Voltage", avg(energy_kwh) AS "avg_Global_intensity",
       sum(k) AS "total_Sub_metering_1", sum(energy_kwh) AS "total_Sub_metering_2", CAST(sum(user_id) AS DOUBLE) AS "total_Sub_metering_3"
FROM (SELECT *, CASE WHEN k >= 10 THEN energy_kwh END AS power FROM readings) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = with_timestamp(meter_log(t)).withColumn("energy_kwh", kw_to_kwh(F.col("Global_active_power")))
    return hourly_rollup(
        rows, ["energy_kwh", "Sub_metering_1", "Sub_metering_2", "Sub_metering_3"],
        ["Global_active_power", "Global_reactive_power", "Voltage", "Global_intensity"])


@query("a2_hourly_zero_filled", needs="ugrid", doubles="energy_kwh", sql="SELECT * FROM ugrid")
def _(t: Tables) -> DataFrame:
    return t.zero_filled()


@query("a3_describe", needs="clean", doubles="mean_kwh stddev_kwh variance_kwh min_kwh max_kwh", sql="""
SELECT series_id, count(*) AS n_rows, min(ts) AS start_ts, max(ts) AS end_ts, avg(energy_kwh) AS mean_kwh,
       stddev_samp(energy_kwh) AS stddev_kwh, var_samp(energy_kwh) AS variance_kwh, min(energy_kwh) AS min_kwh,
       max(energy_kwh) AS max_kwh FROM clean GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return p.describe_energy(t.clean())


QUANTILES = "quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, " \
            "quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.95) AS p95, " \
            "quantile_cont({c}, 0.99) AS p99"


@query("a4_percentiles", needs="clean", doubles="p05 p25 p50 p75 p90 p95 p99",
       sql=f"SELECT series_id, {QUANTILES.format(c='energy_kwh')} FROM clean GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return stats.percentiles(t.clean(), p.REPORT_PERCENTILES)


@query("a4_percentiles_raw", needs="readings", doubles="p05 p25 p50 p75 p90 p95 p99",
       sql=f"SELECT series_id, {QUANTILES.format(c='energy_kwh')} FROM readings GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return stats.exact_percentiles(t.readings(), ["series_id"], "energy_kwh", p.REPORT_PERCENTILES)


@query("a4_sketch_percentiles", needs="readings", sql="""
SELECT series_id, 'D' || CAST(floor(day(ts) / 10) AS INTEGER) AS period, p, count(energy_kwh) AS n, true AS within_rank_error
FROM readings, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS p) WHERE energy_kwh IS NOT NULL GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    """Daily sketches, kept as a table and merged to tens of days; every estimate is held against all readings of its period."""
    period = F.concat(F.lit("D"), F.floor(F.day("date") / 10).cast("string")).alias("period")
    path = shared_folder(t.spark, "sketches")
    stats.daily_sketches(t.readings()).write.parquet(path)
    kept = t.spark.read.parquet(path).select("*", period)
    wide = stats.sketch_percentiles(kept, ["series_id", "period"], p.REPORT_PERCENTILES)
    points = F.array(*[F.struct(F.lit(float(q)).alias("p"), F.col(c).alias("estimate")) for c, q in p.REPORT_PERCENTILES.items()])
    estimates = wide.select("series_id", "period", "n", points.alias("_points"))
    rows = t.readings().filter("energy_kwh IS NOT NULL").withColumn("date", F.to_date("ts")).select("series_id", period, "energy_kwh")
    tested = rows.join(estimates, ["series_id", "period"]).select("series_id", "period", "n", "energy_kwh", F.explode("_points").alias("_q"))
    value, estimate = F.col("energy_kwh"), F.col("_q.estimate")
    ranks = tested.groupBy("series_id", "period", F.col("_q.p").alias("p"), "n").agg(
        F.count_if(value < estimate).alias("_below"), F.count_if(value <= estimate).alias("_upto"),
    )
    slack = stats.SKETCH_RANK_ERROR * F.col("n")
    fits = (F.col("_below") <= F.col("p") * F.col("n") + slack) & (F.col("_upto") >= F.col("p") * F.col("n") - slack)
    return ranks.select("series_id", "period", "p", "n", fits.alias("within_rank_error"))


@query("a5_target_distribution", needs="clean", doubles="mean_kwh stddev_kwh skewness min_kwh max_kwh p05 p25 p50 p75 p90 p95 p99", sql=f"""
SELECT series_id, count(*) AS n_rows, avg(energy_kwh) AS mean_kwh, stddev_samp(energy_kwh) AS stddev_kwh,
       skewness(energy_kwh) AS skewness, count(*) FILTER (energy_kwh = 0) AS zeros, count(*) FILTER (energy_kwh < 0.05) AS near_zero,
       min(energy_kwh) AS min_kwh, max(energy_kwh) AS max_kwh, {QUANTILES.format(c='energy_kwh')}
FROM clean WHERE energy_kwh IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return p.target_distribution(t.clean())


@query("a6_hourly_profile", needs="clean", doubles="avg_energy_kwh", sql=f"""
SELECT series_id, {HOUR} AS hour, avg(energy_kwh) AS avg_energy_kwh FROM clean GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.hourly_profile(t.clean())


@query("a6_hourly_profile_dense", needs="uhourly", doubles="avg_energy_kwh", sql="""
SELECT s.series_id, s.hour, coalesce(m.v, 0.0) AS avg_energy_kwh
FROM (SELECT DISTINCT series_id, CAST(unnest(range(24)) AS INTEGER) AS hour FROM uhourly) s
LEFT JOIN (SELECT series_id, hour(ts) AS hour, avg(energy_kwh) AS v FROM uhourly GROUP BY 1, 2) m
ON s.series_id = m.series_id AND s.hour = m.hour""")
def _(t: Tables) -> DataFrame:
    return p.hourly_profile(t.hourly("user_id"), dense=True)


@query("a7_weekday_profile", needs="clean", doubles="avg_energy_kwh", sql=f"""
SELECT series_id, {DOW} AS dayofweek_num, dayname(ts) AS day_name, avg(energy_kwh) AS avg_energy_kwh FROM clean GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return p.weekday_profile(t.clean())


@query("a8_weekend_comparison", needs="clean", doubles="mean_kwh median_kwh total_kwh max_kwh", sql="""
SELECT series_id, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, avg(energy_kwh) AS mean_kwh,
       median(energy_kwh) AS median_kwh, sum(energy_kwh) AS total_kwh, max(energy_kwh) AS max_kwh FROM clean GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.weekend_comparison(t.clean())


@query("a9_heatmap", needs="uhourly", doubles="avg_energy_kwh", sql="""
SELECT s.series_id, s.dayofweek_num, s.hour, coalesce(m.v, 0.0) AS avg_energy_kwh FROM (
  SELECT series_id, CAST(c // 24 + 1 AS INTEGER) AS dayofweek_num, CAST(c % 24 AS INTEGER) AS hour
  FROM (SELECT DISTINCT series_id FROM uhourly), (SELECT unnest(range(168)) AS c)) s
LEFT JOIN (SELECT series_id, dayofweek(ts) + 1 AS d, hour(ts) AS h, avg(energy_kwh) AS v FROM uhourly GROUP BY 1, 2, 3) m
ON s.series_id = m.series_id AND s.dayofweek_num = m.d AND s.hour = m.h""")
def _(t: Tables) -> DataFrame:
    return p.heatmap(t.hourly("user_id"))


@query("a10_profile_by_daytype", needs="clean", doubles="weekday_kwh weekend_kwh", sql=f"""
SELECT series_id, {HOUR} AS hour, coalesce(avg(energy_kwh) FILTER (dayofweek(ts) NOT IN (0, 6)), 0.0) AS weekday_kwh,
       coalesce(avg(energy_kwh) FILTER (dayofweek(ts) IN (0, 6)), 0.0) AS weekend_kwh FROM clean GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.profile_by_daytype(t.clean())


@query("a11_band_share", needs="clean", doubles="total_kwh", sql="""
SELECT *, round(100 * total_kwh / sum(total_kwh) OVER (PARTITION BY series_id)) AS share_percent FROM (
  SELECT series_id, ['Night (00-06)', 'Morning (06-12)', 'Afternoon (12-18)', 'Evening (18-24)'][hour(ts) // 6 + 1] AS day_band,
         sum(energy_kwh) AS total_kwh FROM clean WHERE energy_kwh IS NOT NULL GROUP BY 1, 2)""")
def _(t: Tables) -> DataFrame:
    return p.band_share(t.clean())


@query("a12_histogram", needs="clean", sql="""
, w AS (SELECT series_id, CASE WHEN max(energy_kwh) > 0 THEN max(energy_kwh) / 12 ELSE 1.0 END AS width FROM clean GROUP BY 1),
b AS (SELECT series_id, least(11, CAST(floor(energy_kwh / width) AS INTEGER)) AS bin_index, count(*) AS n
      FROM clean JOIN w USING (series_id) WHERE energy_kwh IS NOT NULL GROUP BY 1, 2)
SELECT e.series_id, e.bin_index, floor((e.bin_index * e.width + 1e-9) * 100 + 0.5) / 100 AS bin_start, coalesce(b.n, 0) AS n
FROM (SELECT series_id, width, CAST(unnest(range(12)) AS INTEGER) AS bin_index FROM w) e
LEFT JOIN b ON b.series_id = e.series_id AND b.bin_index = e.bin_index""")
def _(t: Tables) -> DataFrame:
    return stats.histogram(t.clean())


@query("a13_daily_consumption", needs="clean", doubles="total_energy_kwh mean_energy_kwh max_energy_kwh min_energy_kwh", sql="""
SELECT series_id, CAST(ts AS DATE) AS date, sum(energy_kwh) AS total_energy_kwh, avg(energy_kwh) AS mean_energy_kwh,
       max(energy_kwh) AS max_energy_kwh, min(energy_kwh) AS min_energy_kwh FROM clean GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.daily_consumption(t.clean())


def _orders_series(t: Tables) -> DataFrame:
    """Multi-year series: order values per priority and day, in thousands."""
    rows = t.table("orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("energy_kwh"))
    return hourly_rollup(rows, scale=9).withColumn("energy_kwh", F.col("energy_kwh") / 1000)


ORDERS_SERIES = """, s AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS energy_kwh FROM orders GROUP BY 1, 2)"""


@query("a14_monthly_consumption", needs="readings", doubles="total_energy_kwh avg_hourly_energy_kwh max_energy_kwh", sql=ORDERS_SERIES + """
SELECT series_id, CAST(month(ts) AS INTEGER) AS month, sum(energy_kwh) AS total_energy_kwh, avg(energy_kwh) AS avg_hourly_energy_kwh,
       max(energy_kwh) AS max_energy_kwh FROM s GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.monthly_consumption(_orders_series(t))


@query("a15_long_term", needs="readings", doubles="energy_kwh", sql=ORDERS_SERIES + """
SELECT series_id, strftime(ts, '%Y-%m') AS period, sum(energy_kwh) AS energy_kwh FROM s GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.long_term(_orders_series(t))


@query("a16_seasonal", needs="readings", doubles="avg_energy_kwh", sql=ORDERS_SERIES + """
SELECT series_id, CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) < 6 THEN 'Spring' WHEN month(ts) < 9 THEN 'Summer'
       ELSE 'Autumn' END AS season, avg(energy_kwh) AS avg_energy_kwh FROM s GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.seasonal(_orders_series(t))


@query("a17_submeter_share", needs="clean", doubles="total relative_contribution", sql="""
, w AS (SELECT series_id, sum(total_k) AS total_k, sum(energy_kwh) AS energy_kwh FROM clean GROUP BY 1)
SELECT series_id, 'total_k' AS sub_meter, total_k AS total, total_k / (total_k + energy_kwh) AS relative_contribution FROM w
UNION ALL SELECT series_id, 'energy_kwh', energy_kwh, energy_kwh / (total_k + energy_kwh) FROM w""")
def _(t: Tables) -> DataFrame:
    return p.submeter_share(t.clean(), ["total_k", "energy_kwh"])


@query("a18_demand_counts", needs="clean", sql="""
SELECT series_id, CASE WHEN energy_kwh >= p95 THEN 'critical' WHEN energy_kwh >= p90 THEN 'high' ELSE 'normal' END AS demand_level,
       count(*) AS n_hours FROM clean JOIN (SELECT series_id, quantile_cont(energy_kwh, 0.9) AS p90, quantile_cont(energy_kwh, 0.95) AS p95
       FROM clean GROUP BY 1) USING (series_id) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.demand_counts(t.clean())


@query("a19_peak_events", needs="p90", sql=f"""
SELECT series_id, {HOUR} AS hour, {DOW} AS dayofweek_num, count(*) AS n_events FROM clean JOIN p90 USING (series_id)
WHERE energy_kwh >= p90 GROUP BY GROUPING SETS ((series_id, 2), (series_id, 3))""".replace("(series_id, 2)", f"(series_id, {HOUR})").replace("(series_id, 3)", f"(series_id, {DOW})"))
def _(t: Tables) -> DataFrame:
    return p.peak_events(t.clean())


@query("a20_variability", needs="clean", doubles="stddev_kwh coefficient_of_variation", sql="""
SELECT series_id, stddev_samp(energy_kwh) AS stddev_kwh, stddev_samp(energy_kwh) / avg(energy_kwh) AS coefficient_of_variation
FROM clean GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return p.variability(t.clean())


MEASURES = ["energy_kwh", "total_k", "avg_k", "is_energy_outlier"]
_ROWS = " UNION ALL ".join(
    f"SELECT series_id, '{a}' AS column_name, " + ", ".join(f"corr({a}, {b}) AS {b}" for b in MEASURES) + " FROM clean GROUP BY 1"
    for a in MEASURES
)


@query("a21_corr_matrix", needs="clean", doubles=" ".join(MEASURES), sql=_ROWS)
def _(t: Tables) -> DataFrame:
    return stats.corr_matrix(t.clean(), MEASURES)


@query("a21_target_correlation", needs="clean", doubles="correlation", sql=" UNION ALL ".join(
    f"SELECT series_id, '{b}' AS column_name, corr(energy_kwh, {b}) AS correlation FROM clean GROUP BY 1" for b in MEASURES[1:]))
def _(t: Tables) -> DataFrame:
    return stats.target_correlation(t.clean(), "energy_kwh", MEASURES[1:])


FEATURES_14 = ["energy_kwh", *[f"lag_{k}" for k in (1, 3, 6, 12, 24, 48, 72, 168)],
               *[f"rolling_mean_{w}" for w in (3, 6, 12, 24, 168)]]
_FEATURES_SQL = ", f AS (SELECT series_id, energy_kwh, total_k, avg_k, " + ", ".join(
    [f"lag(energy_kwh, {k}) OVER w AS lag_{k}" for k in (1, 3, 6, 12, 24, 48, 72, 168)]
    + [f"avg(energy_kwh) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS rolling_mean_{w}"
       for w in (3, 6, 12, 24, 168)]
) + " FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY ts)), kept AS (SELECT * FROM f WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in FEATURES_14 + ["total_k", "avg_k"]) + ")"


@query("a21_feature_correlations", needs="clean", doubles=" ".join(FEATURES_14), sql=_FEATURES_SQL + " UNION ALL ".join(
    f" SELECT series_id, '{a}' AS column_name, " + ", ".join(f"corr({a}, {b}) AS {b}" for b in FEATURES_14)
    + " FROM kept GROUP BY 1" for a in FEATURES_14))
def _(t: Tables) -> DataFrame:
    return stats.corr_matrix(t.features(), FEATURES_14)


@query("a22_autocorrelation", needs="grid", doubles="lag_1 lag_24 lag_48 lag_168", sql="""
, l AS (SELECT series_id, energy_kwh, lag(energy_kwh, 1) OVER w AS l1, lag(energy_kwh, 24) OVER w AS l24, lag(energy_kwh, 48) OVER w AS l48,
        lag(energy_kwh, 168) OVER w AS l168 FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, corr(energy_kwh, l1) AS lag_1, corr(energy_kwh, l24) AS lag_24, corr(energy_kwh, l48) AS lag_48,
       corr(energy_kwh, l168) AS lag_168 FROM l GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return stats.autocorrelation(t.grid())


@query("a23_tou_summary", needs="priced", digits=6, doubles="off_peak_energy_kwh off_peak_cost normal_energy_kwh normal_cost peak_energy_kwh peak_cost "
       "total_energy_kwh total_simulated_cost", sql="SELECT series_id, " + ", ".join(
    f"coalesce(sum(predicted) FILTER (tou_period = '{x}'), 0.0) AS {x}_energy_kwh, "
    f"coalesce(sum(predicted * rate) FILTER (tou_period = '{x}'), 0.0) AS {x}_cost" for x in ("off_peak", "normal", "peak")) + """,
    sum(predicted) AS total_energy_kwh, sum(predicted * rate) AS total_simulated_cost FROM priced GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return tou_summary(tou_cost(t.forecast()))


@query("a24_severity_counts", needs="forecast", sql="""
SELECT series_id, CASE WHEN predicted >= greatest(p99, threshold) THEN 'Critical' WHEN predicted >= threshold THEN 'High' ELSE 'Normal' END
       AS demand_level, count(*) AS n_hours
FROM forecast JOIN (SELECT series_id, quantile_cont(predicted, 0.99) AS p99 FROM forecast GROUP BY 1) USING (series_id) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return p.severity_counts(peak_forecast(t.forecast()))


@query("a25_energy_insights", needs="p90", doubles="average_hourly maximum_hourly minimum_hourly weekday_average weekend_average "
       "peak_demand_frequency average_daily", sql="""
, known AS (SELECT * FROM clean WHERE energy_kwh IS NOT NULL),
base AS (SELECT series_id, count(*) AS record_count, avg(energy_kwh) AS average_hourly, max(energy_kwh) AS maximum_hourly,
  min(energy_kwh) AS minimum_hourly, avg(energy_kwh) FILTER (dayofweek(ts) NOT IN (0, 6)) AS weekday_average,
  avg(energy_kwh) FILTER (dayofweek(ts) IN (0, 6)) AS weekend_average,
  avg(CASE WHEN energy_kwh >= p90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS peak_demand_frequency
  FROM known JOIN p90 USING (series_id) GROUP BY 1),
days AS (SELECT series_id, avg(v) AS average_daily FROM (SELECT series_id, CAST(ts AS DATE) AS d, sum(energy_kwh) AS v FROM known GROUP BY 1, 2) GROUP BY 1),
hours AS (SELECT series_id, CAST(hour(ts) AS INTEGER) AS h, round(avg(energy_kwh), 9) AS v FROM known GROUP BY 1, 2),
hi AS (SELECT series_id, h AS highest_hour FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v DESC, h) AS rn FROM hours) WHERE rn = 1),
lo AS (SELECT series_id, h AS lowest_hour FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v, h) AS rn FROM hours) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY energy_kwh DESC, ts) AS down,
                     row_number() OVER (PARTITION BY series_id ORDER BY energy_kwh, ts) AS up FROM known),
tops AS (SELECT series_id, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' ' ORDER BY down) FILTER (down <= 5) AS top_highest,
                string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' ' ORDER BY up) FILTER (up <= 5) AS top_lowest FROM ranked GROUP BY 1)
SELECT * FROM base JOIN days USING (series_id) JOIN hi USING (series_id) JOIN lo USING (series_id) JOIN tops USING (series_id)""")
def _(t: Tables) -> DataFrame:
    clean = t.clean()
    with_threshold = clean.join(stats.percentiles(clean, {"threshold": 0.9}), "series_id")

    def stamps(name: str):
        return F.array_join(F.transform(name, lambda r: F.date_format(r["ts"], "yyyy-MM-dd'T'HH:mm:ss")), " ")

    return p.energy_insights(with_threshold).withColumns({"top_highest": stamps("top_highest"), "top_lowest": stamps("top_lowest")})


EXTREMES_SQL = """
, v AS (SELECT series_id, 'hour' AS dimension, CAST(hour(ts) AS INTEGER) AS k, round(avg(energy_kwh), 9) AS v FROM clean GROUP BY 1, 3
  UNION ALL SELECT series_id, 'weekday', CAST(dayofweek(ts) + 1 AS INTEGER), round(avg(energy_kwh), 9) FROM clean GROUP BY 1, 3
  UNION ALL SELECT series_id, 'month', CAST(month(ts) AS INTEGER), round(sum(energy_kwh), 9) FROM clean GROUP BY 1, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, dimension ORDER BY v DESC, k) AS down,
             row_number() OVER (PARTITION BY series_id, dimension ORDER BY v, k) AS up FROM v),
extremes AS (SELECT series_id, dimension, max(k) FILTER (down = 1) AS highest_key, max(v) AS highest_value,
             max(k) FILTER (up = 1) AS lowest_key, min(v) AS lowest_value FROM r GROUP BY 1, 2)
"""


@query("a26_profile_extremes", needs="clean", doubles="highest_value lowest_value", sql=EXTREMES_SQL + "SELECT * FROM extremes")
def _(t: Tables) -> DataFrame:
    return p.profile_extremes(t.clean())


@query("a27_error_by_hour", needs="scored", doubles="mae rmse", sql=f"""
SELECT series_id, model, horizon, {HOUR} AS hour, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse
FROM naive WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(t: Tables) -> DataFrame:
    return p.error_by_hour(t.predictions())


_Q = {"p05": .05, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99}
_PARTS = [
    ("dataset_overview", {"n_rows": "count(*)", "duration_days": "round((epoch(max(ts)) - epoch(min(ts))) / 86400, 2)"}),
    ("consumption_statistics", {"mean_kwh": "avg(energy_kwh)", "stddev_kwh": "stddev_samp(energy_kwh)", "variance_kwh": "var_samp(energy_kwh)",
                                "min_kwh": "min(energy_kwh)", "max_kwh": "max(energy_kwh)"}),
    ("percentiles", {n: f"quantile_cont(energy_kwh, {q})" for n, q in _Q.items()}),
    ("weekday_weekend_analysis", {"weekday_average": "avg(energy_kwh) FILTER (dayofweek(ts) NOT IN (0, 6))",
                                  "weekend_average": "avg(energy_kwh) FILTER (dayofweek(ts) IN (0, 6))"}),
    ("variability_analysis", {"stddev_kwh": "stddev_samp(energy_kwh)", "coefficient_of_variation": "stddev_samp(energy_kwh) / avg(energy_kwh)"}),
    ("correlation_analysis", {"total_k": "corr(energy_kwh, total_k)", "avg_k": "corr(energy_kwh, avg_k)"}),
]
_EDA = [f"SELECT series_id, '{section}' AS section, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM clean GROUP BY 1"
        for section, metrics in _PARTS for m, e in metrics.items()]
_EDA += [f"SELECT series_id, dimension || '_analysis', '{m}', CAST({m} AS DOUBLE) FROM extremes"
         for m in ("highest_key", "lowest_key", "highest_value", "lowest_value")]
_EDA += [f"SELECT series_id, 'peak_demand_analysis', '{m}', CAST(count(*) FILTER ({cond}) AS DOUBLE) FROM clean JOIN pq USING (series_id) GROUP BY 1"
         for m, cond in (("high_hours", "energy_kwh >= p90 AND energy_kwh < p95"), ("critical_hours", "energy_kwh >= p95"))]
_EDA += [f"SELECT series_id, 'autocorrelation_analysis', 'lag_{k}', corr(energy_kwh, l) FROM (SELECT series_id, energy_kwh, "
         f"lag(energy_kwh, {k}) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM clean) GROUP BY 1" for k in (1, 24, 48, 168)]


@query("a28_eda_summary", needs="clean", doubles="value", sql=EXTREMES_SQL.rstrip() + """,
pq AS (SELECT series_id, quantile_cont(energy_kwh, 0.9) AS p90, quantile_cont(energy_kwh, 0.95) AS p95 FROM clean GROUP BY 1)
""" + " UNION ALL ".join(_EDA))
def _(t: Tables) -> DataFrame:
    return p.eda_summary(t.clean(), ["total_k", "avg_k"])


@query("o2_top_hours", needs="clean", doubles="energy_kwh", sql="""
SELECT series_id, kind, CAST(rank AS INTEGER) AS rank, ts, energy_kwh FROM (
  SELECT *, 'highest' AS kind, row_number() OVER (PARTITION BY series_id ORDER BY energy_kwh DESC, ts) AS rank FROM clean WHERE energy_kwh IS NOT NULL
  UNION ALL SELECT *, 'lowest', row_number() OVER (PARTITION BY series_id ORDER BY energy_kwh, ts) FROM clean WHERE energy_kwh IS NOT NULL)
WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    return p.top_hours(t.clean())


@query("o6_highest_demand", needs="forecast", doubles="highest_value", sql="""
SELECT series_id, predicted AS highest_value, ts AS highest_ts FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY predicted DESC, ts) AS rn
FROM forecast) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return highest_demand(t.forecast())
