from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions import with_timestamp
from gridmeter.operators import quality as q
from gridmeter.operators.cleaning import dedup_measures, drop_null_ts, flag_outliers
from gridmeter.operators.features import basic_features, drop_incomplete
from gridmeter.operators.costs import with_critical
from gridmeter.operators.split import chronological_split
from gridmeter.operators.uploads import sampling_interval, user_hourly, validate_uploads
from gridmeter.queries.registry import Tables, query
from gridmeter.queries.sources import VALIDATE_SQL, meter_log, upload_rows
from gridmeter.sources.readers import METER_LOG_MEASURES


@query("q1_null_counts", needs="readings", sql="""
SELECT series_id, column_name, count(*) FILTER (column_name = 'Global_active_power' AND k < 10) AS null_count
FROM readings, (SELECT unnest(['Global_active_power', 'Global_reactive_power', 'Voltage', 'Global_intensity',
     'Sub_metering_1', 'Sub_metering_2', 'Sub_metering_3']) AS column_name) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return q.null_counts(meter_log(t), METER_LOG_MEASURES)


@query("q2_time_bounds", needs="readings", sql="""
SELECT series_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM readings GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return q.bounds(t.readings())


@query("q3_duplicate_timestamps", needs="readings", sql="""
SELECT series_id, count(*) FILTER (n > 1) AS duplicate_timestamps, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
FROM (SELECT series_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM readings GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return q.duplicate_timestamps(t.readings().withColumn("ts", F.date_trunc("hour", "ts")))


def _shipped(t: Tables) -> DataFrame:
    """Several measures with many rows per timestamp: shipped lines by return flag and day."""
    return t.table("lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("energy_kwh"), F.col("l_extendedprice").alias("total_sub_metering_1"),
        F.col("l_discount").alias("avg_voltage"),
    )


@query("q4_dedup_measures", doubles="avg_voltage", sql="""
SELECT l_returnflag AS series_id, l_shipdate AS ts, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS energy_kwh,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sub_metering_1, avg(l_discount) AS avg_voltage
FROM lineitem GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return dedup_measures(_shipped(t), scale=9)


@query("q5_drop_null_ts", needs="readings", sql="""
SELECT series_id, count(*) AS n_rows, count(*) FILTER (k < 10) AS removed, count(*) FILTER (k >= 10) AS kept FROM readings GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.readings().withColumn("ts", F.when(F.col("k") >= 10, F.col("ts")))
    kept = drop_null_ts(rows).groupBy("series_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("ts").isNull()).alias("removed")
    ).join(kept, "series_id")


@query("q6_outlier_flags", needs="clean", doubles="energy_kwh", sql="""
SELECT series_id, ts, energy_kwh, is_energy_outlier FROM clean""")
def _(t: Tables) -> DataFrame:
    return t.clean().select("series_id", "ts", "energy_kwh", "is_energy_outlier")


@query("q6_outlier_flags_raw", needs="readings", sql="""
, b AS (SELECT series_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
        FROM (SELECT series_id, CASE WHEN k >= 10 THEN energy_kwh END AS v FROM readings) GROUP BY 1)
SELECT series_id, count(*) AS n_rows, count(*) FILTER (k >= 10 AND (energy_kwh > q3 + 2 * (q3 - q1) OR energy_kwh < q1 - 2 * (q3 - q1)))
       AS outliers FROM readings JOIN b USING (series_id) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    known = t.readings().withColumn("energy_kwh", F.when(F.col("k") >= 10, F.col("energy_kwh")))
    return flag_outliers(known, 2.0, raw=True).groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.sum("is_energy_outlier").alias("outliers"))


@query("q7_negative_count", needs="readings", sql="""
SELECT series_id, count(*) FILTER (energy_kwh < k) AS negative_values FROM readings GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return q.negative_count(t.readings().withColumn("energy_kwh", F.col("energy_kwh") - F.col("k")))


@query("q8_hour_coverage", needs="readings", doubles="avg_readings", sql="""
SELECT series_id, count(*) AS hours, count(*) FILTER (n = 3) AS full_hours, count(*) FILTER (n < 3) AS partial_hours,
       min(n) AS min_readings, max(n) AS max_readings, avg(n) AS avg_readings
FROM (SELECT series_id, date_trunc('hour', ts) AS h, count(*) AS n FROM readings GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return q.hour_coverage(t.readings(), 3)


BASIC_ROWS = """
, feature_rows AS (SELECT c.series_id, c.ts FROM (
    SELECT *, lag(energy_kwh, 168) OVER w AS lag_168, count(energy_kwh) OVER (PARTITION BY series_id ORDER BY ts
             ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS n_known,
           lag(energy_kwh, 1) OVER w AS l1, lag(energy_kwh, 3) OVER w AS l3, lag(energy_kwh, 6) OVER w AS l6,
           lag(energy_kwh, 12) OVER w AS l12, lag(energy_kwh, 24) OVER w AS l24, lag(energy_kwh, 48) OVER w AS l48,
           lag(energy_kwh, 72) OVER w AS l72
    FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY ts)) c
  WHERE lag_168 IS NOT NULL AND energy_kwh IS NOT NULL AND total_k IS NOT NULL AND avg_k IS NOT NULL AND
        l1 + l3 + l6 + l12 + l24 + l48 + l72 IS NOT NULL)
"""


@query("q9_reconciliation", needs="readings clean", sql=BASIC_ROWS + """
, positioned AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
                        count(*) OVER (PARTITION BY series_id) AS n FROM feature_rows)
, stages AS (
  SELECT 0 AS stage_order, 'raw' AS stage, series_id, ts FROM readings UNION ALL
  SELECT 1, 'hourly', series_id, ts FROM hourly UNION ALL SELECT 2, 'clean', series_id, ts FROM clean UNION ALL
  SELECT 3, 'features', series_id, ts FROM feature_rows UNION ALL
  SELECT 4, 'train', series_id, ts FROM positioned WHERE pos <= floor(n * 0.7::DOUBLE) UNION ALL
  SELECT 5, 'test', series_id, ts FROM positioned WHERE pos > floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE))
SELECT stage_order, stage, series_id, count(*) AS n_rows, min(ts) AS start_ts, max(ts) AS end_ts FROM stages GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    clean = t.clean()
    features = drop_incomplete(basic_features(clean))
    split = chronological_split(features.select("series_id", "ts", "energy_kwh"))
    return q.reconcile({
        "raw": t.readings(), "hourly": t.hourly(), "clean": clean, "features": features,
        "train": split.filter(F.col("split") == "train"), "test": split.filter(F.col("split") == "test"),
    })


@query("q10_preprocess_report", needs="clean", doubles="outlier_lower_bound outlier_upper_bound", sql="""
, raw AS (SELECT series_id, count(*) AS input_records, CAST(0 AS BIGINT) AS null_timestamps_removed, count(*) AS records_before_dedup,
       CAST(0 AS BIGINT) AS duplicate_timestamps, count(*) AS records_after_dedup,
       date_diff('hour', min(ts), max(ts)) + 1 AS expected_hourly_records FROM hourly GROUP BY 1),
gridn AS (SELECT series_id, count(*) FILTER (energy_kwh IS NULL) AS missing_energy_before FROM grid GROUP BY 1),
cleann AS (SELECT series_id, count(*) FILTER (energy_kwh IS NULL) AS missing_energy_after,
       CAST(sum(is_long_gap) AS BIGINT) AS long_gap_hours, CAST(sum(is_energy_outlier) AS BIGINT) AS outlier_count,
       CAST(0 AS BIGINT) AS negative_energy_values, count(*) AS output_records FROM clean GROUP BY 1)
SELECT raw.*, expected_hourly_records - records_after_dedup AS missing_hourly_records, missing_energy_before, missing_energy_after,
       long_gap_hours, outlier_count, negative_energy_values, output_records,
       lower_bound AS outlier_lower_bound, upper_bound AS outlier_upper_bound
FROM raw JOIN gridn USING (series_id) JOIN cleann USING (series_id) JOIN iqr USING (series_id)""")
def _(t: Tables) -> DataFrame:
    return q.preprocess_report(t.hourly(), scale=9)


@query("q11_validate_uploads", needs="readings", sql=VALIDATE_SQL + "SELECT * EXCLUDE (user_id) FROM report")
def _(t: Tables) -> DataFrame:
    return validate_uploads(upload_rows(t)).withColumns({
        "errors": F.array_join("errors", " | "), "warnings": F.array_join("warnings", " | ")})


@query("q12_sampling_interval", needs="readings", sql="""
, times AS (SELECT DISTINCT user_id, epoch(date_trunc('hour', ts))::BIGINT AS s FROM readings),
gaps AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM times),
counted AS (SELECT user_id, gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2),
modal AS (SELECT user_id, gap AS interval_seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, gap) AS rn
          FROM counted) WHERE rn = 1)
SELECT user_id, interval_seconds, printf('%d days %02d:%02d:%02d', interval_seconds // 86400, interval_seconds % 86400 // 3600,
       interval_seconds % 3600 // 60, interval_seconds % 60) AS detected_interval,
       round(CAST(sum(n) FILTER (gap = interval_seconds) AS DOUBLE) * 100 / CAST(sum(n) AS DOUBLE), 2) AS consistency_percent,
       CAST(coalesce(sum(n) FILTER (gap > interval_seconds), 0) AS BIGINT) AS gap_count
FROM counted JOIN modal USING (user_id) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return sampling_interval(t.readings().withColumn("ts", F.date_trunc("hour", "ts")), "user_id", "ts")


@query("q13_readiness", needs="catalog", doubles="days", sql="""
SELECT id, (epoch(end_timestamp) - epoch(start_timestamp)) / 86400.0 AS days,
  CASE WHEN epoch(end_timestamp) - epoch(start_timestamp) < 7 * 86400 THEN 'Insufficient history'
       WHEN epoch(end_timestamp) - epoch(start_timestamp) < 30 * 86400 THEN 'Basic'
       WHEN epoch(end_timestamp) - epoch(start_timestamp) < 90 * 86400 THEN 'Good' ELSE 'Strong' END AS readiness FROM catalog""")
def _(t: Tables) -> DataFrame:
    days = (F.unix_timestamp("end_timestamp") - F.unix_timestamp("start_timestamp")) / 86400.0
    return t.catalog().select("id", days.alias("days"), q.readiness(days).alias("readiness"))


@query("q14_forecast_eligibility", needs="ugrid", sql="""
SELECT series_id, horizon, CAST(required AS BIGINT) AS required_hours, available_hours,
       CASE WHEN available_hours < required THEN 'insufficient_history' ELSE 'complete' END AS status
FROM (SELECT series_id, count(*) AS available_hours FROM ugrid GROUP BY 1),
     (SELECT 1 AS horizon, 169 AS required UNION ALL SELECT 24, 192)""")
def _(t: Tables) -> DataFrame:
    hourly = t.zero_filled()
    return q.forecast_eligibility(hourly, 1).unionByName(q.forecast_eligibility(hourly, 24))


@query("q15_profile", needs="readings", doubles="mean_value q25 median_value q75", sql="""
, long AS (SELECT series_id, ts, 'energy_kwh' AS column_name, 'double' AS data_type, CASE WHEN k >= 10 THEN energy_kwh END AS value FROM readings
  UNION ALL SELECT series_id, ts, 'k', 'double', k FROM readings
  UNION ALL SELECT series_id, ts, 'user_id', 'bigint', CAST(user_id AS DOUBLE) FROM readings)
SELECT series_id, column_name, data_type, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS null_count,
       min(ts) AS start_ts, max(ts) AS end_ts, min(value) AS min_value, avg(value) AS mean_value, max(value) AS max_value,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median_value, quantile_cont(value, 0.75) AS q75
FROM long GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rows = t.readings().withColumn("energy_kwh", F.when(F.col("k") >= 10, F.col("energy_kwh")))
    return q.profile(rows, ["energy_kwh", "k", "user_id"])


@query("q15_first_last_rows", needs="readings", doubles="energy_kwh", sql="""
SELECT series_id, side, ts, event_id, energy_kwh FROM (
  SELECT *, 'first' AS side, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM readings
  UNION ALL SELECT *, 'last', row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) FROM readings) WHERE rn <= 5""")
def _(t: Tables) -> DataFrame:
    from gridmeter.operators.split import head_per_series, tail_per_series

    rows = t.readings().select("series_id", "ts", "event_id", "energy_kwh")
    first = head_per_series(rows, 5).withColumn("side", F.lit("first"))
    return first.unionByName(tail_per_series(rows, 5).withColumn("side", F.lit("last")))


@query("q16_feature_guards", needs="clean", sql="""
SELECT series_id, CAST(0 AS BIGINT) AS repeated_timestamps,
       CAST(sum((energy_kwh IS NULL)::INT + (total_k IS NULL)::INT + (avg_k IS NULL)::INT) AS BIGINT) AS null_cells
FROM clean GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return q.feature_violations(t.clean())


@query("q16_prediction_guards", needs="forecast", sql="""
SELECT series_id, CAST(0 AS BIGINT) AS null_predictions, CAST(0 AS BIGINT) AS negative_predictions,
       count(*) FILTER (p99 < threshold) AS misordered_thresholds
FROM forecast JOIN (SELECT series_id, quantile_cont(predicted, 0.99) AS p99 FROM forecast GROUP BY 1) USING (series_id) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return q.prediction_violations(with_critical(t.forecast()), F.col("threshold"), F.col("critical"))


@query("q2_raw_log_bounds", needs="readings", sql="""
SELECT series_id, date_trunc('second', min(ts)) AS start_ts, date_trunc('second', max(ts)) AS end_ts, count(*) AS n_rows
FROM readings GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return q.bounds(with_timestamp(meter_log(t)))


@query("a2_user_hourly", needs="readings", doubles="energy_kwh", sql=VALIDATE_SQL.rstrip() + """,
usable AS (SELECT upload_id FROM parsed GROUP BY 1 HAVING count(*) = count(DISTINCT t) AND count(*) = count(kwh) AND min(kwh) >= 0),
h AS (SELECT upload_id, date_trunc('hour', t) AS ts, CAST(sum(CAST(kwh AS DECIMAL(18,2))) AS DOUBLE) AS energy_kwh
      FROM parsed JOIN usable USING (upload_id) GROUP BY 1, 2)
SELECT s.upload_id AS series_id, s.ts, coalesce(h.energy_kwh, 0.0) AS energy_kwh FROM (
  SELECT upload_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1) s
LEFT JOIN h ON h.upload_id = s.upload_id AND h.ts = s.ts""")
def _(t: Tables) -> DataFrame:
    return user_hourly(upload_rows(t), scale=9)
