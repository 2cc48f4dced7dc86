from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.operators.uploads import validate_uploads
from gridmeter.queries.registry import Tables, query
from gridmeter.session import shared_folder
from gridmeter.sources import (
    StoredCatalog, catalog_append, forecast_for_horizon, parse_meter_lines, parse_user_lines,
    read_records, read_stage, read_user_csv, sql, view, write_csv, write_json, write_stage,
)


def meter_lines(t: Tables) -> DataFrame:
    """Readings as lines of a meter log; power is unknown where k is below ten."""
    power = F.when(F.col("k") < 10, "?").otherwise(F.col("energy_kwh").cast("string"))
    return t.readings().select(
        "series_id", "event_id",
        F.concat_ws(
            ";", F.date_format("ts", "d/M/yyyy"), F.date_format("ts", "HH:mm:ss"), power, (F.col("k") / 100).cast("string"),
            (F.col("k") + 200).cast("string"), F.col("energy_kwh").cast("string"), F.col("k").cast("string"),
            F.col("energy_kwh").cast("string"), F.col("user_id").cast("string"),
        ).alias("line"),
    )


def meter_log(t: Tables) -> DataFrame:
    return parse_meter_lines(meter_lines(t))


@query("s1_meter_log_scan", needs="readings", sql="""
SELECT series_id, event_id, strftime(ts, '%-d/%-m/%Y') AS "Date", strftime(ts, '%H:%M:%S') AS "Time",
       CASE WHEN k >= 10 THEN energy_kwh END AS "Global_active_power", k / 100 AS "Global_reactive_power",
       k + 200 AS "Voltage", energy_kwh AS "Global_intensity", k AS "Sub_metering_1", energy_kwh AS "Sub_metering_2",
       CAST(user_id AS DOUBLE) AS "Sub_metering_3"
FROM readings""", doubles="Global_active_power Global_reactive_power Voltage")
def _(t: Tables) -> DataFrame:
    return meter_log(t)


@query("s2_stage_tables", needs="hourly", doubles="avg_k", sql="SELECT * FROM hourly")
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "hourly")
    write_stage(t.hourly(), path)
    return read_stage(t.spark, path).drop("series_bucket")


@query("s3_csv_sink", needs="grid", doubles="energy_kwh", sql="SELECT series_id, ts, energy_kwh FROM grid")
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "csv")
    write_csv(t.grid().select("series_id", "ts", "energy_kwh"), path)
    return t.spark.read.schema("series_id string, ts timestamp, energy_kwh double").csv(path, header=True)


@query("s4_json_sink", needs="hourly", doubles="energy_kwh avg_k", sql="""
SELECT series_id, count(*) AS n_hours, sum(energy_kwh) AS energy_kwh, avg(avg_k) AS avg_k FROM hourly GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "json")
    nested = t.hourly().groupBy("series_id").agg(
        F.struct(F.count("*").alias("n_hours"), F.sum("energy_kwh").alias("energy_kwh")).alias("totals"),
        F.struct(F.avg("avg_k").alias("avg_k")).alias("levels"),
    )
    write_json(nested, path)
    schema = "series_id string, totals struct<n_hours: bigint, energy_kwh: double>, levels struct<avg_k: double>"
    return t.spark.read.schema(schema).json(path).select("series_id", "totals.*", "levels.*")


def user_lines(t: Tables) -> DataFrame:
    """Readings as lines of user files, with the words for missing values that such files contain."""
    stamp = F.when(F.col("series_id") == "signup", "NaN").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    value = F.when(F.col("series_id") == "error", "NA").when(F.col("series_id") == "view", "").otherwise(
        F.format_string("%.2f", "energy_kwh"))
    return t.readings().select("event_id", F.col("user_id").alias("upload_id"), F.concat_ws(",", stamp, value).alias("line"))


USER_CSV_SQL = """
SELECT {keys}, CASE WHEN series_id <> 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "timestamp",
       CASE WHEN series_id NOT IN ('error', 'view') THEN printf('%.2f', energy_kwh) END AS energy_consumption
FROM readings"""


@query("s5_user_csv_scan", needs="readings", sql=USER_CSV_SQL.format(keys="event_id, user_id AS upload_id"))
def _(t: Tables) -> DataFrame:
    return parse_user_lines(user_lines(t))


@query("s5_user_csv_files", needs="readings", sql="""
SELECT series_id AS upload_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", printf('%.2f', energy_kwh) AS energy_consumption
FROM readings""")
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "uploads")
    rows = t.readings().select(
        "series_id", F.lit("extra").alias("note"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.format_string("%.2f", "energy_kwh").alias("energy_consumption"),
    )
    rows.write.partitionBy("series_id").option("header", True).csv(path)
    return read_user_csv(t.spark, path, "series_id=([^/]+)/").drop("header")


@query("s6_sql_view", needs="readings", doubles="energy_kwh", sql="""
SELECT series_id, count(*) AS n, CAST(sum(CAST(energy_kwh AS DECIMAL(18,2))) AS DOUBLE) AS energy_kwh
FROM readings WHERE energy_kwh > 10 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    name = view(t.spark, "high_readings", "SELECT * FROM {r} WHERE energy_kwh > 10", r=t.readings())
    return sql(t.spark, f"""
        SELECT series_id, count(*) AS n, cast(sum(cast(energy_kwh AS decimal(18,2))) AS double) AS energy_kwh
        FROM {name} GROUP BY series_id""")


@query("s7_first_records", needs="hourly", doubles="energy_kwh", sql="""
SELECT series_id, ts, energy_kwh FROM hourly ORDER BY ts, series_id LIMIT 1000""")
def _(t: Tables) -> DataFrame:
    return read_records(t.hourly().select("series_id", "ts", "energy_kwh"), ["ts", "series_id"], 1000)


@query("s7_forecast_for_horizon", needs="naive", doubles="predicted_consumption", sql="""
SELECT series_id, ts, predicted AS predicted_consumption FROM naive WHERE horizon = 24""")
def _(t: Tables) -> DataFrame:
    return forecast_for_horizon(t.predictions(), 24)


def stored(t: Tables, rows: DataFrame) -> StoredCatalog:
    """A stored catalog of these rows, written as its first batch."""
    store = StoredCatalog(t.spark, shared_folder(t.spark, "catalog"), rows.schema)
    store.append(rows, 1)
    return store


@query("s8_catalog_select", needs="catalog", sql="""
SELECT id, user_id, start_timestamp, end_timestamp FROM catalog WHERE validation_status = 'VALID'""")
def _(t: Tables) -> DataFrame:
    return stored(t, t.catalog()).select(
        {"validation_status": "VALID"}, ["id", "user_id", "start_timestamp", "end_timestamp"],
        [F.desc("created_at"), "id"],
    )


def upload_rows(t: Tables) -> DataFrame:
    """Uploads of readings as text: one upload per user and event type, with some of the usual defects."""
    stamp = F.when((F.col("series_id") == "error") & (F.col("k") < 10), F.lit("not a time")).when(
        (F.col("series_id") == "signup") & (F.col("k") < 10), F.lit(None)
    ).otherwise(F.date_format(F.when(F.col("series_id") == "view", F.date_trunc("hour", "ts")).otherwise(F.col("ts")),
                              "yyyy-MM-dd HH:mm:ss"))
    value = F.when((F.col("series_id") == "click") & (F.col("k") < 5), F.lit("n/a")).when(
        (F.col("series_id") == "click") & (F.col("k") > 95), F.format_string("-%.2f", "energy_kwh")
    ).otherwise(F.format_string("%.2f", "energy_kwh"))
    return t.readings().select(
        F.concat_ws("-", F.col("user_id").cast("string"), "series_id").alias("upload_id"), "user_id", "series_id",
        stamp.alias("timestamp"), value.alias("energy_consumption"),
    )


# Verdicts written out in SQL: parse, count defects, find the modal gap, then word the messages.
VALIDATE_SQL = """
, uploads AS (
  SELECT user_id || '-' || series_id AS upload_id, user_id,
    CASE WHEN series_id = 'error' AND k < 10 THEN 'not a time' WHEN series_id = 'signup' AND k < 10 THEN NULL
         ELSE strftime(CASE WHEN series_id = 'view' THEN date_trunc('hour', ts) ELSE ts END, '%Y-%m-%d %H:%M:%S') END AS txt,
    CASE WHEN series_id = 'click' AND k < 5 THEN 'n/a' WHEN series_id = 'click' AND k > 95 THEN printf('-%.2f', energy_kwh)
         ELSE printf('%.2f', energy_kwh) END AS val FROM readings),
parsed AS (SELECT *, try_strptime(txt, '%Y-%m-%d %H:%M:%S') AS t, TRY_CAST(val AS DOUBLE) AS kwh FROM uploads),
base AS (
  SELECT upload_id, min(user_id) AS user_id, count(*) AS records, count(*) FILTER (txt IS NULL) AS missing_n,
         count(*) FILTER (txt IS NOT NULL AND t IS NULL) AS invalid_n,
         count(*) FILTER (val IS NOT NULL AND kwh IS NULL) AS bad_n, count(*) FILTER (kwh < 0) AS negative_n,
         count(t) - count(DISTINCT t) AS dup_n, min(t) AS s, max(t) AS e FROM parsed GROUP BY 1),
gaps AS (
  SELECT upload_id, epoch(t)::BIGINT - lag(epoch(t)::BIGINT) OVER (PARTITION BY upload_id ORDER BY t) AS gap
  FROM (SELECT DISTINCT upload_id, t FROM parsed WHERE t IS NOT NULL)),
modal AS (
  SELECT upload_id, gap AS modal_gap FROM (
    SELECT upload_id, gap, row_number() OVER (PARTITION BY upload_id ORDER BY count(*) DESC, gap) AS rn
    FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2) WHERE rn = 1),
steps AS (
  SELECT upload_id, modal_gap, round(count(*) FILTER (gap = modal_gap) * 100.0 / count(*), 2) AS consistency,
         count(*) FILTER (gap > modal_gap) AS gap_n
  FROM gaps JOIN modal USING (upload_id) WHERE gap IS NOT NULL GROUP BY 1, 2),
facts AS (
  SELECT b.*, modal_gap, consistency, gap_n, (epoch(e) - epoch(s)) / 86400.0 AS days,
    CASE WHEN invalid_n > 0 THEN 'Found ' || invalid_n || ' invalid unparseable timestamps.'
         WHEN missing_n > 0 THEN 'Found ' || missing_n || ' missing timestamps.'
         ELSE nullif(concat_ws(' | ',
           CASE WHEN bad_n > 0 THEN 'Found ' || bad_n || ' invalid non-numeric energy values.' END,
           CASE WHEN negative_n > 0 THEN 'Found ' || negative_n || ' negative energy consumption values.' END), '') END AS err
  FROM base b LEFT JOIN steps USING (upload_id)),
verdict AS (
  SELECT *, CASE WHEN err IS NOT NULL THEN 'Unknown' WHEN days < 7 THEN 'Insufficient history' WHEN days < 30 THEN 'Basic'
                 WHEN days < 90 THEN 'Good' ELSE 'Strong' END AS ready,
    concat_ws(' | ',
      CASE WHEN invalid_n = 0 AND missing_n = 0 AND dup_n > 0 THEN dup_n || ' duplicate timestamps detected.' END,
      CASE WHEN err IS NULL AND consistency < 100 THEN 'Sampling consistency is ' ||
           regexp_replace(printf('%.2f', consistency), '\\.?0+$', '') || '%.' END,
      CASE WHEN err IS NULL AND gap_n > 0 THEN gap_n || ' timestamp gaps detected.' END,
      CASE WHEN err IS NULL AND days < 7 THEN 'Insufficient history for forecasting (less than 7 days).' END) AS warn
  FROM facts),
report AS (
  SELECT upload_id, user_id, CASE WHEN err IS NOT NULL THEN 'INVALID' WHEN warn <> '' THEN 'VALID_WITH_WARNINGS' ELSE 'VALID' END AS status,
    records, CASE WHEN invalid_n = 0 AND missing_n = 0 THEN s END AS start_ts,
    CASE WHEN invalid_n = 0 AND missing_n = 0 THEN e END AS end_ts,
    CASE WHEN err IS NULL THEN coalesce(printf('%d days %02d:%02d:%02d', modal_gap // 86400, modal_gap % 86400 // 3600,
         modal_gap % 3600 // 60, modal_gap % 60), 'N/A') END AS detected_interval,
    CASE WHEN err IS NULL THEN modal_gap END AS interval_seconds, ready AS forecasting_readiness,
    warn AS warnings, coalesce(err, '') AS errors
  FROM verdict)
"""


@query("s9_catalog_append", needs="readings", sql=VALIDATE_SQL + """
SELECT upload_id AS id, r.user_id, upload_id || '.csv' AS file_name,
       r.user_id || '/' || upload_id || '/' || upload_id || '.csv' AS storage_path, 'text/csv' AS file_type,
       f.file_size, CAST(records AS INTEGER) AS record_count,
       CAST(coalesce(round_even(interval_seconds / 60.0, 0), 60) AS INTEGER) AS interval_minutes, start_ts AS start_timestamp,
       end_ts AS end_timestamp, status AS validation_status, 'PENDING' AS analysis_status
FROM report r JOIN (SELECT upload_id, CAST(sum(length(coalesce(txt, '')) + length(val)) AS BIGINT) AS file_size
                    FROM uploads GROUP BY 1) f USING (upload_id)
WHERE status <> 'INVALID'""")
def _(t: Tables) -> DataFrame:
    rows = upload_rows(t)
    size = F.sum(F.length(F.coalesce("timestamp", F.lit(""))) + F.length("energy_consumption"))
    files = rows.groupBy("upload_id", "user_id").agg(size.alias("file_size")).withColumn(
        "file_name", F.concat("upload_id", F.lit(".csv")))
    return stored(t, catalog_append(files, validate_uploads(rows))).snapshot()


@query("s10_catalog_delete", needs="catalog", sql="""
SELECT c.id, c.user_id, CASE WHEN k.c_custkey IS NULL THEN 'kept' ELSE 'deleted' END AS outcome
FROM catalog c LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') k ON c.user_id = k.c_custkey""")
def _(t: Tables) -> DataFrame:
    store = stored(t, t.catalog())
    leaving = t.table("customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    deleted = store.delete(store.snapshot().join(leaving, "user_id"), 2)
    kept = store.snapshot()
    return kept.select("id", "user_id", F.lit("kept").alias("outcome")).unionByName(
        deleted.select("id", "user_id", F.lit("deleted").alias("outcome")))
