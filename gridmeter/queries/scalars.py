from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter import functions as fn
from gridmeter.functions.scalars import MONTH_NAMES
from gridmeter.queries.registry import Tables, query
from gridmeter.queries.sources import meter_log, upload_rows

K = "event_id"


@query("p1_build_timestamp", needs="readings", sql="""
SELECT series_id, event_id, date_trunc('second', ts) AS ts FROM readings""")
def _(t: Tables) -> DataFrame:
    return fn.with_timestamp(meter_log(t)).select("series_id", "event_id", "ts")


FORMATS = {"view": "yyyy-MM-dd HH:mm:ss", "click": "MM/dd/yyyy HH:mm", "purchase": "dd.MM.yyyy", "signup": "yyyy/MM/dd'T'HH:mm"}


@query("p2_parse_timestamp", needs="readings", sql="""
, texts AS (SELECT event_id, CASE series_id WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 'click' THEN strftime(ts, '%m/%d/%Y %H:%M') WHEN 'purchase' THEN strftime(ts, '%d.%m.%Y')
    WHEN 'signup' THEN strftime(ts, '%Y/%m/%dT%H:%M') ELSE 'at ' || strftime(ts, '%Y') END AS txt FROM readings)
SELECT event_id, txt, coalesce(try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%Y/%m/%dT%H:%M'),
       try_strptime(txt, '%m/%d/%Y %H:%M'), try_strptime(txt, '%m.%d.%Y'), try_strptime(txt, '%d.%m.%Y')) AS ts FROM texts""")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("at "), F.date_format("ts", "yyyy"))
    for kind, fmt in FORMATS.items():
        text = F.when(F.col("series_id") == kind, F.date_format("ts", fmt)).otherwise(text)
    return t.readings().select(K, text.alias("txt")).withColumn("ts", fn.parse_ts(F.col("txt")))


@query("p3_kw_to_kwh", needs="readings", doubles="energy", sql="SELECT event_id, energy_kwh / 60 AS energy FROM readings")
def _(t: Tables) -> DataFrame:
    return t.readings().select(K, fn.kw_to_kwh(F.col("energy_kwh")).alias("energy"))


@query("p4_eda_calendar", needs="readings", sql="""
SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, CAST(month(ts) AS INTEGER) AS month,
       CAST(dayofweek(ts) + 1 AS INTEGER) AS dayofweek_num, dayname(ts) AS day_name,
       CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) < 6 THEN 'Spring' WHEN month(ts) < 9 THEN 'Summer'
            ELSE 'Autumn' END AS season FROM readings""")
def _(t: Tables) -> DataFrame:
    return fn.with_eda_calendar(t.readings()).select(
        K, "date", "hour", "month", "dayofweek_num", "day_name", "is_weekend", "season")


CALENDAR_SQL = """
, dated AS (SELECT o_orderkey, o_orderdate AS ts, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(day(o_orderdate) AS INTEGER) AS day, CAST(day(o_orderdate) AS INTEGER) AS day_of_month,
       CAST((dayofweek(o_orderdate) + 6) % 7 AS INTEGER) AS day_of_week, CAST(hour(o_orderdate) AS INTEGER) AS hour,
       CAST(weekofyear(o_orderdate) AS INTEGER) AS week_of_year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
       CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend FROM orders)
"""


def _dated(t: Tables) -> DataFrame:
    orders = t.table("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return fn.with_feature_calendar(orders)


@query("p5_feature_calendar", needs="readings", sql=CALENDAR_SQL + "SELECT * FROM dated")
def _(t: Tables) -> DataFrame:
    return _dated(t)


@query("p6_cyclical", needs="readings", doubles="hour_sin hour_cos dow_sin dow_cos month_sin month_cos", sql=CALENDAR_SQL + """
SELECT o_orderkey, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
       sin(2 * pi() * day_of_week / 7) AS dow_sin, cos(2 * pi() * day_of_week / 7) AS dow_cos,
       sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos FROM dated""")
def _(t: Tables) -> DataFrame:
    names = [f"{p}_{f}" for p in ("hour", "dow", "month") for f in ("sin", "cos")]
    return fn.with_cyclical(_dated(t)).select("o_orderkey", *names)


@query("p7_interactions", needs="readings", sql="""
SELECT event_id, CAST(hour(ts) * ((dayofweek(ts) + 6) % 7) AS INTEGER) AS hour_x_dow,
       CAST(hour(ts) * CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS hour_x_weekend,
       CAST(month(ts) * hour(ts) AS INTEGER) AS month_x_hour,
       CAST(((dayofweek(ts) + 6) % 7) * month(ts) AS INTEGER) AS dow_x_month FROM readings""")
def _(t: Tables) -> DataFrame:
    return fn.with_interactions(fn.with_feature_calendar(t.readings()), "day_of_week").select(
        K, "hour_x_dow", "hour_x_weekend", "month_x_hour", "dow_x_month")


@query("p8_non_negative", needs="readings", doubles="energy", sql="""
SELECT event_id, CASE WHEN k >= 10 THEN greatest(energy_kwh - 20, 0.0) END AS energy FROM readings""")
def _(t: Tables) -> DataFrame:
    shifted = F.when(F.col("k") >= 10, F.col("energy_kwh") - 20)
    return t.readings().select(K, fn.non_negative(shifted).alias("energy"))


@query("p9_demand_class", needs="readings", sql="""
SELECT event_id, CASE WHEN k < 10 THEN 'normal' WHEN energy_kwh >= 60 THEN 'critical' WHEN energy_kwh >= 40 THEN 'high'
       ELSE 'normal' END AS demand_level FROM readings""")
def _(t: Tables) -> DataFrame:
    known = F.when(F.col("k") >= 10, F.col("energy_kwh"))
    return t.readings().select(K, fn.demand_class(known, F.lit(40.0), F.lit(60.0)).alias("demand_level"))


TOU_SQL = """CASE WHEN hour(ts) BETWEEN 17 AND 21 THEN 'peak' WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 'off_peak' ELSE 'normal' END"""


@query("p10_tariff_period_rate", needs="readings", sql=f"""
SELECT event_id, {TOU_SQL} AS tou_period, CASE {TOU_SQL} WHEN 'peak' THEN 10.0 WHEN 'off_peak' THEN 3.0 ELSE 6.0 END::DOUBLE AS rate
FROM readings""")
def _(t: Tables) -> DataFrame:
    hour = F.hour("ts")
    return t.readings().select(K, fn.tou_period(hour).alias("tou_period"), fn.tou_rate(hour).alias("rate"))


@query("p10_user_tariff_table", needs="readings", doubles="rate", sql="""
, rates AS (SELECT hour(ts) AS h, avg(k) AS rate FROM readings GROUP BY 1)
SELECT event_id, CASE WHEN h < 12 THEN 'early' ELSE 'late' END AS tou_period, rate FROM readings JOIN rates ON hour(ts) = h""")
def _(t: Tables) -> DataFrame:
    readings = t.readings()
    table = readings.groupBy(F.hour("ts").alias("hour")).agg(F.avg("k").alias("rate")).withColumn(
        "tou_period", F.when(F.col("hour") < 12, "early").otherwise("late"))
    return fn.with_rate_table(readings, table).select(K, "tou_period", "rate")


@query("p11_day_band", needs="readings", sql="""
SELECT event_id, ['Night (00-06)', 'Morning (06-12)', 'Afternoon (12-18)', 'Evening (18-24)'][hour(ts) // 6 + 1] AS day_band
FROM readings""")
def _(t: Tables) -> DataFrame:
    return t.readings().select(K, fn.day_band(F.hour("ts")).alias("day_band"))


@query("p12_coerce_number", needs="readings", sql="""
SELECT user_id || '-' || series_id AS upload_id, count(*) AS n_rows,
       count(*) FILTER (series_id = 'click' AND k < 5) AS invalid_values,
       CAST(sum(CASE WHEN series_id = 'click' AND k < 5 THEN NULL WHEN series_id = 'click' AND k > 95
                THEN -CAST(energy_kwh AS DECIMAL(18,2)) ELSE CAST(energy_kwh AS DECIMAL(18,2)) END) AS DOUBLE) AS total
FROM readings GROUP BY 1""", doubles="total")
def _(t: Tables) -> DataFrame:
    text = F.col("energy_consumption")
    value = fn.coerce_double(text)
    return upload_rows(t).groupBy("upload_id").agg(
        F.count("*").alias("n_rows"), F.count_if(text.isNotNull() & value.isNull()).alias("invalid_values"),
        F.sum(value.cast("decimal(18,2)")).cast("double").alias("total"))


@query("p13_format_timedelta", needs="readings", sql="""
, secs AS (SELECT event_id, CAST(epoch(ts) AS BIGINT) - 1704067200 AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM readings))
SELECT event_id, printf('%d days %02d:%02d:%02d', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60) AS span FROM secs""")
def _(t: Tables) -> DataFrame:
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return t.readings().select(K, fn.format_timedelta(seconds).alias("span"))


@query("p14_format_timestamp", needs="readings", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS spaced, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM readings""")
def _(t: Tables) -> DataFrame:
    return t.readings().select(K, fn.fmt_ts(F.col("ts")).alias("spaced"), fn.fmt_ts(F.col("ts"), "T").alias("iso"))


@query("p15_flat_cost", needs="readings", doubles="cost", sql="SELECT event_id, energy_kwh * 7.0 AS cost FROM readings")
def _(t: Tables) -> DataFrame:
    return t.readings().select(K, fn.flat_cost(F.col("energy_kwh")).alias("cost"))


@query("p16_log_transform", needs="readings", doubles="logged restored clamped", sql="""
SELECT event_id, ln(1 + energy_kwh) AS logged, energy_kwh AS restored,
       greatest(0.0, exp(ln(1 + energy_kwh) - 2) - 1) AS clamped FROM readings""")
def _(t: Tables) -> DataFrame:
    logged = fn.to_log(F.col("energy_kwh"))
    return t.readings().select(
        K, logged.alias("logged"), fn.from_log(logged).alias("restored"), fn.from_log(logged - 2).alias("clamped"))


def _periods(t: Tables) -> DataFrame:
    """Period texts of orders: months, years, or something unreadable, by order status."""
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy")).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM")
    ).otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-Q"), F.quarter("o_orderdate").cast("string")))
    return t.table("orders").select("o_orderkey", text.alias("period"))


PERIOD_SQL = """
, asked AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m')
       ELSE year(o_orderdate) || '-Q' || quarter(o_orderdate) END AS period FROM orders),
starts AS (SELECT *, CASE WHEN length(period) = 4 THEN strptime(period || '-01-01', '%Y-%m-%d')
       WHEN period NOT LIKE '%Q%' THEN strptime(period || '-01', '%Y-%m-%d') END AS s,
       CASE WHEN length(period) = 4 THEN 12 ELSE 1 END AS months FROM asked)
"""


@query("p17_period_bounds", needs="readings", sql=PERIOD_SQL + """
SELECT o_orderkey, period, s AS period_start, s + to_months(months) - INTERVAL 1 SECOND AS period_end FROM starts""")
def _(t: Tables) -> DataFrame:
    return _periods(t).withColumn("_b", fn.period_bounds(F.col("period"))).select(
        "o_orderkey", "period", F.col("_b.start").alias("period_start"), F.col("_b.end").alias("period_end"))


@query("p18_previous_period", needs="readings", sql=PERIOD_SQL + """
SELECT o_orderkey, period, CASE WHEN length(period) = 4 THEN strftime(s - INTERVAL 1 YEAR, '%Y')
       ELSE strftime(s - INTERVAL 1 MONTH, '%Y-%m') END AS previous_period FROM starts""")
def _(t: Tables) -> DataFrame:
    return _periods(t).withColumn("previous_period", fn.previous_period(F.col("period")))


@query("p19_bill_month_key", needs="readings", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE monthname(o_orderdate) || ' ' || year(o_orderdate) END AS bill_date,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) END AS month_key FROM orders""")
def _(t: Tables) -> DataFrame:
    return bill_dates(t).select("o_orderkey", "bill_date").withColumn("month_key", fn.bill_month_key(F.col("bill_date")))


def bill_dates(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    label = F.concat_ws(" ", F.element_at(names, F.month("o_orderdate")), F.year("o_orderdate").cast("string"))
    return t.table("orders").withColumn("bill_date", F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(label))


@query("p20_name_filters", needs="catalog", sql="""
SELECT id, CASE WHEN record_count > 1 THEN upper(file_name) ELSE file_name || '.bak' END AS file_name, record_count > 1 AS valid_name,
       NOT contains(id, '-1') AS valid_id FROM catalog""")
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("record_count") > 1, F.upper("file_name")).otherwise(F.concat("file_name", F.lit(".bak")))
    # Ids that end in the code 1 get a slash, which no identifier may contain.
    shape = F.when(F.col("id").contains("-1"), F.replace("id", F.lit("-"), F.lit("/"))).otherwise(F.col("id"))
    return t.catalog().select(
        "id", name.alias("file_name"), fn.valid_upload_name(name).alias("valid_name"), fn.uuid_like(shape).alias("valid_id"))
