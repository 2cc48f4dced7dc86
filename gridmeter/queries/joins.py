from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.operators import households as h
from gridmeter.operators.evaluate import before_after, best_by, improvement_vs_naive, regression_metrics
from gridmeter.operators.features import align_to
from gridmeter.operators.rollup import index_report
from gridmeter.operators.bills import bill_comparison, bills_newest_first
from gridmeter.queries.forecasting import EVALUATED_SQL, evaluated
from gridmeter.queries.registry import Tables, query
from gridmeter.queries.scalars import bill_dates
from gridmeter.session import cut_lineage
from gridmeter.sources import catalog_select


@query("j1_complete_index", needs="grid", doubles="energy_kwh avg_k", sql="SELECT * FROM grid")
def _(t: Tables) -> DataFrame:
    return t.grid()


@query("j1_index_report", needs="hourly", sql="""
SELECT series_id, date_diff('hour', min(ts), max(ts)) + 1 AS expected_hours, count(*) AS actual_hours,
       date_diff('hour', min(ts), max(ts)) + 1 - count(*) AS missing_hours FROM hourly GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return index_report(t.hourly())


@query("j2_align_to_keys", needs="clean", doubles="energy_kwh avg_k", sql="""
, keys AS (SELECT DISTINCT series_id, date_trunc('hour', ts) + INTERVAL 12 HOUR AS ts FROM readings)
SELECT k.series_id, k.ts, c.energy_kwh, c.avg_k FROM keys k LEFT JOIN clean c ON c.series_id = k.series_id AND c.ts = k.ts""")
def _(t: Tables) -> DataFrame:
    half_day = (F.date_trunc("hour", "ts") + F.expr("INTERVAL 12 HOURS")).alias("ts")
    keys = t.readings().select("series_id", half_day).distinct()
    return align_to(keys, t.clean().select("series_id", "ts", "energy_kwh", "avg_k"))


MODELS_SQL = EVALUATED_SQL.rstrip() + """,
metrics AS (SELECT series_id, model, horizon, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  avg(CASE WHEN actual > 1e-8 THEN abs((actual - predicted) / actual) END) * 100 AS mape,
  1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r2, count(*) AS prediction_count FROM models GROUP BY 1, 2, 3)
"""


@query("j3_improvement_vs_naive", needs="clean", digits=6, doubles="mae rmse mape r2 mae_improvement_vs_naive rmse_improvement_vs_naive "
       "mape_improvement_vs_naive", sql=MODELS_SQL + """
SELECT m.*, (n.mae - m.mae) / n.mae * 100 AS mae_improvement_vs_naive, (n.rmse - m.rmse) / n.rmse * 100 AS rmse_improvement_vs_naive,
       (n.mape - m.mape) / n.mape * 100 AS mape_improvement_vs_naive
FROM metrics m JOIN metrics n ON n.model = 'Naive' AND n.series_id = m.series_id AND n.horizon = m.horizon""")
def _(t: Tables) -> DataFrame:
    return improvement_vs_naive(regression_metrics(evaluated(t)))


@query("j4_before_after", needs="clean", digits=6, doubles="original_mae original_rmse original_r2 optimized_mae optimized_rmse optimized_r2",
       sql=MODELS_SQL + """
SELECT a.series_id, a.horizon, a.mae AS original_mae, a.rmse AS original_rmse, a.r2 AS original_r2, b.mae AS optimized_mae,
       b.rmse AS optimized_rmse, b.r2 AS optimized_r2
FROM metrics a JOIN metrics b ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.model = 'Naive' AND b.model = 'SARIMA'""")
def _(t: Tables) -> DataFrame:
    metrics = regression_metrics(evaluated(t))
    return before_after(metrics.filter("model = 'Naive'"), metrics.filter("model = 'SARIMA'"))


@query("o4_best_model", needs="clean", digits=6, doubles="best_rmse", sql=MODELS_SQL + """
SELECT series_id, horizon, model AS best_model, rmse AS best_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY rmse, model) AS rn FROM metrics) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return best_by(regression_metrics(evaluated(t)), ["series_id", "horizon"])


@query("u1_union_predictions", needs="clean", doubles="actual predicted", sql=MODELS_SQL + """
SELECT series_id, model, horizon, count(*) AS n_rows, avg(actual) AS actual, avg(predicted) AS predicted FROM models GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rows = evaluated(t).filter("actual IS NOT NULL AND predicted IS NOT NULL")
    return rows.groupBy("series_id", F.substring_index("model", "_", 1).alias("model"), "horizon").agg(
        F.count("*").alias("n_rows"), F.avg("actual").alias("actual"), F.avg("predicted").alias("predicted"))


@query("u2_distinct_keys", needs="naive", sql="SELECT DISTINCT model, horizon FROM naive")
def _(t: Tables) -> DataFrame:
    return t.predictions().select("model", "horizon").distinct()


# --- uploads and periods ------------------------------------------------------------------------------------------
def requests(t: Tables) -> DataFrame:
    """Periods users ask for: all years and months in which they have an order."""
    orders = t.table("orders")
    months = orders.select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    years = orders.select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy").alias("period"))
    return months.unionByName(years).distinct()


REQUESTS_SQL = """
, requests AS (SELECT DISTINCT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS period FROM orders
  UNION SELECT o_custkey, strftime(o_orderdate, '%Y') FROM orders)
"""


@query("j6_uploads_in_period", needs="catalog", sql=REQUESTS_SQL + """
, bounded AS (SELECT *, CASE WHEN length(period) = 4 THEN strptime(period || '-01-01', '%Y-%m-%d') ELSE strptime(period || '-01', '%Y-%m-%d') END AS s,
                        CASE WHEN length(period) = 4 THEN 12 ELSE 1 END AS months FROM requests),
ranged AS (SELECT *, s + to_months(months) - INTERVAL 1 SECOND AS e FROM bounded)
SELECT r.user_id, r.period, c.id, r.s AS p_start, r.e AS p_end FROM ranged r JOIN catalog c ON c.user_id = r.user_id
WHERE c.start_timestamp <= r.e AND c.end_timestamp >= r.s""")
def _(t: Tables) -> DataFrame:
    return h.uploads_in_period(t.catalog(), requests(t))


def event_requests(t: Tables) -> DataFrame:
    return t.events().select("user_id", F.date_format("ts", "yyyy-MM").alias("period")).distinct()


@query("j7_user_period_data", needs="ecatalog euploads", doubles="energy_kwh", sql="""
SELECT c.user_id, strftime(u.ts, '%Y-%m') AS period, u.ts, avg(u.energy_kwh) AS energy_kwh
FROM euploads u JOIN ecatalog c ON c.id = u.id GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    catalog = t.event_catalog()
    return h.user_period_data(h.merge_uploads(t.readings("user_id").drop("k"), catalog, scale=9), catalog, event_requests(t))


@query("j7_merged_readings", needs="merged", digits=5, doubles="energy_kwh", sql="SELECT user_id, ts, energy_kwh FROM merged")
def _(t: Tables) -> DataFrame:
    return h.merge_uploads(t.upload_readings(), t.catalog(), scale=9)


@query("j8_user_periods", needs="listed", sql="""
, m AS (SELECT user_id, month FROM listed),
y AS (SELECT user_id, string_agg(yr, ' ' ORDER BY yr DESC) AS years FROM (SELECT DISTINCT user_id, substr(month, 1, 4) AS yr FROM m) GROUP BY 1),
l AS (SELECT user_id, strftime(end_timestamp, '%Y-%m') AS latest_period, id AS latest_upload_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY end_timestamp DESC, id) AS rn FROM catalog) WHERE rn = 1)
SELECT user_id, string_agg(month, ' ' ORDER BY month DESC) AS periods, any_value(years) AS years, any_value(latest_period) AS latest_period,
       any_value(latest_upload_id) AS latest_upload_id FROM m JOIN y USING (user_id) JOIN l USING (user_id) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return h.user_periods(t.catalog()).withColumns({"periods": F.array_join("periods", " "), "years": F.array_join("years", " ")})


@query("j9_period_comparison", needs="totals", digits=5, doubles="consumption_kwh cost cost_difference cost_change_percent "
       "consumption_change_percent", sql="""
, keyed AS MATERIALIZED (SELECT *, CASE WHEN length(period) = 4 THEN CAST(CAST(period AS INTEGER) - 1 AS VARCHAR)
       ELSE strftime(strptime(period || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') END AS prev FROM totals)
SELECT a.user_id, a.period, a.consumption_kwh, a.cost, b.period AS previous_period, a.cost - b.cost AS cost_difference,
       CASE WHEN b.cost > 0 THEN (a.cost - b.cost) / b.cost * 100 WHEN b.cost IS NOT NULL THEN 0.0 END AS cost_change_percent,
       CASE WHEN b.consumption_kwh > 0 THEN (a.consumption_kwh - b.consumption_kwh) / b.consumption_kwh * 100
            WHEN b.consumption_kwh IS NOT NULL THEN 0.0 END AS consumption_change_percent
FROM keyed a LEFT JOIN totals b ON b.user_id = a.user_id AND b.period = a.prev""")
def _(t: Tables) -> DataFrame:
    catalog = t.catalog()
    return h.period_comparison(h.period_totals(h.merge_uploads(t.upload_readings(), catalog, scale=9), catalog))


@query("j10_owned_uploads", needs="catalog", sql="""
SELECT id, user_id FROM catalog c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.user_id
       AND c.id = o.o_custkey || '-' || substr(o.o_orderpriority, 1, 1))""")
def _(t: Tables) -> DataFrame:
    asked = t.table("orders").select(
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)).alias("id"),
        F.col("o_custkey").alias("user_id"))
    return h.owned_by(t.catalog(), asked).select("id", "user_id")


def bills(t: Tables) -> DataFrame:
    """Stored bills of users: the cost of the urgent orders of a month."""
    rows = bill_dates(t).filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("bill_date") != "unknown"))
    return rows.groupBy(F.col("o_custkey").alias("user_id"), "bill_date").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cost"))


BILLS_SQL = """
, dated AS (SELECT o_custkey AS user_id, monthname(o_orderdate) || ' ' || year(o_orderdate) AS bill_date, o_totalprice, o_orderpriority,
                   year(o_orderdate) * 12 + month(o_orderdate) AS key FROM orders WHERE o_orderstatus <> 'P'),
bills AS (SELECT user_id, bill_date, key, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM dated
          WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2, 3)
"""


@query("j11_new_bills", needs="readings", sql=BILLS_SQL + """
, incoming AS (SELECT DISTINCT user_id, bill_date FROM dated WHERE o_orderpriority <> '1-URGENT')
SELECT i.user_id, i.bill_date, CASE WHEN b.user_id IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome
FROM incoming i LEFT JOIN bills b ON b.user_id = i.user_id AND b.bill_date = i.bill_date""")
def _(t: Tables) -> DataFrame:
    incoming = bill_dates(t).filter((F.col("o_orderpriority") != "1-URGENT") & (F.col("bill_date") != "unknown")).select(
        F.col("o_custkey").alias("user_id"), "bill_date").distinct()
    accepted, rejected = h.new_bills(incoming, bills(t))
    return accepted.withColumn("outcome", F.lit("accepted")).unionByName(rejected.withColumn("outcome", F.lit("rejected")))


@query("o5_bills_newest_first", needs="readings", sql=BILLS_SQL + """
SELECT user_id, bill_date, CAST(row_number() OVER (PARTITION BY user_id ORDER BY key DESC) AS INTEGER) AS position FROM bills""")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = bills(t)
    newest = Window.partitionBy("user_id").orderBy(*bills_newest_first(rows))
    return rows.select("user_id", "bill_date", F.row_number().over(newest).alias("position")).orderBy("user_id", "position")


@query("o5_catalog_newest_first", needs="catalog", sql="SELECT id, user_id, created_at FROM catalog ORDER BY created_at DESC, id")
def _(t: Tables) -> DataFrame:
    return catalog_select(t.catalog(), columns=["id", "user_id", "created_at"], order=[F.desc("created_at"), "id"])


@query("b8_bill_comparison", needs="readings", digits=2, doubles="cost_difference", sql=BILLS_SQL + """
, r AS (SELECT *, row_number() OVER w AS rn, lead(cost) OVER w AS prev, lead(bill_date) OVER w AS prev_date FROM bills
        WINDOW w AS (PARTITION BY user_id ORDER BY key DESC))
SELECT user_id, bill_date AS latest_date, prev_date AS previous_date, cost - prev AS cost_difference,
       round((cost - prev) / prev * 100, 1) AS change_percent, CASE WHEN cost > prev THEN 'higher' ELSE 'lower' END AS direction
FROM r WHERE rn = 1 AND prev IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return bill_comparison(bills(t))


# --- dashboards ---------------------------------------------------------------------------------------------------
@query("g9_dashboard_month", needs="ecatalog euploads", doubles="energy_kwh cost", sql="""
, m AS (SELECT c.user_id, strftime(u.ts, '%Y-%m') AS period, u.ts, avg(u.energy_kwh) AS kwh FROM euploads u JOIN ecatalog c ON c.id = u.id GROUP BY 1, 2, 3),
d AS (SELECT user_id, period, 'total' AS section, period AS label, sum(kwh) AS energy_kwh FROM m GROUP BY 1, 2
  UNION ALL SELECT user_id, period, 'daily', strftime(ts, '%Y-%m-%d'), sum(kwh) FROM m GROUP BY 1, 2, 4
  UNION ALL SELECT user_id, period, 'hourly', strftime(ts, '%H:00'), avg(kwh) FROM m GROUP BY 1, 2, 4),
asked AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m') AS asked_period FROM events
  UNION SELECT user_id, strftime(ts + INTERVAL 1 YEAR, '%Y-%m') FROM events),
l AS (SELECT user_id, strftime(max(end_timestamp), '%Y-%m') AS latest FROM ecatalog GROUP BY 1),
shown AS (SELECT a.user_id, asked_period, CASE WHEN h.period IS NULL THEN latest ELSE h.period END AS period FROM asked a JOIN l USING (user_id)
  LEFT JOIN (SELECT DISTINCT user_id, period FROM m) h ON h.user_id = a.user_id AND h.period = asked_period)
SELECT s.user_id, asked_period, s.period, section, label, energy_kwh, energy_kwh * 7.0 AS cost
FROM shown s JOIN d ON d.user_id = s.user_id AND d.period = s.period""")
def _(t: Tables) -> DataFrame:
    catalog, asked = t.event_catalog(), event_requests(t)
    later = t.events().select("user_id", F.date_format(F.add_months("ts", 12), "yyyy-MM").alias("period")).distinct()
    merged = h.merge_uploads(t.readings("user_id").drop("k"), catalog, scale=9)
    return h.dashboard_month(merged, catalog, asked.unionByName(later))


@query("g10_dashboard_year", needs="totals latest", digits=5, doubles="consumption_kwh cost peak_consumption", sql="""
, asked AS (SELECT DISTINCT o_custkey AS user_id, strftime(o_orderdate + INTERVAL 1 YEAR, '%Y') AS asked_period FROM orders),
shown AS (SELECT a.user_id, asked_period, CASE WHEN t.period IS NULL THEN latest_period ELSE t.period END AS period
  FROM asked a JOIN latest l ON l.user_id = a.user_id LEFT JOIN totals t ON t.user_id = a.user_id AND t.period = asked_period)
SELECT s.user_id, s.asked_period, s.period, t.period AS month, t.consumption_kwh, t.cost,
       max(t.consumption_kwh) OVER w AS peak_consumption, count(*) OVER w AS months_with_data
FROM shown s JOIN totals t ON t.user_id = s.user_id AND length(t.period) = 7 AND s.period IN (t.period, substr(t.period, 1, 4))
WINDOW w AS (PARTITION BY s.user_id, s.asked_period)""")
def _(t: Tables) -> DataFrame:
    catalog = cut_lineage(t.catalog())
    totals = cut_lineage(h.period_totals(h.merge_uploads(t.upload_readings(), catalog, scale=9), catalog))
    following = F.date_format(F.add_months("o_orderdate", 12), "yyyy").alias("period")
    asked = t.table("orders").select(F.col("o_custkey").alias("user_id"), following)
    return h.dashboard_year(totals, h.user_periods(catalog), asked)


@query("g11_cost_analytics", needs="totals listed", digits=5, doubles="total_cost total_consumption average_monthly_cost highest_cost lowest_cost", sql="""
, months AS (SELECT l.user_id, l.month, t.cost, t.consumption_kwh, row_number() OVER (PARTITION BY l.user_id ORDER BY t.cost DESC NULLS LAST, l.month DESC) AS hi,
             row_number() OVER (PARTITION BY l.user_id ORDER BY t.cost NULLS LAST, l.month DESC) AS lo
  FROM (SELECT user_id, month FROM listed) l LEFT JOIN totals t ON t.user_id = l.user_id AND t.period = l.month)
SELECT user_id, coalesce(sum(cost), 0.0) AS total_cost, coalesce(sum(consumption_kwh), 0.0) AS total_consumption,
       coalesce(sum(cost), 0.0) / count(*) AS average_monthly_cost, max(month) FILTER (hi = 1) AS highest_cost_month, max(cost) AS highest_cost,
       max(month) FILTER (lo = 1) AS lowest_cost_month, min(cost) AS lowest_cost, count(*) AS months_analyzed FROM months GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    catalog = t.catalog()
    totals = h.period_totals(h.merge_uploads(t.upload_readings(), catalog, scale=9), catalog)
    return h.cost_analytics(totals, catalog)


