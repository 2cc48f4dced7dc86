from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.operators import features as f
from gridmeter.operators import split as sp
from gridmeter.operators.cleaning import fill_short_gaps, gap_islands
from gridmeter.operators.profiles import daily_consumption
from gridmeter.operators.stats import percentiles
from gridmeter.queries.registry import Tables, query

W = "(PARTITION BY series_id ORDER BY ts)"


def past(width: int) -> str:
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"


@query("w1_gap_islands", needs="islands", sql="""
SELECT series_id, ts, CAST(is_missing AS BIGINT) AS is_missing, gap_group, gap_size, CASE WHEN gap_size > 3 THEN 1 ELSE 0 END AS is_long_gap
FROM islands""")
def _(t: Tables) -> DataFrame:
    return gap_islands(t.grid()).select("series_id", "ts", "is_missing", "gap_group", "gap_size", "is_long_gap")


@query("w1_gap_islands_users", sql="""
WITH h AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1),
g AS (SELECT s.series_id, s.ts, n, count(n) OVER (PARTITION BY s.series_id ORDER BY s.ts) AS gap_group
      FROM s LEFT JOIN h ON h.series_id = s.series_id AND h.ts = s.ts)
SELECT series_id, gap_group, count(*) FILTER (n IS NULL) AS gap_size, min(ts) AS start_ts, max(ts) AS end_ts FROM g GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    islands = gap_islands(t.grid("user_id"))
    return islands.groupBy("series_id", "gap_group").agg(
        F.max("gap_size").alias("gap_size"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("w2_fill_short_gaps", needs="filled", doubles="energy_kwh avg_k", sql="SELECT * FROM filled")
def _(t: Tables) -> DataFrame:
    return fill_short_gaps(t.grid())


def _lag_sql(lags: list[int]) -> str:
    return ", ".join(f"lag(energy_kwh, {k}) OVER w AS lag_{k}" for k in lags)


def _names(prefix: str, ks: list[int]) -> str:
    return " ".join(f"{prefix}_{k}" for k in ks)


@query("w3_basic_lags", needs="clean", digits=6, doubles="energy_kwh " + _names("lag", f.BASIC_LAGS),
       sql=f"SELECT series_id, ts, energy_kwh, {_lag_sql(f.BASIC_LAGS)} FROM clean WINDOW w AS {W}")
def _(t: Tables) -> DataFrame:
    return f.with_lags(t.clean().select("series_id", "ts", "energy_kwh"))


ROLLING_SQL = ", ".join([f"avg(energy_kwh) OVER {past(w)} AS rolling_mean_{w}" for w in f.BASIC_ROLLING] + [
    f"stddev_samp(energy_kwh) OVER {past(24)} AS rolling_std_24", f"min(energy_kwh) OVER {past(24)} AS rolling_min_24",
    f"max(energy_kwh) OVER {past(24)} AS rolling_max_24"])
ROLLING_NAMES = _names("rolling_mean", f.BASIC_ROLLING) + " rolling_std_24 rolling_min_24 rolling_max_24"


@query("w4_rolling_lenient", needs="grid", digits=6, doubles="energy_kwh " + ROLLING_NAMES,
       sql=f"SELECT series_id, ts, energy_kwh, {ROLLING_SQL} FROM grid")
def _(t: Tables) -> DataFrame:
    return f.with_rolling(t.grid().select("series_id", "ts", "energy_kwh"))


@query("w5_trend_flags", needs="p90", digits=6, doubles="trend_3h trend_24h", sql=f"""
, l AS (SELECT series_id, ts, {_lag_sql([1, 3, 24])} FROM clean WINDOW w AS {W})
SELECT series_id, ts, lag_1 - lag_3 AS trend_3h, lag_1 - lag_24 AS trend_24h,
       CASE WHEN lag_1 >= p90 THEN 1 ELSE 0 END AS is_high_demand_previous_hour FROM l JOIN p90 USING (series_id)""")
def _(t: Tables) -> DataFrame:
    clean = t.clean().select("series_id", "ts", "energy_kwh")
    lagged = f.with_lags(clean, [1, 3, 24]).join(percentiles(clean, {"p90": 0.9}), "series_id")
    return f.with_trend(lagged).select("series_id", "ts", "trend_3h", "trend_24h", "is_high_demand_previous_hour")


_CAL = """CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  CAST(day(ts) AS INTEGER) AS day_of_month, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(weekofyear(ts) AS INTEGER) AS week_of_year, CAST(quarter(ts) AS INTEGER) AS quarter,
  CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend"""
_CYC = """sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7) AS dow_sin, cos(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7) AS dow_cos,
  sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos"""
_CYC_NAMES = "hour_sin hour_cos dow_sin dow_cos month_sin month_cos"
BASIC_SQL = f""", basic AS (SELECT *, lag_1 - lag_3 AS trend_3h, lag_1 - lag_24 AS trend_24h,
    CASE WHEN lag_1 >= p90 THEN 1 ELSE 0 END AS is_high_demand_previous_hour FROM (
  SELECT c.*, {_CAL}, {_CYC}, {_lag_sql(f.BASIC_LAGS)}, {ROLLING_SQL} FROM clean c WINDOW w AS {W}) JOIN p90 USING (series_id))
"""
BASIC_NAMES = f"energy_kwh avg_k {_CYC_NAMES} {_names('lag', f.BASIC_LAGS)} {ROLLING_NAMES} trend_3h trend_24h"


@query("w6_basic_features", needs="p90", digits=6, doubles=BASIC_NAMES, sql=BASIC_SQL + """
SELECT * EXCLUDE (p90) FROM basic WHERE lag_168 IS NOT NULL AND energy_kwh IS NOT NULL AND total_k IS NOT NULL AND
  lag_1 + lag_3 + lag_6 + lag_12 + lag_24 + lag_48 + lag_72 IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return t.features()


_BASIC_COLUMNS = (["series_id", "ts", "energy_kwh", "total_k", "avg_k", "is_long_gap", "is_energy_outlier", "year", "month", "day",
                   "day_of_month", "day_of_week", "hour", "week_of_year", "quarter", "is_weekend"] + _CYC_NAMES.split()
                  + [f"lag_{k}" for k in f.BASIC_LAGS] + ROLLING_NAMES.split() + ["trend_3h", "trend_24h", "is_high_demand_previous_hour"])


@query("w6_incomplete_report", needs="p90", sql=BASIC_SQL + ", n AS (SELECT series_id, " + " + ".join(
    f"({c} IS NULL)::INT" for c in _BASIC_COLUMNS) + """ AS nulls FROM basic)
SELECT series_id, count(*) AS input_records, count(*) FILTER (nulls = 0) AS output_records, count(*) FILTER (nulls > 0) AS rows_removed,
       CAST(sum(nulls) AS BIGINT) AS missing_values_before, CAST(0 AS BIGINT) AS missing_values_after FROM n GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return f.incomplete_report(f.basic_features(t.clean()))


@query("w7_advanced_lags", needs="grid", digits=6, doubles="energy_kwh " + _names("lag", f.ADVANCED_LAGS),
       sql=f"SELECT series_id, ts, energy_kwh, {_lag_sql(f.ADVANCED_LAGS)} FROM grid WINDOW w AS {W}")
def _(t: Tables) -> DataFrame:
    return f.advanced_lags(t.grid().select("series_id", "ts", "energy_kwh"))


def _strict(fn: str, w: int, name: str) -> str:
    return f"CASE WHEN count(energy_kwh) OVER {past(w)} = {w} THEN {fn} OVER {past(w)} END AS {name}_{w}"


STRICT_SQL = ", ".join([_strict("avg(energy_kwh)", w, "roll_mean") for w in f.STRICT_MEANS]
                       + [_strict("stddev_samp(energy_kwh)", w, "roll_std") for w in f.STRICT_DEVIATIONS])
STRICT_NAMES = _names("roll_mean", f.STRICT_MEANS) + " " + _names("roll_std", f.STRICT_DEVIATIONS)
ORDER_SQL = ", ".join(_strict(fn, w, name) for w in f.STRICT_ORDER for fn, name in (
    ("min(energy_kwh)", "roll_min"), ("max(energy_kwh)", "roll_max"), ("quantile_cont(energy_kwh, 0.5)", "roll_median")))
ORDER_NAMES = " ".join(f"{n}_{w}" for w in f.STRICT_ORDER for n in ("roll_min", "roll_max", "roll_median"))


@query("w8_rolling_strict", needs="grid", digits=6, doubles="energy_kwh " + STRICT_NAMES,
       sql=f"SELECT series_id, ts, energy_kwh, {STRICT_SQL} FROM grid")
def _(t: Tables) -> DataFrame:
    return f.strict_rolling(t.grid().select("series_id", "ts", "energy_kwh"))


@query("w9_rolling_order", needs="clean", digits=6, doubles="energy_kwh " + ORDER_NAMES,
       sql=f"SELECT series_id, ts, energy_kwh, {ORDER_SQL} FROM clean")
def _(t: Tables) -> DataFrame:
    return f.strict_rolling_order(t.clean().select("series_id", "ts", "energy_kwh"))


# The recursion itself in SQL: one row per hour, carrying mean and old weight.
EWM_SQL = """, numbered_rows AS (SELECT series_id, ts, energy_kwh, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM {src}),
ewm AS (WITH RECURSIVE r AS (
  SELECT series_id, ts, rn, span, 2.0::DOUBLE / (span + 1) AS alpha, energy_kwh AS mean, 1.0::DOUBLE AS old_weight
  FROM numbered_rows, (SELECT unnest([3, 6, 12, 24, 48]) AS span) WHERE rn = 1
  UNION ALL
  SELECT n.series_id, n.ts, n.rn, r.span, r.alpha,
    CASE WHEN n.energy_kwh IS NULL THEN r.mean WHEN r.mean IS NULL THEN n.energy_kwh
         ELSE (r.old_weight * (1 - r.alpha) * r.mean + r.alpha * n.energy_kwh) / (r.old_weight * (1 - r.alpha) + r.alpha) END,
    CASE WHEN n.energy_kwh IS NOT NULL OR r.mean IS NULL THEN 1.0::DOUBLE ELSE r.old_weight * (1 - r.alpha) END
  FROM r JOIN numbered_rows n ON n.series_id = r.series_id AND n.rn = r.rn + 1)
  SELECT series_id, rn + 1 AS rn, {pivot} FROM r GROUP BY 1, 2)
"""
EWM_PIVOT = ", ".join(f"max(mean) FILTER (span = {s}) AS ewm_{s}" for s in f.EWM_SPANS)
EWM_NAMES = _names("ewm", f.EWM_SPANS)


@query("w10_exponential_means", needs="grid", digits=6, doubles="energy_kwh " + EWM_NAMES, sql=EWM_SQL.format(src="grid", pivot=EWM_PIVOT) + """
SELECT n.series_id, n.ts, n.energy_kwh, """ + ", ".join(f"ewm_{s}" for s in f.EWM_SPANS) + """
FROM numbered_rows n LEFT JOIN ewm e ON e.series_id = n.series_id AND e.rn = n.rn""")
def _(t: Tables) -> DataFrame:
    return f.with_ewm(t.grid().select("series_id", "ts", "energy_kwh"))


_SAME = " + ".join(f"lag_{k}" for k in f.SAME_HOUR_LAGS)
HISTORY_SQL = f"""lag_1 - lag_2 AS trend_1h, lag_1 - lag_4 AS trend_3h, ({_SAME}) / 7 AS same_hour_avg_7d, ({_SAME}) / 7 AS same_hour_avg_14d,
  lag_36 + lag_48 AS prev_day_total, (lag_36 + lag_48) / 2 AS prev_day_mean,
  CASE WHEN lag_36 + lag_48 IS NOT NULL THEN greatest(lag_36, lag_48) END AS prev_day_max,
  CASE WHEN lag_36 + lag_48 IS NOT NULL THEN least(lag_36, lag_48) END AS prev_day_min,
  lag_168 AS prev_week_same_hour, lag_168 AS prev_week_same_hour_avg, CAST(lag_1 >= p90 AS INTEGER) AS is_peak_prev_hour"""
HISTORY_NAMES = ("trend_1h trend_3h same_hour_avg_7d same_hour_avg_14d prev_day_total prev_day_mean prev_day_max prev_day_min "
                 "prev_week_same_hour prev_week_same_hour_avg")


@query("w11_history_features", needs="grid", digits=6, doubles=HISTORY_NAMES, sql=f"""
, t AS (SELECT series_id, quantile_cont(energy_kwh, 0.9) AS p90 FROM grid GROUP BY 1),
l AS (SELECT series_id, ts, {_lag_sql(f.ADVANCED_LAGS)} FROM grid WINDOW w AS {W})
SELECT series_id, ts, {HISTORY_SQL} FROM l JOIN t USING (series_id)""")
def _(t: Tables) -> DataFrame:
    lagged = f.advanced_lags(t.grid().select("series_id", "ts", "energy_kwh"))
    rows = f.history_features(f.with_p90(lagged))
    return rows.select("series_id", "ts", *HISTORY_NAMES.split(), "is_peak_prev_hour")


ADVANCED_NAMES = (f"energy_kwh {_CYC_NAMES} {_names('lag', f.ADVANCED_LAGS)} {STRICT_NAMES} {ORDER_NAMES} {HISTORY_NAMES}")
ADVANCED_SQL = f""", windows AS (SELECT series_id, ts, energy_kwh, CAST(hour(ts) AS INTEGER) AS hour, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS dow,
    CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
    {_CYC}, {_lag_sql(f.ADVANCED_LAGS)}, {STRICT_SQL}, {ORDER_SQL}, row_number() OVER w AS rn FROM clean WINDOW w AS {W}),
advanced AS (SELECT w.*, CAST(hour * dow AS INTEGER) AS hour_x_dow, CAST(hour * is_weekend AS INTEGER) AS hour_x_weekend,
    CAST(month * hour AS INTEGER) AS month_x_hour, CAST(dow * month AS INTEGER) AS dow_x_month, {HISTORY_SQL}
  FROM windows w JOIN p90 USING (series_id))
"""


@query("w12_advanced_features", needs="p90", digits=6, doubles=f"{ADVANCED_NAMES} {EWM_NAMES}",
       sql=EWM_SQL.format(src="clean", pivot=EWM_PIVOT) + ADVANCED_SQL + """
SELECT a.* EXCLUDE (rn), """ + ", ".join(f"ewm_{s}" for s in f.EWM_SPANS) + """
FROM advanced a LEFT JOIN ewm e ON e.series_id = a.series_id AND e.rn = a.rn""")
def _(t: Tables) -> DataFrame:
    return f.advanced_features(t.clean().select("series_id", "ts", "energy_kwh"))


@query("w13_locf_zero", needs="grid", doubles="energy_kwh total_k avg_k", sql=f"""
SELECT series_id, ts, """ + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER {W}, 0) AS {c}" for c in ("energy_kwh", "total_k", "avg_k")) + " FROM grid")
def _(t: Tables) -> DataFrame:
    return f.locf_zero(t.grid())


DAILY_SQL = ", d AS (SELECT series_id, CAST(ts AS DATE) AS date, sum(energy_kwh) AS total_energy_kwh FROM {src} GROUP BY 1, 2)"
WEEK = "(PARTITION BY series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query("w14_weekly_mean_strict", needs="clean", doubles="total_energy_kwh rolling_7d", sql=DAILY_SQL.format(src="clean") + f"""
SELECT *, CASE WHEN count(total_energy_kwh) OVER {WEEK} = 7 THEN avg(total_energy_kwh) OVER {WEEK} END AS rolling_7d FROM d""")
def _(t: Tables) -> DataFrame:
    return f.ma7_strict(daily_consumption(t.clean()).select("series_id", "date", "total_energy_kwh"))


@query("w15_weekly_mean_partial", needs="ugrid", doubles="total_energy_kwh avg7", sql=DAILY_SQL.format(src="ugrid") + f"""
SELECT *, avg(total_energy_kwh) OVER {WEEK} AS avg7 FROM d""")
def _(t: Tables) -> DataFrame:
    return f.ma7_partial(daily_consumption(t.zero_filled()).select("series_id", "date", "total_energy_kwh"))


SPLIT_SQL = """, positions AS (SELECT series_id, ts, energy_kwh, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
  count(*) OVER (PARTITION BY series_id) AS n FROM clean WHERE energy_kwh IS NOT NULL AND total_k IS NOT NULL),
split AS (SELECT *, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM positions)
"""


def split_rows(t: Tables) -> DataFrame:
    known = t.clean().filter("energy_kwh IS NOT NULL AND total_k IS NOT NULL")
    return sp.chronological_split(known.select("series_id", "ts", "energy_kwh"))


@query("w16_direct_target", needs="clean", doubles="energy_kwh target", sql=SPLIT_SQL + """
SELECT series_id, ts, energy_kwh, pos, split, target FROM (
  SELECT *, lead(energy_kwh, 23) OVER (PARTITION BY series_id, split ORDER BY pos) AS target FROM split) WHERE target IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return sp.with_target(split_rows(t)).select("series_id", "ts", "energy_kwh", "pos", "split", "target")


@query("w17_chronological_split", needs="clean", doubles="energy_kwh", sql=SPLIT_SQL + "SELECT series_id, ts, energy_kwh, pos, split FROM split")
def _(t: Tables) -> DataFrame:
    return split_rows(t)


@query("w17_split_report", needs="clean", sql=SPLIT_SQL + """
SELECT series_id, split, count(*) AS n_rows, min(ts) AS start_ts, max(ts) AS end_ts FROM split GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return sp.split_report(split_rows(t))


@query("w18_series_tail", needs="ugrid", doubles="energy_kwh", sql="""
SELECT series_id, ts, energy_kwh FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM ugrid) WHERE rn <= 168""")
def _(t: Tables) -> DataFrame:
    return sp.tail_per_series(t.zero_filled(), 168)


@query("o1_chronological_order", needs="clean", doubles="energy_kwh", sql="SELECT series_id, ts, energy_kwh FROM clean ORDER BY series_id, ts")
def _(t: Tables) -> DataFrame:
    return t.clean().select("series_id", "ts", "energy_kwh").orderBy("series_id", "ts")
