"""Registration of queries, their input tables, and the shared parts of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.operators.cleaning import clean_hourly
from gridmeter.operators.features import basic_features, drop_incomplete, with_lags
from gridmeter.operators.forecast import naive
from gridmeter.operators.rollup import complete_index, hourly_rollup, hourly_zero_filled
from gridmeter.operators.stats import percentiles
from gridmeter.session import cut_lineage, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Input tables in the roles the operators expect: readings, hourly series, catalogs of uploads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder
        self._clean: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", k)

    def readings(self, series: str = "event_type") -> DataFrame:
        return self.events().select(
            F.col(series).alias("series_id"), "ts", "event_id", "user_id", F.col("value").alias("energy_kwh"), "k"
        )

    def hourly(self, series: str = "event_type") -> DataFrame:
        return hourly_rollup(self.readings(series), ["energy_kwh", "k"], ["k"], scale=9)

    def grid(self, series: str = "event_type") -> DataFrame:
        return complete_index(cut_lineage(self.hourly(series)))

    def clean(self, series: str = "event_type") -> DataFrame:
        """Settled once for all uses within a query."""
        if series not in self._clean:
            self._clean[series] = cut_lineage(clean_hourly(self.hourly(series), scale=9))
        return self._clean[series]

    def zero_filled(self, series: str = "user_id") -> DataFrame:
        return hourly_zero_filled(self.readings(series), scale=9)

    def features(self) -> DataFrame:
        return cut_lineage(drop_incomplete(basic_features(self.clean())))

    def predictions(self) -> DataFrame:
        """Naive predictions of the cleaned series, both horizons."""
        return naive(with_lags(self.clean(), [1, 24]))

    def forecast(self) -> DataFrame:
        """Next-hour predictions with the peak threshold of each series."""
        clean = self.clean()
        pred = with_lags(clean, [1]).filter(F.col("lag_1").isNotNull()).select(
            "series_id", "ts", F.col("lag_1").alias("predicted")
        )
        return pred.join(percentiles(clean, {"threshold": 0.9}), "series_id")

    def catalog(self) -> DataFrame:
        """Uploads of multi-year household data: the orders of a customer, one upload per order priority."""
        code = F.substring("o_orderpriority", 1, 1)
        return self.table("orders").groupBy("o_custkey", code.alias("_code")).agg(
            F.count("*").cast("int").alias("record_count"),
            F.min("o_orderdate").cast("timestamp").alias("start_timestamp"),
            F.max("o_orderdate").cast("timestamp").alias("end_timestamp"),
        ).select(
            F.concat_ws("-", F.col("o_custkey").cast("string"), "_code").alias("id"), F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("meter-"), "_code", F.lit(".csv")).alias("file_name"), "record_count",
            "start_timestamp", "end_timestamp",
            F.when(F.col("record_count") > 1, "VALID").otherwise("VALID_WITH_WARNINGS").alias("validation_status"),
            F.col("end_timestamp").alias("created_at"),
        )

    def upload_readings(self) -> DataFrame:
        return self.table("orders").select(
            F.concat_ws("-", F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)).alias("id"),
            F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_totalprice").alias("energy_kwh"),
        )

    def event_catalog(self) -> DataFrame:
        """Uploads of one month: the readings of a user, one upload per event type."""
        return self.events().groupBy("user_id", "event_type").agg(
            F.min("ts").alias("start_timestamp"), F.max("ts").alias("end_timestamp"),
        ).select(
            F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("id"), "user_id",
            "start_timestamp", "end_timestamp",
        )


# Named building blocks of the SQL counterparts, each with the blocks it needs.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": ((), """
        SELECT event_type AS series_id, ts, event_id, user_id, value AS energy_kwh,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events"""),
    "hourly": (("readings",), """
        SELECT series_id, date_trunc('hour', ts) AS ts,
               CAST(sum(CAST(energy_kwh AS DECIMAL(18,2))) AS DOUBLE) AS energy_kwh,
               CAST(sum(CAST(k AS DECIMAL(18,2))) AS DOUBLE) AS total_k, avg(k) AS avg_k
        FROM readings GROUP BY 1, 2"""),
    "spine": (("hourly",), """
        SELECT series_id, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS ts
        FROM (SELECT series_id, min(ts) AS s, max(ts) AS e FROM hourly GROUP BY 1)"""),
    "grid": (("spine",), """
        SELECT s.series_id, s.ts, h.energy_kwh, h.total_k, h.avg_k
        FROM spine s LEFT JOIN hourly h ON s.series_id = h.series_id AND s.ts = h.ts"""),
    "numbered": (("grid",), """
        SELECT *, CASE WHEN energy_kwh IS NULL THEN 1 ELSE 0 END AS is_missing,
               count(energy_kwh) OVER (PARTITION BY series_id ORDER BY ts) AS gap_group FROM grid"""),
    "islands": (("numbered",), """
        SELECT *, CAST(CASE WHEN is_missing = 1 THEN sum(is_missing) OVER (PARTITION BY series_id, gap_group) ELSE 0 END
                       AS BIGINT) AS gap_size FROM numbered"""),
    "filled": (("islands",), """
        SELECT series_id, ts, total_k, avg_k, CASE WHEN gap_size > 3 THEN 1 ELSE 0 END AS is_long_gap,
               CASE WHEN is_missing = 1 AND gap_size <= 3 THEN
                 (last_value(energy_kwh IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) +
                  first_value(energy_kwh IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 2 ELSE energy_kwh END AS energy_kwh
        FROM islands"""),
    "iqr": (("filled",), """
        SELECT series_id, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
        FROM (SELECT series_id, quantile_cont(energy_kwh, 0.25) AS q1, quantile_cont(energy_kwh, 0.75) AS q3
              FROM filled GROUP BY 1)"""),
    "clean": (("iqr",), """
        SELECT f.series_id, f.ts, f.total_k, f.avg_k, f.is_long_gap,
               CASE WHEN f.energy_kwh < 0 THEN 0.0 ELSE f.energy_kwh END AS energy_kwh,
               CASE WHEN f.energy_kwh > upper_bound OR f.energy_kwh < lower_bound THEN 1 ELSE 0 END AS is_energy_outlier
        FROM filled f JOIN iqr USING (series_id)"""),
    "p90": (("clean",), "SELECT series_id, quantile_cont(energy_kwh, 0.9) AS p90 FROM clean GROUP BY 1"),
    "naive": (("clean",), """
        SELECT series_id, ts, energy_kwh AS actual, predicted, horizon, model FROM (
          SELECT series_id, ts, energy_kwh, lag(energy_kwh, 1) OVER w AS predicted, 1 AS horizon, 'Naive_1h' AS model
          FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY ts)
          UNION ALL
          SELECT series_id, ts, energy_kwh, lag(energy_kwh, 24) OVER w, 24, 'Naive_24h'
          FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""),
    "scored": (("naive",), """
        SELECT series_id, ts, actual, predicted, horizon, split_part(model, '_', 1) AS model FROM naive
        WHERE actual IS NOT NULL AND predicted IS NOT NULL"""),
    "forecast": (("p90",), """
        SELECT series_id, ts, predicted, p90 AS threshold FROM (
          SELECT series_id, ts, lag(energy_kwh, 1) OVER (PARTITION BY series_id ORDER BY ts) AS predicted FROM clean
        ) JOIN p90 USING (series_id) WHERE predicted IS NOT NULL"""),
    "priced": (("forecast",), """
        SELECT *, CASE WHEN hour(ts) BETWEEN 17 AND 21 THEN 'peak' WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 'off_peak'
                       ELSE 'normal' END AS tou_period,
                  CASE WHEN hour(ts) BETWEEN 17 AND 21 THEN 10.0 WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 3.0
                       ELSE 6.0 END::DOUBLE AS rate FROM forecast"""),
    # User series: interval energies per hour, hours without readings are zero.
    "uhourly": ((), """
        SELECT user_id AS series_id, date_trunc('hour', ts) AS ts,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS energy_kwh FROM events GROUP BY 1, 2"""),
    "ugrid": (("uhourly",), """
        SELECT s.series_id, s.ts, coalesce(h.energy_kwh, 0.0) AS energy_kwh FROM (
          SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM uhourly GROUP BY 1
        ) s LEFT JOIN uhourly h ON s.series_id = h.series_id AND s.ts = h.ts"""),
    "catalog": ((), """
        SELECT o_custkey || '-' || substr(o_orderpriority, 1, 1) AS id, o_custkey AS user_id,
               'meter-' || substr(o_orderpriority, 1, 1) || '.csv' AS file_name, CAST(count(*) AS INTEGER) AS record_count,
               min(o_orderdate) AS start_timestamp, max(o_orderdate) AS end_timestamp,
               CASE WHEN count(*) > 1 THEN 'VALID' ELSE 'VALID_WITH_WARNINGS' END AS validation_status,
               max(o_orderdate) AS created_at
        FROM orders GROUP BY o_custkey, substr(o_orderpriority, 1, 1)"""),
    "listed": (("catalog",), """
        SELECT DISTINCT user_id, printf('%04d-%02d', m // 12, m % 12 + 1) AS month FROM (
          SELECT user_id, unnest(generate_series(s, e)) AS m FROM (
            SELECT DISTINCT user_id, year(start_timestamp) * 12 + month(start_timestamp) - 1 AS s,
                   year(end_timestamp) * 12 + month(end_timestamp) - 1 AS e FROM catalog))"""),
    "merged": (("catalog",), """
        SELECT h.user_id, h.ts, h.total / count(*) AS energy_kwh FROM (
          SELECT o_custkey AS user_id, date_trunc('hour', o_orderdate) AS ts,
                 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2) h
        JOIN catalog c ON c.user_id = h.user_id AND h.ts BETWEEN date_trunc('hour', c.start_timestamp)
             AND date_trunc('hour', c.end_timestamp)
        GROUP BY h.user_id, h.ts, h.total"""),
    "zero_months": (("merged", "listed"), """
        SELECT user_id, month, sum(energy_kwh) AS energy_kwh FROM (
          SELECT user_id, month, 0.0 AS energy_kwh FROM listed
          UNION ALL SELECT user_id, strftime(ts, '%Y-%m'), energy_kwh FROM merged) GROUP BY 1, 2"""),
    "totals": (("zero_months",), """
        SELECT user_id, period, consumption_kwh, consumption_kwh * 7.0 AS cost FROM (
          SELECT user_id, month AS period, energy_kwh AS consumption_kwh FROM zero_months
          UNION ALL SELECT user_id, substr(month, 1, 4), sum(energy_kwh) FROM zero_months GROUP BY 1, 2)"""),
    "latest": (("catalog",), """
        SELECT user_id, strftime(max(end_timestamp), '%Y-%m') AS latest_period FROM catalog GROUP BY 1"""),
    "ecatalog": ((), """
        SELECT user_id || '-' || event_type AS id, user_id, min(ts) AS start_timestamp, max(ts) AS end_timestamp
        FROM events GROUP BY user_id, event_type"""),
    "euploads": ((), """
        SELECT s.id, s.ts, coalesce(h.energy_kwh, 0.0) AS energy_kwh FROM (
          SELECT user_id || '-' || event_type AS id,
                 unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS ts
          FROM events GROUP BY user_id, event_type) s
        LEFT JOIN (SELECT user_id || '-' || event_type AS id, date_trunc('hour', ts) AS ts,
                          CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS energy_kwh FROM events GROUP BY 1, 2) h
        ON s.id = h.id AND s.ts = h.ts"""),
}


#: Blocks that a query reads more than once.
READ_TWICE = {"listed", "merged", "zero_months", "totals"}


def ctes(*names: str) -> str:
    """WITH clause that defines the named blocks and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in READ_TWICE else ''}({CTES[n][1].strip()})" for n in order)


def nudge(digits: int) -> float:
    """A shift far below the last kept digit, so that exact halves round alike whatever order a sum was added in."""
    return 3 * 10.0 ** -(digits + 2)


def finish(df: DataFrame, digits: int) -> DataFrame:
    """Stable output: doubles rounded, timestamps without zone."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "double":
            col = F.round(col + F.lit(nudge(digits)), digits) + F.lit(0.0)
        elif kind == "timestamp":
            col = col.cast("timestamp_ntz")
        out.append(col.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, needs: str = "", doubles: str = "", digits: int = 8):
    """Register a query; `sql` follows the WITH clause of the blocks in `needs`, `doubles` are its rounded columns."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return finish(build(Tables(spark, folder)), digits)

        QUERIES[name] = run
        if sql is not None:
            text = f"{ctes(*needs.split()) if needs else ''}\n{sql.strip()}"
            if needs and sql.lstrip().startswith(","):
                text = ctes(*needs.split()) + sql.strip()
            rounded = ", ".join(f"round({c} + {nudge(digits):.0e}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            replace = f" REPLACE ({rounded})" if rounded else ""
            ORACLE[name] = f"SELECT *{replace} FROM (\n{text}\n) AS result"
        return build

    return register
