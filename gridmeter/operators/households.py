"""Per-user views over many uploads: periods, merged readings, dashboards, cost analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.scalars import FLAT_RATE_PER_KWH, flat_cost, period_bounds, previous_period
from gridmeter.operators.chunks import hour_index
from gridmeter.operators.rollup import exact_sum

USER = "user_id"


def _dated(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("start_timestamp").isNotNull() & F.col("end_timestamp").isNotNull())


def upload_months(catalog: DataFrame) -> DataFrame:
    """One row per upload and calendar month it covers."""
    first, last = F.trunc("start_timestamp", "MM"), F.trunc("end_timestamp", "MM")
    months = F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    return _dated(catalog).withColumn("month", months).withColumn("month", F.date_format("month", "yyyy-MM"))


def covered_runs(spans: DataFrame) -> DataFrame:
    """Disjoint runs (_first, _last) of whole numbers that any span (_first, _last) of a user covers.

    Of all spans that begin at the same number only the one that reaches furthest counts, and a run ends where none of the
    earlier ones reaches on; spans are never compared pairwise.
    """
    reach = spans.groupBy(USER, "_first").agg(F.max("_last").alias("_last")).filter("_last >= _first")
    in_order = Window.partitionBy(USER).orderBy("_first")
    before = F.max("_last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before >= F.col("_first") - 1, 0).otherwise(1)
    runs = reach.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(in_order))
    return runs.groupBy(USER, "_run").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).drop("_run")


def _month_number(name: str) -> Column:
    return F.year(name) * 12 + F.month(name) - 1


def _year_text(month: Column) -> Column:
    return F.lpad(F.floor(month / 12).cast("string"), 4, "0")


def _month_text(month: Column) -> Column:
    return F.concat(_year_text(month), F.lit("-"), F.lpad((month % 12 + 1).cast("string"), 2, "0"))


def _covered_month_numbers(catalog: DataFrame) -> DataFrame:
    spans = _dated(catalog).select(USER, _month_number("start_timestamp").alias("_first"), _month_number("end_timestamp").alias("_last"))
    return covered_runs(spans).select(USER, F.explode(F.sequence("_first", "_last")).alias("_month"))


def covered_months(catalog: DataFrame) -> DataFrame:
    """One row per user and calendar month that any of the user's uploads covers."""
    return _covered_month_numbers(catalog).select(USER, _month_text(F.col("_month")).alias("month"))


def covered_hours(catalog: DataFrame) -> DataFrame:
    """Disjoint runs of hours (_first to _last, counted from 1970) with any upload of a user, cut at the ends of months.

    A row stands for as many hours as it spans, so what depends on the number of hours is counted from its two ends.
    """
    runs = covered_runs(_dated(catalog).select(USER, hour_index("start_timestamp").alias("_first"), hour_index("end_timestamp").alias("_last")))
    begin = lambda name: F.trunc(F.timestamp_seconds(F.col(name) * 3600), "MM")
    cut = runs.withColumn("_month", F.explode(F.sequence(begin("_first"), begin("_last"), F.expr("INTERVAL 1 MONTH"))))
    opens, closes = F.col("_month").cast("timestamp"), F.add_months("_month", 1).cast("timestamp")
    return cut.withColumns({"_opens": opens, "_closes": closes}).select(
        USER, F.date_format("_month", "yyyy-MM").alias("month"), F.greatest("_first", hour_index("_opens")).alias("_first"),
        F.least(F.col("_last"), hour_index("_closes") - 1).alias("_last"),
    )


def user_periods(catalog: DataFrame) -> DataFrame:
    """Months and years with data per user, newest first, with the latest period and upload."""
    months = covered_months(catalog).groupBy(USER).agg(F.collect_list("month").alias("_months"))
    newest = F.struct(-F.unix_micros(F.col("end_timestamp").cast("timestamp")), F.col("id"))
    latest = _dated(catalog).groupBy(USER).agg(
        F.date_format(F.max("end_timestamp"), "yyyy-MM").alias("latest_period"),
        F.min_by("id", newest).alias("latest_upload_id"),
    )
    periods = F.sort_array("_months", asc=False)
    years = F.array_distinct(F.transform(periods, lambda m: F.substring(m, 1, 4)))
    return months.select(USER, periods.alias("periods"), years.alias("years")).join(latest, USER)


def period_months(requests: DataFrame) -> DataFrame:
    """One row per user, requested period and month of it, with the bounds of the period; what is no period is left out."""
    wanted = requests.select(USER, "period").distinct().withColumn("_b", period_bounds(F.col("period")))
    wanted = wanted.select(USER, "period", F.col("_b.start").alias("p_start"), F.col("_b.end").alias("p_end"))
    months = F.explode(F.sequence(F.trunc("p_start", "MM"), F.trunc("p_end", "MM"), F.expr("INTERVAL 1 MONTH")))
    wanted = wanted.filter(F.col("p_start").isNotNull()).withColumn("month", months)
    return wanted.withColumn("month", F.date_format("month", "yyyy-MM"))


def uploads_in_period(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Uploads that overlap a requested period of their user.

    Both sides are expanded to calendar months and joined on (user, month), then checked against the exact bounds: an
    equi-join instead of comparing every upload of a user with every period.
    """
    wanted = period_months(requests)
    pairs = upload_months(catalog).select(USER, "id", "start_timestamp", "end_timestamp", "month").join(wanted, [USER, "month"])
    # A pair that shares several months is kept in the first shared month only.
    first_shared = F.date_format(F.greatest(F.col("start_timestamp").cast("timestamp"), "p_start"), "yyyy-MM")
    overlap = (F.col("start_timestamp") <= F.col("p_end")) & (F.col("end_timestamp") >= F.col("p_start"))
    return pairs.filter(overlap & (F.col("month") == first_shared)).select(USER, "period", "id", "p_start", "p_end")


def user_period_data(merged: DataFrame, catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Every hour of a requested period that an upload of the user covers, with its merged reading or zero.

    `merged`: output of `merge_uploads`. An hour is there once for each period, however many uploads cover it.
    """
    hours = covered_hours(catalog).join(period_months(requests).select(USER, "period", "month"), [USER, "month"]).select(
        USER, "period", F.explode(F.sequence("_first", "_last")).alias("_h"))
    read = merged.select(USER, hour_index("ts").alias("_h"), "energy_kwh")
    return hours.join(read, [USER, "_h"], "left").select(
        USER, "period", F.timestamp_seconds(F.col("_h") * 3600).alias("ts"), F.coalesce("energy_kwh", F.lit(0.0)).alias("energy_kwh"))


def merge_uploads(readings: DataFrame, catalog: DataFrame, scale: int | None = None) -> DataFrame:
    """Merged hourly readings of every user, without materialising the zero hours of each upload.

    Averaging zero-filled uploads means dividing the hour's sum by the number of uploads that cover the hour. That
    number is a running count of uploads started minus uploads ended, so nothing is compared pairwise.
    """
    hours = readings.groupBy(USER, F.date_trunc("hour", F.col("ts")).alias("ts")).agg(
        exact_sum(F.col("energy_kwh"), scale).alias("_sum")
    ).select(USER, hour_index("ts").alias("_h"), F.lit(0).alias("_delta"), "_sum")
    dated = _dated(catalog)
    edges = dated.select(USER, F.inline(F.array(
        F.struct(hour_index("start_timestamp").alias("_h"), F.lit(1).alias("_delta")),
        F.struct((hour_index("end_timestamp") + 1).alias("_h"), F.lit(-1).alias("_delta")),
    ))).withColumn("_sum", F.lit(None).cast("double"))
    per_hour = hours.unionByName(edges).groupBy(USER, "_h").agg(
        F.sum("_delta").alias("_delta"), F.sum("_sum").alias("_sum")
    )
    running = Window.partitionBy(USER).orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    covered = per_hour.withColumn("_cover", F.sum("_delta").over(running)).filter(F.col("_sum").isNotNull())
    return covered.select(
        USER, F.timestamp_seconds(F.col("_h") * 3600).alias("ts"),
        (F.col("_sum") / F.greatest(F.col("_cover"), F.lit(1))).alias("energy_kwh"),
    )


def period_totals(merged: DataFrame, catalog: DataFrame, rate: float = FLAT_RATE_PER_KWH) -> DataFrame:
    """Energy and flat-rate cost of every month and year of every user; years add up the months.

    Hours without a reading count as zero, so a month that an upload of the catalog covers is there with 0 kWh even if no
    reading falls into it. Months are enough for that; no hours are filled.
    """
    zero = _covered_month_numbers(catalog).select(USER, "_month", F.lit(0.0).alias("consumption_kwh"))
    read = merged.select(USER, _month_number("ts").alias("_month"), F.col("energy_kwh").alias("consumption_kwh"))
    # Months are numbers until all sums are taken, and move once: both sums are taken where a user's rows lie.
    months = zero.unionByName(read).repartition(USER).groupBy(USER, "_month").agg(F.sum("consumption_kwh").alias("consumption_kwh"))
    both = F.explode(F.array(F.struct(F.lit(True).alias("whole"), (F.col("_month") - F.col("_month") % 12).alias("month")),
                             F.struct(F.lit(False).alias("whole"), F.col("_month").alias("month")))).alias("_p")
    known = F.col("_month").isNotNull()
    totals = months.select(USER, both, "consumption_kwh", known.alias("_known")).groupBy(USER, F.when(F.col("_known"), F.col("_p")).alias("_p")).agg(
        F.sum("consumption_kwh").alias("consumption_kwh")
    )
    period = F.when(F.col("_p.whole"), _year_text(F.col("_p.month"))).otherwise(_month_text(F.col("_p.month")))
    return totals.select(USER, period.alias("period"), "consumption_kwh").withColumn("cost", flat_cost(F.col("consumption_kwh"), rate))


def _change(now: Column, before: Column) -> Column:
    positive = F.when(before > 0, before)
    return F.when(before.isNotNull(), F.coalesce((now - before) / positive * 100, F.lit(0.0)))


def period_comparison(totals: DataFrame) -> DataFrame:
    """Each period next to the one before; a missing previous period gives null, a non-positive one 0 %."""
    # Months and years are rows of their own, so the period before, if there is one, is the row before of the same kind.
    in_order = Window.partitionBy(USER, F.length("period")).orderBy("period")
    kept = {"_before": "period", "_kwh": "consumption_kwh", "_cost": "cost"}
    rows = totals.withColumns({name: F.lag(source).over(in_order) for name, source in kept.items()})
    adjacent = F.col("_before") == previous_period(F.col("period"))
    rows = rows.withColumns({
        "previous_period": F.when(adjacent, F.col("_before")), "previous_kwh": F.when(adjacent, F.col("_kwh")),
        "previous_cost": F.when(adjacent, F.col("_cost")),
    })
    return rows.select(
        USER, "period", "consumption_kwh", "cost",
        F.when(F.col("previous_kwh").isNotNull(), F.col("previous_period")).alias("previous_period"),
        (F.col("cost") - F.col("previous_cost")).alias("cost_difference"),
        _change(F.col("cost"), F.col("previous_cost")).alias("cost_change_percent"),
        _change(F.col("consumption_kwh"), F.col("previous_kwh")).alias("consumption_change_percent"),
    )


def owned_by(uploads: DataFrame, owners: DataFrame) -> DataFrame:
    """Uploads that belong to the user who asks; `owners` holds (id, user_id) requests."""
    return uploads.join(owners, ["id", USER], "left_semi")


def new_bills(incoming: DataFrame, bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split incoming bills into (accepted, rejected): a user has one bill per month."""
    keys = [USER, "bill_date"]
    return incoming.join(bills, keys, "left_anti"), incoming.join(bills, keys, "left_semi")


def resolve_periods(totals: DataFrame, latest: DataFrame, requests: DataFrame) -> DataFrame:
    """Period shown for each request: the asked one if it has data, else the user's latest one."""
    having = totals.select(USER, "period", F.lit(True).alias("_found"))
    asked = requests.select(USER, F.col("period").alias("asked_period")).distinct()
    found = asked.withColumn("period", F.col("asked_period")).join(having, [USER, "period"], "left")
    return found.join(latest.select(USER, "latest_period"), USER).select(
        USER, "asked_period", F.when(F.col("_found"), F.col("period")).otherwise(F.col("latest_period")).alias("period"),
    )


def dashboard_month(merged: DataFrame, catalog: DataFrame, requests: DataFrame, rate: float = FLAT_RATE_PER_KWH) -> DataFrame:
    """Month dashboard in long form: total, totals by day, means by hour of day, each with its flat-rate cost.

    `merged`: output of `merge_uploads`, whose hours lie in the spans of the catalog. Covered hours without a reading are zero:
    they make days appear and means smaller, and are counted from the ends of covered runs, never made. A request for a month that
    no upload covers shows the user's latest month; a user without uploads has no dashboard.
    """
    cover = covered_hours(catalog)
    latest = _dated(catalog).groupBy(USER).agg(F.date_format(F.max("end_timestamp"), "yyyy-MM").alias("latest_period"))
    shown = resolve_periods(cover.select(USER, F.col("month").alias("period")).distinct(), latest, requests)
    wanted = shown.select(USER, "period").distinct()

    def cell(section: str, label: Column, hours: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), label.alias("label"), hours.cast("long").alias("_n"))

    first, last = F.col("_first"), F.col("_last")
    of_day = lambda k: F.floor((last - k) / 24) - F.floor((first - 1 - k) / 24)
    days = F.transform(F.sequence(F.floor(first / 24).cast("int"), F.floor(last / 24).cast("int")), lambda d: cell(
        "daily", F.date_from_unix_date(d).cast("string"), F.lit(0)))
    hours = F.filter(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: cell(
        "hourly", F.format_string("%02d:00", k), of_day(k))), lambda c: c["_n"] > 0)
    total = F.array(cell("total", F.col("month"), F.lit(0)))
    counted = cover.select(USER, F.col("month").alias("period"), F.inline(F.concat(total, days, hours))).withColumn("_sum", F.lit(0.0))
    read = merged.select(
        USER, F.date_format("ts", "yyyy-MM").alias("period"), F.col("energy_kwh").alias("_sum"), F.inline(F.array(
            cell("total", F.date_format("ts", "yyyy-MM"), F.lit(0)), cell("daily", F.to_date("ts").cast("string"), F.lit(0)),
            cell("hourly", F.date_format("ts", "HH:00"), F.lit(0)),
        )))
    # Only months that are shown; both sides are reduced to one row for each label before the asked months are attached.
    cells = counted.unionByName(read).join(wanted, [USER, "period"], "left_semi").groupBy(USER, "period", "section", "label").agg(
        F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    energy = F.when(F.col("section") == "hourly", F.col("_sum") / F.col("_n")).otherwise(F.col("_sum"))
    return cells.join(shown, [USER, "period"]).select(
        USER, "asked_period", "period", "section", "label", energy.alias("energy_kwh")).withColumn("cost", flat_cost(F.col("energy_kwh"), rate))


def dashboard_year(totals: DataFrame, latest: DataFrame, requests: DataFrame) -> DataFrame:
    """Year dashboard: month totals with cost, the peak month and the number of months with data.

    A request without data shows the latest month instead, which then is its only row.
    """
    shown = resolve_periods(totals, latest, requests)
    months = totals.filter(F.length("period") == 7).withColumnRenamed("period", "month")
    keyed = months.withColumn("period", F.explode(F.array(F.substring("month", 1, 4), F.col("month"))))
    rows = keyed.join(shown, [USER, "period"])
    whole = Window.partitionBy(USER, "asked_period")
    return rows.select(
        USER, "asked_period", "period", "month", "consumption_kwh", "cost",
        F.max("consumption_kwh").over(whole).alias("peak_consumption"),
        F.count("*").over(whole).alias("months_with_data"),
    )


def cost_analytics(totals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Total and average cost per user with the dearest and the cheapest month.

    The average divides by every month the catalog lists, with or without data; the newest month wins a tie.
    """
    listed = covered_months(catalog)
    costs = totals.select(USER, F.col("period").alias("month"), "consumption_kwh", "cost")
    known = F.col("cost").isNotNull()
    return listed.join(costs, [USER, "month"], "left").groupBy(USER).agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("consumption_kwh"), F.lit(0.0)).alias("total_consumption"),
        (F.coalesce(F.sum("cost"), F.lit(0.0)) / F.count("*")).alias("average_monthly_cost"),
        F.max_by("month", F.when(known, F.struct("cost", "month"))).alias("highest_cost_month"),
        F.max("cost").alias("highest_cost"),
        F.max_by("month", F.when(known, F.struct(-F.col("cost"), F.col("month")))).alias("lowest_cost_month"),
        F.min("cost").alias("lowest_cost"),
        F.count("*").alias("months_analyzed"),
    )
