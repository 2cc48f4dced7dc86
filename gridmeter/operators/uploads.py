"""Validation of uploaded reading files, many files in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.functions.scalars import coerce_double, format_timedelta, parse_ts
from gridmeter.operators.quality import readiness
from gridmeter.operators.rollup import hourly_zero_filled
from gridmeter.session import cut_lineage

U = "upload_id"
REQUIRED_COLUMNS = ["timestamp", "energy_consumption"]


def sampling_interval(df: DataFrame, key: str = U, ts: str = "ts") -> DataFrame:
    """Most frequent gap between neighbouring distinct timestamps, smallest on ties, with its share.

    Neighbours are found per day of a file, and between days from one summary row per day, so a huge file is never
    sorted in one task.
    """
    times = df.filter(F.col(ts).isNotNull()).select(key, F.unix_timestamp(ts).alias("_t")).distinct()
    daily = times.withColumn("_day", F.floor(F.col("_t") / 86400))
    inside = daily.select(key, (F.col("_t") - F.lag("_t").over(Window.partitionBy(key, "_day").orderBy("_t"))).alias("_gap"))
    edges = daily.groupBy(key, "_day").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    between = edges.select(key, (F.col("_first") - F.lag("_last").over(Window.partitionBy(key).orderBy("_day"))).alias("_gap"))
    gaps = inside.unionByName(between).filter(F.col("_gap").isNotNull()).groupBy(key, "_gap").agg(F.count("*").alias("_n"))
    modal = gaps.groupBy(key).agg(
        F.max_by("_gap", F.struct("_n", -F.col("_gap"))).alias("interval_seconds"), F.sum("_n").alias("_total"),
    )
    shares = gaps.join(modal, key).groupBy(key, "interval_seconds", "_total").agg(
        F.sum(F.when(F.col("_gap") == F.col("interval_seconds"), F.col("_n")).otherwise(0)).alias("_equal"),
        F.sum(F.when(F.col("_gap") > F.col("interval_seconds"), F.col("_n")).otherwise(0)).alias("gap_count"),
    )
    found = shares.select(
        key, "interval_seconds", format_timedelta(F.col("interval_seconds")).alias("detected_interval"),
        F.round(F.col("_equal") * 100 / F.col("_total"), 2).alias("consistency_percent"), "gap_count",
    )
    return times.select(key).distinct().join(found, key, "left").fillna("N/A", ["detected_interval"])


def _messages(*pairs: tuple[Column, Column]) -> Column:
    """Messages whose condition holds, in the given order."""
    entries = F.array(*[F.when(condition, text) for condition, text in pairs])
    return F.filter(entries, lambda text: text.isNotNull())


def _counted(fmt: str, count: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(count), F.lit(0)) > 0, F.format_string(fmt, F.col(count))


def _trimmed(percent: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", percent), r"\.?0+$", "")


def validate_uploads(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One verdict per upload with ordered error and warning messages.

    `rows`: upload_id, timestamp and energy_consumption as text, optionally `header` (array of the column names of the
    file). `files`: upload_id and file_size, to report files without any data row.
    """
    text = F.col("timestamp")
    parsed = rows.withColumn("ts", parse_ts(text)).withColumn("_kwh", coerce_double(F.col("energy_consumption")))
    header = F.col("header") if "header" in rows.columns else F.array(*[F.lit(c) for c in REQUIRED_COLUMNS])
    # One row per (upload, timestamp) first: a huge upload is reduced in many tasks, and texts are parsed once.
    per_ts = parsed.groupBy(U, "ts").agg(
        F.count("*").alias("_n"),
        F.count_if(text.isNull()).alias("_missing"),
        F.count_if(text.isNotNull() & F.col("ts").isNull()).alias("_invalid"),
        F.count_if(F.col("energy_consumption").isNotNull() & F.col("_kwh").isNull()).alias("_bad"),
        F.count_if(F.col("_kwh") < 0).alias("_negative"),
        F.max(header).alias("_header"),
    )
    per_ts = cut_lineage(per_ts)
    base = per_ts.groupBy(U).agg(
        F.sum("_n").alias("records"), F.sum("_missing").alias("_missing"), F.sum("_invalid").alias("_invalid"),
        F.sum("_bad").alias("_bad"), F.sum("_negative").alias("_negative"), F.max("_header").alias("_header"),
        F.coalesce(F.sum(F.when(F.col("ts").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("_duplicates"),
        F.min("ts").alias("_start"), F.max("ts").alias("_end"),
    )
    facts = base.join(sampling_interval(per_ts, U, "ts"), U, "left")
    if files is not None:
        facts = files.select(U, "file_size").join(facts, U, "left")
    else:
        facts = facts.withColumn("file_size", F.lit(None).cast("long"))
    facts = facts.withColumn("records", F.coalesce("records", F.lit(0)))

    required = F.array(*[F.lit(c) for c in REQUIRED_COLUMNS])
    absent = F.transform(F.array_except(required, F.col("_header")), lambda c: F.concat(F.lit("Missing required column: "), c))
    energy_errors = _messages(
        _counted("Found %d invalid non-numeric energy values.", "_bad"),
        _counted("Found %d negative energy consumption values.", "_negative"),
    )
    empty = F.col("records") == 0
    errors = (
        F.when(empty & (F.col("file_size") == 0), F.array(F.lit("File is empty.")))
        .when(empty, F.array(F.lit("CSV has no data rows.")))
        .when(F.size(absent) > 0, absent)
        .when(F.col("_invalid") > 0, _messages(_counted("Found %d invalid unparseable timestamps.", "_invalid")))
        .when(F.col("_missing") > 0, _messages(_counted("Found %d missing timestamps.", "_missing")))
        .otherwise(energy_errors)
    )
    unread = empty | (F.size(absent) > 0) | (F.col("_invalid") > 0) | (F.col("_missing") > 0)
    out = facts.withColumn("errors", errors).withColumn("_unread", unread)
    failed = F.size("errors") > 0
    days = (F.unix_timestamp("_end") - F.unix_timestamp("_start")) / 86400.0
    out = out.withColumn("forecasting_readiness", F.when(failed, "Unknown").otherwise(readiness(days)))
    checked = ~failed
    warnings = _messages(
        (~F.col("_unread") & (F.col("_duplicates") > 0),
         F.format_string("%d duplicate timestamps detected.", F.col("_duplicates"))),
        (checked & (F.col("consistency_percent") < 100),
         F.concat(F.lit("Sampling consistency is "), _trimmed(F.col("consistency_percent")), F.lit("%."))),
        (checked & (F.col("gap_count") > 0), F.format_string("%d timestamp gaps detected.", F.col("gap_count"))),
        (F.col("forecasting_readiness") == "Insufficient history",
         F.lit("Insufficient history for forecasting (less than 7 days).")),
    )
    out = out.withColumn("warnings", warnings)
    status = F.when(failed, "INVALID").when(F.size("warnings") > 0, "VALID_WITH_WARNINGS").otherwise("VALID")
    return out.select(
        U, status.alias("status"), "records",
        F.when(~F.col("_unread"), F.col("_start")).alias("start_ts"),
        F.when(~F.col("_unread"), F.col("_end")).alias("end_ts"),
        F.when(checked, F.col("detected_interval")).alias("detected_interval"),
        F.when(checked, F.col("interval_seconds")).alias("interval_seconds"),
        "forecasting_readiness", "warnings", "errors",
    )


def user_hourly(rows: DataFrame, scale: int | None = None) -> DataFrame:
    """Zero-filled hourly series (series_id = upload) of the uploads that can be forecast.

    An upload with an unreadable or repeated timestamp, or with a missing, non-numeric or negative energy, is left out as
    a whole; `validate_uploads` says why.
    """
    parsed = rows.select(
        F.col(U).alias("series_id"), parse_ts(F.col("timestamp")).alias("ts"),
        coerce_double(F.col("energy_consumption")).alias("energy_kwh"),
    )
    per_ts = cut_lineage(parsed.groupBy("series_id", "ts").agg(
        F.count("*").alias("_n"), F.first("energy_kwh").alias("energy_kwh"),
        F.count_if(F.col("energy_kwh").isNull() | (F.col("energy_kwh") < 0)).alias("_bad"),
    ))
    broken = F.col("ts").isNull() | (F.col("_n") > 1) | (F.col("_bad") > 0)
    rejected = per_ts.filter(broken).select("series_id").distinct()
    usable = per_ts.join(rejected, "series_id", "left_anti")
    return hourly_zero_filled(usable.select("series_id", "ts", "energy_kwh"), scale=scale)
