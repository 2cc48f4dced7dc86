"""Scans: meter logs, user reading files, stage tables, SQL text."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmeter.sources.user_files import UserFiles

# Layout of the public one-minute household meter log.
METER_LOG_MEASURES = [
    "Global_active_power", "Global_reactive_power", "Voltage", "Global_intensity",
    "Sub_metering_1", "Sub_metering_2", "Sub_metering_3",
]
METER_LOG_OPTIONS = {"sep": ";", "nullValue": "?"}
USER_NULLS = ["", "NA", "NaN"]

METER_LOG_SCHEMA = T.StructType(
    [T.StructField("Date", T.StringType()), T.StructField("Time", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in METER_LOG_MEASURES]
)
USER_CSV_SCHEMA = "timestamp string, energy_consumption string"
UPLOAD_PATTERN = r"([^/]+?)(?:\.[A-Za-z0-9]+)?$"


def read_meter_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan meter logs with an explicit schema; files are splittable, so no inference pass is needed."""
    return spark.read.schema(METER_LOG_SCHEMA).options(header=True, **METER_LOG_OPTIONS).csv(path)


def parse_meter_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse lines that arrive in a text column with the schema and options of `read_meter_log`."""
    parsed = F.from_csv(F.col(line), METER_LOG_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " "), METER_LOG_OPTIONS)
    return lines.withColumn("_row", parsed).select(*[c for c in lines.columns if c != line], "_row.*")


def _null_words(col: Column) -> Column:
    return F.when(~F.trim(col).isin(USER_NULLS), col)


def read_user_csv(spark: SparkSession, path: str | list[str], upload_pattern: str = UPLOAD_PATTERN) -> DataFrame:
    """Scan user reading files once, every value as text, each file by its own header line.

    Files come from many users, so columns may be in any order, missing, or accompanied by others, and quoted cells may hold
    line ends. `upload_pattern` takes the upload id out of the file path. Column `header` lists the columns the file has.
    Blank lines are skipped, of repeated names the first counts, short rows give nulls, and a file of a header alone gives no row.
    """
    spark.dataSource.register(UserFiles)
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.format(UserFiles.name()).option("paths", json.dumps(paths)).load()
    return rows.select(
        F.regexp_extract("file", upload_pattern, 1).alias("upload_id"),
        *[_null_words(F.col(c)).alias(c) for c in ("timestamp", "energy_consumption")], "header",
    )


def parse_user_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse user reading lines held in a text column."""
    parsed = F.from_csv(F.col(line), USER_CSV_SCHEMA, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_row", parsed).select(*[c for c in lines.columns if c != line], "_row.*")
    return rows.withColumns({c: _null_words(F.col(c)) for c in ("timestamp", "energy_consumption")})


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text; `{name}` in the text refers to a DataFrame given by that name."""
    return spark.sql(query, **tables)


def view(spark: SparkSession, name: str, query: str, **tables: DataFrame) -> str:
    """Register the result of SQL text as a named view and return the name."""
    spark.sql(query, **tables).createOrReplaceTempView(name)
    return name


def read_records(df: DataFrame, order: Sequence[str | Column], limit: int = 5000) -> DataFrame:
    """First rows in a stated order; the limit is the feature (a page of records)."""
    return df.orderBy(*order).limit(limit)


def forecast_for_horizon(predictions: DataFrame, horizon: int) -> DataFrame:
    return predictions.filter(F.col("horizon") == horizon).select(
        *[c for c in ("series_id", "ts") if c in predictions.columns],
        F.col("predicted").alias("predicted_consumption"),
    )
