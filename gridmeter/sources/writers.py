"""Sinks. Executors write their own partitions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, series: str = "series_id", buckets: int = 64, mode: str = "overwrite") -> None:
    """Write a stage table in folders by series bucket, so a read for some series prunes the other folders.

    Rows are spread by series and year before writing: a task then writes few files, and a series that holds much of
    the data is still split over several tasks.
    """
    bucket = F.pmod(F.hash(F.col(series)), F.lit(buckets))
    out = df.withColumn("series_bucket", bucket)
    spread = [F.col("series_bucket")]
    if "ts" in df.columns:
        spread.append(F.date_trunc("month", F.col("ts")))
    out.repartition(*spread).write.mode(mode).partitionBy("series_bucket").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, emptyValue="", nullValue="").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write nested records, keeping null fields."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
