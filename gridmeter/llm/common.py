"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.session import cut_lineage, prepare, shared_folder

__all__ = ["SPACE", "cut_lineage", "documents", "prepare_texts", "settle", "shared_folder", "table", "words_of"]

#: Separators of words: the space and the five control characters from tab to carriage return.
SPACE = " \t\n\x0b\f\r"


def prepare_texts(spark: SparkSession) -> SparkSession:
    """Session settings for texts: Arrow batches bounded by bytes as well as rows, since one text may be megabytes long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare_texts(spark).read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its rows are computed once and outlive a lost executor."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def words_of(text: Column) -> Column:
    """Words of a text; none for a null or blank one."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
