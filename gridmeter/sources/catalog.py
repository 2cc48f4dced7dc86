"""The table of uploaded datasets: select, append, delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: minutes assumed when an upload has a single timestamp.
DEFAULT_INTERVAL_MINUTES = 60


def catalog_select(
    df: DataFrame, equals: Mapping[str, object] | None = None, columns: Sequence[str] | None = None,
    order: Sequence[Column | str] = (),
) -> DataFrame:
    for name, value in (equals or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    if order:
        df = df.orderBy(*order)
    return df.select(*columns) if columns else df


def catalog_append(uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """Catalog rows for valid uploads: file facts joined with their validation report.

    `uploads`: upload_id, user_id, file_name, file_size; `reports`: output of `validate_uploads`.
    """
    valid = reports.filter(F.col("status").isin("VALID", "VALID_WITH_WARNINGS"))
    minutes = F.rint(F.col("interval_seconds") / 60).cast("int")
    return uploads.join(valid, "upload_id").select(
        F.col("upload_id").alias("id"),
        "user_id",
        "file_name",
        F.concat_ws("/", F.col("user_id").cast("string"), "upload_id", "file_name").alias("storage_path"),
        F.lit("text/csv").alias("file_type"),
        F.col("file_size").cast("long").alias("file_size"),
        F.col("records").cast("int").alias("record_count"),
        F.coalesce(minutes, F.lit(DEFAULT_INTERVAL_MINUTES)).alias("interval_minutes"),
        F.col("start_ts").alias("start_timestamp"),
        F.col("end_ts").alias("end_timestamp"),
        F.col("status").alias("validation_status"),
        F.lit("PENDING").alias("analysis_status"),
    )


def catalog_delete(df: DataFrame, keys: DataFrame, on: Sequence[str] = ("id", "user_id")) -> tuple[DataFrame, DataFrame]:
    """Split a catalog into (kept, deleted); matching on the owner too is the owner check."""
    return df.join(keys, list(on), "left_anti"), df.join(keys, list(on), "left_semi")
