from gridmeter.sources.catalog import catalog_append, catalog_delete, catalog_select
from gridmeter.sources.catalog_store import StoredCatalog
from gridmeter.sources.readers import (
    METER_LOG_SCHEMA,
    forecast_for_horizon,
    parse_meter_lines,
    parse_user_lines,
    read_meter_log,
    read_records,
    read_stage,
    read_user_csv,
    view,
    sql,
)
from gridmeter.sources.writers import write_csv, write_json, write_stage

__all__ = [
    "METER_LOG_SCHEMA", "StoredCatalog", "catalog_append", "catalog_delete", "catalog_select", "forecast_for_horizon",
    "parse_meter_lines", "parse_user_lines", "read_meter_log", "read_records", "read_stage", "read_user_csv", "sql",
    "view", "write_csv", "write_json", "write_stage",
]
