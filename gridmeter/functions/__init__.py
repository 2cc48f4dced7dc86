from gridmeter.functions.calendar import (
    day_band,
    with_cyclical,
    with_eda_calendar,
    with_feature_calendar,
    with_interactions,
)
from gridmeter.functions.scalars import (
    bill_month_key,
    coerce_double,
    demand_class,
    flat_cost,
    fmt_ts,
    format_timedelta,
    from_log,
    kw_to_kwh,
    non_negative,
    parse_ts,
    period_bounds,
    previous_period,
    to_log,
    uuid_like,
    valid_upload_name,
    with_timestamp,
)
from gridmeter.functions.tariff import DEFAULT_TARIFF, Tariff, tou_period, tou_rate, with_rate_table

__all__ = [
    "DEFAULT_TARIFF", "Tariff", "bill_month_key", "coerce_double", "day_band", "demand_class", "flat_cost", "fmt_ts",
    "format_timedelta", "from_log", "kw_to_kwh", "non_negative", "parse_ts", "period_bounds", "previous_period",
    "to_log", "tou_period", "tou_rate", "uuid_like", "valid_upload_name", "with_cyclical", "with_eda_calendar",
    "with_feature_calendar", "with_interactions", "with_rate_table", "with_timestamp",
]
