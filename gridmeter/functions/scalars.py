"""Column expressions used by the operators; all built-in, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results must agree with published ones.
METER_LOG_FORMAT = "d/M/yyyy HH:mm:ss"
FLAT_RATE_PER_KWH = 7.0
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

_TIME_PARTS = ["H m s", "H m", ""]
_TIMESTAMP_SHAPE = (
    r"^\s*[0-9]{1,4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,4}"
    r"([ T]+[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)?\s*$"
)


def with_timestamp(df: DataFrame, date_col: str = "Date", time_col: str = "Time", out: str = "ts") -> DataFrame:
    """Build a timestamp from separate day/month/year and time texts; bad text gives null."""
    return df.withColumn(out, F.try_to_timestamp(F.concat_ws(" ", date_col, time_col), F.lit(METER_LOG_FORMAT)))


def parse_ts(col: Column, day_first: bool = False) -> Column:
    """Parse year-first, month-first or day-first text with seconds, minutes or no time of day.

    Each row is parsed on its own in a fixed priority: year first, then month first, then day first
    (`day_first` swaps the last two).
    """
    digits = F.when(col.rlike(_TIMESTAMP_SHAPE), F.trim(F.regexp_replace(col, "[^0-9]+", " ")))
    dates = ["yyyy M d", "d M yyyy", "M d yyyy"] if day_first else ["yyyy M d", "M d yyyy", "d M yyyy"]
    formats = [f"{date} {time}".strip() for date in dates for time in _TIME_PARTS]
    return F.coalesce(*[F.try_to_timestamp(digits, F.lit(fmt)) for fmt in formats])


def kw_to_kwh(col: Column, minutes: float = 1.0) -> Column:
    """Average power over an interval to energy used in it."""
    return col * F.lit(minutes / 60.0) if minutes != 1.0 else col / F.lit(60.0)


def non_negative(col: Column) -> Column:
    return F.when(col < 0, F.lit(0.0)).otherwise(col)


def demand_class(col: Column, high: Column, critical: Column) -> Column:
    """Demand class of a reading; a null reading counts as normal."""
    return F.when(col >= critical, "critical").when(col >= high, "high").otherwise("normal")


def coerce_double(col: Column) -> Column:
    return F.trim(col).try_cast("double")


def format_timedelta(seconds: Column) -> Column:
    total = F.rint(seconds).cast("long")
    rest = F.pmod(total, F.lit(86400))
    return F.format_string(
        "%d days %02d:%02d:%02d",
        F.floor(total / 86400), F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60,
    )


def fmt_ts(col: Column, sep: str = " ") -> Column:
    return F.date_format(col, f"yyyy-MM-dd'{sep}'HH:mm:ss")


def flat_cost(kwh: Column, rate: float = FLAT_RATE_PER_KWH) -> Column:
    return kwh * F.lit(float(rate))


def to_log(col: Column) -> Column:
    return F.log1p(col)


def from_log(col: Column) -> Column:
    """Inverse of `to_log`, clamped at zero because consumption is never negative."""
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.expm1(col)))


def _period_start(period: Column) -> Column:
    first = (
        F.when(period.rlike("^[0-9]{4}$"), F.concat(period, F.lit("-1-1")))
        .when(period.rlike("^[0-9]{4}-[0-9]{1,2}$"), F.concat(period, F.lit("-1")))
    )
    return F.to_date(F.try_to_timestamp(first, F.lit("yyyy-M-d")))


def period_bounds(period: Column) -> Column:
    """"YYYY" or "YYYY-MM" to struct(start, end), end being one second before the next period."""
    start = _period_start(period)
    months = F.when(F.length(period) == 4, 12).otherwise(1)
    after = F.add_months(start, months).cast("timestamp")
    return F.struct(
        start.cast("timestamp").alias("start"),
        (after - F.expr("INTERVAL 1 SECOND")).alias("end"),
    )


def previous_period(period: Column) -> Column:
    start = _period_start(period)
    return F.when(F.length(period) == 4, F.date_format(F.add_months(start, -12), "yyyy")).otherwise(
        F.date_format(F.add_months(start, -1), "yyyy-MM")
    )


def bill_month_key(bill_date: Column) -> Column:
    """"August 2026" to 2026 * 12 + 8, null when unreadable (sort it last)."""
    parts = F.split(bill_date, " ")
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    month = F.nullif(F.array_position(names, F.get(parts, F.lit(0))), F.lit(0))
    return F.get(parts, F.lit(1)).try_cast("int") * 12 + month


def valid_upload_name(name: Column) -> Column:
    return name.rlike(r"(?i)\.csv$")


def uuid_like(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9-]+$")
