"""Calendar columns. Reports number weekdays 1 = Sunday, features number them 0 = Monday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels shown in reports.
DAY_BANDS = ["Night (00-06)", "Morning (06-12)", "Afternoon (12-18)", "Evening (18-24)"]


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )


def monday_zero(ts: Column) -> Column:
    return (F.dayofweek(ts) + 5) % 7


def with_eda_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "date": F.to_date(t),
        "hour": F.hour(t),
        "month": F.month(t),
        "dayofweek_num": F.dayofweek(t),
        "day_name": F.date_format(t, "EEEE"),
        "is_weekend": F.dayofweek(t).isin(1, 7).cast("int"),
        "season": season(F.month(t)),
    })


def with_feature_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "day_of_month": F.dayofmonth(t),
        "day_of_week": monday_zero(t),
        "hour": F.hour(t),
        "week_of_year": F.weekofyear(t),
        "quarter": F.quarter(t),
        "is_weekend": monday_zero(t).isin(5, 6).cast("int"),
    })


def with_cyclical(df: DataFrame, dow: str = "day_of_week") -> DataFrame:
    """Sine and cosine of hour, weekday and month on their circles."""
    out = {}
    for prefix, column, period in (("hour", "hour", 24), ("dow", dow, 7), ("month", "month", 12)):
        angle = 2 * F.pi() * F.col(column) / period
        out[f"{prefix}_sin"] = F.sin(angle)
        out[f"{prefix}_cos"] = F.cos(angle)
    return df.withColumns(out)


def with_interactions(df: DataFrame, dow: str = "dow") -> DataFrame:
    hour, day, month, weekend = (F.col(c) for c in ("hour", dow, "month", "is_weekend"))
    return df.withColumns({
        "hour_x_dow": hour * day,
        "hour_x_weekend": hour * weekend,
        "month_x_hour": month * hour,
        "dow_x_month": day * month,
    })


def day_band(hour: Column) -> Column:
    names = F.array(*[F.lit(name) for name in DAY_BANDS])
    return F.get(names, F.floor(hour / 6).cast("int"))
