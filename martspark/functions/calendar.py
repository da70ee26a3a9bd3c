"""Calendar fields used by features and forecasts (Sunday = 0 throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code of each event type; everything else is 0.
EVENT_TYPE_CODES = {"Sporting": 1, "Cultural": 2, "National": 3, "Religious": 4}

# Weekday label of codes 0..6 in the order-time report.
WEEKDAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def day_of_week(date: Column) -> Column:
    return F.dayofweek(date) - 1


def calendar_columns(date: Column) -> dict[str, Column]:
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    return {
        "day_of_week": day_of_week(date).cast("smallint"),
        "day_of_month": F.dayofmonth(date).cast("smallint"),
        "week_of_year": F.weekofyear(date).cast("smallint"),
        "month": F.month(date).cast("smallint"),
        "year": F.year(date).cast("smallint"),
        "is_weekend": flag(day_of_week(date).isin(0, 6)),
        "is_month_start": flag(F.dayofmonth(date) <= 3),
        "is_month_end": flag(F.dayofmonth(date) >= 28),
    }


def event_code(event_type: Column) -> Column:
    code = F.lit(0)
    for name, value in EVENT_TYPE_CODES.items():
        code = F.when(event_type == name, value).otherwise(code)
    return code


def weekday_label(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), code.cast("int") + 1)
