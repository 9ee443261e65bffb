"""Time and amount expressions. Times are integer seconds from an unknown start."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

HOUR = 3_600
DAY = 86_400
WEEK = 604_800


def bucket(time: str | Column, width: int) -> Column:
    return F.floor((F.col(time) if isinstance(time, str) else time) / width)


def hour_of_day(time: Column) -> Column:
    """0 to 24, with the fraction."""
    return F.pmod(time, F.lit(DAY)) / HOUR


def weekday(time: Column) -> Column:
    return F.pmod(F.floor(time / DAY), F.lit(7))


def on_circle(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / period
    return F.sin(angle), F.cos(angle)


def time_columns(time: Column) -> dict[str, Column]:
    hour, day = hour_of_day(time), weekday(time)
    hour_sin, hour_cos = on_circle(hour, 24)
    dow_sin, dow_cos = on_circle(day, 7)
    columns = {"hour_sin": hour_sin, "hour_cos": hour_cos, "dow_sin": dow_sin, "dow_cos": dow_cos,
               "hour_raw": hour}
    return {name: value.cast("float") for name, value in columns.items()}


def log_amount(amount: Column) -> Column:
    return F.log1p(amount).cast("float")
