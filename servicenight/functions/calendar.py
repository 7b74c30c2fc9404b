"""Service days, calendar attributes and clock labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from servicenight import rules


def service_date(opened: Column, cutoff_hours: int = rules.SERVICE_CUTOFF_HOURS) -> Column:
    """The night an instant belongs to."""
    return F.to_date(opened - F.expr(f"interval {cutoff_hours} hours"))


def day_start(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def clock_seconds(instant: Column, day: Column) -> Column:
    """Seconds since midnight of the service day; runs past 86400 after midnight."""
    return seconds_between(day_start(day), instant)


def clock_minutes(instant: Column, day: Column) -> Column:
    return clock_seconds(instant, day) / F.lit(60.0)


def slot_of(instant: Column, day: Column, minutes: int = rules.SLOT_MINUTES) -> Column:
    return F.floor(clock_seconds(instant, day) / F.lit(minutes * 60)).cast("int")


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def iso_weekday(day: Column) -> Column:
    """1 = Monday."""
    return F.weekday(day) + 1


def is_fri_or_sat(day: Column) -> Column:
    return F.weekday(day).isin(4, 5)


def date_key(day: Column) -> Column:
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def week_start(day: Column) -> Column:
    return F.trunc(day, "week")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def clock_label(minutes: Column) -> Column:
    """``25:30`` for half past one of the same night."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def hour_label(hour: Column) -> Column:
    """Twelve-hour label: 24 reads ``12am``."""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.when(hour % 24 < 12, "am").otherwise("pm"))


def hour_span(hour: Column) -> Column:
    return F.concat(hour_label(hour), F.lit("-"), hour_label(hour + 1))


def export_clock(instant: Column) -> Column:
    """A timestamp in the form merged exports are written in."""
    return F.date_format(instant, "MM/dd/yy hh:mm a")
