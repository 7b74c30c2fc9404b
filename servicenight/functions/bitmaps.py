"""Exact distinct counts of nights as bitmaps: a bit per week, 64 weeks to a long.

Dates of one weekday differ in their week, so within a weekday a bit is a night. Words are OR-ed by
plain aggregation, before and after a shuffle, and counted by ``bit_count``; a group sends one long
for up to 64 nights.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _week(day: Column) -> Column:
    return F.floor(F.unix_date(day) / 7)


def word_of(day: Column) -> Column:
    """Number of the long that holds the night."""
    return F.floor(_week(day) / 64)


def bit_of(day: Column) -> Column:
    """The night's bit in its long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_week(day), F.lit(64)).cast("int"))
