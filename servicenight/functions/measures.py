"""Per-order measures, flags and bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from servicenight import rules


def duration_minutes(seconds: Column) -> Column:
    return F.round(seconds.cast("decimal(12,0)") / 60, 2)


def is_long_session(seconds: Column) -> Column:
    return seconds > rules.LONG_SESSION_SECONDS


def is_negative_duration(seconds: Column) -> Column:
    return seconds < 0


def duration_usable(seconds: Column) -> Column:
    """False, not NULL, when there is no duration."""
    return F.coalesce(seconds.between(0, rules.LONG_SESSION_SECONDS), F.lit(False))


def order_type(table_code: Column, amount: Column) -> Column:
    return (F.when(table_code.isNotNull(), "Seated")
            .when(amount >= rules.EVENT_AMOUNT, "Event-Catering")
            .otherwise("To-Go"))


def guests_implausible(guests: Column, section: Column) -> Column:
    """Three-valued: 13 to 30 guests without a known section is NULL."""
    return ((guests > rules.GUESTS_IMPLAUSIBLE)
            | ((section == "Bar") & (guests > rules.BAR_GUESTS_IMPLAUSIBLE)))


def in_time_metrics(table_code: Column, usable: Column, minutes: Column, guests: Column,
                    implausible: Column) -> Column:
    return (table_code.isNotNull() & usable & (minutes >= rules.DURATION_FLOOR_MINUTES)
            & (guests > 0) & ~implausible)


def spend_per_guest_quarter_hour(amount: Column, guests: Column, minutes: Column) -> Column:
    """Spend per guest per 15 minutes, one exact division, four places."""
    return F.round(amount * 15 / (guests * minutes), 4)


def spend_per_table_quarter_hour(amount: Column, minutes: Column) -> Column:
    """Spend per table per 15 minutes, four places."""
    return F.round(amount * 15 / minutes, 4)


def minutes_after(opened: Column, instant: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", opened, instant)
    return F.round(seconds.cast("decimal(18,0)") / 60, 1)


def paid_at(opened: Column, seconds: Column) -> Column:
    """When the party settled; NULL without a duration."""
    return F.timestamp_add("SECOND", seconds, opened)


def floored(value: Column, less: Column | float) -> Column:
    """``value - less``, never below zero; NULL stays NULL."""
    excess = value - less
    return F.when(excess < 0, F.lit(0).cast("double")).otherwise(excess)


def close_to(left: Column, right: Column, atol: float, rtol: float = 1e-5) -> Column:
    return F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)


def band(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bands: ``edges[i] < value <= edges[i + 1]``; outside every band is NULL."""
    chosen = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (value > low) & (value <= high)
        chosen = F.when(inside, label) if chosen is None else chosen.when(inside, label)
    return chosen


FULLNESS_EDGES = [-1, 25, 50, 75, 100]
FULLNESS_LABELS = ["<25% full", "25-50%", "50-75%", ">75% full"]


def fullness_band(percent: Column) -> Column:
    return band(percent, FULLNESS_EDGES, FULLNESS_LABELS)


def geometric_mean(value: Column) -> Column:
    return F.exp(F.avg(F.log(value)))


def missing_total(amount: Column, tax: Column, tip: Column, gratuity: Column, total: Column) -> Column:
    """The recorded total, or amount + tax + tip + gratuity where the export has no total."""
    return F.coalesce(total, F.round(amount + tax + tip + gratuity, 2))


def missing_tax(amount: Column, tax: Column, tip: Column, gratuity: Column, total: Column) -> Column:
    return F.coalesce(tax, F.round(total - amount - tip - gratuity, 2))


def section_of(table_code: Column) -> Column:
    """Section by code prefix; BD is tested before B."""
    return (F.when(table_code.isNull(), "Unknown/To-Go")
            .when(table_code.startswith("BD"), "Black Duck")
            .when(table_code.startswith("B"), "Bar")
            .when(table_code.startswith("E"), "Evangeline")
            .when(table_code.startswith("O"), "Open Lounge")
            .otherwise("Unknown"))
