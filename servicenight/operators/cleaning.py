"""Cleaning rules and the per-order frame of exports without ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from servicenight import rules
from servicenight.functions import calendar, measures
from servicenight.operators.floorplan import with_units


def drop_exact_duplicates(orders: DataFrame) -> DataFrame:
    """Rows repeated whole where two report chunks overlap."""
    return orders.dropDuplicates()


def keep_plausible(orders: DataFrame) -> DataFrame:
    """Paid orders of believable parties, the retired table left out; untabled rows stay."""
    return orders.where(
        (F.col("amount") > 0) & (F.col("guests") <= rules.GUESTS_SANITY_MAX)
        & ~F.col("table_code").eqNullSafe(F.lit(rules.RETIRED_TABLE)))


def cleaning_report(orders: DataFrame) -> DataFrame:
    """How many rows each rule removes, applied in order."""
    positive = F.col("amount") > 0
    believable = positive & (F.col("guests") <= rules.GUESTS_SANITY_MAX)
    retired = F.col("table_code").eqNullSafe(F.lit(rules.RETIRED_TABLE))
    # identical rows collapse with a count, so one pass serves both numbers
    distinct = orders.groupBy(*orders.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return distinct.agg(
        F.sum("_copies").alias("rows_read"),
        (F.sum("_copies") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count_if(positive & (F.col("guests") > rules.GUESTS_SANITY_MAX)).alias("implausible_guests"),
        F.count_if(believable & retired).alias("retired_table"),
        F.count_if(believable & ~retired).alias("kept"))


def with_night(orders: DataFrame) -> DataFrame:
    """Service date, weekday, minutes since its midnight, and when the party paid."""
    day = F.col("service_date")
    return (orders.withColumn("service_date", calendar.service_date(F.col("opened_at")))
            .withColumns({
                "service_dow": calendar.day_name(day),
                "clock_minutes": calendar.clock_minutes(F.col("opened_at"), day),
                "duration": F.col("duration_seconds") / F.lit(60.0),
                "paid_at": measures.paid_at(F.col("opened_at"), F.col("duration_seconds"))}))


def clean_orders(orders: DataFrame, units: DataFrame) -> DataFrame:
    """Cleaned orders with section, unit, flags, order type and night columns."""
    kept = keep_plausible(drop_exact_duplicates(orders))
    typed = kept.withColumns({
        "section": measures.section_of(F.col("table_code")),
        "order_type": measures.order_type(F.col("table_code"), F.col("amount"))})
    return with_night(with_units(typed, units))


def above_duration_floor(orders: DataFrame, minutes: int = rules.DURATION_FLOOR_MINUTES) -> DataFrame:
    return orders.where(F.col("duration_seconds") >= minutes * 60)


def duration_floor_report(orders: DataFrame, minutes: int = rules.DURATION_FLOOR_MINUTES) -> DataFrame:
    """Per section, what the duration floor removes."""
    counted = orders.groupBy("section").agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if(F.col("duration_seconds") >= minutes * 60).alias("after"))
    dropped = F.col("before") - F.col("after")
    return counted.select("section", "before", "after", dropped.alias("dropped"),
                          F.round(F.lit(100.0) * dropped / F.col("before"), 1).alias("drop_pct"))


def near_cutoff(orders: DataFrame, cutoff: int = rules.SERVICE_CUTOFF_HOURS) -> DataFrame:
    """Orders opened within an hour of the service-day boundary."""
    return orders.where(F.hour("opened_at").between(cutoff - 1, cutoff))


def reservation_only(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("section").isin(rules.RESERVATION_SECTIONS))
