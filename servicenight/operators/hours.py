"""What each clock hour of the night earns, by exact minute overlap."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from servicenight import rules
from servicenight.functions import calendar
from servicenight.session import small_table

FIRST_HOUR, LAST_HOUR = rules.NIGHT_HOURS


def revenue_by_hour(orders: DataFrame) -> DataFrame:
    """One row per order and touched hour: the amount in proportion to the minutes spent there.

    Without a usable duration the whole amount counts in the opening hour. Revenue outside
    the night's hours is not placed. Only touched hours are produced, at most seven a row.
    """
    start = calendar.clock_minutes(F.col("opened_at"), F.col("service_date"))
    minutes = F.col("duration_minutes").cast("double")
    spread = F.coalesce(F.col("duration_usable") & (F.col("duration_minutes") > 0), F.lit(False))
    based = orders.withColumns({"_start": start, "_spread": spread,
                                "_minutes": F.when(spread, minutes).otherwise(0.0)})
    end = F.col("_start") + F.col("_minutes")
    first = F.greatest(F.floor(F.col("_start") / 60), F.lit(FIRST_HOUR)).cast("int")
    last = F.least(F.floor(end / 60), F.lit(LAST_HOUR)).cast("int")
    # sequence counts down when its end lies before its start, hence the test
    hours = based.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("hour"))
    low, high = F.col("hour") * 60.0, (F.col("hour") + 1) * 60.0
    overlap = F.greatest(F.least(end, high) - F.greatest("_start", low), F.lit(0.0))
    share = F.when(F.col("_spread"), overlap / F.nullif(F.col("_minutes"), F.lit(0.0))).otherwise(1.0)
    return (hours.select("order_id", "service_date", "day_name", "hour",
                         (F.col("amount").cast("double") * share).alias("revenue"))
            .where(F.col("revenue") != 0))


def seated_on_trading_days(orders: DataFrame) -> DataFrame:
    """Seated orders, Mondays left out."""
    day = F.col("service_date")
    return orders.where((F.col("order_type") == "Seated") & (calendar.iso_weekday(day) != 1)
                        ).withColumn("day_name", calendar.day_name(day))


def unplaced_revenue(orders: DataFrame) -> DataFrame:
    """Recorded, placed and unplaced seated revenue (outside 11 AM to 4 AM)."""
    seated = seated_on_trading_days(orders)
    placed = revenue_by_hour(seated).agg(F.coalesce(F.sum("revenue"), F.lit(0.0))).scalar()
    recorded = seated.agg(F.sum("amount").cast("double").alias("recorded"))
    return recorded.select("recorded", placed.alias("placed")).withColumn(
        "unplaced", F.col("recorded") - F.col("placed"))


def mean_by_hour(orders: DataFrame, window: tuple[dt.date, dt.date]) -> DataFrame:
    """Mean revenue per night for every trading day and hour of the night.

    A night that earned nothing in an hour counts as zero, and so does an hour nobody sat in;
    a weekday without any night has no mean.
    """
    seated = seated_on_trading_days(orders).where(
        F.col("service_date").between(F.lit(window[0]), F.lit(window[1])))
    nights = seated.groupBy("day_name").agg(F.countDistinct("service_date").alias("nights"))
    totals = revenue_by_hour(seated).groupBy("day_name", "hour").agg(F.sum("revenue").alias("revenue"))
    cells = every_cell(orders.sparkSession, range(FIRST_HOUR, LAST_HOUR + 1))
    nights_seen = F.coalesce("nights", F.lit(0))
    return cells.join(nights, "day_name", "left").join(totals, ["day_name", "hour"], "left").select(
        "day_name", "hour", calendar.hour_span(F.col("hour")).alias("span"), nights_seen.alias("nights"),
        (F.coalesce("revenue", F.lit(0.0)) / F.nullif(nights_seen, F.lit(0))).alias("per_night"))


def every_cell(spark: SparkSession, hours) -> DataFrame:
    """One row per trading day and hour."""
    rows = [(day, int(hour)) for day in rules.TRADING_DAYS for hour in hours]
    return small_table(spark, rows, "day_name string, hour int")


def edge_comparison(orders: DataFrame, windows: dict[str, tuple[dt.date, dt.date]],
                    hours: tuple[int, ...] = (16, 17, 23, 24)) -> DataFrame:
    """The edge hours' mean per night in several windows, one column each."""
    seated = seated_on_trading_days(orders)
    inside = {n: F.col("service_date").between(F.lit(w[0]), F.lit(w[1])) for n, w in windows.items()}
    nights = seated.groupBy("day_name").agg(*[
        F.countDistinct(F.when(test, F.col("service_date"))).alias(f"_{n}") for n, test in inside.items()])
    sums = revenue_by_hour(seated).where(F.col("hour").isin(list(hours))).groupBy("day_name", "hour").agg(*[
        F.coalesce(F.sum(F.when(test, F.col("revenue"))), F.lit(0.0)).alias(n) for n, test in inside.items()])
    cells = every_cell(orders.sparkSession, hours)
    return cells.join(nights, "day_name", "left").join(sums, ["day_name", "hour"], "left").select(
        "day_name", "hour",
        *[(F.coalesce(n, F.lit(0.0)) / F.nullif(F.col(f"_{n}"), F.lit(0))).alias(n) for n in windows])


def edge_shares(hourly: DataFrame) -> DataFrame:
    """Share of the night earned before 5 PM and after midnight."""
    total = F.sum("per_night")
    early = F.coalesce(F.sum(F.when(F.col("hour") < 17, F.col("per_night"))), F.lit(0.0))
    late = F.coalesce(F.sum(F.when(F.col("hour") >= 24, F.col("per_night"))), F.lit(0.0))
    return hourly.groupBy("day_name").agg(
        total.alias("whole_night"), early.alias("early"), late.alias("late"),
        (early / total).alias("early_share"), (late / total).alias("late_share"))


def untabled_totals(orders: DataFrame, window: tuple[dt.date, dt.date]) -> DataFrame:
    """Event and to-go revenue in a window, Mondays left out."""
    return (orders.where((F.col("order_type") != "Seated")
                         & (calendar.iso_weekday(F.col("service_date")) != 1)
                         & F.col("service_date").between(F.lit(window[0]), F.lit(window[1])))
            .groupBy("order_type").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("revenue")))
