"""Star schema: dates, order facts and item facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from servicenight.functions import calendar, measures
from servicenight.operators.floorplan import in_force
from servicenight.operators.prices import price_in_force


def date_dimension(orders: DataFrame) -> DataFrame:
    """Every day from the first to the last service date; today when there are no orders."""
    span = orders.agg(F.coalesce(F.min("service_date"), F.current_date()).alias("first"),
                      F.coalesce(F.max("service_date"), F.current_date()).alias("last"))
    day = F.col("service_date")
    return span.select(F.explode(F.sequence("first", "last")).alias("service_date")).select(
        calendar.date_key(day).alias("date_key"), "service_date",
        calendar.day_name(day).alias("day_name"),
        calendar.iso_weekday(day).alias("iso_day_of_week"),
        calendar.is_fri_or_sat(day).alias("is_fri_or_sat"),
        calendar.week_start(day).alias("week_start"),
        calendar.month_start(day).alias("month_start"),
        F.year(day).alias("year"))


def seating_unit_version(placed: DataFrame, seating_units: DataFrame) -> DataFrame:
    """Left as-of join: the seating-unit row in force on the service date."""
    unit = seating_units.select("seating_unit_key", "unit_name", "valid_from", "valid_to")
    return placed.join(
        unit, (F.col("unit_name") == F.col("seating_unit"))
        & in_force(F.col("service_date"), F.col("valid_from"), F.col("valid_to")),
        "left").drop("unit_name", "valid_from", "valid_to")


def order_measures(placed: DataFrame) -> DataFrame:
    """Order type, time-metric gate and spend rates; expects order and placement columns."""
    gate = measures.in_time_metrics(
        F.col("table_code"), F.col("duration_usable"), F.col("duration_minutes"),
        F.col("guests"), F.col("guests_implausible"))
    amount, guests, minutes = F.col("amount"), F.col("guests"), F.col("duration_minutes")
    return placed.withColumns({
        "order_type": measures.order_type(F.col("table_code"), amount),
        "in_time_metrics": gate,
        "vpcpm": F.when(gate, measures.spend_per_guest_quarter_hour(amount, guests, minutes)),
        "tpcpm": F.when(gate, measures.spend_per_table_quarter_hour(amount, minutes)),
    })


def order_facts(placed: DataFrame, seating_units: DataFrame) -> DataFrame:
    """One row per order with its placement, type and rates.

    Takes orders that already carry their placement, so nothing is shuffled here.
    """
    return order_measures(seating_unit_version(placed, seating_units)).select(
        "order_id", calendar.date_key(F.col("service_date")).alias("date_key"),
        "seating_unit_key", "table_code",
        F.coalesce("section", F.lit("No table")).alias("section"), "order_type", "seating_fit",
        "opened_at", "guests", F.size("check_numbers").alias("checks"),
        "discount_amount", "amount", "tax", "tip", "gratuity", "total", "duration_minutes",
        "is_long_session", "is_negative_duration", "duration_usable", "guests_implausible",
        "in_time_metrics", "vpcpm", "tpcpm")


def dated_items(items: DataFrame, orders: DataFrame, days: tuple | None = None) -> DataFrame:
    """Item selections with their order's opening and the day they count for, inside ``days`` if given.

    A sale whose order is unknown is dated by its own sent day.
    """
    order = orders.select(F.col("order_id").alias("_order"), "opened_at", "service_date")
    linked = items.withColumn("sday", calendar.service_date(F.col("sent_at"))).join(
        order, F.col("order_id") == F.col("_order"), "left").withColumn("day", F.coalesce("service_date", "sday"))
    return linked if days is None else linked.where(F.col("day").between(F.lit(days[0]), F.lit(days[1])))


def item_facts(items: DataFrame, orders: DataFrame, menu_items: DataFrame, days: tuple | None = None) -> DataFrame:
    """One row per item selection, of the given days where they are given."""
    linked = price_in_force(dated_items(items, orders, days), menu_items, ("menu_item_key",))
    return linked.select(
        "item_selection_id", "order_id", "check_id", calendar.date_key(F.col("day")).alias("date_key"),
        "menu_item_key", "sent_at",
        measures.minutes_after(F.col("opened_at"), F.col("sent_at")).alias("minutes_after_open"),
        "qty", "gross_price", "discount", "net_price", "is_void")


def sum_when(condition: Column, value: str) -> Column:
    return F.sum(F.when(condition, F.col(value)))


def nightly_summary(dates: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per day of the calendar: orders, revenue by order type, seated parties and guests.

    Facts are reduced to one row per day before they meet the calendar; days without
    orders appear with zeros.
    """
    seated_paid = (F.col("order_type") == "Seated") & (F.col("amount") > 0)
    per_day = facts.groupBy("date_key").agg(
        F.count("order_id").alias("orders"),
        F.sum("amount").alias("revenue"),
        sum_when(F.col("order_type") == "Seated", "amount").alias("seated_revenue"),
        sum_when(F.col("order_type") == "Event-Catering", "amount").alias("event_revenue"),
        sum_when(F.col("order_type") == "To-Go", "amount").alias("togo_revenue"),
        F.count(F.when(seated_paid, 1)).alias("parties"),
        sum_when(seated_paid & ~F.col("guests_implausible"), "guests").alias("guests"))
    measured = [c for c in per_day.columns if c != "date_key"]
    return dates.join(per_day, "date_key", "left").select(
        "service_date", "day_name", "iso_day_of_week", "is_fri_or_sat", "month_start", "year",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in measured])
