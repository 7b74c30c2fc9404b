"""Raw text to one typed row per id, newest copy first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from servicenight.functions import calendar, measures, parse

ITEM_COLUMNS = ["load_id", "source_file", "source_row_number", "Order Id", "Order #", "Sent Date",
                "Order Date", "Check Id", "Table", "Dining Area", "Item Selection Id", "Menu Item",
                "Menu Group", "Menu", "Sales Category", "Gross Price", "Discount", "Net Price",
                "Qty", "Void?"]


def copy_rank() -> Column:
    """Greater is preferred: later range end, then later load, then earlier line.

    A struct compares field by field with NULL lowest, so undated files rank last.
    """
    return F.struct(parse.export_end_date(F.col("source_file")).alias("end"),
                    F.col("load_id").cast("bigint").alias("load"),
                    (-F.col("source_row_number").cast("bigint")).alias("line"))


def latest_copies(raw: DataFrame, key: str, payload: list[str] | None = None) -> DataFrame:
    """One row per key, the preferred copy, with ``copies_in_raw``.

    ``max_by`` combines on the map side: however many copies one id has, each task
    sends one. A window would send every copy of an id to the same task.
    """
    payload = payload or [c for c in raw.columns if c != key]
    kept = F.max_by(F.struct(*[F.col(f"`{c}`") for c in payload]), copy_rank()).alias("_kept")
    grouped = raw.groupBy(f"`{key}`").agg(kept, F.count(F.lit(1)).alias("copies_in_raw"))
    return grouped.select(f"`{key}`", *[F.col("_kept").getField(c).alias(c) for c in payload],
                          "copies_in_raw")


def typed_orders(latest: DataFrame) -> DataFrame:
    """Typed columns and data-quality flags for orders that carry ids."""
    c = lambda name: F.col(f"`{name}`")
    seconds = parse.parse_duration_seconds(parse.blank_to_null(c("Duration (Opened to Paid)")))
    typed = latest.select(
        c("Order Id").cast("bigint").alias("order_id"),
        c("Order #").cast("int").alias("order_number"),
        parse.parse_int_list(c("Checks")).alias("check_numbers"),
        parse.parse_clock(c("Opened")).alias("opened_at"),
        c("# of Guests").cast("int").alias("guests"),
        parse.blank_to_null(c("Table")).alias("table_code"),
        parse.money(c("Discount Amount")).alias("discount_amount"),
        parse.money(c("Amount")).alias("amount"),
        parse.money(c("Tax")).alias("tax"),
        parse.money(c("Tip")).alias("tip"),
        parse.money(c("Gratuity")).alias("gratuity"),
        parse.money(c("Total")).alias("total"),
        parse.parse_clock(parse.blank_to_null(c("Closed"))).alias("closed_at"),
        seconds.alias("duration_seconds"),
        "load_id", "source_file", "source_row_number", "copies_in_raw")
    return with_order_flags(typed)


def with_order_flags(typed: DataFrame) -> DataFrame:
    """Service date, minutes and session flags; expects opened_at and duration_seconds."""
    seconds = F.col("duration_seconds")
    return typed.withColumns({
        "service_date": calendar.service_date(F.col("opened_at")),
        "duration": parse.duration_interval(seconds),
        "duration_minutes": measures.duration_minutes(seconds),
        "is_long_session": measures.is_long_session(seconds),
        "is_negative_duration": measures.is_negative_duration(seconds),
        "duration_usable": measures.duration_usable(seconds),
    })


def stage_orders(raw_orders: DataFrame) -> DataFrame:
    return typed_orders(latest_copies(raw_orders, "Order Id"))


def union_item_layouts(items_a: DataFrame, items_b: DataFrame) -> DataFrame:
    """Both item layouts; the extra Service column of the first carries nothing."""
    columns = [F.col(f"`{c}`") for c in ITEM_COLUMNS]
    return items_a.select(*columns).unionByName(items_b.select(*columns))


def typed_items(latest: DataFrame) -> DataFrame:
    c = lambda name: F.col(f"`{name}`")
    return latest.select(
        c("Item Selection Id").cast("bigint").alias("item_selection_id"),
        c("Order Id").cast("bigint").alias("order_id"),
        c("Check Id").cast("bigint").alias("check_id"),
        c("Order #").cast("int").alias("order_number"),
        parse.parse_clock(c("Order Date")).alias("ordered_at"),
        parse.parse_clock(c("Sent Date")).alias("sent_at"),
        parse.blank_to_null(c("Table")).alias("table_code"),
        parse.blank_to_null(c("Dining Area")).alias("dining_area"),
        c("Menu Item").alias("menu_item"),
        parse.blank_to_null(c("Menu Group")).alias("menu_group"),
        parse.blank_to_null(c("Menu")).alias("menu"),
        parse.blank_to_null(c("Sales Category")).alias("sales_category"),
        parse.money(c("Gross Price")).alias("gross_price"),
        parse.money(c("Discount")).alias("discount"),
        parse.money(c("Net Price")).alias("net_price"),
        c("Qty").cast(parse.QUANTITY).alias("qty"),
        (c("Void?") == "true").alias("is_void"),
        "load_id", "source_file", "source_row_number", "copies_in_raw")


def stage_items(items_a: DataFrame, items_b: DataFrame) -> DataFrame:
    return typed_items(latest_copies(union_item_layouts(items_a, items_b), "Item Selection Id"))
