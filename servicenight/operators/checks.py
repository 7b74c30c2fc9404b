"""Invariants as queries: one row per check with a count of offenders that must be zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from servicenight import rules
from servicenight.operators import cleaning, floorplan, merge


def unique_and_complete(raw: DataFrame, raw_key: str, staged: DataFrame, key: str) -> DataFrame:
    """One staged row per id, and every raw id covered."""
    raw_ids = raw.select(F.countDistinct(f"`{raw_key}`")).scalar()
    return staged.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids")).withColumn(
        "raw_ids", raw_ids)


def unparsed_clocks(orders: DataFrame, raw: DataFrame) -> DataFrame:
    """Orders without an opening time, and filled closing cells that did not parse."""
    filled = raw.where(F.col("Closed") != "").select("load_id", "source_file", "source_row_number")
    lost = (orders.where(F.col("closed_at").isNull())
            .join(filled, ["load_id", "source_file", "source_row_number"], "left_semi")
            .agg(F.count(F.lit(1))).scalar())
    return orders.agg(F.count_if(F.col("opened_at").isNull()).alias("opened_missing")).withColumn(
        "closed_unparsed", lost)


def item_reconciliation(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose amount differs from the net prices of their items."""
    sums = items.where(~F.col("is_void")).groupBy("order_id").agg(F.sum("net_price").alias("items"))
    return orders.join(sums, "order_id").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("amount") != F.col("items")).alias("mismatches"))


def total_identity(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("orders"), F.count_if(
        F.col("amount") + F.col("tax") + F.col("tip") + F.col("gratuity") != F.col("total")).alias("wrong"))


def placement_counts(placed: DataFrame) -> DataFrame:
    """Orders per placement outcome; 'unknown_table' is the one to look at."""
    return placed.groupBy("seating_fit").agg(F.count(F.lit(1)).alias("orders"))


def facts_keep_everything(staged: DataFrame, facts: DataFrame, amount: str) -> DataFrame:
    """Rows and dollars before and after."""
    before = staged.agg(F.sum(amount)).scalar()
    rows = staged.agg(F.count(F.lit(1))).scalar()
    return facts.agg(F.count(F.lit(1)).alias("fact_rows"), F.sum(amount).alias("fact_amount")).withColumns(
        {"staged_rows": rows, "staged_amount": before})


def broken_versions(menu_items: DataFrame) -> DataFrame:
    """Versions whose end is not the next version's start."""
    by_start = Window.partitionBy("menu_item").orderBy("valid_from")
    following = F.lead("valid_from").over(by_start)
    return menu_items.withColumn("_next", following).agg(
        F.count(F.lit(1)).alias("versions"),
        F.count_if(~F.col("valid_to").eqNullSafe(F.col("_next"))).alias("broken"))


def uncovered_sales(items: DataFrame, item_facts: DataFrame) -> DataFrame:
    """Sales without a price version."""
    covered = item_facts.agg(F.count("menu_item_key")).scalar()
    return items.agg(F.count(F.lit(1)).alias("sales")).withColumn(
        "uncovered", F.col("sales") - covered)


def undated_facts(facts: DataFrame, dates: DataFrame) -> DataFrame:
    return facts.join(dates.select("date_key"), "date_key", "left_anti").agg(
        F.count(F.lit(1)).alias("undated"))


def facts_without_unit(facts: DataFrame) -> DataFrame:
    """Tabled orders outside the bar that have no seating unit, by placement outcome."""
    return (facts.where(F.col("table_code").isNotNull() & (F.col("section") != "Bar")
                        & F.col("seating_unit_key").isNull())
            .groupBy("seating_fit").agg(F.count(F.lit(1)).alias("orders")))


def section_seat_totals(units: DataFrame) -> DataFrame:
    expected = F.create_map(*[F.lit(x) for pair in rules.EXPECTED_SECTION_SEATS.items() for x in pair])
    return floorplan.section_capacity(units).withColumns({
        "expected": expected[F.col("section")],
        "ok": F.col("seats") == expected[F.col("section")]})


def codes_in_several_units(units: DataFrame) -> DataFrame:
    return units.groupBy("code").agg(F.count("seating_unit").alias("units")).where("units <> 1")


def cutoff_and_closed_day(orders: DataFrame) -> DataFrame:
    """Orders near the day boundary, and seated orders on the closed weekday."""
    near = cleaning.near_cutoff(orders).agg(F.count(F.lit(1))).scalar()
    monday = F.col("service_dow") == "Monday"
    return orders.agg(
        F.count_if(monday).alias("monday_rows"),
        F.count_if(monday & (F.col("order_type") == "Seated")).alias("monday_seated")
    ).withColumn("near_cutoff", near)


def order_types_known(orders: DataFrame) -> DataFrame:
    known = ["Seated", "Event-Catering", "To-Go"]
    return orders.agg(F.count(F.lit(1)).alias("orders"), F.count_if(
        F.coalesce(~F.col("order_type").isin(known), F.lit(True))).alias("unknown"))


def room_within_floor(room: DataFrame, table_count: int = rules.RESERVATION_TABLES) -> DataFrame:
    return room.agg(F.max("tables_occupied").alias("peak"),
                    F.count_if(F.col("tables_occupied") > table_count).alias("over_floor"))


def span_reconciliation(turned: DataFrame) -> DataFrame:
    """Occupied plus gap time against each table-night's span, overlap nights left out."""
    nights = turned.groupBy("service_date", "table_code").agg(
        F.count(F.lit(1)).alias("parties"), F.bool_or("turn_overlap").alias("overlap"),
        F.min("opened_at").alias("a"), F.max("paid_at").alias("b"),
        F.sum("duration_seconds").alias("seconds"), F.sum("turn_gap").alias("gaps"))
    clean = (F.col("parties") >= 2) & ~F.col("overlap")
    span = F.timestamp_diff("SECOND", F.col("a"), F.col("b")) / F.lit(60.0)
    residual = F.abs(span - (F.col("seconds") / F.lit(60.0) + F.coalesce("gaps", F.lit(0.0))))
    return nights.agg(
        F.count_if(clean).alias("clean_table_nights"),
        F.count_if((F.col("parties") >= 2) & F.col("overlap")).alias("overlap_nights"),
        F.count_if(clean & (residual >= 0.01)).alias("unreconciled"))


def negative_gaps(turned: DataFrame) -> DataFrame:
    return turned.agg(F.count("turn_gap").alias("gaps"), F.min("turn_gap").alias("least"),
                      F.count_if(F.col("turn_gap") < 0).alias("negative"))


def merge_is_lossless(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged rows, distinct identities of all pulls, and the worst one-pull revenue drift."""
    identities = rows.select(*merge.KEY).distinct().agg(F.count(F.lit(1))).scalar()
    lost = merge.lost_identities(rows, merged).agg(F.count(F.lit(1))).scalar()
    drift = merge.revenue_drift(rows, merged).agg(F.max("drift")).scalar()
    return merged.agg(F.count(F.lit(1)).alias("merged_rows")).withColumns(
        {"identities": identities, "lost": lost, "worst_drift": drift})


def block_within_night(blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """Median best block against the median night's revenue of the section."""
    nights = orders.groupBy("section", "service_date").agg(F.sum("amount").cast("double").alias("revenue"))
    whole = nights.groupBy("section").agg(F.median("revenue").alias("median_night"))
    best = blocks.groupBy("section").agg(F.median("best_block").alias("median_block"))
    return best.join(whole, "section").withColumn("ok", F.col("median_block") <= F.col("median_night"))
