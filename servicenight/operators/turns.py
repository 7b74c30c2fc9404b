"""Turn gaps: dead time between one party paying and the next sitting down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from servicenight.functions import calendar, measures
from servicenight.operators.ordering import with_position
from servicenight.session import materialize


def add_turn_gaps(orders: DataFrame) -> DataFrame:
    """Gap in minutes to the next party of the same table and night.

    A next party that sits before this one paid is an overlap: flagged, gap NULL. Orders
    without a table are no turn at all. Ties in opening time follow the order id.
    """
    # without a table an order is a group of its own, so one pass serves all rows
    at_table = F.col("table_code").isNotNull()
    keyed = orders.withColumn("_alone", F.when(~at_table, F.col("order_id")))
    positioned = with_position(
        keyed, ["table_code", "_alone", "service_date"], [F.col("opened_at"), F.col("order_id")],
        "_position", {"_next_opened": "opened_at"})
    gap = calendar.seconds_between(F.col("paid_at"), F.col("_next_opened")) / F.lit(60.0)
    return (positioned.withColumn("_gap", F.when(at_table, gap))
            .withColumns({"turn_index": F.when(at_table, F.col("_position")),
                          "turn_overlap": F.coalesce(F.col("_gap") < 0, F.lit(False)),
                          "turn_gap": F.when(F.col("_gap") >= 0, F.col("_gap"))})
            .drop("_gap", "_next_opened", "_alone", "_position"))


def gap_summary(turned: DataFrame, by: str, min_turns: int = 0) -> DataFrame:
    """Turns, median and mean gap per value of ``by``."""
    return (turned.where(F.col("turn_gap").isNotNull()).groupBy(by)
            .agg(F.count(F.lit(1)).alias("turns"), F.median("turn_gap").alias("median_gap"),
                 F.avg("turn_gap").alias("mean_gap"))
            .where(F.col("turns") >= min_turns))


def gap_by_weekday(turned: DataFrame) -> DataFrame:
    """Gap summary per weekday with the mean number of parties per table and night."""
    table_nights = turned.groupBy("service_date", "service_dow", "table_code").agg(
        F.count(F.lit(1)).alias("parties"))
    per_night = table_nights.groupBy("service_dow").agg(F.avg("parties").alias("turns_per_table_night"))
    return gap_summary(turned, "service_dow").join(per_night, "service_dow")


def gap_by_paid_hour(turned: DataFrame, min_turns: int = 20) -> DataFrame:
    return gap_summary(turned.withColumn("paid_hour", F.hour("paid_at")), "paid_hour", min_turns)


def gap_by_table(turned: DataFrame, min_turns: int = 30) -> DataFrame:
    """Tables with enough measured turns, against their section's median gap."""
    tables = (turned.groupBy("section", "table_code").agg(
        F.count("turn_gap").alias("turns"), F.median("turn_gap").alias("median_gap"),
        F.median("duration").alias("median_duration"), F.count("amount").alias("orders"),
        F.sum("amount").alias("revenue")).where(F.col("turns") >= min_turns))
    sections = turned.groupBy("section").agg(F.median("turn_gap").alias("section_median"))
    return tables.join(sections, "section").select(
        *tables.columns, (F.col("median_gap") - F.col("section_median")).alias("vs_section"))


def with_room_fullness(rows: DataFrame, room: DataFrame, slot: str = "slot") -> DataFrame:
    """Attach how full the room was in a row's slot; a slot nobody sat in is empty."""
    fullness = room.select("service_date", F.col("slot").alias(slot), "room_pct")
    return rows.join(fullness, ["service_date", slot], "left").withColumn(
        "room_pct", F.coalesce("room_pct", F.lit(0.0)))


def gaps_with_fullness(turned: DataFrame, room: DataFrame) -> DataFrame:
    """Measured gaps with room fullness at the moment the table came free."""
    gaps = turned.where(F.col("turn_gap").isNotNull()).withColumn(
        "slot", calendar.slot_of(F.col("paid_at"), F.col("service_date")))
    return with_room_fullness(gaps, room).withColumn(
        "room_fullness", measures.fullness_band(F.col("room_pct")))


def gap_by_fullness(gaps: DataFrame) -> DataFrame:
    banded = gaps.where(F.col("room_fullness").isNotNull())
    summary = banded.groupBy("room_fullness").agg(
        F.count(F.lit(1)).alias("turns"), F.median("turn_gap").alias("median_gap"),
        F.avg("turn_gap").alias("mean_gap"))
    everything = Window.partitionBy()    # at most four bands
    return summary.withColumn(
        "share_pct", F.round(F.lit(100.0) * F.col("turns") / F.sum("turns").over(everything), 1))


def faster_turning_value(gaps: DataFrame, seated: DataFrame, annualize: float = 2.0) -> DataFrame:
    """Idle peak minutes and their yearly value under three assumptions.

    1: every minute above 15 sells; 2: above the reset reached when the room is over
    three quarters full; 3: as 2, but only gaps that began while it was that full.
    """
    gaps = materialize(gaps.select("turn_gap", "room_pct", "paid_at"))     # read twice below
    busy_reset = gaps.where(F.col("room_pct") > 75).agg(F.median("turn_gap")).scalar()
    rate = seated.agg(F.sum("amount").cast("double") / (F.sum("duration_seconds") / F.lit(900.0))).scalar()
    peak = gaps.where(F.hour("paid_at").between(17, 22)).withColumn("_reset", busy_reset)
    idle = peak.agg(
        F.sum(measures.floored(F.col("turn_gap"), 15)).alias("naive"),
        F.sum(measures.floored(F.col("turn_gap"), F.col("_reset"))).alias("reset"),
        F.coalesce(F.sum(F.when(F.col("room_pct") > 75, measures.floored(F.col("turn_gap"), F.col("_reset")))),
                   F.lit(0.0)).alias("busy"))
    scenario = idle.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("scenario"), F.col(c).alias("idle_minutes"))
        for i, c in enumerate(["naive", "reset", "busy"], 1)])).alias("s")).select("s.*")
    return scenario.withColumn(
        "value_per_year", F.col("idle_minutes") / 15 * rate * annualize)
