"""Occupancy: which tables were full in each quarter hour of each night."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight import rules
from servicenight.functions import bitmaps, calendar


def _settled(total: Column) -> Column:
    """A sum of doubles without the last digits that depend on the order of addition."""
    return F.round(total, 6)


def stay_slots(orders: DataFrame, minutes: int = rules.SLOT_MINUTES) -> DataFrame:
    """First and last slot of every plausible seated stay; the last slot is included."""
    seated = orders.where((F.col("order_type") == "Seated")
                          & F.col("duration_seconds").between(0, rules.LONG_SESSION_SECONDS))
    return seated.withColumns({
        "first_slot": calendar.slot_of(F.col("opened_at"), F.col("service_date"), minutes),
        "last_slot": calendar.slot_of(F.col("paid_at"), F.col("service_date"), minutes)})


def build_occupancy(orders: DataFrame, minutes: int = rules.SLOT_MINUTES) -> DataFrame:
    """One row per order and occupied slot, the amount spread evenly over its slots.

    A stay is at most six hours, so a row becomes at most 25.
    """
    stays = stay_slots(orders, minutes)
    slots = F.sequence("first_slot", "last_slot")
    return stays.select(
        "service_date", "service_dow", "table_code", "section",
        F.explode(slots).alias("slot"),
        (F.col("amount").cast("double") / (F.col("last_slot") - F.col("first_slot") + 1)
         ).alias("slot_revenue"),
    ).withColumn("clock_minutes", F.col("slot") * minutes).withColumn(
        "clock_label", calendar.clock_label(F.col("clock_minutes")))


def table_slots(occupancy: DataFrame) -> DataFrame:
    """Distinct occupied (night, slot, table)."""
    return occupancy.select("service_date", "slot", "table_code").distinct()


def room_fullness(occupancy: DataFrame, table_count: int = rules.RESERVATION_TABLES) -> DataFrame:
    """Distinct tables taken per night and slot in the reservation sections."""
    reserved = occupancy.where(F.col("section").isin(rules.RESERVATION_SECTIONS))
    return (table_slots(reserved).groupBy("service_date", "slot")
            .agg(F.count("table_code").alias("tables_occupied"))
            .withColumn("room_pct", F.lit(100.0) * F.col("tables_occupied") / table_count))


def room_summary(room: DataFrame, table_count: int = rules.RESERVATION_TABLES) -> DataFrame:
    return room.agg(
        F.max("room_pct").alias("peak_pct"), F.median("room_pct").alias("median_pct"),
        F.count_if(F.col("tables_occupied") == table_count).alias("full_slots"),
        F.count_if(F.col("tables_occupied") >= 15).alias("nearly_full_slots"),
        F.count(F.lit(1)).alias("open_slots"))


def utilization_by_slot(occupancy: DataFrame, sections: list[str], table_count: int) -> DataFrame:
    """Share of tables taken per weekday and slot, as reported, and averaged per night.

    ``utilization_pct`` divides the distinct tables seen in the slot over all nights by
    nights times tables; ``mean_utilization_pct`` counts table-nights instead.
    """
    rows = occupancy.where(F.col("section").isin(sections))
    # one reduction to bitmaps of nights per (slot, table) feeds every count below
    words = rows.groupBy("service_dow", "slot", "table_code", bitmaps.word_of(F.col("service_date")).alias("word")).agg(
        F.bit_or(bitmaps.bit_of(F.col("service_date"))).alias("bits"), F.sum("slot_revenue").alias("revenue"))
    nights = words.groupBy("service_dow", "word").agg(F.bit_or("bits").alias("bits")).groupBy("service_dow").agg(
        F.sum(F.bit_count("bits")).alias("nights"))
    per_table = words.groupBy("service_dow", "slot", "table_code").agg(
        F.sum(F.bit_count("bits")).alias("table_nights"), F.sum("revenue").alias("revenue"))
    per_slot = per_table.groupBy("service_dow", "slot").agg(
        F.count("table_code").alias("tables_occupied"),
        F.sum("table_nights").alias("table_nights"), _settled(F.sum("revenue")).alias("revenue"))
    hundred = F.lit(100.0)
    floor = F.col("nights") * table_count
    clock = F.col("slot") * rules.SLOT_MINUTES
    return per_slot.join(nights, "service_dow").select(
        "service_dow", calendar.clock_label(clock).alias("clock_label"),
        clock.alias("clock_minutes"), "tables_occupied", "nights", "revenue",
        (hundred * F.col("tables_occupied") / floor).alias("utilization_pct"),
        (hundred * F.col("table_nights") / floor).alias("mean_utilization_pct"),
        (F.col("revenue") / F.col("nights")).alias("revenue_per_night"))


def unit_peak_share(occupancy: DataFrame, units: DataFrame, slots: tuple[int, int] = rules.PEAK_SLOTS
                    ) -> DataFrame:
    """Share of open peak slots in which a unit was taken; a unit nobody used has a share of zero."""
    peak = occupancy.where(F.col("slot").between(*slots))
    cells = peak.select("service_date", "slot", "table_code").distinct()
    open_slots = cells.select("service_date", "slot").distinct().agg(F.count(F.lit(1))).scalar()
    codes = units.select(F.col("code").alias("table_code"), "seating_unit").where("seating_unit is not null")
    busy = (cells.join(codes, "table_code").select("seating_unit", "service_date", "slot").distinct()
            .groupBy("seating_unit").agg(F.count(F.lit(1)).alias("busy")))
    every = codes.select("seating_unit").distinct().join(busy, "seating_unit", "left")
    return every.select("seating_unit", F.coalesce("busy", F.lit(0)).alias("busy_slots")).select(
        "seating_unit", "busy_slots",
        (F.lit(100.0) * F.col("busy_slots") / F.nullif(open_slots, F.lit(0))).alias("peak_pct"))


def hour_shape(occupancy: DataFrame, nights: DataFrame) -> DataFrame:
    """Revenue per night by weekday and clock hour, from slot-spread revenue."""
    hours = occupancy.groupBy("service_dow", F.floor(F.col("clock_minutes") / 60).cast("int").alias("hour")
                              ).agg(_settled(F.sum("slot_revenue")).alias("revenue"))
    return hours.join(nights, "service_dow").select(
        "service_dow", "hour", "revenue", (F.col("revenue") / F.col("nights")).alias("per_night"))


def nights_by_weekday(orders: DataFrame) -> DataFrame:
    return orders.groupBy("service_dow").agg(F.countDistinct("service_date").alias("nights"))


def pivot_hours(shape: DataFrame) -> DataFrame:
    """Hours down, trading days across; hours a day never traded read zero."""
    wide = shape.groupBy("hour").pivot("service_dow", rules.TRADING_DAYS).agg(F.sum("per_night"))
    return wide.na.fill(0.0)


def edge_hours(shape: DataFrame) -> DataFrame:
    """What the first and last hours earn per weekday, and their share of the night."""
    at = lambda *hours: F.coalesce(F.sum(F.when(F.col("hour").isin(list(hours)), F.col("per_night"))),
                                   F.lit(0.0))
    whole = F.sum("per_night")
    return shape.where(F.col("service_dow").isin(rules.TRADING_DAYS)).groupBy("service_dow").agg(
        at(16).alias("opens_4pm"), at(17).alias("opens_5pm"), at(23).alias("hour_11pm"),
        at(24).alias("midnight_hour"), at(25).alias("hour_1am"), whole.alias("whole_night"),
        (F.lit(100.0) * at(16, 17) / whole).alias("early_pct"),
        (F.lit(100.0) * at(24, 25, 26) / whole).alias("late_pct"))


def slot_revenue(occupancy: DataFrame) -> DataFrame:
    return occupancy.groupBy("section", "service_date", "service_dow", "slot").agg(
        F.sum("slot_revenue").alias("revenue"))


def best_blocks(occupancy: DataFrame, block: int = rules.BLOCK_SLOTS) -> DataFrame:
    """Each night's best run of ``block`` slots per section.

    Empty slots inside the night count as zero; nights shorter than a block are left out.
    Rows are first reduced to one per slot, so a night's window has at most some 120 rows.
    """
    revenue = slot_revenue(occupancy)
    night = ["section", "service_date", "service_dow"]
    span = revenue.groupBy(*night).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    dense = span.select(*night, F.explode(F.sequence("lo", "hi")).alias("slot"))
    filled = dense.join(revenue, [*night, "slot"], "left").withColumn(
        "revenue", F.coalesce("revenue", F.lit(0.0)))
    window = Window.partitionBy(*night).orderBy("slot").rowsBetween(1 - block, 0)
    rolled = filled.select(*night, F.sum("revenue").over(window).alias("total"),
                           F.count(F.lit(1)).over(window).alias("slots"))
    return (rolled.where(F.col("slots") == block).groupBy(*night)
            .agg(F.max("total").alias("best_block")))


def event_price_verdict(blocks: DataFrame, by_weekday: bool) -> DataFrame:
    """Compare each section's event price with its best blocks."""
    prices = F.create_map(*[F.lit(x) for pair in rules.EVENT_PRICES.items() for x in pair])
    priced = (blocks.where(F.col("section").isin(list(rules.EVENT_PRICES)))
              .withColumn("price", prices[F.col("section")]))
    keys = ["section", "price"] + (["service_dow"] if by_weekday else [])
    return priced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nights"), F.median("best_block").alias("median_block"),
        F.max("best_block").alias("best_ever"),
        (F.lit(100.0) * F.count_if(F.col("best_block") < F.col("price")) / F.count(F.lit(1))).alias("price_wins_pct"),
    ).withColumn("event_premium", F.col("price") - F.col("median_block"))


def arrival_conflicts(orders: DataFrame, held_table: str, held_max: int, party: tuple[int, int]) -> DataFrame:
    """Larger parties that arrived while a table was held by a small one (semi join).

    Nobody arrives after the night's last slot, so a check left open for days is only
    followed up to there.
    """
    last_arrival = (24 + rules.SERVICE_CUTOFF_HOURS) * 60 // rules.SLOT_MINUTES - 1
    stays = (orders.where((F.col("table_code") == held_table) & (F.col("guests") <= held_max)
                          & F.col("paid_at").isNotNull())
             .withColumns({"a": calendar.slot_of(F.col("opened_at"), F.col("service_date")),
                           "b": F.least(calendar.slot_of(F.col("paid_at"), F.col("service_date")),
                                        F.lit(last_arrival))})
             .where("a <= b"))
    held = stays.select("service_date", F.explode(F.sequence("a", "b")).alias("slot")).distinct()
    arrivals = orders.where(F.col("guests").between(*party)).withColumn(
        "slot", calendar.slot_of(F.col("opened_at"), F.col("service_date")))
    return arrivals.join(held, ["service_date", "slot"], "left_semi")


def partner_pairs(units: DataFrame) -> DataFrame:
    """Both directions of every two-code unit, with the anchor's solo capacity."""
    two = units.where(F.col("unit_codes") == 2).select("code", "seating_unit", "capacity_max")
    other = two.select(F.col("code").alias("partner"), F.col("seating_unit").alias("_unit"))
    return (two.join(other, (F.col("seating_unit") == F.col("_unit")) & (F.col("code") != F.col("partner")))
            .select(F.col("code").alias("anchor"), "partner", "capacity_max"))


def partner_free(orders: DataFrame, occupancy: DataFrame, units: DataFrame, min_parties: int = 20) -> DataFrame:
    """How often a code's partner was empty when the code took a party too big for itself."""
    pairs = partner_pairs(units).withColumnRenamed("capacity_max", "_solo")
    big = (orders.join(pairs, F.col("table_code") == F.col("anchor"))
           .where(F.col("guests") > F.col("_solo"))
           .select("anchor", "partner", "service_date",
                   calendar.slot_of(F.col("opened_at"), F.col("service_date")).alias("slot")))
    # parties of one anchor, night and slot are counted before they meet the timeline
    cells = big.groupBy("anchor", "partner", "service_date", "slot").agg(F.count(F.lit(1)).alias("n"))
    taken = table_slots(occupancy).withColumnRenamed("table_code", "partner").withColumn("taken", F.lit(True))
    return (cells.join(taken, ["partner", "service_date", "slot"], "left")
            .groupBy("anchor", "partner").agg(
                F.sum("n").alias("parties"),
                F.sum(F.when(F.col("taken").isNull(), F.col("n")).otherwise(0)).alias("free"))
            .where(F.col("parties") >= min_parties)
            .withColumn("free_pct", F.lit(100.0) * F.col("free") / F.col("parties")))


def slot_split_shortfall(orders: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Slot-spread revenue against recorded seated revenue; the rest sat over six hours."""
    seated = orders.where(F.col("order_type") == "Seated")
    too_long = F.col("duration_seconds") > rules.LONG_SESSION_SECONDS
    split = occupancy.agg(F.sum("slot_revenue")).scalar()
    totals = seated.agg(
        F.sum("amount").cast("double").alias("recorded"), F.count_if(too_long).alias("long_stays"),
        F.coalesce(F.sum(F.when(too_long, F.col("amount"))).cast("double"), F.lit(0.0)).alias("long_revenue"))
    return totals.select("recorded", split.alias("split"), "long_stays", "long_revenue")
