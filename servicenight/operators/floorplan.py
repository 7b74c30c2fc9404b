"""Where each order sat: a floor plan that changes over time.

Floor plans are hand-kept tables of a few dozen rows. Everything about a table code
is folded into one row per code, so placing orders is one join on the code and
narrow expressions after it: orders are never shuffled, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from servicenight import rules
from servicenight.functions import measures
from servicenight.session import small_table


def tables(spark: SparkSession) -> DataFrame:
    return small_table(
        spark, rules.FLOOR_PLAN_TABLES,
        "table_code string, section string, seats_min int, seats_max int, valid_from date, valid_to date")


def combinations(spark: SparkSession) -> DataFrame:
    return small_table(
        spark, rules.FLOOR_PLAN_COMBINATIONS,
        "combination string, section string, table_codes array<string>, seats int, "
        "is_whole_room boolean, valid_from date, valid_to date")


def in_force(day: Column, valid_from: Column, valid_to: Column) -> Column:
    return (day >= valid_from) & (valid_to.isNull() | (day < valid_to))


def table_in_force(orders: DataFrame, floor_tables: DataFrame) -> DataFrame:
    """Left as-of join: each order with the floor-plan row of its code on its service date."""
    plan = floor_tables.select(
        F.col("table_code").alias("_code"), "section", "seats_max", "valid_from", "valid_to")
    return orders.join(
        plan, (F.col("table_code") == F.col("_code"))
        & in_force(F.col("service_date"), F.col("valid_from"), F.col("valid_to")),
        "left").drop("valid_from", "valid_to")


def options_by_code(floor_combinations: DataFrame) -> DataFrame:
    """One row per table code with every combination that contains it."""
    option = F.struct("seats", F.size("table_codes").alias("size"), "combination", "is_whole_room",
                      "valid_from", "valid_to")
    return (floor_combinations
            .select(F.explode("table_codes").alias("_option_code"), option.alias("o"))
            .groupBy("_option_code").agg(F.collect_list("o").alias("_options")))


def with_best_options(orders: DataFrame, floor_combinations: DataFrame) -> DataFrame:
    """The smallest combination and room that seat the party, and the largest of any kind.

    Ties: fewer tables, then name; for the largest, a room before a combination.
    """
    joined = orders.join(options_by_code(floor_combinations),
                         F.col("table_code") == F.col("_option_code"), "left")
    current = F.filter("_options", lambda o: in_force(F.col("service_date"), o["valid_from"], o["valid_to"]))
    rank = lambda o: F.struct(o["seats"].alias("seats"), o["size"].alias("size"),
                              o["combination"].alias("unit"))
    fits = lambda room: F.array_min(F.transform(
        F.filter("_current", lambda o: (o["is_whole_room"] == F.lit(room))
                 & (o["seats"] >= F.col("guests"))), rank))
    largest = F.array_min(F.transform("_current", lambda o: F.struct(
        (-o["seats"]).alias("order"), (~o["is_whole_room"]).alias("kind"),
        o["combination"].alias("unit"), o["seats"].alias("seats"))))
    return (joined.withColumn("_current", current)
            .withColumns({"_combo": fits(False), "_room": fits(True), "_largest": largest})
            .drop("_option_code", "_options", "_current"))


def with_placement(orders: DataFrame, floor_tables: DataFrame, floor_combinations: DataFrame) -> DataFrame:
    """Add section, fit class, seating unit, its seats and the guest-count flag to orders.

    A party larger than its table is taken to have used the smallest listed combination
    that seats it, then the whole room, then whatever is largest.
    """
    known = F.col("_code").isNotNull()
    fits_table = F.col("guests") <= F.col("seats_max")
    seated = known & (F.col("section") != "Bar")
    rows = with_best_options(table_in_force(orders, floor_tables), floor_combinations)
    chosen = lambda field, own: F.coalesce(
        F.col(f"_combo.{field}"), F.col(f"_room.{field}"), F.col(f"_largest.{field}"), own)
    return rows.select(
        *orders.columns, "section",
        F.when(F.col("table_code").isNull(), "no_table")
        .when(~known, "unknown_table")
        .when(F.col("section") == "Bar", "bar")
        .when(fits_table, "table")
        .when(F.col("_combo").isNotNull(), "combination")
        .when(F.col("_room").isNotNull(), "whole_room")
        .otherwise("over_capacity").alias("seating_fit"),
        F.when(seated, F.when(fits_table, F.col("table_code"))
               .otherwise(chosen("unit", F.col("table_code")))).alias("seating_unit"),
        F.when(seated, F.when(fits_table, F.col("seats_max"))
               .otherwise(chosen("seats", F.col("seats_max")))).alias("unit_seats"),
        measures.guests_implausible(F.col("guests"), F.col("section")).alias("guests_implausible"))


def place_orders(orders: DataFrame, floor_tables: DataFrame, floor_combinations: DataFrame) -> DataFrame:
    """The placement table alone: one row per order."""
    base = orders.select("order_id", "service_date", "table_code", "guests")
    return with_placement(base, floor_tables, floor_combinations)


def seating_unit_dimension(floor_tables: DataFrame, floor_combinations: DataFrame) -> DataFrame:
    """Tables, combinations and rooms per validity period, keyed in a fixed order."""
    single = floor_tables.select(
        F.col("table_code").alias("unit_name"),
        F.when(F.col("section") == "Bar", "bar").otherwise("table").alias("unit_type"),
        "section", F.array("table_code").alias("table_codes"), F.col("seats_max").alias("seats"),
        "valid_from", "valid_to")
    combined = floor_combinations.select(
        F.col("combination").alias("unit_name"),
        F.when(F.col("is_whole_room"), "whole_room").otherwise("combination").alias("unit_type"),
        "section", "table_codes", "seats", "valid_from", "valid_to")
    # a floor plan is a hand-kept list, so one task numbers it
    order = Window.orderBy("section", "unit_name", "valid_from")
    return single.unionByName(combined).select(
        F.row_number().over(order).alias("seating_unit_key"), "*",
        F.col("valid_to").isNull().alias("is_current"))


# --- current physical units (exports without ids) ---------------------------------------------

def unit_dimension(spark: SparkSession) -> DataFrame:
    """One row per code of a current unit: unit, seats, solo range and section."""
    solo = {code: (least, most) for code, least, most in rules.SOLO_CAPACITY}
    units = [(code, unit, seats, len(codes), *solo.get(code, (None, None)))
             for unit, codes, seats in rules.SEATING_UNITS for code in codes]
    frame = small_table(spark, units, "code string, seating_unit string, unit_capacity int, unit_codes int, "
                        "capacity_min int, capacity_max int")
    return frame.withColumn("unit_section", measures.section_of(F.col("code")))


def with_units(orders: DataFrame, units: DataFrame) -> DataFrame:
    """Unit and capacity columns; unmapped codes keep NULL and compare as False."""
    dim = units.select(F.col("code").alias("_code"), "seating_unit", "unit_capacity",
                       "capacity_min", "capacity_max")
    never = F.lit(False)
    return (orders.join(dim, F.col("table_code") == F.col("_code"), "left").drop("_code")
            .withColumns({
                "likely_combined": F.coalesce(F.col("guests") > F.col("unit_capacity"), never),
                "exceeds_solo": F.coalesce(F.col("guests") > F.col("capacity_max"), never)}))


def section_capacity(units: DataFrame) -> DataFrame:
    """Seats, units and capacity-bearing tables per section."""
    per_unit = units.where(F.col("seating_unit").isNotNull()).groupBy("unit_section", "seating_unit").agg(
        F.max("unit_capacity").alias("seats"),
        F.count(F.when(F.col("capacity_max").isNotNull(), 1)).alias("codes"))
    return per_unit.groupBy(F.col("unit_section").alias("section")).agg(
        F.sum("seats").alias("seats"), F.count(F.lit(1)).alias("units"),
        F.sum("codes").alias("tables"))
