"""The engine's frames built from the given tables, shared by the registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from servicenight import rules
from servicenight.functions import measures
from servicenight.operators import (cleaning, facts, floorplan, menu, merge, occupancy, prices, rates,
                                    trend, turns)
from servicenight.plans import standins


def placed_orders(spark: SparkSession, sf: str) -> DataFrame:
    return floorplan.with_placement(standins.orders(spark, sf), floorplan.tables(spark),
                                    floorplan.combinations(spark))


def seating_units(spark: SparkSession) -> DataFrame:
    return floorplan.seating_unit_dimension(floorplan.tables(spark), floorplan.combinations(spark))


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.order_facts(placed_orders(spark, sf), seating_units(spark))


def typed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their order type, for reports that need no placement."""
    orders = standins.orders(spark, sf)
    return orders.withColumn("order_type", measures.order_type(orders.table_code, orders.amount))


def dates(spark: SparkSession, sf: str) -> DataFrame:
    return facts.date_dimension(standins.orders(spark, sf))


def nightly(spark: SparkSession, sf: str) -> DataFrame:
    return facts.nightly_summary(dates(spark, sf), order_facts(spark, sf))


def trading_nights(spark: SparkSession, sf: str) -> DataFrame:
    """Regular nights with weather and derived columns."""
    every = nightly(spark, sf)
    weather = standins.daily_weather(every)
    return trend.with_weather(trend.with_night_columns(trend.regular_nights(every)), weather)


def menu_items(spark: SparkSession, sf: str) -> DataFrame:
    return prices.menu_item_dimension(standins.items(spark, sf))


def item_facts(spark: SparkSession, sf: str, menu_dim: DataFrame, days: tuple | None = None) -> DataFrame:
    return facts.item_facts(standins.items(spark, sf), standins.orders(spark, sf), menu_dim, days)


def sales(spark: SparkSession, sf: str, menu_dim: DataFrame | None = None, days: tuple | None = None) -> DataFrame:
    menu_dim = menu_dim or menu_items(spark, sf)
    return menu.item_sales(item_facts(spark, sf, menu_dim, days), menu_dim, dates(spark, sf))


def guest_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales of the compared years with their order's type and guests."""
    first, last = rules.COMPARED_YEARS
    days = (dt.date(first, 1, 1), dt.date(last, 12, 31))
    return menu.with_order_context(sales(spark, sf, days=days), order_facts(spark, sf))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_orders(standins.visits(spark, sf), floorplan.unit_dimension(spark))


def seated(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.above_duration_floor(cleaned(spark, sf))


def turned(spark: SparkSession, sf: str) -> DataFrame:
    return turns.add_turn_gaps(seated(spark, sf))


def reserved(spark: SparkSession, sf: str) -> DataFrame:
    """Seated visits of the reservation sections."""
    return cleaning.reservation_only(seated(spark, sf))


def reserved_turns(spark: SparkSession, sf: str) -> DataFrame:
    return turns.add_turn_gaps(reserved(spark, sf))


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.build_occupancy(seated(spark, sf))


def room(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.room_fullness(occupancy.build_occupancy(reserved(spark, sf)))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return turns.gaps_with_fullness(reserved_turns(spark, sf), room(spark, sf))


def rated(spark: SparkSession, sf: str) -> DataFrame:
    return rates.with_rates(seated(spark, sf))


def single_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rated reservation visits that did not span units."""
    return cleaning.reservation_only(rated(spark, sf)).where("not likely_combined")


def visit_nights(spark: SparkSession, sf: str) -> DataFrame:
    """Seated revenue per night with weather and holidays."""
    nights = trend.seated_nights(seated(spark, sf))
    with_wx = trend.with_weather(nights, standins.daily_weather(nights))
    return trend.with_holidays(with_wx, trend.holidays_frame(spark))


def pulls(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every pull, chunk duplicates dropped and occurrences numbered."""
    return merge.add_occurrence(merge.drop_chunk_duplicates(standins.pull_rows(spark, sf)))
