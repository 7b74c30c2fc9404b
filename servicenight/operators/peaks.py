"""Peaks to the minute, from arrivals and departures instead of stays cut into slots.

A stay adds one where it starts and takes one away after its last minute; running totals of these
steps tell how many tables are taken. Steps of one moment are summed before they move. The totals
run over the whole table in even ranges whose sums are carried across the cuts: the steps of a
night cancel out, so the total starts every night at zero and a night of any size is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from servicenight.functions import calendar
from servicenight.operators import occupancy
from servicenight.session import materialize


def running_totals(steps: DataFrame, order: list[str], step: str) -> DataFrame:
    """The rows with ``total``, the sum of ``step`` up to and with each row in the given order, which has to be unique."""
    ranged = materialize(steps.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("_range").agg(F.sum(step).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    # one row per range
    return ranged.withColumn("_here", F.sum(step).over(inside)).join(F.broadcast(carried), "_range").withColumn(
        "total", F.col("_here") + F.col("_before")).drop("_range", "_here", "_before")


def summed_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    return steps.groupBy(*keys).agg(F.sum("step").alias("step")).where("step <> 0")


def tables_taken(orders: DataFrame) -> DataFrame:
    """(service_date, minute, tables): from each minute on which it changes, how many tables have a stay.

    Minutes count from the midnight that starts the service date. A stay holds its table from the
    minute it opens in to the one it is paid in. Stays that overlap at one table count once.
    """
    stays = occupancy.stay_slots(orders, 1).where(F.col("service_date").isNotNull() & F.col("table_code").isNotNull())
    edge = lambda minute, step: F.struct(minute.cast("long").alias("minute"), F.lit(step).alias("step"))
    edges = stays.select("service_date", "table_code", F.explode(F.array(
        edge(F.col("first_slot"), 1), edge(F.col("last_slot") + 1, -1))).alias("e")).select("service_date", "table_code", "e.*")
    at_table = ["service_date", "table_code", "minute"]
    parties = running_totals(summed_steps(edges, at_table), at_table, "step")
    taken = (F.col("total") > 0).cast("int") - (F.col("total") - F.col("step") > 0).cast("int")
    in_room = ["service_date", "minute"]
    changes = summed_steps(parties.select(*in_room, taken.alias("step")), in_room)
    return running_totals(changes, in_room, "step").select(*in_room, F.col("total").alias("tables"))


def minute_peaks(orders: DataFrame) -> DataFrame:
    """Most tables taken at one time in each night, and the first minute at which they are."""
    top = F.max(F.struct("tables", (-F.col("minute")).alias("before")))
    return tables_taken(orders).groupBy("service_date").agg(top.alias("t")).select(
        "service_date", F.col("t.tables").alias("peak_tables"), (-F.col("t.before")).alias("peak_minute"),
        calendar.clock_label(-F.col("t.before")).alias("peak_clock"))


def against_slots(peaks: DataFrame, room: DataFrame, table_count: int) -> DataFrame:
    """Nights, and those whose peak is over the floor or over that of its quarter hours.

    A quarter hour counts all tables that were taken at some time in it, one after the other too,
    so a peak to the minute can be lower but never higher.
    """
    slots = room.groupBy("service_date").agg(F.max("tables_occupied").alias("slot_peak"))
    return peaks.join(slots, "service_date", "full").agg(
        F.count(F.lit(1)).alias("nights"), F.count_if(F.col("peak_tables") > table_count).alias("over_floor"),
        F.count_if(~(F.coalesce(F.col("peak_tables"), F.lit(-1)) <= F.coalesce(F.col("slot_peak"), F.lit(-1))) | F.col("peak_tables").isNull()).alias("over_slots"),
        F.count_if(F.col("peak_tables") < F.col("slot_peak")).alias("under_slots"))
