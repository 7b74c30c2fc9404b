"""Joins of points with the intervals they lie in, when both sides are large.

A sweep over points and interval bounds in the order of key and time: the events are cut into even
ranges, each range counts its points, and the counts are carried across the cuts. Every interval then
knows the first and the last point inside it by number, whatever ranges lie between, and an equality
join on blocks of numbers brings them together. Numbers are unique, so a key with a third of all
rows is spread like any other, and an interval costs what it matches, not what it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight.session import materialize

#: Points of one block: an interval is sent once to each block it touches.
BLOCK = 64
# at one moment: what ends before it, what starts, the points, what ends after it
_END, _START, _POINT, _CLOSED_END = range(4)


def numbered_events(events: DataFrame) -> DataFrame:
    """Events (key, at, kind, id) with ``passed``, how many points stand before each in the order of key, time and kind."""
    order = ["key", "at", "kind", "id"]
    ranked = materialize(events.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id())
    is_point = (F.col("kind") == _POINT).cast("long")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranked.withColumn("_local", F.coalesce(F.sum(is_point).over(inside), F.lit(0)))
    totals = ranked.groupBy("_range").agg(F.sum(is_point).alias("_points"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", F.coalesce(F.sum("_points").over(earlier), F.lit(0)).alias("_before"))
    # one row per range
    return local.join(F.broadcast(carried), "_range").select("id", "kind", (F.col("_local") + F.col("_before")).alias("passed"))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[tuple[str, str]], at: str, start: str, end: str,
                  how: str = "inner", closed: bool = False) -> DataFrame:
    """Each point with every interval of its key that it lies in; all columns of both sides.

    ``on`` pairs columns of points and intervals that must be equal. An interval holds its start and
    goes up to, but not including, its end (including it if ``closed``); a null start or end leaves that side open. A
    null key or time lies in no interval. ``how`` is inner, left, left_semi or left_anti, for the points.
    """
    left = materialize(points.withColumn("_iv_pid", F.monotonically_increasing_id()))
    right = materialize(intervals.withColumn("_iv_iid", F.monotonically_increasing_id()))
    point_key, interval_key = [F.struct(*[F.col(side[i]).alias(f"k{n}") for n, side in enumerate(on)]) for i in (0, 1)]
    known = lambda i: _all([F.col(side[i]).isNotNull() for side in on])
    # a struct sorts by whether the time is known, so that open sides lie before and after all times
    moment = lambda open_, time: F.struct(F.lit(open_).alias("o"), time.alias("t"))
    time = left.schema[at].dataType
    bound = lambda c, open_: F.when(F.col(c).isNull(), moment(open_, F.lit(None).cast(time))).otherwise(moment(0, F.col(c).cast(time)))
    events = left.where(known(0) & F.col(at).isNotNull()).select(
        point_key.alias("key"), moment(0, F.col(at)).alias("at"), F.lit(_POINT).alias("kind"), F.col("_iv_pid").alias("id"))
    spans = right.where(known(1))
    events = events.union(spans.select(interval_key.alias("key"), bound(start, -1).alias("at"), F.lit(_START).alias("kind"), F.col("_iv_iid").alias("id")))
    events = events.union(spans.select(interval_key.alias("key"), bound(end, 1).alias("at"), F.lit(_CLOSED_END if closed else _END).alias("kind"), F.col("_iv_iid").alias("id")))
    swept = materialize(numbered_events(events))

    number = swept.where(F.col("kind") == _POINT).select(F.col("id").alias("_iv_pid"), F.col("passed").alias("_iv_number"))
    passed_at = lambda kind: F.max(F.when(kind, F.col("passed")))
    edges = swept.where(F.col("kind") != _POINT).groupBy("id").agg(
        passed_at(F.col("kind") == _START).alias("_iv_from"), passed_at(F.col("kind") != _START).alias("_iv_to"))
    # an interval that ends before it starts, or without a point inside, holds nothing
    spans = edges.where(F.col("_iv_from") < F.col("_iv_to")).select(F.col("id").alias("_iv_iid"), "_iv_from", "_iv_to")
    touched = right.join(spans, "_iv_iid").withColumn(
        "_iv_block", F.explode(F.sequence(F.expr(f"_iv_from div {BLOCK}"), F.expr(f"(_iv_to - 1) div {BLOCK}")))).drop("_iv_iid")
    placed = left.join(number, "_iv_pid", "left").withColumn("_iv_spot", F.expr(f"_iv_number div {BLOCK}"))
    inside = (F.col("_iv_spot") == F.col("_iv_block")) & (F.col("_iv_number") >= F.col("_iv_from")) & (F.col("_iv_number") < F.col("_iv_to"))
    return placed.join(touched, inside, how).drop("_iv_pid", "_iv_number", "_iv_spot", "_iv_from", "_iv_to", "_iv_block")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out

