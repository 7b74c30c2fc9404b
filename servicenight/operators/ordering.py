"""Row numbers and neighbours that hold up when one group has most of the rows.

The ordered data is cut into even ranges, rows are ranked inside each range, and counts and
neighbours are carried across the cuts. One plan serves every size of group: a group with a
third of all rows lies in as many ranges as its rows fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight.session import materialize


def with_position(df: DataFrame, keys: list[str], order: list[Column], index: str,
                  following: dict[str, str] | None = None) -> DataFrame:
    """Add the 1-based position within ``keys`` and values of the next row.

    ``order`` must end in a unique column. ``following`` maps a new column to the
    column whose value in the next row of the group it takes (NULL in the last row).
    The frame is read once: ranges are cut on the keys and the order, and stored.
    """
    following = following or {}
    ranged = materialize(df.repartitionByRange(*[F.col(k) for k in keys], *order))
    ranged = ranged.withColumn("_chunk", F.spark_partition_id())
    inside = Window.partitionBy("_chunk", *keys).orderBy(*order)
    local = ranged.select(
        "*", F.row_number().over(inside).cast("bigint").alias("_local"),
        *[F.lead(source).over(inside).alias(f"_{new}") for new, source in following.items()],
        F.lead(F.lit(True)).over(inside).isNull().alias("_last"))

    # One row per chunk and key; only keys that cross a cut (fewer than there are chunks) remain.
    firsts = [F.max(F.when(F.col("_local") == 1, F.col(source))).alias(f"_first_{new}")
              for new, source in following.items()]
    parts = local.groupBy("_chunk", *keys).agg(F.count(F.lit(1)).alias("_rows"), *firsts)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    seams = parts.select(
        "_chunk", *keys,
        F.coalesce(F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        *[F.lead(f"_first_{new}").over(across).alias(f"_next_{new}") for new in following],
        F.lead("_chunk").over(across).isNotNull().alias("_continues"),
    ).where((F.col("_before") > 0) | F.col("_continues"))

    left, right = local.alias("l"), F.broadcast(seams).alias("r")
    same = (F.col("l._chunk") == F.col("r._chunk"))
    for key in keys:
        same &= F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    values = [
        F.when(F.col("l._last"), F.col(f"r._next_{new}")).otherwise(F.col(f"l._{new}")).alias(new)
        for new in following]
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._local") + F.coalesce(F.col("r._before"), F.lit(0))).alias(index), *values)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers over the whole frame in a fixed order, without a one-task window.

    The frame is range-sorted and stored; each range counts its rows, and the running
    total of those counts (one row per range) gives every range its first number.
    """
    stored = materialize(df.repartitionByRange(*order))
    stored = stored.withColumn("_chunk", F.spark_partition_id())
    sizes = stored.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    running = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_chunk", F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy(*order)
    numbered = stored.withColumn("_local", F.row_number().over(inside))
    return (numbered.join(F.broadcast(starts), "_chunk")
            .select((F.col("_local") + F.col("_before")).cast("bigint").alias(name), *df.columns))
