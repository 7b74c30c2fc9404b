"""Exact medians of groups of any size, by histograms that are refined until one value is left.

The built-in median holds a group's values in one task. Here a group is counted into bins, which are
combined on the map side; only the bins that hold the middle ranks stay, and their rows are counted
again into finer bins between the bin's own least and greatest value. A pass narrows a bin a
thousandfold, so two or three do; equal values end in one bin however many they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from servicenight.operators.joins import null_safe_join
from servicenight.session import materialize

BINS = 1024


def _binned(rows: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """Rows that lie in an open span of their group, with the span and their bin in it."""
    met = null_safe_join(rows, open_, by, "inner").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return met.withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))


def median_of(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the median of each group's known values as a double; groups without one are absent.

    Infinite values are not allowed. Group columns may be null.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    spans = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    middle = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    open_ = materialize(spans.select(*by, "_lo", "_hi", middle.alias("_ranks")))
    found = None
    while True:
        known = open_.where("_lo = _hi").select(*by, F.col("_lo").alias("_value"), F.size("_ranks").alias("_times"))
        found = known if found is None else found.union(known)
        open_ = open_.where("_lo < _hi")
        if open_.isEmpty():
            break
        rows = materialize(_binned(rows, open_, by).select(*by, "_v", "_lo", "_hi", "_bin", "_ranks"))
        span = [*by, "_lo", "_hi"]
        # at most one row per bin of an open span, and two spans of a group are open at most
        bins = rows.groupBy(*span, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_ranks").alias("_ranks"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*span).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = bins.withColumn("_before", before)
        inside = F.transform(F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))), lambda r: r - F.col("_before"))
        kept = placed.withColumn("_ranks", inside).where(F.size("_ranks") > 0)
        open_ = materialize(kept.select(*by, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_ranks"))
        rows = rows.select(*by, "_v")
    # one rank for an odd number of values, two for an even one, which may be the same value twice
    half = F.sum(F.col("_value") * F.col("_times")) / F.sum("_times")
    return found.groupBy(*by).agg(half.alias(name))
