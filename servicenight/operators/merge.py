"""Upsert of overlapping exports without order ids.

Rows are matched on identity (opened, table, guests and an occurrence number), and each
field takes the newest value any pull supplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight.functions import calendar, parse
from servicenight.operators.joins import null_safe_join
from servicenight.operators.ordering import number_rows, with_position

CONTENT = ["opened", "guests", "table_code", "discount_amount", "amount", "tax", "tip", "gratuity",
           "total", "closed", "duration_text"]
KEY = ["k_opened", "k_table", "k_guests", "occurrence"]
PROVENANCE = ["source_file", "source_chunk", "source_row_number", "pull_rank", "occurrence"]


def content_columns(df: DataFrame) -> list[str]:
    """Modelled columns first, then whatever else an export carried."""
    extras = [c for c in df.columns if c not in CONTENT and c not in PROVENANCE and c not in KEY]
    return [c for c in CONTENT if c in df.columns] + extras


def rank_pulls(files: DataFrame) -> DataFrame:
    """Pull order of files (source_file, modified): range end, then file time; undated first."""
    dated = files.withColumn("range_end", parse.pull_end_date(F.col("source_file")))
    order = [F.col("range_end").asc_nulls_first(), F.col("modified"), F.col("source_file")]
    return number_rows(dated, order, "_n").select(
        "source_file", "range_end", F.col("range_end").isNull().alias("undated"), (F.col("_n") - 1).alias("pull_rank"))


def drop_chunk_duplicates(rows: DataFrame) -> DataFrame:
    """Rows repeated whole inside one export, the first line kept."""
    content = content_columns(rows)
    kept = [F.min(F.struct("source_row_number", "source_chunk")).alias("_first")]
    carried = [c for c in rows.columns if c in ("pull_rank",)]
    grouped = rows.groupBy("source_file", *carried, *content).agg(*kept)
    return grouped.select(*content, "source_file", *carried, F.col("_first.source_row_number"),
                          F.col("_first.source_chunk"))


def add_identity(rows: DataFrame) -> DataFrame:
    """Null-safe identity columns: no table is '', no guests is -1."""
    return rows.withColumns({
        "k_opened": F.col("opened"), "k_table": F.coalesce("table_code", F.lit("")),
        "k_guests": F.coalesce("guests", F.lit(-1))})


def add_occurrence(rows: DataFrame) -> DataFrame:
    """Number rows of one export that share an identity, by amount, discount, then line."""
    order = [F.col("amount").asc_nulls_first(), F.col("discount_amount").asc_nulls_first(),
             F.col("source_row_number")]
    keyed = add_identity(rows)
    numbered = with_position(keyed, ["source_file", "k_opened", "k_table", "k_guests"], order, "_position")
    return numbered.withColumn("occurrence", F.col("_position") - 1).drop("_position")


def newest(column: str) -> Column:
    """The value of the latest pull that supplied one."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("pull_rank"))).alias(column)


def merge_pulls(rows: DataFrame) -> DataFrame:
    """One row per identity; every field the newest non-null value (combined on the map side)."""
    content = content_columns(rows)
    merged = rows.groupBy(*KEY).agg(*[newest(c) for c in content], newest("source_file"))
    return merged


def supersession(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Per pull: rows first seen there, rows a later pull revised, rows confirmed unchanged.

    A row is revised only when a value it supplied was overwritten.
    """
    content = content_columns(rows)
    ranks = rows.groupBy(*KEY).agg(F.min("pull_rank").alias("_first"), F.max("pull_rank").alias("_last"))
    final = null_safe_join(merged.select(*KEY, *[F.col(c).alias(f"m_{c}") for c in content]),
                           ranks, KEY, "inner")
    overwritten = F.lit(False)
    for c in content:
        overwritten = overwritten | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"m_{c}")))
    earlier = F.col("pull_rank") < F.col("_last")
    joined = null_safe_join(rows, final, KEY, "inner").withColumn("_revised", earlier & overwritten)
    return joined.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("pull_rank") == F.col("_first")).alias("first_seen"),
        F.count_if("_revised").alias("superseded"),
        F.count_if(earlier & ~F.col("_revised")).alias("confirmed"))


def read_report(rows: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Per pull: rows read, report chunks, exact duplicates dropped, duration present or not."""
    read = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_read"), (F.max("source_chunk") + 1).alias("chunks"),
        F.bool_or(F.col("duration_text").isNotNull()).alias("has_duration"))
    kept = deduplicated.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    return read.join(kept, "source_file").withColumn(
        "duplicates_dropped", F.col("rows_read") - F.col("rows"))


def contiguous_runs(days: DataFrame, day: str = "service_date") -> DataFrame:
    """First and last day of every run of consecutive days (gaps and islands).

    The frame is reduced to distinct days, at most 366 a year, before the window.
    """
    distinct = days.select(F.col(day).alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.orderBy("d")))
    return (distinct.withColumn("_island", island).groupBy("_island")
            .agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"),
                 F.count(F.lit(1)).alias("days")).drop("_island"))


def missing_runs(days: DataFrame, min_run: int = 2, day: str = "service_date") -> DataFrame:
    """Runs of at least ``min_run`` days without any row, inside the covered span."""
    present = days.select(F.col(day).alias("d")).distinct()
    span = present.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    missing = span.select(F.explode(F.sequence("a", "b")).alias("d")).join(present, "d", "left_anti")
    return contiguous_runs(missing, "d").where(F.col("days") >= min_run)


def with_service_date(merged: DataFrame) -> DataFrame:
    return merged.withColumn("service_date", calendar.service_date(F.col("opened")))


def blind_days(merged: DataFrame) -> DataFrame:
    """Service days on which no order has a duration."""
    return (with_service_date(merged).groupBy("service_date")
            .agg(F.count("duration_text").alias("_timed")).where(F.col("_timed") == 0)
            .select("service_date"))


def coverage(merged: DataFrame) -> DataFrame:
    dated = with_service_date(merged)
    return dated.agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("service_date").alias("days"),
        F.min("service_date").alias("first_day"), F.max("service_date").alias("last_day"),
        F.count("duration_text").alias("with_duration"))


def lost_identities(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Identities of a pull that the merged frame lacks (must be empty)."""
    return null_safe_join(rows, merged.select(*KEY), KEY, "left_anti").select("source_file", *KEY)


def revenue_drift(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """On days whose merged rows all come from one pull: merged minus that pull's own revenue."""
    per_day = (with_service_date(merged).groupBy("service_date").agg(
        F.min("source_file").alias("source_file"), F.max("source_file").alias("_other"),
        F.sum("amount").alias("merged_amount"))
        .where(F.col("source_file") == F.col("_other")).drop("_other"))
    own = with_service_date(rows).groupBy("service_date", "source_file").agg(
        F.sum("amount").alias("source_amount"))
    return per_day.join(own, ["service_date", "source_file"]).withColumn(
        "drift", F.abs(F.col("merged_amount") - F.col("source_amount")))


def export_form(merged: DataFrame) -> DataFrame:
    """Merged rows in export column names and formats, in reading order."""
    extras = [c for c in content_columns(merged) if c not in CONTENT and c != "source_file"]
    return merged.orderBy("opened", "table_code", "k_guests", "occurrence").select(
        calendar.export_clock(F.col("opened")).alias("Opened"),
        F.col("guests").alias("# of Guests"), F.col("table_code").alias("Table"),
        F.col("discount_amount").alias("Discount Amount"), F.col("amount").alias("Amount"),
        F.col("tip").alias("Tip"), F.col("gratuity").alias("Gratuity"),
        calendar.export_clock(F.col("closed")).alias("Closed"), F.col("tax").alias("Tax"),
        F.col("total").alias("Total"), F.col("duration_text").alias("Duration (Opened to Paid)"),
        *extras, F.col("source_file").alias("Source_File"))
