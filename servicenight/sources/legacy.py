"""From a folder of exports without order ids to one merged set, and on to the visits it describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from servicenight.functions import parse
from servicenight.operators import merge
from servicenight.operators.ordering import number_rows
from servicenight.session import materialize
from servicenight.sources import exports


class IncompleteExport(ValueError):
    """An export that lacks a column the merge cannot do without."""


def pull_records(files: DataFrame) -> DataFrame:
    """Parsed records of every file, read once and stored; an export without a required column is refused."""
    records = materialize(exports.parse_files(files))
    some = exports.missing_core_columns(records).orderBy("source_file").limit(5).collect()
    if some:
        raise IncompleteExport("; ".join(f"{r.source_file} lacks {', '.join(r.missing)}" for r in some))
    return records


def pull_rows(files: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """Typed rows of every pull with rank and occurrence; columns beyond the model ride along as text."""
    records = pull_records(files)
    extras = exports.extra_columns(records) if extras is None else extras
    ranks = merge.rank_pulls(files.select("source_file", "modified")).select("source_file", "pull_rank")
    rows = exports.legacy_rows(records, extras).join(ranks, "source_file")
    return merge.add_occurrence(merge.drop_chunk_duplicates(rows))


def build(files: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """One row per order of all pulls, every field from the newest pull that supplied it."""
    return merge.merge_pulls(pull_rows(files, extras))


def build_folder(spark: SparkSession, folder: str) -> DataFrame:
    return build(exports.scan_folder(spark, folder))


def visits(merged: DataFrame) -> DataFrame:
    """Merged orders in the form that cleaning, turns and occupancy take, numbered by identity."""
    numbered = number_rows(merged, [F.col(c) for c in merge.KEY], "order_id")
    return numbered.select(
        "order_id", F.col("opened").alias("opened_at"), "table_code", "guests", "amount",
        parse.parse_duration_seconds(F.col("duration_text")).alias("duration_seconds"))
