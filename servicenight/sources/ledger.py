"""Load each export once, each file by itself.

Rows are written first, the log rows last. The files that are loaded together share one folder per
layout, named ``load_id=`` and the first id of their batch, so a table has as many folders as there were
batches, however many files came. Readers keep only rows whose folder and fingerprint are in the log and
take the load id from there, so a load that died half way is never seen; the next run gets the same
first id and simply writes the folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from servicenight import rules
from servicenight.operators.ordering import number_rows
from servicenight.session import Spool, materialize, shuffles_freed
from servicenight.sources import exports, ranges

LOG_SCHEMA = ("load_id bigint, source_file string, file_hash string, export_type string, "
              "row_count int, loaded_at timestamp, folder_id bigint")
REFUSAL_SCHEMA = "source_file string, file_hash string, reason string, refused_at timestamp"


class RefusedExport(ValueError):
    """An export that cannot be read faithfully."""


class LostLog(RuntimeError):
    """Raw tables lie under a root whose load log is gone."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored table, or None where nothing was ever written; any other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The load log. It is written before any raw table, so without it there must be none."""
    log = _read(spark, f"{root}/raw/load_log", LOG_SCHEMA)
    if log is None:
        for name in rules.RAW_TABLES.values():
            if _read(spark, f"{root}/raw/{name}", "load_id bigint") is not None:
                raise LostLog(f"{root}/raw has {name} but no load log; restore the log before loading")
        return spark.createDataFrame([], LOG_SCHEMA)
    return log


def read_refusals(spark: SparkSession, root: str) -> DataFrame:
    """Every file that was refused, with the reason, once per content."""
    refused = _read(spark, f"{root}/raw/refused", REFUSAL_SCHEMA)
    return spark.createDataFrame([], REFUSAL_SCHEMA) if refused is None else refused


def unseen_files(files: DataFrame, log: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Files whose bytes were never loaded nor refused; of equal files in one batch the first by name."""
    first = files.groupBy("file_hash").agg(F.min("source_file").alias("source_file"))
    unseen = first.join(log.select("file_hash"), "file_hash", "left_anti")
    return unseen if refused is None else unseen.join(refused.select("file_hash"), "file_hash", "left_anti")


def assign_load_ids(unseen: DataFrame, log: DataFrame) -> DataFrame:
    """Consecutive load ids in name order, after the highest id in the log."""
    last = log.agg(F.coalesce(F.max("load_id"), F.lit(0))).scalar()
    return number_rows(unseen, [F.col("source_file"), F.col("file_hash")], "_n").withColumn(
        "load_id", F.col("_n") + last).drop("_n")


def committed(raw: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of finished loads only."""
    return raw.join(log.select("load_id", "file_hash"), ["load_id", "file_hash"], "left_semi")


def read_raw(spark: SparkSession, root: str, export_type: str, after: int = 0) -> DataFrame:
    """Committed rows of one layout with lineage columns, all cells as text; of loads after an id only their batches' folders are opened.

    ``after`` must be the last id of a batch. Loads logged without a folder have one of their own.
    """
    names = rules.LAYOUTS[export_type]
    schema = ", ".join(["source_file string", "file_hash string", "source_row_number int",
                        *[f"`{n}` string" for n in names], "load_id bigint"])
    stored = _read(spark, f"{root}/raw/{rules.RAW_TABLES[export_type]}", schema)
    if stored is None:
        stored = spark.createDataFrame([], schema)
    log = read_log(spark, root)
    loads = log.select("load_id", "file_hash", F.coalesce("folder_id", "load_id").alias("_folder"))
    if after:
        stored, loads = stored.where(F.col("load_id") > after), loads.where(F.col("load_id") > after)
    loads = loads.groupBy("_folder", "file_hash").agg(F.min("load_id").alias("load_id"))  # a load that is logged twice counts once
    return stored.withColumnRenamed("load_id", "_folder").join(loads, ["_folder", "file_hash"]).select(
        "source_file", "source_row_number", *[f"`{n}`" for n in names], "load_id")


def load_files(files: DataFrame, root: str, parse: Callable[[DataFrame], DataFrame] = exports.parse_files,
               retry_refused: bool = False) -> DataFrame:
    """Load every unseen file that can be read faithfully; record the others with their reason.

    A refused file holds up no other and leaves no row; its bytes are not parsed again unless
    ``retry_refused`` says so, as after a rule change. Returns the log rows added.
    """
    spark = files.sparkSession
    spool = Spool(spark)
    try:
        with shuffles_freed(spark):
            return _load(files, root, parse, retry_refused, spool)
    finally:
        spool.drop()


def _load(files: DataFrame, root: str, parse: Callable[[DataFrame], DataFrame], retry_refused: bool, spool: Spool) -> DataFrame:
    spark = files.sparkSession
    log = read_log(spark, root)
    wanted = unseen_files(files, log, None if retry_refused else read_refusals(spark, root))
    # Parsed once and stored: the checks, every layout and the log read the same records.
    records = spool.store("records", parse(files.join(wanted, ["source_file", "file_hash"], "left_semi")))
    layouts = exports.layout_table(spark)
    refused = materialize(exports.refused_files(records, layouts))
    record_refusals(refused, root)

    known = exports.file_layouts(records, layouts).select("source_file", "file_hash", "export_type")
    good = known.join(refused.select("file_hash"), "file_hash", "left_anti")
    sizes = records.groupBy("file_hash").agg(F.count_if(F.col("kind") == "row").cast("int").alias("row_count"))
    loads = materialize(assign_load_ids(good, log).join(sizes, "file_hash"))
    if loads.isEmpty():
        return spark.createDataFrame([], LOG_SCHEMA)
    if _read(spark, f"{root}/raw/load_log", LOG_SCHEMA) is None:
        spark.createDataFrame([], LOG_SCHEMA).coalesce(1).write.parquet(f"{root}/raw/load_log")
    folder_id = loads.agg(F.min("load_id")).first()[0]
    rows = records.where(F.col("kind") == "row")
    for export_type in [r.export_type for r in loads.select("export_type").distinct().collect()]:
        those = loads.where(F.col("export_type") == export_type).select("file_hash")
        cells = [F.col("fields")[i].alias(n) for i, n in enumerate(rules.LAYOUTS[export_type])]
        (rows.join(those, "file_hash", "left_semi").select("source_file", "file_hash", "source_row_number", *cells)
         .write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/raw/{rules.RAW_TABLES[export_type]}/load_id={folder_id}"))

    added = materialize(loads.select(
        "load_id", "source_file", "file_hash", "export_type", "row_count",
        F.current_timestamp().alias("loaded_at"), F.lit(folder_id).cast("bigint").alias("folder_id")).coalesce(1))
    added.write.mode("append").parquet(f"{root}/raw/load_log")
    return added


def record_refusals(refused: DataFrame, root: str) -> None:
    """Append refusals that are not on record yet; a file with several faults keeps all reasons."""
    seen = read_refusals(refused.sparkSession, root)
    fresh = refused.join(seen.select("file_hash"), "file_hash", "left_anti").select(
        "source_file", "file_hash", "reason", F.current_timestamp().alias("refused_at"))
    fresh.write.mode("append").parquet(f"{root}/raw/refused")


def load_folder(spark: SparkSession, folder: str, root: str, strict: bool = False, retry_refused: bool = False) -> DataFrame:
    """Load a folder's new exports, each read in ranges. With ``strict``, raise afterwards if it holds a refused file."""
    files = materialize(exports.scan_folder(spark, folder).drop("content"))  # every file's bytes are read for its fingerprint once
    spool = Spool(spark)
    try:
        added = load_files(files, root, lambda wanted: ranges.parse_folder(spark, folder, wanted, spool), retry_refused)
    finally:
        spool.drop()
    if strict:
        here = read_refusals(spark, root).join(files.select("file_hash"), "file_hash", "left_semi")
        some = here.orderBy("source_file").limit(5).collect()
        if some:  # all of them are on record; the message names a few
            raise RefusedExport(f"{here.count()} refusals: " + "; ".join(f"{r.source_file}: {r.reason}" for r in some))
    return added
