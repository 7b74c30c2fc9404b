"""CSV exports as records with physical line numbers.

Spark's CSV reader does not know the line a record starts on and has no Windows-1252
fallback, so each file is parsed by a small task-side reader; everything after that,
from layout dispatch to typing, is column expressions.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from servicenight import rules
from servicenight.functions import measures, parse
from servicenight.session import small_table, travels

travels(__name__)

RECORD_SCHEMA = ("source_file string, file_hash string, kind string, source_row_number int, "
                 "chunk int, fields array<string>, error string")
_BATCH_ROWS = 20_000


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Every export of a folder: name, fingerprint, file time and bytes."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "false").load(folder))
    return describe_files(files)


def describe_files(files: DataFrame) -> DataFrame:
    """Name and SHA-256 fingerprint for binary files (path, modificationTime, content)."""
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.sha2("content", 256).alias("file_hash"),
        F.col("modificationTime").alias("modified"), "content")


def decode(content: bytes) -> str:
    """UTF-8, else Windows-1252; bytes neither can read raise UnicodeDecodeError."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252")


def read_records(content: bytes) -> Iterator[tuple[str, int, int, list[str] | None, str | None]]:
    """Yield (kind, first line, chunk, cells, error) for one file.

    Lines count from 1, the header's line. A repeat of the header starts a new chunk and is
    reported as such; blank records are passed over. The first fault ends the file.
    """
    try:
        reader = csv.reader(io.StringIO(decode(content), newline=""))
        header, line, chunk = None, 1, 0
        for cells in reader:
            first, line = line, reader.line_num + 1
            if header is None:
                header = cells
                yield "header", first, 0, cells, None
            elif not cells:
                continue
            elif cells == header:
                chunk += 1
                yield "repeat", first, chunk, None, None
            elif len(cells) != len(header):
                yield ("error", first, chunk, None,
                       f"line {first}: {len(cells)} fields, header has {len(header)}")
                return
            elif any("\0" in cell for cell in cells):
                yield "error", first, chunk, None, f"line {first}: NUL character"
                return
            else:
                yield "row", first, chunk, cells, None
        if header is None:
            yield "error", 1, 0, None, "empty file"
    except UnicodeDecodeError as fault:
        yield "error", 0, 0, None, f"not valid UTF-8 or Windows-1252 ({fault})"
    except csv.Error as fault:
        yield "error", line, chunk, None, f"line {line}: {fault}"


_RECORDS = pa.schema([("source_file", pa.string()), ("file_hash", pa.string()), ("kind", pa.string()), ("source_row_number", pa.int32()),
                      ("chunk", pa.int32()), ("fields", pa.list_(pa.string())), ("error", pa.string())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, file_hash, content in zip(*(batch.column(c) for c in ("source_file", "file_hash", "content"))):
            records = read_records(content.as_py())
            while rows := list(itertools.islice(records, _BATCH_ROWS)):
                same = [[x.as_py()] * len(rows) for x in (name, file_hash)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*same, *zip(*rows)], _RECORDS)], schema=_RECORDS)


def parse_files(files: DataFrame) -> DataFrame:
    """Records of every file; one file is read by one task."""
    return files.select("source_file", "file_hash", "content").mapInArrow(_parse, RECORD_SCHEMA)


def layout_table(spark: SparkSession) -> DataFrame:
    rows = [(header, kind, rules.RAW_TABLES[kind]) for kind, header in rules.LAYOUTS.items()]
    return small_table(spark, rows, "fields array<string>, export_type string, raw_table string")


def file_layouts(records: DataFrame, layouts: DataFrame) -> DataFrame:
    """Layout of each file by exact header match; an unknown header has none."""
    headers = records.where(F.col("kind") == "header").select("source_file", "file_hash", "fields")
    return headers.join(layouts, "fields", "left").select(
        "source_file", "file_hash", "export_type", "raw_table", F.col("fields").alias("header"))


def refused_files(records: DataFrame, layouts: DataFrame) -> DataFrame:
    """Files that must not be loaded, with the reason."""
    faulty = records.where(F.col("kind") == "error").select("source_file", "file_hash", F.col("error").alias("reason"))
    unknown = file_layouts(records, layouts).where(F.col("export_type").isNull()).select(
        "source_file", "file_hash", F.concat(F.lit("unrecognised header: "), F.array_join("header", ", ")).alias("reason"))
    return faulty.unionByName(unknown)


def raw_rows(records: DataFrame, export_type: str) -> DataFrame:
    """Data rows of one layout as text columns under their original names, with lineage.

    ``records`` must carry ``export_type`` and ``load_id``.
    """
    cells = [F.col("fields")[i].alias(name) for i, name in enumerate(rules.LAYOUTS[export_type])]
    return records.where((F.col("kind") == "row") & (F.col("export_type") == export_type)).select(
        "load_id", "source_file", "source_row_number", *cells)


def legacy_rows(records: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """Rows of exports without ids as typed columns, whatever columns a pull carries.

    Tax and total are derived from each other where an export has only one; the duration
    text is NULL where the column is missing. Extra columns ride along as text.
    """
    # where each column stands, once per file; ``records`` should be stored, as it is read twice
    places = F.map_from_entries(F.transform("fields", lambda name, i: F.struct(name, i)))
    headers = records.where(F.col("kind") == "header").select(F.col("file_hash").alias("_file"), places.alias("_places"))
    placed = records.where(F.col("kind") == "row").join(headers, F.col("file_hash") == F.col("_file"))
    return typed_legacy(placed, extras)


def typed_legacy(placed: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """Typed columns from a frame with ``fields``, ``_places`` (header name to position) and lineage columns."""
    cell = lambda name: F.nullif(F.get("fields", F.col("_places")[name]), F.lit(""))
    money = {name: cell(name).try_cast("decimal(12,2)") for name in rules.MONEY_COLUMNS}
    amount, tip, gratuity = money["Amount"], money["Tip"], money["Gratuity"]
    has = lambda name: F.map_contains_key("_places", name)
    tax = F.when(has("Tax") | ~has("Total"), money["Tax"]).otherwise(
        measures.missing_tax(amount, F.lit(None), tip, gratuity, money["Total"]))
    total = F.when(has("Total") | ~has("Tax"), money["Total"]).otherwise(
        measures.missing_total(amount, money["Tax"], tip, gratuity, F.lit(None)))
    return placed.select(
        "source_file", "source_row_number", F.col("chunk").alias("source_chunk"),
        parse.parse_clock_tolerant(cell("Opened")).alias("opened"),
        cell("# of Guests").try_cast("int").alias("guests"), cell("Table").alias("table_code"),
        money["Discount Amount"].alias("discount_amount"), amount.alias("amount"),
        tax.cast("decimal(12,2)").alias("tax"), tip.alias("tip"), gratuity.alias("gratuity"),
        total.cast("decimal(12,2)").alias("total"),
        parse.parse_clock_tolerant(cell("Closed")).alias("closed"),
        cell(rules.DURATION_COLUMN).alias("duration_text"),
        *[cell(name).alias(name) for name in extras or []])


def extra_columns(records: DataFrame) -> list[str]:
    """Header names this pipeline does not model (headers are few and short)."""
    known = [*rules.CORE_COLUMNS, "Tax", "Total", rules.DURATION_COLUMN]
    names = records.where(F.col("kind") == "header").select(F.explode("fields").alias("c")).distinct()
    return sorted(r.c for r in names.where(~F.col("c").isin(known)).collect())


def missing_core_columns(records: DataFrame) -> DataFrame:
    """Files that lack a required column, and which."""
    core = F.array(*[F.lit(c) for c in rules.CORE_COLUMNS])
    return (records.where(F.col("kind") == "header")
            .select("source_file", F.array_except(core, F.col("fields")).alias("missing"))
            .where(F.size("missing") > 0))
