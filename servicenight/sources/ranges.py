"""Exports read in byte ranges, so that many tasks share one file.

Spark's text source deals a file out in ranges and gives each range the lines that start in it. A task
packs them into pieces of bounded size and notes, for both cases, whether a quoted cell is open at a
piece's end if one is open, or none is, at its start. These notes are small; carried across the pieces
of a file they tell how each piece starts, on which line, and where a record that is open across
pieces began. Then every piece is cut into records alone, and only the records that cross pieces are put together.
No row holds a file.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from servicenight.session import Spool, materialize, shuffles_freed, travels
from servicenight.sources.exports import scan_folder

travels(__name__)

#: Bytes of lines in one piece; a longer line is a piece of its own.
PIECE_BYTES = 4 << 20
#: Up to so many files are opened by their paths. More are found by one listing of their folder, as Spark lists given paths one by one.
BY_PATH = 1000

_OPENING = re.compile(rb'(?:\A|(?<=[,\r\n]))"')
_CLOSING = re.compile(rb'(?:[^"]++|"")*+"')
_GLOB = re.compile(r"[\[\]{}*?\\]")
_UNKNOWN = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")


def crossing(content: bytes, inside: bool) -> tuple[bool, int, int]:
    """Whether a quoted cell is open after ``content``, and where its first record ends and its last one starts.

    ``inside`` says whether one is open before it. Without a record's end both places are the same:
    the start, if no cell was open there, and else the end.
    """
    first = last = None
    at, end = 0, len(content)
    while True:
        if inside:
            closed = _CLOSING.match(content, at)
            if closed is None:
                break
            at = closed.end()
        opened = _OPENING.search(content, at)
        stop = opened.start() if opened else end
        if first is None:
            ends = [p for p in (content.find(b"\n", at, stop), content.find(b"\r", at, stop)) if p >= 0]
            if ends:
                first = min(ends) + (2 if content[min(ends):min(ends) + 2] == b"\r\n" else 1)
        last = max(last or 0, content.rfind(b"\n", at, stop) + 1, content.rfind(b"\r", at, stop) + 1)
        if opened is None:
            return False, end if first is None else first, last
        inside, at = True, opened.end()
    return True, end if first is None else first, last or 0


def count_lines(content: bytes) -> int:
    """Lines as the record reader counts them: ended by CR, LF or both."""
    return content.count(b"\n") + content.count(b"\r") - content.count(b"\r\n")


_PIECE_SCHEMA = ("source_file string, start long, part int, content binary, file_bytes long, bytes long, lines long, "
                 "open_if_closed boolean, open_if_open boolean, ends_a_record boolean, utf8 boolean, cp1252 boolean")


def _noted(name: str, start: int, part: int, content: bytes, file_bytes: int) -> dict:
    plain = b'"' not in content
    from_open, end, _ = (True, len(content), 0) if plain else crossing(content, True)
    try:
        content.decode("utf-8")
        utf8 = True
    except UnicodeDecodeError:
        utf8 = False
    return {"source_file": name, "start": start, "part": part, "content": content, "file_bytes": file_bytes, "bytes": len(content), "lines": count_lines(content),
            "open_if_closed": False if plain else crossing(content, False)[0], "open_if_open": from_open,
            "ends_a_record": not plain and (not from_open or end < len(content)), "utf8": utf8, "cp1252": _UNKNOWN.search(content) is None}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source_file", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("content", pa.binary()), ("file_bytes", pa.int64()),
                        ("bytes", pa.int64()), ("lines", pa.int64()), *[(c, pa.bool_()) for c in ("open_if_closed", "open_if_open", "ends_a_record", "utf8", "cp1252")]])
    here, lines, size, part = None, [], 0, 0
    out = lambda: pa.RecordBatch.from_pylist([_noted(here[0], here[1], part, b"\n".join([*lines, b""]), here[2])], schema)
    for batch in batches:
        for name, start, whole, line in zip(*(batch.column(c).to_pylist() for c in ("name", "start", "size", "line"))):
            if here != (name, start, whole) or size + len(line) > PIECE_BYTES:
                if lines:
                    yield out()
                part = part + 1 if here == (name, start, whole) else 0
                here, lines, size = (name, start, whole), [], 0
            lines.append(line)
            size += len(line) + 1
    if lines:
        yield out()


def pieces(spark: SparkSession, paths: list[str], span: tuple[str, str] | None = None) -> DataFrame:
    """The files' lines in pieces (source_file, start, part, content) with what the states are computed from.

    ``span``, the first and the last name to read, tells which files of a folder are opened.
    """
    # the name comes with its special characters as in a URI, where a plus is a plus
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", "\n").text([_GLOB.sub(r"\\\g<0>", p) for p in paths])
    lines = (lines if span is None else lines.where(name.between(*span))).select(
        name.alias("name"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_pack, _PIECE_SCHEMA)


def piece_states(packed: DataFrame) -> DataFrame:
    """How each piece starts: (source_file, start, part, open, owner, first_line, unended, utf8, fault_line).

    A piece either keeps the state, turns it over, or ends in one state whatever came before; so the
    state at a piece is that of the last one of the third kind, turned over by those since. ``owner`` is the
    piece in which the open record began. The windows hold one small row per piece of a file.
    """
    order = Window.partitionBy("source_file").orderBy("start", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source_file")
    turns = (F.col("open_if_closed") & ~F.col("open_if_open")).cast("int")
    noted = packed.drop("content").withColumn("turned", F.sum(turns).over(so_far))
    settled = F.when(F.col("open_if_closed") == F.col("open_if_open"), F.struct(F.col("open_if_closed").cast("int").alias("open"), "turned"))
    noted = noted.withColumns({
        "settled": F.last(settled, ignorenulls=True).over(before), "turned_before": F.coalesce(F.sum(turns).over(before), F.lit(0))})
    since = F.col("turned_before") - F.coalesce("settled.turned", F.lit(0))
    noted = noted.withColumn("open", (F.coalesce("settled.open", F.lit(0)) + since) % 2 == 1)
    ends_open = F.when(F.col("open"), F.col("open_if_open")).otherwise(F.col("open_if_closed"))
    begins = F.when(ends_open & (~F.col("open") | F.col("ends_a_record")), F.struct("start", "part"))
    missing = F.sum("bytes").over(whole) > F.col("file_bytes")  # a line's end was added to the last line
    line = F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1
    faulty = noted.withColumns({"first_line": line, "utf8": F.min("utf8").over(whole)})
    return faulty.select(
        "source_file", "start", "part", "open", F.last(begins, ignorenulls=True).over(before).alias("owner"), "first_line",
        (missing & F.lead("part").over(order).isNull()).alias("unended"), "utf8",
        F.min(F.when(~F.col("utf8") & ~F.col("cp1252"), F.col("first_line"))).over(whole).alias("fault_line"))


_CUT_SCHEMA = ("source_file string, line long, fields array<string>, error string, "
               "owner struct<start: long, part: int>, start long, part int, piece binary")
_CUT = pa.schema([("source_file", pa.string()), ("line", pa.int64()), ("fields", pa.list_(pa.string())), ("error", pa.string()),
                  ("owner", pa.struct([("start", pa.int64()), ("part", pa.int32())])), ("start", pa.int64()), ("part", pa.int32()), ("piece", pa.binary())])
_ROWS = 5000


def records_of(text: str, line: int) -> Iterator[tuple[int, list[str] | None, str | None]]:
    """(first line, cells, error) of records that are whole in ``text``, which starts on ``line``; blank ones only on line 1."""
    reader, first = csv.reader(io.StringIO(text, newline="")), line
    try:
        for cells in reader:
            if cells or first == 1:
                yield first, cells, None
            first = line + reader.line_num
    except csv.Error as fault:
        yield first, None, f"line {first}: {fault}"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            name, content, line, owner = row["source_file"], row["content"], row["first_line"], row["owner"]
            here = {"start": row["start"], "part": row["part"]}
            content = content[:-1] if row["unended"] else content
            ends_open, first, last = crossing(content, row["open"])
            first = first if row["open"] else 0
            last = max(last, first) if ends_open or last > first else first
            if row["open"]:
                yield pa.RecordBatch.from_pylist([here | {"source_file": name, "line": line, "owner": owner, "piece": content[:first]}], _CUT)
            if ends_open and not (row["open"] and first == len(content)):
                tail_line = line + count_lines(content[:last])
                yield pa.RecordBatch.from_pylist([here | {"source_file": name, "line": tail_line, "owner": here, "piece": content[last:]}], _CUT)
            middle = content[first:last] if ends_open else content[first:]
            out = []
            for at, cells, error in records_of(middle.decode("utf-8" if row["utf8"] else "cp1252"), line + count_lines(content[:first])):
                out.append({"source_file": name, "line": at, "fields": cells, "error": error})
                if len(out) == _ROWS:
                    yield pa.RecordBatch.from_pylist(out, _CUT)
                    out = []
            yield pa.RecordBatch.from_pylist(out, _CUT)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            text = b"".join(p["piece"] for p in row["pieces"]).decode("utf-8" if row["utf8"] else "cp1252")
            found = records_of(text, row["pieces"][0]["line"])
            yield pa.RecordBatch.from_pylist([{"source_file": row["source_file"], "line": at, "fields": c, "error": e} for at, c, e in found], _CUT)


def cut_records(packed: DataFrame, states: DataFrame, spool: Spool) -> DataFrame:
    """(source_file, line, fields, error) of every record, stored once."""
    key = ["source_file", "start", "part"]
    placed = packed.select(*key, "content").join(states.where(F.col("fault_line").isNull()), key)
    cut = spool.store("cut", placed.mapInArrow(_cut, _CUT_SCHEMA))
    # a record in pieces is as long as its cells, whatever the file's size
    apart = cut.where(F.col("piece").isNotNull()).groupBy("source_file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "line", "piece"))).alias("pieces"))
    encodings = states.groupBy("source_file").agg(F.min("utf8").alias("utf8"))
    joined = spool.store("joined", apart.join(encodings, "source_file").mapInArrow(_join, _CUT_SCHEMA))
    out = ["source_file", "line", "fields", "error"]
    unread = states.where(F.col("fault_line").isNotNull()).groupBy("source_file").agg(F.min("fault_line").alias("line")).select(
        "source_file", F.lit(0).cast("long").alias("line"), F.lit(None).cast("array<string>").alias("fields"),
        F.concat(F.lit("not valid UTF-8 or Windows-1252 (from line "), "line", F.lit(" on)")).alias("error"))
    return cut.where(F.col("piece").isNull()).select(*out).union(joined.select(*out)).union(unread)


def told_apart(cut: DataFrame, files: DataFrame) -> DataFrame:
    """The records in the form of ``exports.RECORD_SCHEMA``: headers, repeats of them, rows, and a file's first fault, after which nothing counts.

    ``cut`` should be stored, as it is read three times.
    """
    with shuffles_freed(cut.sparkSession):
        headers = materialize(cut.where(F.col("fields").isNotNull()).groupBy("source_file").agg(F.min_by("fields", "line").alias("header"), F.min("line").alias("header_line")))
    size = lambda c: F.size(c).cast("string")
    wide = F.when(F.size("fields") != F.size("header"), F.concat(
        F.lit("line "), F.col("line").cast("string"), F.lit(": "), size("fields"), F.lit(" fields, header has "), size("header")))
    nul = F.when(F.exists("fields", lambda c: F.contains(c, F.lit("\0"))), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": NUL character")))
    kind = (F.when(F.col("error").isNotNull(), "error").when(F.col("line") == F.col("header_line"), "header")
            .when(F.col("fields") == F.col("header"), "repeat").otherwise(F.when(F.coalesce(wide, nul).isNotNull(), "error").otherwise("row")))
    told = cut.join(headers, "source_file", "left").withColumn("kind", kind).withColumn(
        "error", F.when(F.col("kind") == "error", F.coalesce("error", wide, nul)))
    # an export repeats its header once per report in it
    with shuffles_freed(cut.sparkSession):
        marks = materialize(told.where(F.col("kind").isin("repeat", "error")).groupBy("source_file").agg(
            F.sort_array(F.collect_list(F.when(F.col("kind") == "repeat", F.col("line")))).alias("repeats"),
            F.min(F.when(F.col("kind") == "error", F.col("line"))).alias("fault")))
    chunk = F.coalesce(F.size(F.filter("repeats", lambda r: r <= F.col("line"))), F.lit(0))
    placed = told.join(marks, "source_file", "left").where(F.col("fault").isNull() | (F.col("line") <= F.col("fault")))
    return placed.join(files.select("source_file", "file_hash"), "source_file").select(
        "source_file", "file_hash", "kind", F.col("line").cast("int").alias("source_row_number"), chunk.cast("int").alias("chunk"),
        F.when(F.col("kind").isin("row", "header"), F.col("fields")).alias("fields"), "error")


def parse_folder(spark: SparkSession, folder: str, files: DataFrame | None = None, spool: Spool | None = None) -> DataFrame:
    """Records of a folder's exports like those of ``exports.parse_files``; ``files`` (source_file, file_hash) picks some of them.

    An empty file has no line to read and no record. Of many files the driver gets the first and the last name; files between
    them that are not wanted are dropped before their records are cut. The records are read from ``spool``, which the caller may drop after use.
    """
    files = scan_folder(spark, folder).select("source_file", "file_hash") if files is None else files.select("source_file", "file_hash")
    files = materialize(files)
    few = sorted(r.source_file for r in files.select("source_file").limit(BY_PATH + 1).collect())
    if not few:
        return spark.createDataFrame([], "source_file string, file_hash string, kind string, source_row_number int, chunk int, fields array<string>, error string")
    spool = spool or Spool(spark)
    with shuffles_freed(spark):
        span = () if len(few) <= BY_PATH else (tuple(files.agg(F.min("source_file"), F.max("source_file")).first()),)
        packed = spool.store("pieces", pieces(spark, [folder] if span else [f"{folder}/{n}" for n in few], *span))
        states = piece_states(packed)
        states = materialize(states.join(files, "source_file", "left_semi") if span else states)
        cut = cut_records(packed, states, spool)
    spool.drop("pieces")
    return told_apart(cut, files)
