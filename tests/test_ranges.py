"""Files cut into byte ranges against the reader that takes a file whole."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from servicenight.plans import standins
from servicenight.rules import LAYOUTS
from servicenight.session import FREE_SHUFFLES, shuffles_freed
from servicenight.sources import exports, ranges
from tests.fixtures import header, line


def made_of(r, n):
    """Lines of cells with everything that can mislead a cut: quotes, breaks in quotes, lone quotes, blank lines."""
    cells = ['a', '', '"x"', '"two\nlines"', '"ends\r\n\r\nlater, with comma"', '"say ""so"""', 'in"side', '"then"more', '""', '"\n"', 'é', '"ü,\r\n"', '"' + "y\n" * 40 + '"']
    out = ["A,B"]
    for _ in range(n):
        out.append(r.choice([",".join(r.choice(cells) for _ in range(2)), ",".join(r.choice(cells) for _ in range(2)), "", "A,B", "p,q"]))
    return r.choice(["\n", "\r\n", "\r"]).join(out)


FILES = {
    "plain.csv": "A,B\r\n1,2\r\n3,4\r\n", "no_end.csv": "A,B\n1,2\n3,4", "open at the end.csv": 'A,B\n1,2\n3,"never\nclosed', "open_with_end.csv": 'A,B\n1,"never\nclosed\n',
    "only_quoted.csv": '"A","B"\n"' + "l\n" * 300 + '","z"\n"q",r\n', "ragged.csv": 'A,B\n1,2\n"x\ny",2,3\n4,5\n1,2,3\n', "nul.csv": "A,B\n1,2\n\0,3\n4,5\n",
    "blank_first.csv": "\nA,B\n1,2\n", "old.csv": "A,B\n\xe9,\x80\n".encode("latin-1"), "broken.csv": b"A,B\n" + b"1,2\n" * 30 + b"\x81,2\n", "mixed.csv": "A,B\n€,1\n".encode() + b"\xe9,2\n",
    "long_cell.csv": "A,B\n1,2\n" + "z" * 140_000 + ",2\n3,4\n", "header.csv": "A,B", "cr.csv": "A,B\r1,2\r\r3,\"4\r5\"\r", "repeats.csv": "A,B\n1,2\nA,B\n1,2\nA,B\n\n3,4\n"}


@pytest.mark.parametrize("piece,size", [(1, 64), (1 << 20, 1000)])
def test_ranges_equal_whole_files(spark, tmp_path, monkeypatch, piece, size):
    monkeypatch.setattr(ranges, "PIECE_BYTES", piece)
    r = random.Random(piece)
    contents = {n: c if isinstance(c, bytes) else c.encode() for n, c in FILES.items()}
    contents |= {f"made {k}.csv": made_of(r, 25).encode("cp1252" if k % 3 == 0 else "utf-8") for k in range(8)}
    if size == 64:  # each range is a task
        contents = {n: c for n, c in contents.items() if len(c) < 1000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = ranges.parse_folder(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_file = {}
    for x in got:
        by_file.setdefault(x.source_file, []).append((x.source_row_number, x.kind, x.chunk, x.fields, x.error))
    for name, content in contents.items():
        wanted = [(at, kind, chunk, cells, error) for kind, at, chunk, cells, error in exports.read_records(content)]
        found = sorted(by_file.get(name, []), key=lambda x: x[0])
        if wanted[-1][4] and "Windows" in wanted[-1][4]:  # the whole-file reader names a place in the file
            assert [x[:4] for x in found] == [(0, "error", 0, None)] and "Windows" in found[0][4], name
        else:
            assert found == wanted, name


def test_rows_of_layouts_and_chosen_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\r\n".join([header("A"), line("A", 1), header("A"), line("A", 2, Table="O\n6"), ""]).encode())
    (tmp_path / "b.csv").write_bytes(header("B").encode())
    files = exports.scan_folder(spark, str(tmp_path)).where("source_file = 'a.csv'")
    records = ranges.parse_folder(spark, str(tmp_path), files)
    layouts = exports.file_layouts(records, exports.layout_table(spark)).collect()
    assert [(x.source_file, x.export_type, x.header) for x in layouts] == [("a.csv", "A", list(LAYOUTS["A"]))]
    assert {(x.source_row_number, x.chunk, x.file_hash) for x in records.where("kind = 'row'").collect()} == {
        (2, 0, files.first().file_hash), (4, 1, files.first().file_hash)}
    assert ranges.parse_folder(spark, str(tmp_path), files.limit(0)).count() == 0


def test_many_files_are_found_by_one_listing(spark, tmp_path, monkeypatch):
    """By the folder or by their paths: the same records, whatever else lies between the wanted files."""
    names = ["b.csv", "b 1+2.csv", "b%20.csv", "d é[1].csv"]
    for name in [*names, "a.csv", "c.csv", "e.csv"]:
        (tmp_path / name).write_bytes(f'A,B\n"{name}\nx",1\n2,3\n'.encode())
    (tmp_path / "c.txt").write_bytes(b"\x81 not an export")
    files = exports.scan_folder(spark, str(tmp_path)).where(F.col("source_file").isin(names))
    seen, pieces = [], ranges.pieces
    monkeypatch.setattr(ranges, "pieces", lambda spark, paths, *span: seen.append((len(paths), *span)) or pieces(spark, paths, *span))
    found = []
    for most in (100, 2):
        monkeypatch.setattr(ranges, "BY_PATH", most)
        found.append(sorted(tuple(r) for r in ranges.parse_folder(spark, str(tmp_path), files).collect()))
    assert seen == [(4,), (1, ("b 1+2.csv", "d é[1].csv"))]
    assert found[0] == found[1] and len(found[0]) == 3 * len(names)


def test_records_are_stored_once(spark, tmp_path, monkeypatch):
    """Neither the pieces nor a second copy of the records stay on disk, and no checkpoint holds any of them."""
    for n in range(3):
        (tmp_path / f"{n}.csv").write_bytes(b'A,B\n1,2\n"x\ny",3\n')
    checkpoints, materialize = [], ranges.materialize
    monkeypatch.setattr(ranges, "materialize", lambda df: checkpoints.append(df.columns) or materialize(df))
    files = exports.scan_folder(spark, str(tmp_path))
    spool = ranges.Spool(spark)
    records = ranges.parse_folder(spark, str(tmp_path), files, spool)
    assert records.count() == 9 and not any({"content", "fields"} & set(names) for names in checkpoints)
    stored = lambda: {p.name for p in Path(spool.root.removeprefix("file:")).glob("*")}
    assert stored() == {"cut", "joined"}
    spool.drop()
    assert not stored()


def test_shuffle_files_go_with_the_action(spark, tmp_path):
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {str(blocks.apply(i)).split("_")[1] for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(FREE_SHUFFLES, None)
    with shuffles_freed(spark):
        spark.range(1000).repartition(5, "id").write.parquet(str(tmp_path / "out"))
    for _ in range(100):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(FREE_SHUFFLES, None) == setting
    spark.range(1000).repartition(5, "id").write.parquet(str(tmp_path / "other"))
    assert shuffles() - before


def test_files_are_written_by_the_tasks_that_hold_them(spark, tmp_path):
    contents = {f"{n}.csv": f"A,B\r\n{n},é\r\n".encode("cp1252") for n in range(7)} | {"no end.csv": b"A", "empty.csv": b""}
    frame = spark.createDataFrame([(n, bytearray(c)) for n, c in contents.items()], "name string, content binary").repartition(3)
    for _ in range(2):  # a task that runs again replaces its files
        assert standins.write_files(frame, f"file:{tmp_path}") == len(contents)
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == contents


def test_files_that_are_rows_have_the_reader_s_records(spark):
    contents = {n: c if isinstance(c, bytes) else c.encode() for n, c in FILES.items()} | {"empty.csv": b"", "long.csv": b"A,B\n" + b"1,2\n" * 20_001}
    frame = spark.createDataFrame([(n, f"hash of {n}", bytearray(c)) for n, c in contents.items()], "source_file string, file_hash string, content binary")
    parsed = exports.parse_files(frame)
    assert "MapInArrow" in parsed._jdf.queryExecution().toString()
    found = {}
    for r in parsed.collect():
        assert r.file_hash == f"hash of {r.source_file}"
        found.setdefault(r.source_file, []).append((r.kind, r.source_row_number, r.chunk, r.fields, r.error))
    assert found == {n: list(exports.read_records(c)) for n, c in contents.items()}
