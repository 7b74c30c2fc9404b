"""Loading exports file by file, and the chain from exports without ids to turn gaps."""

import shutil
from pathlib import Path

import pytest

from servicenight import rules
from servicenight.operators import cleaning, floorplan, merge, turns
from servicenight.session import FREE_SHUFFLES, Spool
from servicenight.sources import exports, ledger, legacy, warehouse, weather
from servicenight.streaming.loads import stream_exports
from tests.fixtures import Venue, header, line


@pytest.fixture
def venue(spark, tmp_path):
    return Venue(spark, tmp_path)


def rows(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).orderBy("source_row_number").collect()]


def test_a_file_is_loaded_once_under_ids_in_name_order(venue):
    venue.write("night.csv", "A", line("A"), line("A"))
    venue.write("early.csv", "A", line("A"))
    assert venue.load() == 2 and venue.load() == 0
    shutil.copy(venue.exports / "night.csv", venue.exports / "again.csv")
    venue.write("0.csv", "C", line("C"))
    assert venue.load() == 1
    assert {(r.source_file, r.load_id, r.export_type, r.row_count) for r in venue.log().collect()} == {
        ("early.csv", 1, "A", 1), ("night.csv", 2, "A", 2), ("0.csv", 3, "C", 1)}
    assert venue.raw("A").count() == 3


BAD = {
    "short.csv": (f"{header('A')}\r\n{line('A', 1)}\r\n4/1/26 5:00 PM,2\r\n".encode(), "line 3: 2 fields"),
    "other.csv": (b"Opened,Weather\r\n4/1/26,fair\r\n", "unrecognised header"),
    "bytes.csv": (header("ITEM").encode() + b"\r\n\x9d\r\n", "Windows-1252"),
    "nul.csv": (f"{header('A')}\r\n{line('A', 2, Table=chr(0))}\r\n".encode(), "NUL"),
}


def test_bad_files_stay_out_on_record_and_hold_up_no_other(venue, spark):
    for name, (content, _) in BAD.items():
        venue.write_bytes(name, content)
    venue.write("good.csv", "A", line("A"))
    assert venue.load() == 1 and venue.raw("A").count() == 1
    refused = {r.source_file: r.reason for r in ledger.read_refusals(spark, venue.root).collect()}
    assert refused.keys() == BAD.keys() and all(BAD[n][1] in reason for n, reason in refused.items())
    venue.write("later.csv", "A", line("A"))
    with pytest.raises(ledger.RefusedExport, match="4 refusals"):
        venue.load(strict=True)
    assert venue.raw("A").count() == 2  # committed before the complaint
    assert ledger.read_refusals(spark, venue.root).count() == len(BAD)


def test_a_lost_log_is_noticed(venue, tmp_path):
    venue.write("a.csv", "A", line("A"))
    venue.load()
    log = tmp_path / "warehouse" / "raw" / "load_log"
    log.rename(tmp_path / "elsewhere")
    venue.write("b.csv", "A", line("A"))
    with pytest.raises(ledger.LostLog):
        venue.load()
    (tmp_path / "elsewhere").rename(log)
    assert venue.load() == 1 and venue.raw("A").count() == 2


def test_an_empty_file_has_no_records():
    [record] = exports.read_records(b"")
    assert (record[0], record[4]) == ("error", "empty file")


def test_rows_of_an_unfinished_load_are_not_seen_and_are_replaced(venue, spark):
    venue.write("a.csv", "A", line("A"), line("A"))
    venue.load()
    raw = spark.read.parquet(f"{venue.root}/raw/order_details_a")
    stray = raw.selectExpr("source_file", "'dead' as file_hash", "source_row_number",
                           *[f"`{c}`" for c in raw.columns[3:-1]], "cast(2 as bigint) as load_id")
    stray.write.mode("append").partitionBy("load_id").parquet(f"{venue.root}/raw/order_details_a")
    assert venue.raw("A").count() == 2
    venue.write("b.csv", "A", line("A"))
    venue.load()
    assert venue.raw("A").count() == 3


def test_each_layout_has_its_own_table_and_old_encodings_are_read(venue):
    venue.write("items.csv", "ITEM", line("ITEM", Menu_Item="Crème brûlée – “small”"), encoding="cp1252")
    for kind in ("ITEM_B", "C", "B"):
        venue.write(f"{kind}.csv", kind, line(kind))
    venue.load()
    assert [venue.raw(k).count() for k in ("A", "B", "C", "ITEM", "ITEM_B")] == [0, 1, 1, 1, 1]
    assert rows(venue.raw("ITEM"), "Menu Item") == [("Crème brûlée – “small”",)]


def test_records_are_numbered_by_their_first_line(venue):
    venue.write("lines.csv", "A", line("A", 1), line("A", 2, Table="O\r\n\r\n6"), "", header("A"), line("A", 3, Table=""), line("A", 3, Table=""))
    venue.load()
    assert rows(venue.raw("A"), "source_row_number", "Table") == [(2, "O6"), (3, "O\r\n\r\n6"), (8, ""), (9, "")]


def test_a_stream_loads_what_arrived_and_passes_over_bad_files(venue, spark, tmp_path):
    def run():
        stream_exports(spark, str(venue.exports), venue.root, str(tmp_path / "state")).awaitTermination(180)

    venue.write("a.csv", "A", line("A"))
    venue.write_bytes("short.csv", BAD["short.csv"][0])
    run()
    assert venue.raw("A").count() == 1
    venue.write("b.csv", "A", line("A"), line("A"))
    shutil.copy(venue.exports / "a.csv", venue.exports / "copy.csv")
    run()
    assert venue.raw("A").count() == 3 and venue.log().count() == 2
    assert ledger.read_refusals(spark, venue.root).count() == 1


def test_exports_without_ids_from_folder_to_gaps(venue, spark, tmp_path):
    """Tax from total and back, an amended tip, an extra column, a repeated chunk, then the merged file and turn gaps."""
    same = dict(Opened="4/3/26 6:00 PM", Table="O6", Guests=2, Amount="50.00")
    venue.write("OrderDetails_2026_04_01-2026_04_10.csv", "A",
                line("A", 1, **same, Tip="5.00", Total="60.50", Duration="1:00:00"), header("A"),
                line("A", 1, **same, Tip="5.00", Total="60.50", Duration="1:00:00"),
                line("A", 2, Opened="4/3/26 7:30 PM", Table="O6", Guests=2, Duration="0:30:00"))
    extra = f"{header('B')},Server\r\n" + line("B", 1, **same, Tax="5.50", Tip="9.00") + ",Kim\r\n"
    venue.write_bytes("OrderDetails_2026_04_02-2026_04_20.csv", extra.encode())
    merged = legacy.build_folder(spark, str(venue.exports))
    [first] = merged.where("amount = 50").collect()
    assert [float(x) for x in (first.tax, first.tip, first.total)] == [5.5, 9.0, 64.5]
    assert (first.duration_text, first.Server, first.source_file) == ("1:00:00", "Kim", "OrderDetails_2026_04_02-2026_04_20.csv")
    seated = cleaning.above_duration_floor(cleaning.clean_orders(legacy.visits(merged), floorplan.unit_dimension(spark)))
    assert [r.turn_gap for r in turns.add_turn_gaps(seated).orderBy("opened_at").collect()] == [30.0, None]

    warehouse.write_merged(merged, str(tmp_path / "merged"))
    written = spark.read.option("header", True).csv(str(tmp_path / "merged"))
    assert written.count() == 2 and {"Opened", "Total", "Server", "Source_File"} <= set(written.columns)

    venue.write_bytes("thin.csv", b"Opened,Amount\r\n4/1/26 5:00 PM,3\r\n")
    with pytest.raises(legacy.IncompleteExport, match="thin.csv lacks # of Guests"):
        legacy.build_folder(spark, str(venue.exports))


def test_weather_table(spark, tmp_path):
    (tmp_path / "w.csv").write_text("service_date,temp_high_f,temp_low_f,precip_in,wind_max_mph\n2026-04-01,61.5,44,0.1,9\n2026-04-01,61.5,44,0.1,9\n")
    frame = weather.read_weather(spark, str(tmp_path / "w.csv"))
    frame.write.parquet(str(tmp_path / "w.parquet"))
    assert frame.count() == weather.read_weather(spark, str(tmp_path / "w.parquet")).count() == 1


def test_pull_order_is_by_range_end_then_file_time(spark):
    import datetime as dt
    files = [("undated.csv", dt.datetime(2026, 5, 2)), ("a_2026_01_01-2026_03_01.csv", dt.datetime(2026, 5, 1)),
             ("b_2026_02_01-2026_03_01 (1).csv", dt.datetime(2026, 4, 1)), ("older.csv", dt.datetime(2026, 5, 1))]
    ranked = merge.rank_pulls(spark.createDataFrame(files, "source_file string, modified timestamp"))
    assert [r.source_file for r in ranked.orderBy("pull_rank").collect()] == [
        "older.csv", "undated.csv", "b_2026_02_01-2026_03_01 (1).csv", "a_2026_01_01-2026_03_01.csv"]


def test_files_loaded_together_share_a_folder(venue, tmp_path):
    for name in "abc":
        venue.write(f"{name}.csv", "A", line("A"))
    venue.write("items.csv", "ITEM", line("ITEM"))
    assert venue.load() == 4
    venue.write("d.csv", "A", line("A"), line("A"))
    assert venue.load() == 1
    folders = lambda name: sorted(p.name for p in (tmp_path / "warehouse" / "raw" / name).glob("load_id=*"))
    assert folders("order_details_a") == ["load_id=1", "load_id=5"] and folders(rules.RAW_TABLES["ITEM"]) == ["load_id=1"]
    assert sorted((r.source_file, r.load_id) for r in venue.raw("A").collect()) == [("a.csv", 1), ("b.csv", 2), ("c.csv", 3), ("d.csv", 5), ("d.csv", 5)]
    assert [(r.source_file, r.load_id) for r in venue.raw("ITEM").collect()] == [("items.csv", 4)]
    for part in (tmp_path / "warehouse" / "raw" / "order_details_a" / "load_id=1").glob("part-*"):
        part.write_bytes(b"must not be opened")
    assert [r.load_id for r in ledger.read_raw(venue.spark, venue.root, "A", after=4).collect()] == [5, 5]


def test_rows_of_a_dead_batch_do_not_come_back_when_their_file_is_loaded_later(venue, spark):
    late = venue.write("late.csv", "A", line("A"), line("A"))
    content = late.read_bytes()
    venue.write("a.csv", "A", line("A"))
    venue.load()
    late.unlink()
    # what a batch from id 3 on left when it died: the same rows under the same fingerprint
    (log,) = venue.log().where("source_file = 'late.csv'").collect()
    spark.read.parquet(f"{venue.root}/raw/order_details_a/load_id=1").where(f"file_hash = '{log.file_hash}'").write.parquet(
        f"{venue.root}/raw/order_details_a/load_id=3")
    assert venue.raw("A").count() == 3
    venue.write("items.csv", "ITEM", line("ITEM"))
    late.write_bytes(content + (line("A") + "\r\n").encode())
    assert venue.load() == 2 and venue.raw("A").count() == 6


def test_loads_logged_without_a_folder_are_read_from_their_own(venue, spark):
    """What was stored before batches had folders: one folder per load, and a log that names none."""
    venue.write("a.csv", "A", line("A"))
    venue.write("b.csv", "A", line("A"), line("A"))
    venue.load()
    old_log = venue.log().drop("folder_id").localCheckpoint()
    stored = spark.read.parquet(f"{venue.root}/raw/order_details_a").drop("load_id").join(
        old_log.select("file_hash", "load_id"), "file_hash").localCheckpoint()
    old_log.write.mode("overwrite").parquet(f"{venue.root}/raw/load_log")
    stored.write.mode("overwrite").partitionBy("load_id").parquet(f"{venue.root}/raw/order_details_a")
    assert [r.load_id for r in venue.raw("A").orderBy("load_id").collect()] == [1, 2, 2]
    venue.write("c.csv", "A", line("A"))
    assert venue.load() == 1
    assert [r.load_id for r in venue.raw("A").orderBy("load_id").collect()] == [1, 2, 2, 3]


def test_a_load_leaves_nothing_but_the_warehouse(venue, spark, monkeypatch):
    """The parsed records and what they were read from are gone after a load, also after one that failed."""
    spools, store = [], Spool.store
    monkeypatch.setattr(Spool, "store", lambda self, name, df: spools.append((self.root, name)) or store(self, name, df))
    venue.write("a.csv", "A", line("A"))
    setting = spark.conf.get(FREE_SHUFFLES, None)
    assert venue.load() == 1
    assert {"pieces", "cut", "records"} <= {name for _, name in spools}
    monkeypatch.setattr(exports, "file_layouts", lambda *a: 1 / 0)
    venue.write("b.csv", "A", line("A"))
    with pytest.raises(ZeroDivisionError):
        venue.load()
    assert not any(Path(root.removeprefix("file:")).exists() for root, _ in spools)
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
