"""Queries on export files derived from orders: fingerprints, parsing, dispatch and the load log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from servicenight import rules
from servicenight.session import Spool, ensure_checkpoint_dir, materialize
from servicenight.sources import exports, ledger, monthly, ranges, warehouse
from servicenight.plans import standins as S
from servicenight.plans.registry import ORACLES, query
from servicenight.plans.sql_base import b, cte, f, i, money, sql, t

_HEADER = ",".join(rules.LAYOUTS["C"])
_MONEY = "printf('%d.%02d', {c} // 100, {c} % 100)"
cte("x_lines", f"""
SELECT order_id, order_id // {S.FILE_ROWS} AS n,
  replace(array_to_string(check_numbers, ','), ',', CASE WHEN order_id % 5 = 0 THEN ',' || chr(10) ELSE ', ' END) AS checks_text,
  CASE WHEN order_id % 5 = 0 THEN checks - 1 ELSE 0 END AS breaks,
  strftime(opened_at, '%-m/%-d/%y %-I:%M %p') AS opened_text, coalesce(guests, 0)::VARCHAR AS guests_text,
  coalesce(table_code, '') AS table_text, order_number::VARCHAR AS number_text,
  {', '.join(_MONEY.format(c=f'{c}_c') + f' AS {c}_text' for c in ('discount', 'amount', 'tax', 'tip', 'gratuity', 'total'))}
FROM v_orders""")
cte("x_files", f"""
SELECT printf('OrderDetails_%08d.csv', n) AS source_file, n, count(*) AS rows,
  '{_HEADER}' || chr(13) || chr(10) || string_agg(concat_ws(',', order_id, number_text, '"' || checks_text || '"',
    opened_text, guests_text, table_text, discount_text, amount_text, tax_text, tip_text, gratuity_text, total_text, '', ''),
    chr(13) || chr(10) ORDER BY order_id) || chr(13) || chr(10) AS content
FROM x_lines GROUP BY n""")


def _files(spark, sf):
    return exports.describe_files(S.export_files(spark, sf))


@query("file_fingerprints", sql("SELECT source_file, sha256(content) AS file_hash FROM x_files"))
def file_fingerprints(spark, sf):
    """SHA-256 of every export."""
    return _files(spark, sf).select("source_file", "file_hash")


@query("export_records", sql(f"""
SELECT source_file, {i('''2 + coalesce(sum(1 + breaks) OVER (PARTITION BY n ORDER BY order_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)''', 'source_row_number')},
  order_id::VARCHAR AS order_id, checks_text, opened_text, guests_text, table_text, amount_text, total_text
FROM x_lines JOIN x_files USING (n)"""))
def export_records(spark, sf):
    """Records of every export, numbered by the line they start on."""
    return _record_cells(exports.parse_files(_files(spark, sf)))


def _record_cells(records):
    cells = {name: F.col("fields")[rules.LAYOUTS["C"].index(source)] for name, source in {
        "order_id": "Order Id", "checks_text": "Checks", "opened_text": "Opened",
        "guests_text": "# of Guests", "table_text": "Table", "amount_text": "Amount",
        "total_text": "Total"}.items()}
    return records.where("kind = 'row'").select(
        "source_file", "source_row_number", *[c.alias(n) for n, c in cells.items()])


@query("layout_dispatch", sql(f"""
SELECT source_file, 'C' AS export_type, 'order_details_c' AS raw_table, {i('rows')} FROM x_files"""))
def layout_dispatch(spark, sf):
    """Layout of each export by its exact header, with its rows."""
    records = exports.parse_files(_files(spark, sf))
    sizes = records.groupBy("file_hash").agg(F.count_if(F.col("kind") == "row").alias("rows"))
    layouts = exports.file_layouts(records, exports.layout_table(spark))
    return layouts.join(sizes, "file_hash").select("source_file", "export_type", "raw_table", "rows")


def _seen(spark, sf):
    """A load log that knows the files with an even number, and files with a copy under a new name."""
    files = _files(spark, sf).select("source_file", "file_hash")
    number = F.regexp_extract("source_file", r"(\d+)\.csv$", 1).cast("bigint")
    log = files.where(number % 2 == 0).select(
        (number / 2 + 1).cast("bigint").alias("load_id"), "source_file", "file_hash")
    renamed = files.withColumn("source_file", F.concat(F.lit("copy of "), "source_file"))
    return files.unionByName(renamed), log


@query("unseen_files", sql(f"""
SELECT 'OrderDetails_' || right(source_file, 12) AS source_file, sha256(content) AS file_hash,
  {i('row_number() OVER (ORDER BY source_file) + (SELECT max(n) // 2 + 1 FROM x_files WHERE n % 2 = 0)', 'load_id')}
FROM x_files WHERE n % 2 = 1"""))
def unseen_files(spark, sf):
    """Files still to load: known bytes and second copies are skipped; ids follow the log's."""
    files, log = _seen(spark, sf)
    return ledger.assign_load_ids(ledger.unseen_files(files, log), log)


@query("committed_rows", sql(f"""
SELECT source_file, {i('n // 2 + 1', 'load_id')}, {i('rows')} FROM x_files WHERE n % 2 = 0"""))
def committed_rows(spark, sf):
    """Rows readers may see: those of loads the log has, whatever else lies in the raw tables."""
    files, log = _seen(spark, sf)
    number = F.regexp_extract("source_file", r"(\d+)\.csv$", 1).cast("bigint")
    records = exports.parse_files(_files(spark, sf)).where("kind = 'row'").withColumn(
        "load_id", (F.floor(number / 2) + 1).cast("bigint"))
    return ledger.committed(records, log).groupBy("source_file", "load_id").agg(F.count(F.lit(1)).alias("rows"))


cte("x_items", """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_orderkey % 300 + 1 AS number, l_suppkey, sent_at, menu_item, price_c, discount_c,
  halves, net_c, is_void, l_partkey
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) AS nth
      FROM (SELECT i.*, l.l_linenumber, l.l_quantity, l.l_discount, l.l_tax, l.l_shipdate FROM lineitem l JOIN v_items i
            ON i.l_orderkey = l.l_orderkey AND i.item_selection_id = l.l_orderkey * 10 + l.l_linenumber AND i.l_partkey = l.l_partkey
              AND i.l_suppkey = l.l_suppkey AND i.l_extendedprice = l.l_extendedprice AND i.l_returnflag = l.l_returnflag AND i.l_linestatus = l.l_linestatus))
WHERE nth = 1""")
cte("x_item_files", f"""
SELECT printf('ItemSelectionDetails_%08d.csv', l_orderkey // 100) AS source_file, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY id) + 1 AS line,
  x.*, strftime(sent_at, '%-m/%-d/%y %-I:%M %p') AS sent FROM x_items x""")


@query("folder_files", sql("""
SELECT source_file, sha256(content) AS file_hash FROM x_files"""))
def folder_files(spark, sf):
    """The order exports of a folder, as a scan finds them."""
    return exports.scan_folder(spark, S.export_folder(spark, sf), "Order*.csv").select("source_file", "file_hash")


@query("folder_records", ORACLES["export_records"])
def folder_records(spark, sf):
    """Records of the order exports of a folder, each file read in ranges."""
    folder = S.export_folder(spark, sf)
    records = ranges.parse_folder(spark, folder, exports.scan_folder(spark, folder, "Order*.csv"))
    return _record_cells(records)


@query("folder_items", sql(f"""
SELECT source_file, {i('line', 'source_row_number')}, id::VARCHAR AS id, 'Café ' || menu_item AS menu_item, sent FROM x_item_files"""))
def folder_items(spark, sf):
    """Records of the item exports of a folder, in Windows-1252, each file read in ranges."""
    folder = S.export_folder(spark, sf)
    records = ranges.parse_folder(spark, folder, exports.scan_folder(spark, folder, "Item*.csv"))
    cell = lambda name: F.col("fields")[rules.LAYOUTS["ITEM_B"].index(name)]
    return records.where("kind = 'row'").select("source_file", "source_row_number", cell("Item Selection Id").alias("id"),
                                                cell("Menu Item").alias("menu_item"), cell("Sent Date").alias("sent"))


@query("unseen_or_refused", sql(f"""
SELECT 'OrderDetails_' || right(source_file, 12) AS source_file, sha256(content) AS file_hash FROM x_files WHERE n % 2 = 1 AND n % 3 <> 0"""))
def unseen_or_refused(spark, sf):
    """Files still to load where every third one was refused before: those are not parsed again."""
    files, log = _seen(spark, sf)
    number = F.regexp_extract("source_file", r"(\d+)\.csv$", 1).cast("bigint")
    return ledger.unseen_files(files, log, files.where(number % 3 == 0)).select("source_file", "file_hash")


@query("legacy_rows", sql(f"""
SELECT source_file, {i('source_row_number')}, {t('opened_at', 'opened')}, {i('coalesce(guests, 0)', 'guests')},
  table_code, {money('amount', 'total')}
FROM (SELECT order_id, source_file, 2 + coalesce(sum(1 + breaks) OVER (PARTITION BY n ORDER BY order_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS source_row_number
      FROM x_lines JOIN x_files USING (n)) JOIN v_orders USING (order_id)"""))
def legacy_rows(spark, sf):
    """Exports read by column name, whatever columns they carry."""
    records = materialize(exports.parse_files(_files(spark, sf)))
    return exports.legacy_rows(records).select(
        "source_file", "source_row_number", "opened", "guests", "table_code", "amount", "total")


# --- a warehouse loaded and refreshed from these files -----------------------------------------------

_BUILT: dict[tuple[str, str], str] = {}


def _warehouse(spark, sf) -> str:
    """A warehouse of the export files of ``sf``, built once per application under the checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        root = f"{ensure_checkpoint_dir(spark)}/warehouse-{uuid.uuid4().hex}"
        spool = Spool(spark)
        try:  # a load reads its files twice
            files = spool.store("files", S.export_files(spark, sf).unionByName(S.item_files(spark, sf)))
            ledger.load_files(exports.describe_files(files), root)
        finally:
            spool.drop()
        warehouse.refresh(spark, root)
        _BUILT[key] = root
    return _BUILT[key]


@query("refreshed_order_facts", sql(f"""
SELECT {i('order_id')}, {i("strftime(service_date, '%Y%m%d')::BIGINT", 'date_key')}, coalesce(section, 'No table') AS section,
  {money('amount', 'total')}, {i('checks')} FROM v_placed"""))
def refreshed_order_facts(spark, sf):
    """Order facts read back from a warehouse that loaded and refreshed export files."""
    return warehouse.read(spark, _warehouse(spark, sf), "analytics/fact_order").select(
        "order_id", "date_key", "section", "amount", "total", "checks")


@query("order_facts_by_load", ORACLES["refreshed_order_facts"])
def order_facts_by_load(spark, sf):
    """Order facts kept by month: half of the files come first with other hours, so that orders change nights and months later."""
    root = f"{ensure_checkpoint_dir(spark)}/monthly-{uuid.uuid4().hex}"
    files = S.export_files(spark, sf)
    early = files.where(F.regexp_extract("path", r"(\d+)\.csv$", 1).cast("bigint") % 2 == 0).withColumns({
        "path": F.replace("path", F.lit("OrderDetails"), F.lit("early")),
        "content": F.encode(F.replace(F.decode("content", "UTF-8"), F.lit(" PM"), F.lit(" AM")), "UTF-8")})
    for arrived in (early, files):
        ledger.load_files(exports.describe_files(arrived), root)
        monthly.refresh(spark, root)
    return monthly.read(spark, root, monthly.FACTS).select("order_id", "date_key", "section", "amount", "total", "checks")


@query("refreshed_items", sql(f"""
SELECT {i('id', 'item_selection_id')}, {i('l_orderkey', 'order_id')}, 'Café ' || menu_item AS menu_item, 'Café' AS dining_area,
  {money('price', 'discount', 'net')}, {f('halves / 2.0', 'qty')}, {b('is_void')} FROM x_items"""))
def refreshed_items(spark, sf):
    """Staged item selections of files in Windows-1252."""
    return warehouse.read(spark, _warehouse(spark, sf), "staging/item_selections").select(
        "item_selection_id", "order_id", "menu_item", "dining_area", F.col("gross_price").alias("price"), "discount",
        F.col("net_price").alias("net"), "qty", "is_void")


@query("refreshed_year_by_section", sql(f"""
SELECT coalesce(section, 'No table') AS section, {i('count(*)', 'orders')}, {f('sum(amount_c) / 100.0', 'revenue')} FROM v_placed
WHERE service_date BETWEEN DATE '{rules.REPORT_YEAR[0]}' AND DATE '{rules.REPORT_YEAR[1]}' GROUP BY 1"""))
def refreshed_year_by_section(spark, sf):
    """A period report over the stored facts, which opens the folders of its months alone."""
    facts = warehouse.read_days(spark, _warehouse(spark, sf), "analytics/fact_order", *rules.REPORT_YEAR)
    return facts.groupBy("section").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("revenue"))


@query("refreshed_sql", sql(f"""
SELECT dayname(service_date) AS day_name, {i('count(*)', 'orders')} FROM v_orders GROUP BY 1"""))
def refreshed_sql(spark, sf):
    """SQL over the stored tables."""
    return warehouse.query(spark, _warehouse(spark, sf), "SELECT day_name, count(*) AS orders FROM fact_order JOIN dim_date USING (date_key) GROUP BY day_name")


@query("refused_files", sql("""
SELECT source_file, CASE WHEN n % 3 = 0 THEN 'line 3: 1 fields, header has 14' ELSE 'unrecognised header: Opened, Something' END AS reason
FROM x_files WHERE n % 3 < 2"""))
def refused_files(spark, sf):
    """Files that must not be loaded, among good ones, each with its reason."""
    number = F.regexp_extract("source_file", r"(\d+)\.csv$", 1).cast("bigint")
    files = _files(spark, sf)
    plain = F.concat(F.lit(_HEADER + "\r\n"), F.lit("1,2,,1/1/26 1:00 PM,1,O3,0,1,0,0,0,1,,\r\nragged\r\n"))
    spoiled = F.when(number % 3 == 0, F.encode(plain, "UTF-8")).when(
        number % 3 == 1, F.encode(F.lit("Opened,Something\r\nx,y\r\n"), "UTF-8")).otherwise(F.col("content"))
    records = materialize(exports.parse_files(files.withColumn("content", spoiled)))
    return exports.refused_files(records, exports.layout_table(spark)).select("source_file", "reason")
