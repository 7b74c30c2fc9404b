"""Point-of-sale frames derived from the given tables, row by row and over whole tables.

``orders`` and ``lineitem`` stand for the venue's orders and item selections (dates moved
into the floor plan's years), ``events`` for visits of exports without ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from servicenight import rules
from servicenight.operators import staging
from servicenight.session import ensure_checkpoint_dir, shuffles_freed, travels

travels(__name__)

ORDER_SHIFT_DAYS = 10958    # 30 years
VISIT_SHIFT_DAYS = 762
TABLE_CODES = [*[f"BD{i}" for i in range(1, 6)], *[f"E{i}" for i in range(1, 6)],
               *[f"O{i}" for i in range(1, 11)], *[f"B{i}" for i in range(1, 15)], "X1"]
CATEGORIES = ["Liquor", "Glass Wine", "Draft Beer", "Food", "NA Beverage", "Bottle Wine"]

EXPORT_FILES = ["OrderDetails_2024_12_01-2026_01_15.csv", "OrderDetails_2025_06_01-2031_09_30.csv",
                "renamed.csv", "OrderDetails_2025_06_02-2031_09_30.csv", "older_pull.csv"]
ITEM_FILES = {"A": "ItemSelectionDetails_2025_01_01-2026_01_31.csv",
              "N": "ItemSelectionDetails_2025_01_01-2026_06_30.csv", "R": "items.csv"}
PULL_FILES = ["OrderDetails_undated.csv", "OrderDetails_2026_01_01-2026_02_15.csv",
              "OrderDetails_2026_02_01-2026_03_05.csv"]
FILE_ROWS = 500
DARK_DAYS = [3, 4, 5, 11, 12, 20]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    """The value at a 0-based index; NULL past the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def cents(amount: Column) -> Column:
    """Whole cents as money."""
    return (amount.cast("decimal(14,0)") * F.lit(Decimal("0.01"))).cast("decimal(10,2)")


def _shifted(day: Column, days: int, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), day + F.expr(f"interval {days} days"))


def _order_columns(o: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    o = o.withColumns({
        "_cents": F.floor(F.round(F.col("o_totalprice") * 100).cast("bigint") / 1000).cast("bigint"),
        "_span": (key * 7919) % 25200})
    o = o.withColumns({
        "_tax": F.expr("_cents * 8 div 100"), "_tip": F.expr("_cents * (o_custkey % 3) div 10"),
        "_grat": F.when(F.col("o_orderpriority") == "1-URGENT", F.expr("_cents * 18 div 100")).otherwise(0)})
    return o.withColumns({
        "_total": (F.col("_cents") + F.col("_tax") + F.col("_tip") + F.col("_grat")
                   + F.when(key % 211 == 0, 1).otherwise(0)),
        "_discount": F.when(F.col("o_orderpriority") == "5-LOW", 500).otherwise(0),
        "_guests": (F.when(key % 53 == 0, 0).when(key % 59 == 0, 14).when(key % 61 == 0, 35)
                    .when(key % 67 == 0, F.lit(None)).otherwise(1 + key % 9)).cast("int"),
        "_table": pick(TABLE_CODES, F.col("o_custkey") % 40),
        "_opened": _shifted(F.col("o_orderdate"), ORDER_SHIFT_DAYS, 600 + (key * 37) % 1100),
        "_seconds": (F.when(key % 43 == 0, F.lit(None)).when(key % 47 == 0, -F.col("_span"))
                     .when(key % 41 == 0, F.col("_span") + 100000).otherwise(F.col("_span"))),
        "_checks": F.transform(F.sequence(F.lit(0), (key % 3).cast("int")),
                               lambda i: (key % 50).cast("int") + i)})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed orders, one row per order id."""
    o = _order_columns(table(spark, sf_dir, "orders"))
    typed = o.select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 300 + 1).cast("int").alias("order_number"),
        F.col("_checks").alias("check_numbers"), F.col("_opened").alias("opened_at"),
        F.col("_guests").alias("guests"), F.col("_table").alias("table_code"),
        cents(F.col("_discount")).alias("discount_amount"), cents(F.col("_cents")).alias("amount"),
        cents(F.col("_tax")).alias("tax"), cents(F.col("_tip")).alias("tip"),
        cents(F.col("_grat")).alias("gratuity"), cents(F.col("_total")).alias("total"),
        F.col("_seconds").alias("duration_seconds"))
    return staging.with_order_flags(typed)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of the layout with ids; an order is in as many exports as its priority says.

    A later load carries a larger tip, so the chosen copy shows in the result.
    """
    copies = F.substring("o_orderpriority", 1, 1).cast("int")
    o = _order_columns(table(spark, sf_dir, "orders")).withColumn(
        "load_id", F.explode(F.sequence(F.lit(1), copies).cast("array<bigint>")))
    text = lambda c: c.cast("string")
    money = lambda name: text(cents(F.col(name)))
    blank = lambda c: F.coalesce(text(c), F.lit(""))
    clock = lambda c: F.date_format(c, "M/d/yy h:mm a")
    seconds = F.col("_seconds")
    sign = F.when(seconds < 0, "-").otherwise("")
    size = F.abs(seconds)
    duration = F.concat(
        sign, text(F.floor(size / 3600)), F.lit(":"), sign, F.lpad(text(F.floor(size % 3600 / 60)), 2, "0"),
        F.lit(":"), sign, F.lpad(text(size % 60), 2, "0"))
    closed = F.when(F.col("o_orderkey") % 71 != 0, clock(F.col("_opened") + F.expr("interval 1 day")))
    return o.select(
        "load_id", pick(EXPORT_FILES, F.col("load_id") - 1).alias("source_file"),
        F.col("o_orderkey").alias("source_row_number"),
        text(F.col("o_orderkey")).alias("Order Id"), text(F.col("o_orderkey") % 300 + 1).alias("Order #"),
        F.array_join(F.col("_checks").cast("array<string>"), ", ").alias("Checks"),
        clock(F.col("_opened")).alias("Opened"), text(F.coalesce("_guests", F.lit(0))).alias("# of Guests"),
        blank(F.col("_table")).alias("Table"), money("_discount").alias("Discount Amount"),
        money("_cents").alias("Amount"), money("_tax").alias("Tax"),
        text(cents(F.col("_tip") + F.col("load_id") * 100)).alias("Tip"), money("_grat").alias("Gratuity"),
        money("_total").alias("Total"), blank(closed).alias("Closed"),
        blank(duration).alias("Duration (Opened to Paid)"))


def _item_columns(l: DataFrame) -> DataFrame:
    part, rare = F.col("l_partkey"), F.col("l_partkey") % 400 == 0
    l = l.withColumns({
        "_sent": _shifted(F.col("l_shipdate"), ORDER_SHIFT_DAYS, 600 + (part * 13 + F.col("l_orderkey") * 7) % 1100),
        "_item": F.when(rare, F.concat(F.lit("Rare "), part.cast("string")))
        .otherwise(F.concat(F.lit("Item "), (part % 50).cast("string"))),
        "_price": F.when(rare, 4000)
        .when(part % 50 == 49, F.expr("cast(round(l_extendedprice * 100) as bigint) div 1000"))
        .when(F.col("l_quantity") <= 25, 800 + 100 * (part % 50)).otherwise(900 + 100 * (part % 50)),
        "_discount": F.when(F.col("l_discount") > 0.085, 100).otherwise(0),
        "_halves": F.when(F.col("l_quantity").isin(10, 20, 30, 40, 50), 4)
        .when(F.col("l_quantity") == 7, 1).otherwise(2)})
    return l.withColumn("_net", F.when(
        F.col("l_tax") > 0.075, F.expr("(_price - _discount) div 2")
    ).otherwise(F.expr("(_price - _discount) * _halves div 2")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed item selections, every line item one sale."""
    l = _item_columns(table(spark, sf_dir, "lineitem"))
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_selection_id"),
        F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("order_id"),
        F.col("l_suppkey").alias("check_id"), F.col("_sent").alias("sent_at"), F.col("_item").alias("menu_item"),
        F.when(F.col("l_suppkey") % 6 != 0, F.concat(F.lit("Group "), (F.col("l_suppkey") % 6).cast("string"))
               ).alias("menu_group"),
        F.concat(F.lit("Menu "), F.col("l_linestatus")).alias("menu"),
        pick(CATEGORIES, F.col("l_partkey") % 50 % 7).alias("sales_category"),
        cents(F.col("_price")).alias("gross_price"), cents(F.col("_discount")).alias("discount"),
        cents(F.col("_net")).alias("net_price"),
        (F.col("_halves").cast("decimal(4,0)") * F.lit(Decimal("0.50"))).cast("decimal(6,2)").alias("qty"),
        (F.col("l_returnflag") == "R").alias("is_void"))


def raw_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Text rows of both item layouts; line items that share order and line are copies."""
    l = _item_columns(table(spark, sf_dir, "lineitem"))
    text = lambda c: c.cast("string")
    blank = lambda c: F.coalesce(text(c), F.lit(""))
    sent = F.date_format("_sent", "M/d/yy h:mm a")
    columns = {
        "load_id": F.col("l_suppkey"),
        "source_file": F.when(F.col("l_returnflag") == "A", ITEM_FILES["A"])
        .when(F.col("l_returnflag") == "N", ITEM_FILES["N"]).otherwise(ITEM_FILES["R"]),
        "source_row_number": F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        "Order Id": text(F.col("l_orderkey")), "Order #": text(F.col("l_orderkey") % 300 + 1),
        "Sent Date": sent, "Order Date": sent, "Check Id": text(F.col("l_suppkey")),
        "Table": blank(pick(TABLE_CODES, F.col("l_suppkey") % 40)),
        "Dining Area": F.when(F.col("l_suppkey") % 2 == 0, "Lounge").otherwise(""),
        "Service": F.lit(""),
        "Item Selection Id": text(F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        "Menu Item": F.col("_item"), "Menu Group": F.concat(F.lit("Group "), text(F.col("l_suppkey") % 6)),
        "Menu": F.lit(""), "Sales Category": blank(pick(CATEGORIES, F.col("l_partkey") % 50 % 7)),
        "Gross Price": text(cents(F.col("_price"))), "Discount": text(cents(F.col("_discount"))),
        "Net Price": text(cents(F.col("_net"))),
        "Qty": F.when(F.col("_halves") == 1, "0.5").when(F.col("_halves") == 4, "2.0").otherwise("1.0"),
        "Void?": F.when(F.col("l_returnflag") == "R", "true").otherwise("false")}
    with_service = l.where(F.col("l_linestatus") == "O").select(*[c.alias(n) for n, c in columns.items()])
    without = l.where(F.col("l_linestatus") != "O").select(
        *[c.alias(n) for n, c in columns.items() if n != "Service"])
    return with_service, without


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits as one export without ids carries them, some rows repeated whole."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    value = F.round(F.col("value") * 100).cast("bigint")
    rows = e.select(
        key.alias("order_id"),
        (F.expr("ts - make_dt_interval(0, 0, 0, extract(second from ts))")
         + F.expr(f"interval {VISIT_SHIFT_DAYS} days")).alias("opened_at"),
        pick(TABLE_CODES, F.col("user_id") % 40).alias("table_code"),
        (F.when(key % 97 == 0, 25).when(key % 89 == 0, F.lit(None)).otherwise(1 + key % 8)
         ).cast("int").alias("guests"),
        cents(F.when(key % 83 == 0, value * 10).otherwise(value)).alias("amount"),
        (F.when(key % 79 == 0, F.lit(None)).when(key % 73 == 0, 28800 + key % 3600)
         .when(key % 11 == 0, 300 + key % 600)
         .otherwise((15 + key % 120) * 60 + key % 60)).cast("bigint").alias("duration_seconds"))
    copies = F.when(F.col("order_id") % 50 == 0, 2).otherwise(1)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def pull_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three pulls that share their boundary days; the second has no duration."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    rank = F.col("pull_rank")
    opened = (F.expr("ts - make_dt_interval(0, 0, minute(ts), extract(second from ts))")
              + F.expr(f"interval {VISIT_SHIFT_DAYS} days"))
    value = F.round(F.col("value") * 100).cast("bigint")
    # days without any row, alone and in runs
    dark = (F.datediff("ts", F.lit("2000-01-01")) % 29).isin(DARK_DAYS)
    covered = F.filter(F.array(*[F.lit(p) for p in range(3)]),
                       lambda p: F.dayofmonth("ts").between(p * 10, p * 10 + 12) & ~dark)
    rows = e.withColumn("pull_rank", F.explode(covered)).withColumn(
        "source_chunk", F.explode(F.sequence(F.lit(0), F.when(key % 40 == 0, 1).otherwise(0))))
    return rows.select(
        pick(PULL_FILES, rank).alias("source_file"), "pull_rank", "source_chunk",
        (key * 2 + F.col("source_chunk")).alias("source_row_number"),
        opened.alias("opened"),
        F.when(key % 31 != 0, (1 + key % 8)).cast("int").alias("guests"),
        pick(TABLE_CODES, F.col("user_id") % 40).alias("table_code"),
        cents(key % 7 * 100).alias("discount_amount"), cents(value).alias("amount"),
        cents(F.expr("cast(round(value * 100) as bigint) * 8 div 100")).alias("tax"),
        cents(F.when((key % 5 == 0) & (rank > 0), F.lit(None)).otherwise(rank * 100 + key % 9)).alias("tip"),
        cents(F.lit(0)).alias("gratuity"),
        (opened + F.make_dt_interval(rank)).alias("closed"),
        F.when(rank != 1, F.concat(F.lit("1:"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(":00"))
               ).alias("duration_text"))


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports as files: ``FILE_ROWS`` consecutive order ids each, some cells broken over lines."""
    o = _order_columns(table(spark, sf_dir, "orders"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    break_ = F.when(F.col("o_orderkey") % 5 == 0, ",\n").otherwise(", ")
    checks = F.col("_checks").cast("array<string>")
    cell = F.concat(F.lit('"'), F.aggregate(
        F.slice(checks, 2, 9), checks[0], lambda acc, x: F.concat(acc, break_, x)), F.lit('"'))
    line = F.concat_ws(
        ",", text(F.col("o_orderkey")), text(F.col("o_orderkey") % 300 + 1), cell,
        F.date_format("_opened", "M/d/yy h:mm a"), text(F.coalesce("_guests", F.lit(0))),
        text(F.col("_table")), text(cents(F.col("_discount"))), text(cents(F.col("_cents"))),
        text(cents(F.col("_tax"))), text(cents(F.col("_tip"))), text(cents(F.col("_grat"))),
        text(cents(F.col("_total"))), F.lit(""), F.lit(""))
    number = F.floor(F.col("o_orderkey") / FILE_ROWS).cast("bigint")
    header = ",".join(rules.LAYOUTS["C"])
    # order keys are unique, so a file never has more than FILE_ROWS lines
    lines = o.select(number.alias("n"), "o_orderkey", line.alias("line")).groupBy("n").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n")
    return lines.select(
        F.format_string("/exports/OrderDetails_%08d.csv", "n").alias("path"),
        F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("modificationTime"),
        F.encode(F.concat(F.lit(header + "\r\n"), body, F.lit("\r\n")), "UTF-8").alias("content"))


LEGACY_FILES = ["OrderDetails_%05d_2026_01_01-2026_02_15.csv", "OrderDetails_%05d_2026_02_01-2026_03_05.csv"]


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports without ids, ``FILE_ROWS`` events each, from two rounds of pulls.

    The first round has Total but no Tax and repeats its header midway, with some rows on both
    sides; the second has a third of the events with a larger tip, Tax, no Total, no duration, and
    a column of its own.
    """
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    value = F.round(F.col("value") * 100).cast("bigint")
    opened = (F.expr("ts - make_dt_interval(0, 0, minute(ts), extract(second from ts))")
              + F.expr(f"interval {VISIT_SHIFT_DAYS} days"))
    clock = lambda c: F.date_format(c, "M/d/yy h:mm a")
    e = e.select(key, value.alias("v"), opened.alias("o"), pick(TABLE_CODES, F.col("user_id") % 40).alias("t"))
    tax = F.expr("v * 8 div 100")
    tip = key % 9 * 100
    head = [clock(F.col("o")), text(1 + key % 8), text(F.col("t")), text(cents(key % 7 * 100)), text(cents(F.col("v")))]
    closed = clock(F.col("o") + F.expr("interval 1 day"))
    first = F.concat_ws(",", *head, text(cents(tip)), F.lit("0"), text(cents(F.col("v") + tax + tip)), closed,
                        F.concat(F.lit("1:"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(":00")))
    second = F.concat_ws(",", *head, text(cents(tax)), text(cents(tip + 100)), F.lit("0.00"), closed,
                         F.concat(F.lit("S"), text(key % 4)))
    place, half = key % FILE_ROWS, FILE_ROWS // 2
    early = e.where(place < half).select(key, first.alias("line"), F.lit(0).alias("kind"), F.lit(0).alias("part"))
    late = e.where(place >= half - 5).select(key, first.alias("line"), F.lit(0).alias("kind"), F.lit(2).alias("part"))
    other = e.where(key % 3 == 0).select(key, second.alias("line"), F.lit(1).alias("kind"), F.lit(0).alias("part"))
    lines = early.unionByName(late).unionByName(other).withColumn("n", F.floor(key / FILE_ROWS).cast("bigint"))
    headers = [",".join(rules.LAYOUTS["A"]), ",".join([*rules.LAYOUTS["B"], "Server"])]
    repeat = F.struct(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("event_id"), F.lit(headers[0]).alias("line"))
    files = lines.groupBy("kind", "n").agg(F.collect_list(F.struct("part", "event_id", "line")).alias("lines"))
    ordered = F.sort_array(F.when(F.col("kind") == 0, F.array_append("lines", repeat)).otherwise(F.col("lines")))
    body = F.array_join(F.transform(ordered, lambda x: x["line"]), "\r\n")
    name = F.when(F.col("kind") == 0, F.format_string(LEGACY_FILES[0], "n")).otherwise(F.format_string(LEGACY_FILES[1], "n"))
    header = F.when(F.col("kind") == 0, headers[0]).otherwise(headers[1])
    return files.select(
        F.concat(F.lit("/exports/"), name).alias("path"), F.to_timestamp(F.lit("2026-03-06 00:00:00")).alias("modificationTime"),
        F.encode(F.concat(header, F.lit("\r\n"), body, F.lit("\r\n")), "UTF-8").alias("content"))


def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item exports in Windows-1252: one line per item id, the orders of a hundred keys per file."""
    one = ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag"]
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*one)).alias("x"))
    # the cells are made after the shuffle, which moves numbers instead
    l = _item_columns(l.select("l_orderkey", "l_linenumber", "x.*"))
    text = lambda c: c.cast("string")
    sent = F.date_format("_sent", "M/d/yy h:mm a")
    cells = [text(F.col("l_orderkey")), text(F.col("l_orderkey") % 300 + 1), sent, sent, text(F.col("l_suppkey")), F.lit("O3"),
             F.lit("Caf\u00e9"), text(F.col("l_orderkey") * 10 + F.col("l_linenumber")), F.concat(F.lit("Caf\u00e9 "), "_item"),
             F.concat(F.lit("Group "), text(F.col("l_suppkey") % 6)), F.lit(""), F.coalesce(pick(CATEGORIES, F.col("l_partkey") % 50 % 7), F.lit("")),
             text(cents(F.col("_price"))), text(cents(F.col("_discount"))), text(cents(F.col("_net"))),
             F.when(F.col("_halves") == 1, "0.5").when(F.col("_halves") == 4, "2.0").otherwise("1.0"),
             F.when(F.col("l_returnflag") == "R", "true").otherwise("false")]
    number = F.floor(F.col("l_orderkey") / 100).cast("bigint")
    # an order has seven lines at most
    lines = l.select(number.alias("n"), "l_orderkey", "l_linenumber", F.concat_ws(",", *cells).alias("line")).groupBy("n").agg(
        F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n")
    return lines.select(
        F.format_string("/exports/ItemSelectionDetails_%08d.csv", "n").alias("path"),
        F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("modificationTime"),
        # Latin-1 letters have the same bytes in Windows-1252
        F.encode(F.concat(F.lit(",".join(rules.LAYOUTS["ITEM_B"]) + "\r\n"), body, F.lit("\r\n")), "ISO-8859-1").alias("content"))


def write_files(files: DataFrame, folder: str) -> int:
    """Write (name, content) as files of an existing folder; a task that runs again writes the same bytes once more."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                # readers pass over names that start with a dot
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    return files.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


_FOLDERS: dict[tuple[str, str], str] = {}


def export_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the order and item exports as files, written once per application under the checkpoint folder.

    Every task writes its files under their own names, so neither the driver nor a commit touches them one by one.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        root = f"{ensure_checkpoint_dir(spark)}/exports-{uuid.uuid4().hex}"
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/files"))
        fs.deleteOnExit(place)
        files = export_files(spark, sf_dir).unionByName(item_files(spark, sf_dir))
        with shuffles_freed(spark):
            write_files(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), f"{root}/files")
        _FOLDERS[key] = f"{root}/files"
    return _FOLDERS[key]


def daily_weather(nights: DataFrame) -> DataFrame:
    """A weather table with one row per night, computed from the date; every 17th day is missing."""
    day = F.datediff("service_date", F.lit("2000-01-01").cast("date"))
    return nights.select("service_date").distinct().select(
        "service_date",
        (40 + (day * 37) % 51 + F.col("service_date").substr(6, 2).cast("int")).cast("double").alias("temp_high_f"),
        (30 + (day * 37) % 40).cast("double").alias("temp_low_f"),
        ((day * 7) % 5 / F.lit(20.0)).alias("precip_in"),
        (5 + (day * 11) % 23).cast("double").alias("wind_max_mph"),
    ).where(F.datediff("service_date", F.lit("2000-01-01").cast("date")) % 17 != 0)
