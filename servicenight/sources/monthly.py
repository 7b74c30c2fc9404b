"""Order tables by month, brought up to date by what new loads touch.

Each table lies in folders by month, an index from order id to month in folders by id bucket. A
version is a manifest that names the folder of every part; a refresh reads the rows of new loads alone,
finds the months their ids are in now and were in before, rewrites those parts, and lists the folders of
the version before for all others. No other folder is opened. A version is marked done last; readers take
the last one that is done.
"""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from servicenight import rules
from servicenight.operators import facts, floorplan, staging
from servicenight.session import materialize
from servicenight.sources import ledger
from servicenight.sources.warehouse import DONE, folder_of

MANIFEST = "name string, part int, path string, first_day date, last_day date, covered bigint"
ORDERS, SEATING, FACTS, INDEX = "orders", "order_seating", "fact_order", "order_index"
#: Buckets of the id index; fixed for the life of a root.
BUCKETS = 64


def month_key(day: Column) -> Column:
    """Year and month as one number; 0 for rows without a day."""
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(0))


def bucket(order_id: Column) -> Column:
    return F.pmod(F.xxhash64(order_id), F.lit(BUCKETS)).cast("int")


def versions(spark: SparkSession, root: str) -> list[str]:
    """Finished versions, oldest first."""
    pattern, fs = folder_of(spark, f"{root}/monthly/versions/*/{DONE}")
    return sorted(s.getPath().getParent().toString() for s in fs.globStatus(pattern) or [])


def manifest(spark: SparkSession, root: str, back: int = 1) -> list[Row]:
    """The parts of the latest version: one row per month and table and per index bucket, a calendar's worth."""
    done = versions(spark, root)
    return spark.read.schema(MANIFEST).parquet(f"{done[-back]}/manifest").collect() if len(done) >= back else []


def staged(raw: DataFrame) -> DataFrame:
    """Typed newest copies; an interval has no Parquet type that every reader knows."""
    return staging.stage_orders(raw).drop("duration")


def newest(copies: DataFrame) -> DataFrame:
    """One row per order of staged copies, by the rule that staging goes by; how many raw copies there were adds up."""
    payload = [c for c in copies.columns if c not in ("order_id", "copies_in_raw")]
    kept = F.max_by(F.struct(*payload), staging.copy_rank()).alias("k")
    return copies.groupBy("order_id").agg(kept, F.sum("copies_in_raw").alias("copies_in_raw")).select("order_id", "k.*", "copies_in_raw").select(*copies.columns)


def _facts(orders: DataFrame) -> DataFrame:
    spark = orders.sparkSession
    plan, combos = floorplan.tables(spark), floorplan.combinations(spark)
    return facts.order_facts(floorplan.with_placement(orders, plan, combos), floorplan.seating_unit_dimension(plan, combos))


def _seating(orders: DataFrame) -> DataFrame:
    return floorplan.place_orders(orders, floorplan.tables(orders.sparkSession), floorplan.combinations(orders.sparkSession))


def _index(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", month_key(F.col("service_date")).alias("month_key"))


DERIVED = {ORDERS: lambda orders: orders, SEATING: _seating, FACTS: _facts, INDEX: _index}


@functools.cache
def _schema(name: str) -> T.StructType:
    """The columns of a table, from the rules alone."""
    cells = ", ".join(f"`{n}` string" for n in rules.LAYOUTS["C"])
    raw = SparkSession.active().createDataFrame([], f"load_id bigint, source_file string, source_row_number int, {cells}")
    return DERIVED[name](staged(raw)).schema


def read_parts(spark: SparkSession, root: str, name: str, rows: list[Row], parts: Iterable[int] | None = None) -> DataFrame:
    """The given parts of a table as a version has them; only their folders are listed and opened."""
    wanted = None if parts is None else set(parts)
    paths = sorted(r.path for r in rows if r.name == name and (wanted is None or r.part in wanted))
    return spark.read.schema(_schema(name)).parquet(*paths) if paths else spark.createDataFrame([], _schema(name))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_parts(spark, root, name, manifest(spark, root))


def read_days(spark: SparkSession, root: str, first: dt.date, last: dt.date) -> DataFrame:
    """Order facts of a period, from the folders of its months."""
    key = lambda d: d.year * 10000 + d.month * 100 + d.day
    rows = manifest(spark, root)
    months = {r.part for r in rows if r.name == FACTS and key(first) // 100 <= r.part <= key(last) // 100}
    return read_parts(spark, root, FACTS, rows, months).where(F.col("date_key").between(key(first), key(last)))


def date_dimension(spark: SparkSession, root: str) -> DataFrame:
    """The calendar from the days that the manifest notes for each month."""
    rows = [r for r in manifest(spark, root) if r.name == ORDERS]
    days = [(d,) for r in rows for d in (r.first_day, r.last_day)]
    return facts.date_dimension(spark.createDataFrame(days, "service_date date"))


def _write(df: DataFrame, path: str, part: Column, covered: int, days: dict[int, Row], name: str) -> list[tuple]:
    df.withColumn("_part", part).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)
    pattern, fs = folder_of(df.sparkSession, f"{path}/_part=*")
    found = [(s.getPath().toString(), int(s.getPath().getName().removeprefix("_part="))) for s in fs.globStatus(pattern) or []]
    return [(name, p, place, days[p].first_day if name == ORDERS else None, days[p].last_day if name == ORDERS else None, covered) for place, p in found]


def refresh(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """Bring the tables up to the latest load; return which parts of each were written.

    Without new loads nothing is written. The version before stays for readers that are under way.
    """
    before = manifest(spark, root)
    covered = max((r.covered for r in before), default=0)
    latest = ledger.read_log(spark, root).agg(F.coalesce(F.max("load_id"), F.lit(0))).scalar()
    latest = spark.range(1).select(latest.alias("n")).first().n
    if latest <= covered:
        return {}
    month = month_key(F.col("service_date"))
    fresh = materialize(staged(ledger.read_raw(spark, root, "C", covered)))
    ids = fresh.select("order_id")
    values = lambda df, c: {r[0] for r in df.select(c).distinct().collect()}
    buckets = values(fresh, bucket(F.col("order_id")))
    index = read_parts(spark, root, INDEX, before, buckets)
    months = values(index.join(ids, "order_id", "left_semi"), "month_key") | values(fresh, month)

    stood = read_parts(spark, root, ORDERS, before, months)
    merged = newest(stood.join(ids, "order_id", "left_semi").unionByName(fresh))
    orders = materialize(stood.join(ids, "order_id", "left_anti").unionByName(merged))
    spans = orders.groupBy(month.alias("m")).agg(F.min("service_date").alias("first_day"), F.max("service_date").alias("last_day"))
    days = {r.m: r for r in spans.collect()}

    stamp = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = lambda name: f"{root}/monthly/parts/{stamp}/{name}"
    written: list[tuple] = []
    for name in (ORDERS, SEATING, FACTS):
        day = F.col("service_date") if name != FACTS else F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
        written += _write(DERIVED[name](orders), folder(name), month_key(day), latest, days, name)
    # the moved and the new ids take the place of what their buckets said of them
    now = index.join(ids, "order_id", "left_anti").unionByName(_index(orders.join(ids, "order_id", "left_semi")))
    written += _write(now, folder(INDEX), bucket(F.col("order_id")), latest, days, INDEX)

    replaced = {(name, m) for name in (ORDERS, SEATING, FACTS) for m in months} | {(INDEX, b) for b in buckets}
    kept = [tuple(r) for r in before if (r.name, r.part) not in replaced]
    version = f"{root}/monthly/versions/{stamp}"
    spark.createDataFrame([(*r[:5], latest) for r in kept] + written, MANIFEST).coalesce(1).write.parquet(f"{version}/manifest")
    done, fs = folder_of(spark, f"{version}/{DONE}")
    fs.mkdirs(done)
    _forget(spark, root)
    return {name: sorted(p for n, p, *_ in written if n == name) for name in DERIVED}


def _forget(spark: SparkSession, root: str) -> None:
    """Delete all versions but the last two, and the folders that neither of these lists."""
    done = versions(spark, root)
    held = {r.path for back in (1, 2) for r in manifest(spark, root, back)}
    for version in done[:-2]:
        for path in {r.path for r in spark.read.schema(MANIFEST).parquet(f"{version}/manifest").collect()} - held | {version}:
            place, fs = folder_of(spark, path)
            fs.delete(place, True)
