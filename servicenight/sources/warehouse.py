"""The stored layers: refresh everything derived from raw, in dependency order.

A refresh writes all layers into a version folder of its own and marks it done at the end.
Readers take the latest version that is done, so a refresh that fails leaves the last one in use.
So does one whose tables do not fit together; they are measured while they are written.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from servicenight.operators import facts, floorplan, merge, prices, staging
from servicenight.session import shuffles_freed
from servicenight.sources import ledger, measured

# Partitioned by month of the date key, so a report over a period reads only its months.
FACT_TABLES = ("fact_order", "fact_item_selection")
TABLES = ("staging/orders", "staging/item_selections", "staging/order_seating", "analytics/dim_date",
          "analytics/dim_seating_unit", "analytics/dim_menu_item", "analytics/fact_order", "analytics/fact_item_selection")
DONE = "_done"


def folder_of(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[str]:
    """Finished versions, oldest first; a version's name starts with the time it was begun."""
    pattern, fs = folder_of(spark, f"{root}/versions/*/{DONE}")
    return sorted(s.getPath().getParent().getName() for s in fs.globStatus(pattern) or [])


def current(spark: SparkSession, root: str) -> str:
    done = versions(spark, root)
    if not done:
        raise FileNotFoundError(f"no finished refresh under {root}")
    return f"{root}/versions/{done[-1]}"


def _write(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    if name.split("/")[-1] in FACT_TABLES:
        monthly = df.withColumn("month_key", F.floor(F.col("date_key") / 100).cast("int"))
        # rows of a month come together before they are written; a large month is split over tasks
        monthly.hint("rebalance", "month_key").write.option("compression", "zstd").partitionBy("month_key").parquet(path)
    else:
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current version; facts carry ``month_key``, on which filters prune folders."""
    return spark.read.parquet(f"{current(spark, root)}/{name}")


def read_days(spark: SparkSession, root: str, name: str, first: dt.date, last: dt.date) -> DataFrame:
    """The facts of a period; only the folders of its months are listed and opened."""
    key = lambda d: d.year * 10000 + d.month * 100 + d.day
    return read(spark, root, name).where(
        F.col("month_key").between(key(first) // 100, key(last) // 100) & F.col("date_key").between(key(first), key(last)))


def refresh(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Re-derive staging and analytics from raw; every step reads the stored step before it.

    Running it again after a rule change rebuilds all layers; raw is never touched. The version
    before stays for readers that are under way; older ones go.
    """
    folder = f"{root}/versions/{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    raw = lambda layout: ledger.read_raw(spark, root, layout)
    plan, combos = floorplan.tables(spark), floorplan.combinations(spark)
    out: dict[str, DataFrame] = {}
    checks = measured.Measured()

    def store(name: str, df: DataFrame) -> DataFrame:
        with shuffles_freed(spark):
            out[name.split("/")[-1]] = _write(checks.watch(name, df), folder, name)
        return out[name.split("/")[-1]]

    # an interval has no Parquet type that every reader knows; seconds are stored instead
    orders = store("staging/orders", staging.stage_orders(raw("C")).drop("duration"))
    items = store("staging/item_selections", staging.stage_items(raw("ITEM"), raw("ITEM_B")))
    store("staging/order_seating", floorplan.place_orders(orders, plan, combos))
    store("analytics/dim_date", facts.date_dimension(orders))
    units = store("analytics/dim_seating_unit", floorplan.seating_unit_dimension(plan, combos))
    menu = store("analytics/dim_menu_item", prices.menu_item_dimension(items))
    placed = floorplan.with_placement(orders, plan, combos)
    store("analytics/fact_order", facts.order_facts(placed, units))
    store("analytics/fact_item_selection", facts.item_facts(items, orders, menu))
    measured.settle(checks, lambda name: spark.read.parquet(f"{folder}/{name}"))
    done, fs = folder_of(spark, f"{folder}/{DONE}")
    fs.mkdirs(done)
    for old in versions(spark, root)[:-2]:
        fs.delete(folder_of(spark, f"{root}/versions/{old}")[0], True)
    return out


def load_and_refresh(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """Load new exports; refresh the derived layers when any row came in."""
    added = ledger.load_folder(spark, folder, root)
    if not added.isEmpty():
        refresh(spark, root)
    return added


def query(spark: SparkSession, root: str, sql: str, **params) -> DataFrame:
    """SQL over the stored tables, named as they are stored (``fact_order``, ``dim_date``...)."""
    for name in TABLES:
        read(spark, root, name).createOrReplaceTempView(name.split("/")[-1])
    return spark.sql(sql, args=params or None)


def write_merged(merged: DataFrame, path: str) -> None:
    """Merged orders as CSV in export form; the order of rows runs across the part files."""
    merge.export_form(merged).write.mode("overwrite").option("header", True).csv(path)
