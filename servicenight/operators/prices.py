"""Price history inferred from what was sold (Type 2).

One pass reduces the sales to counts per item, day, price and attributes; the history and its
descriptions work on that summary, whose size depends on the menu and the calendar, not on the
sales. So an item with a third of all sales costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight.functions import calendar
from servicenight.operators.floorplan import in_force
from servicenight.operators.ordering import number_rows
from servicenight.session import materialize

MIN_MONTH_SALES = 3


def is_clean_sale() -> Column:
    """Sales that show the list price: not void, single, priced, not split or comped."""
    return F.coalesce(
        ~F.col("is_void") & (F.col("qty") == 1) & (F.col("gross_price") > 0)
        & (F.col("net_price") == F.col("gross_price") - F.col("discount")), F.lit(False))


def price_counts(items: DataFrame) -> DataFrame:
    """Per item, month and price: clean sales, first clean sale, first sale of any kind."""
    clean = is_clean_sale()
    return items.groupBy(
        "menu_item", F.to_date(F.trunc("sent_at", "month")).alias("month"),
        F.col("gross_price").alias("price"),
    ).agg(F.count(F.when(clean, 1)).alias("n"),
          F.min(F.when(clean, F.col("sent_at"))).alias("first_sale"),
          F.min("sent_at").alias("first_any"))


def stored_price_counts(items: DataFrame) -> DataFrame:
    """The summary every later step reads, stored so that the sales are scanned for it once."""
    return materialize(price_counts(items))


ATTRIBUTES = ["menu_group", "menu", "sales_category"]


def daily_sales(items: DataFrame) -> DataFrame:
    """Sales per item, service day, month sent, price and attributes; version bounds are service days."""
    clean = is_clean_sale()
    return items.groupBy(
        "menu_item", calendar.service_date(F.col("sent_at")).alias("sday"),
        F.to_date(F.trunc("sent_at", "month")).alias("month"), F.col("gross_price").alias("price"), *ATTRIBUTES,
    ).agg(F.count(F.lit(1)).alias("sales"), F.count(F.when(clean, 1)).alias("n"),
          F.min(F.when(clean, F.col("sent_at"))).alias("first_sale"), F.min("sent_at").alias("first_any"))


def counts_of_days(daily: DataFrame) -> DataFrame:
    """``price_counts`` from daily sales."""
    return daily.groupBy("menu_item", "month", "price").agg(
        F.sum("n").alias("n"), F.min("first_sale").alias("first_sale"), F.min("first_any").alias("first_any"))


def established_prices(counts: DataFrame) -> DataFrame:
    """Months in which one price is more than half of at least three clean sales."""
    best = F.max_by(F.struct("price", "first_sale", "n"), F.struct("n", F.col("price").alias("p")))
    return (counts.where("n > 0").groupBy("menu_item", "month")
            .agg(best.alias("best"), F.sum("n").alias("month_n"))
            .where((F.col("month_n") >= MIN_MONTH_SALES) & (F.col("best.n") * 2 > F.col("month_n")))
            .select("menu_item", "month", "best.price", "best.first_sale"))


def overall_prices(counts: DataFrame) -> DataFrame:
    """Items whose most frequent clean price is more than half of all clean sales."""
    per_price = counts.where("n > 0").groupBy("menu_item", "price").agg(F.sum("n").alias("n"))
    best = F.max_by(F.struct("price", "n"), F.struct("n", (-F.col("price")).alias("p")))
    return (per_price.groupBy("menu_item").agg(best.alias("best"), F.sum("n").alias("total_n"))
            .where(F.col("best.n") * 2 > F.col("total_n"))
            .select("menu_item", F.col("best.price").alias("price")))


def price_changes(established: DataFrame) -> DataFrame:
    """Established months whose price differs from the established month before."""
    months = Window.partitionBy("menu_item").orderBy("month")   # at most one row per month
    return (established.withColumn("_prev", F.lag("price").over(months))
            .where(~F.col("_prev").eqNullSafe(F.col("price"))).drop("_prev"))


def price_versions(counts: DataFrame) -> DataFrame:
    """Dated versions per item.

    The first version goes back to the item's first appearance; a later one starts with the
    first clean sale at its price. The end is the next start, taken before versions that
    begin and end on one service day are dropped, so the later of the two stays.
    """
    seen = counts.groupBy("menu_item").agg(F.min("first_any").alias("first_seen"))
    starts = price_changes(established_prices(counts)).select("menu_item", "price", "first_sale")
    by_start = Window.partitionBy("menu_item").orderBy("first_sale")
    changed = starts.join(seen, "menu_item").select(
        "menu_item", "price",
        F.when(F.row_number().over(by_start) == 1, F.col("first_seen"))
        .otherwise(F.col("first_sale")).alias("start"))
    steady = (seen.join(starts.select("menu_item").distinct(), "menu_item", "left_anti")
              .join(overall_prices(counts), "menu_item", "left")
              .select("menu_item", "price", F.col("first_seen").alias("start")))
    by_version = Window.partitionBy("menu_item").orderBy("start")
    return (changed.unionByName(steady)
            .select("menu_item", F.col("price").alias("list_price"),
                    calendar.service_date(F.col("start")).alias("valid_from"),
                    calendar.service_date(F.lead("start").over(by_version)).alias("valid_to"))
            .where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))


def version_months(menu_items: DataFrame, last: Column) -> DataFrame:
    """Price versions once per calendar month they touch, up to the month of the last change.

    Joining on item and month keeps the candidates of a sale to the versions of its month,
    and parts the sales of a much-sold item by month.
    """
    end = F.coalesce(F.date_sub("valid_to", 1), last)
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return menu_items.withColumn("_month", F.explode(months))


def price_in_force(items: DataFrame, menu_items: DataFrame, carry: tuple[str, ...] = ("menu_item_key", "list_price")
                   ) -> DataFrame:
    """Each sale with the price version of its item on its service day (``sday``, else that of ``sent_at``)."""
    last = menu_items.agg(F.max("valid_from")).scalar()
    version = version_months(menu_items, last).select(
        F.col("menu_item").alias("_item"), "_month", *carry, "valid_from", "valid_to")
    # after the last change only open versions are left, and all of them reach its month
    dated = items if "sday" in items.columns else items.withColumn("sday", calendar.service_date(F.col("sent_at")))
    dated = dated.withColumn("_sold", F.trunc(F.least(F.col("sday"), last), "month"))
    return dated.join(
        version, (F.col("menu_item") == F.col("_item")) & (F.col("_sold") == F.col("_month"))
        & in_force(F.col("sday"), F.col("valid_from"), F.col("valid_to"))
    ).drop("_item", "_month", "_sold", "valid_from", "valid_to")


def describe_versions(versions: DataFrame, daily: DataFrame) -> DataFrame:
    """Most frequent group, menu and category during each version; ties go to the smallest."""
    attributes = ATTRIBUTES
    key = ["menu_item", "valid_from"]
    dated = versions.withColumn("_since", F.col("valid_from"))
    during = (price_in_force(daily, dated, ("_since",))
              .groupBy("menu_item", F.col("_since").alias("valid_from"), *attributes)
              .agg(F.sum("sales").alias("n")))
    long = during.select(*key, "n", F.explode(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])).alias("x"))
    counted = (long.where("x.value is not null").groupBy(*key, "x.attribute", "x.value")
               .agg(F.sum("n").alias("n")))
    return counted.groupBy(*key).agg(*[_most_frequent(a) for a in attributes])


def _most_frequent(attribute: str) -> Column:
    # min_by passes over rows whose ordering value is NULL, here the other attributes
    rank = F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))
    return F.min_by("value", F.when(F.col("attribute") == attribute, rank)).alias(attribute)


def menu_item_dimension(items: DataFrame) -> DataFrame:
    """The price-version dimension, keyed 1..n by item and start."""
    daily = materialize(daily_sales(items))
    versions = materialize(price_versions(counts_of_days(daily)))
    described = versions.join(describe_versions(versions, daily), ["menu_item", "valid_from"], "left")
    rows = described.select("menu_item", "menu_group", "menu", "sales_category", "list_price",
                            "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))
    return number_rows(rows, [F.col("menu_item"), F.col("valid_from")], "menu_item_key")
