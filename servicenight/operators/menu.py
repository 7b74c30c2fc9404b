"""Menu mix: what sells, what changed price, why spend per guest moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from servicenight import rules
from servicenight.functions import measures

NO_CATEGORY = "(none)"


def item_sales(item_facts: DataFrame, menu_items: DataFrame, dates: DataFrame) -> DataFrame:
    """Sales that were not voided, inside the calendar, with their menu attributes and date."""
    menu = menu_items.select("menu_item_key", "menu_item", "menu_group", "menu", "sales_category", "list_price")
    facts = item_facts.where(~F.col("is_void")).select(
        "item_selection_id", "order_id", "date_key", "menu_item_key", "qty", "net_price", "gross_price")
    return (facts.join(menu, "menu_item_key").join(dates.select("date_key", "service_date"), "date_key")
            .withColumn("sales_category", F.coalesce("sales_category", F.lit(NO_CATEGORY))))


def with_order_context(sales: DataFrame, order_facts: DataFrame) -> DataFrame:
    """Order type and guests beside each sale, for the reports that ask who sat there."""
    return sales.join(order_facts.select("order_id", "order_type", "guests", "guests_implausible"), "order_id", "left")


def sales_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(F.sum("net_price").alias("net"), F.sum("qty").alias("units"),
                     F.countDistinct("menu_item").alias("items"))


def _with_share(sums: DataFrame, total) -> DataFrame:
    return sums.withColumns({
        "share": F.col("net").cast("double") / total,
        "per_unit": F.col("net").cast("double") / F.nullif(F.col("units").cast("double"), F.lit(0.0))})


def category_mix(sales: DataFrame) -> DataFrame:
    """Net sales, share, units and average per unit by category."""
    sums = sales.groupBy("sales_category").agg(F.sum("net_price").alias("net"), F.sum("qty").alias("units"))
    return _with_share(sums, sums.agg(F.sum("net").cast("double")).scalar())


def uncategorised_items(sales: DataFrame, limit: int = 6) -> DataFrame:
    return (sales.where(F.col("sales_category") == NO_CATEGORY).groupBy("menu_item")
            .agg(F.sum("net_price").alias("net"))
            .orderBy(F.col("net").desc(), "menu_item").limit(limit))


def top_items(sales: DataFrame, limit: int = 20) -> DataFrame:
    """Biggest items by net sales, their share, and the share of all of them together."""
    sums = sales.groupBy("menu_item", "sales_category").agg(
        F.sum("net_price").alias("net"), F.sum("qty").alias("units"))
    total = sales.agg(F.sum("net_price").cast("double")).scalar()
    top = sums.orderBy(F.col("net").desc(), "menu_item", "sales_category").limit(limit)
    combined = F.sum("net").over(Window.partitionBy()).cast("double")   # over ``limit`` rows
    return _with_share(top, total).withColumn("combined_share", combined / total)


def seated_guest_sales(sales: DataFrame) -> DataFrame:
    """Seated sales with a believable guest count; an unknown flag counts as implausible."""
    return sales.where((F.col("order_type") == "Seated") & (F.col("guests") > 0)
                       & ~F.coalesce(F.col("guests_implausible"), F.lit(True)))


def seated_guest_orders(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("order_type") == "Seated") & (F.col("amount") > 0)
                       & ~F.col("guests_implausible") & (F.col("guests") > 0))


def per_guest_rates(sales: DataFrame, facts: DataFrame, dates: DataFrame,
                    years: tuple[int, int] = rules.COMPARED_YEARS,
                    months: list[int] = rules.COMPARED_MONTHS) -> DataFrame:
    """Spend, items, drinks and food per seated guest in the compared months of each year."""
    day = F.col("service_date")
    chosen = F.year(day).isin(*years) & F.month(day).isin(*months)
    orders = (seated_guest_orders(facts).join(dates.select("date_key", "service_date"), "date_key")
              .where(chosen).groupBy(F.year(day).alias("year"))
              .agg(F.sum("guests").alias("guests"), F.sum("amount").cast("double").alias("amount")))
    drink = F.col("sales_category").isin(rules.DRINK_CATEGORIES)
    food = F.col("sales_category") == rules.FOOD_CATEGORY
    units = lambda when: F.coalesce(F.sum(F.when(when, F.col("qty"))), F.lit(0)).cast("double")
    items = seated_guest_sales(sales).where(chosen).groupBy(F.year(day).alias("year")).agg(
        F.sum("qty").cast("double").alias("units"), F.sum("net_price").cast("double").alias("net"),
        units(drink).alias("drinks"), units(food).alias("food"))
    return orders.join(items, "year").select(
        "year", "guests", (F.col("amount") / F.col("guests")).alias("spend_per_guest"),
        (F.col("units") / F.col("guests")).alias("items_per_guest"),
        (F.col("drinks") / F.col("guests")).alias("drinks_per_guest"),
        (F.col("food") / F.col("guests")).alias("food_per_guest"),
        (F.col("net") / F.col("units")).alias("net_per_item"))


def both_periods(sales: DataFrame, years: tuple[int, int] = rules.COMPARED_YEARS,
                 months: list[int] = rules.COMPARED_MONTHS, min_units: int = 20) -> DataFrame:
    """Items sold in both years' compared months in sufficient units, one row each."""
    day = F.col("service_date")
    seated = seated_guest_sales(sales).where(F.month(day).isin(*months))
    sums = []
    for tag, year in zip(("base", "new"), years):
        of_year = F.year(day) == year
        sums += [F.sum(F.when(of_year, F.col("qty"))).cast("double").alias(f"units_{tag}"),
                 F.sum(F.when(of_year, F.col("net_price"))).cast("double").alias(f"net_{tag}")]
    return seated.where(F.year(day).isin(*years)).groupBy("menu_item").agg(*sums).where(
        (F.col("units_base") >= min_units) & (F.col("units_new") >= min_units))


def like_for_like(sales: DataFrame, years: tuple[int, int] = rules.COMPARED_YEARS,
                  months: list[int] = rules.COMPARED_MONTHS, min_units: int = 20) -> DataFrame:
    """Price index over items sold in both periods, weighted by base-period units."""
    day = F.col("service_date")
    common = both_periods(sales, years, months, min_units)
    base_net = seated_guest_sales(sales).where(
        (F.year(day) == years[0]) & F.month(day).isin(*months)
    ).agg(F.sum("net_price").cast("double")).scalar()
    new_price = F.col("net_new") / F.col("units_new")
    return common.agg(
        F.count(F.lit(1)).alias("items"), F.sum("net_base").alias("base_net"),
        (F.sum(new_price * F.col("units_base")) / F.sum("net_base") - 1).alias("price_change"),
    ).withColumn("share_of_base", F.col("base_net") / base_net)


def price_steps(menu_items: DataFrame) -> DataFrame:
    """Consecutive list prices of one item (an item has few versions)."""
    versions = Window.partitionBy("menu_item").orderBy("valid_from")
    stepped = menu_items.withColumn("prev_price", F.lag("list_price").over(versions))
    return stepped.where(F.col("prev_price").isNotNull() & F.col("list_price").isNotNull()).select(
        "menu_item", "valid_from", "prev_price", "list_price",
        (F.col("list_price").cast("double") / F.col("prev_price").cast("double") - 1).alias("change"))


def price_step_summary(steps: DataFrame) -> DataFrame:
    """Changes, items, ups and downs, and how many are the tax switch of June 2025."""
    switched = ((F.col("valid_from") <= F.lit(rules.TAX_SWITCH_UNTIL))
                & measures.close_to(F.col("prev_price").cast("double") * rules.TAX_SWITCH_FACTOR,
                                    F.col("list_price").cast("double"), 0.02))
    return steps.agg(
        F.count(F.lit(1)).alias("changes"), F.countDistinct("menu_item").alias("items"),
        F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") < 0).alias("down"),
        F.count_if(switched).alias("tax_switch"))


def big_seller_steps(steps: DataFrame, sales: DataFrame, min_units: int = 200, limit: int = 25) -> DataFrame:
    """Price changes of items that sold enough, biggest sellers first."""
    units = sales.groupBy("menu_item").agg(F.sum("qty").alias("units"))
    return (steps.join(units.where(F.col("units") >= min_units), "menu_item")
            .orderBy(F.col("units").desc(), "menu_item", "valid_from").limit(limit))
