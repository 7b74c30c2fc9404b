"""Queries on item selections: price history, item facts and the menu mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from servicenight import rules
from servicenight.functions import calendar
from servicenight.operators import intervals, menu, prices
from servicenight.plans import frames, standins as S
from servicenight.plans.registry import ORACLES, query
from servicenight.plans.sql_base import FORCE, b, d, f, i, quoted, sql, t


@query("established_prices", sql(f"""
SELECT menu_item, {d('month')}, {f('price_c / 100.0', 'price')}, {t('first_sale')} FROM p_established"""))
def established_prices(spark, sf):
    """Months in which one price dominates an item's clean sales."""
    return prices.established_prices(prices.price_counts(S.items(spark, sf)))


@query("overall_prices", sql(f"SELECT menu_item, {f('price_c / 100.0', 'price')} FROM p_overall"))
def overall_prices(spark, sf):
    """Items with one dominant price over their whole history."""
    return prices.overall_prices(prices.price_counts(S.items(spark, sf)))


@query("price_changes", sql(f"""
SELECT menu_item, {d('month')}, {f('price_c / 100.0', 'price')}, {t('first_sale')} FROM p_changes"""))
def price_changes(spark, sf):
    """Established months whose price differs from the one before."""
    return prices.price_changes(prices.established_prices(prices.price_counts(S.items(spark, sf))))


@query("price_versions", sql(f"""
SELECT menu_item, {f('price_c / 100.0', 'list_price')}, {d('valid_from')}, {d('valid_to')} FROM p_versions"""))
def price_versions(spark, sf):
    """Dated price versions per item."""
    return prices.price_versions(prices.stored_price_counts(S.items(spark, sf)))


@query("menu_item_dimension", sql(f"""
SELECT {i('menu_item_key')}, menu_item, menu_group, menu, sales_category,
  {f('price_c / 100.0', 'list_price')}, {d('valid_from')}, {d('valid_to')}, {b('is_current')} FROM dim_item"""))
def menu_item_dimension(spark, sf):
    """The Type 2 menu dimension, keyed in a fixed order."""
    return frames.menu_items(spark, sf)


@query("price_in_force", sql(f"""
SELECT {i('i.item_selection_id', 'item_selection_id')}, i.menu_item, {d('i.sday', 'sday')},
  {f('i.price_c / 100.0', 'gross_price')}, {f('v.price_c / 100.0', 'list_price')}, {d('v.valid_from', 'since')}
FROM v_items i JOIN p_versions v ON v.menu_item = i.menu_item AND {FORCE.format(day='i.sday', p='v')}"""))
def price_in_force(spark, sf):
    """Each sale with the list price of its item that day."""
    items = S.items(spark, sf)
    versions = prices.price_versions(prices.stored_price_counts(items)).withColumn("since", F.col("valid_from"))
    return prices.price_in_force(items, versions, ("list_price", "since")).select(
        "item_selection_id", "menu_item", "sday", "gross_price", "list_price", "since")


@query("price_in_force_swept", ORACLES["price_in_force"])
def price_in_force_swept(spark, sf):
    """The same by a sweep over sales and price versions, as if both were large."""
    items = S.items(spark, sf)
    versions = prices.price_versions(prices.stored_price_counts(items)).withColumnRenamed("menu_item", "_item")
    dated = items.withColumn("sday", calendar.service_date(F.col("sent_at")))
    joined = intervals.interval_join(dated, versions, [("menu_item", "_item")], "sday", "valid_from", "valid_to")
    return joined.select("item_selection_id", "menu_item", "sday", "gross_price", "list_price", F.col("valid_from").alias("since"))


@query("item_facts", sql(f"""
SELECT {i('item_selection_id')}, {i('order_id')}, {i('check_id')}, {i('date_key')}, {i('menu_item_key')},
  {t('sent_at')}, {f('round(after_seconds / 60.0::DOUBLE, 1)', 'minutes_after_open')}, {f('halves / 2.0', 'qty')},
  {f('price_c / 100.0', 'gross_price')}, {f('discount_c / 100.0', 'discount')},
  {f('net_c / 100.0', 'net_price')}, {b('is_void')} FROM v_item_fact"""))
def item_facts(spark, sf):
    """One row per item selection with its price version and its order's opening."""
    return frames.item_facts(spark, sf, frames.menu_items(spark, sf))


@query("item_sales_totals", sql(f"""
SELECT {f('sum(net_c) / 100.0', 'net')}, {f('sum(halves) / 2.0', 'units')},
  {i('count(DISTINCT menu_item)', 'items')} FROM v_year_sales"""))
def item_sales_totals(spark, sf):
    """Net sales, units and distinct items of the latest year."""
    return menu.sales_totals(frames.sales(spark, sf, days=rules.REPORT_YEAR))


_MIX = (f"{f('net / 100.0', 'net')}, {f('halves / 2.0', 'units')}, "
        f"{f('net / 100.0::DOUBLE / (total / 100.0::DOUBLE)', 'share')}, "
        f"{f('net / 100.0::DOUBLE / (halves / 2.0::DOUBLE)', 'per_unit')}")


@query("category_mix", sql(f"""
SELECT sales_category, {_MIX} FROM (SELECT sales_category, sum(net_c) AS net, sum(halves) AS halves,
  (SELECT sum(net_c) FROM v_year_sales) AS total FROM v_year_sales GROUP BY sales_category)"""))
def category_mix(spark, sf):
    """Net sales, share and average per unit by category."""
    return menu.category_mix(frames.sales(spark, sf, days=rules.REPORT_YEAR))


@query("uncategorised_items", sql(f"""
SELECT menu_item, {f('sum(net_c) / 100.0', 'net')} FROM v_year_sales WHERE sales_category = '(none)'
GROUP BY menu_item ORDER BY sum(net_c) DESC, menu_item LIMIT 6"""))
def uncategorised_items(spark, sf):
    """Largest items without a sales category."""
    return menu.uncategorised_items(frames.sales(spark, sf, days=rules.REPORT_YEAR))


@query("top_items", sql(f"""
SELECT menu_item, sales_category, {_MIX},
  {f('sum(net) OVER () / 100.0::DOUBLE / (total / 100.0::DOUBLE)', 'combined_share')} FROM (
  SELECT menu_item, sales_category, sum(net_c) AS net, sum(halves) AS halves,
    (SELECT sum(net_c) FROM v_year_sales) AS total
  FROM v_year_sales GROUP BY menu_item, sales_category ORDER BY net DESC, menu_item, sales_category LIMIT 20)"""))
def top_items(spark, sf):
    """The twenty biggest items by net sales."""
    return menu.top_items(frames.sales(spark, sf, days=rules.REPORT_YEAR))


@query("per_guest_rates", sql(f"""
SELECT {i('year')}, {i('guests')}, {f('amount / 100.0::DOUBLE / guests', 'spend_per_guest')},
  {f('halves / 2.0::DOUBLE / guests', 'items_per_guest')},
  {f('drinks / 2.0::DOUBLE / guests', 'drinks_per_guest')}, {f('food / 2.0::DOUBLE / guests', 'food_per_guest')},
  {f('net / 100.0::DOUBLE / (halves / 2.0::DOUBLE)', 'net_per_item')}
FROM (SELECT year(service_date) AS year, sum(guests) AS guests, sum(amount_c) AS amount FROM v_fact
      WHERE order_type = 'Seated' AND amount_c > 0 AND NOT guests_implausible AND guests > 0
        AND year(service_date) IN (2025, 2026) AND month(service_date) BETWEEN 5 AND 9 GROUP BY 1)
JOIN (SELECT year(service_date) AS year, sum(halves) AS halves, sum(net_c) AS net,
        coalesce(sum(halves) FILTER (WHERE sales_category IN ({quoted(rules.DRINK_CATEGORIES)})), 0) AS drinks,
        coalesce(sum(halves) FILTER (WHERE sales_category = 'Food'), 0) AS food
      FROM v_guest_sales WHERE year(service_date) IN (2025, 2026) GROUP BY 1) USING (year)"""))
def per_guest_rates(spark, sf):
    """Spend, items, drinks and food per seated guest in both summers."""
    return menu.per_guest_rates(frames.guest_sales(spark, sf), frames.order_facts(spark, sf), frames.dates(spark, sf))


_BOTH = """(SELECT menu_item, sum(halves) FILTER (WHERE y = 2025) / 2.0::DOUBLE AS u25,
  sum(halves) FILTER (WHERE y = 2026) / 2.0::DOUBLE AS u26,
  sum(net_c) FILTER (WHERE y = 2025) / 100.0::DOUBLE AS n25, sum(net_c) FILTER (WHERE y = 2026) / 100.0::DOUBLE AS n26
  FROM (SELECT *, year(service_date) AS y FROM v_guest_sales) GROUP BY menu_item)"""


@query("items_in_both_periods", sql(f"""
SELECT menu_item, {f('u25', 'units_base')}, {f('n25', 'net_base')}, {f('u26', 'units_new')}, {f('n26', 'net_new')}
FROM {_BOTH} WHERE u25 >= 20 AND u26 >= 20"""))
def items_in_both_periods(spark, sf):
    """Items that sold enough in the compared months of both years."""
    return menu.both_periods(frames.guest_sales(spark, sf))


@query("like_for_like_prices", sql(f"""
SELECT {i('count(*)', 'items')}, {f('sum(n25)', 'base_net')},
  {f('sum(n26 / u26 * u25) / sum(n25) - 1', 'price_change')},
  {f('sum(n25) / (SELECT sum(net_c) / 100.0::DOUBLE FROM v_guest_sales WHERE year(service_date) = 2025)', 'share_of_base')}
FROM {_BOTH} WHERE u25 >= 20 AND u26 >= 20"""))
def like_for_like_prices(spark, sf):
    """Price index over items sold in both summers, weighted by base units."""
    return menu.like_for_like(frames.guest_sales(spark, sf))


_STEPS = """(SELECT menu_item, valid_from, price_c,
  lag(price_c) OVER (PARTITION BY menu_item ORDER BY valid_from) AS prev_c FROM p_versions)"""
_STEP = f"""menu_item, {d('valid_from')}, {f('prev_c / 100.0', 'prev_price')}, {f('price_c / 100.0', 'list_price')},
  {f('(price_c / 100.0::DOUBLE) / (prev_c / 100.0::DOUBLE) - 1', 'change')}"""


@query("price_steps", sql(f"SELECT {_STEP} FROM {_STEPS} WHERE prev_c IS NOT NULL AND price_c IS NOT NULL"))
def price_steps(spark, sf):
    """Consecutive list prices of an item."""
    return menu.price_steps(prices.price_versions(prices.stored_price_counts(S.items(spark, sf))))


@query("price_step_summary", sql(f"""
SELECT {i('count(*)', 'changes')}, {i('count(DISTINCT menu_item)', 'items')},
  {i('count(*) FILTER (WHERE price_c > prev_c)', 'up')}, {i('count(*) FILTER (WHERE price_c < prev_c)', 'down')},
  {i(f'''count(*) FILTER (WHERE valid_from <= DATE '{rules.TAX_SWITCH_UNTIL}' AND
    abs(prev_c / 100.0::DOUBLE * {rules.TAX_SWITCH_FACTOR} - price_c / 100.0::DOUBLE) <= 0.02 + 1e-5 * price_c / 100.0::DOUBLE)''',
     'tax_switch')}
FROM {_STEPS} WHERE prev_c IS NOT NULL AND price_c IS NOT NULL"""))
def price_step_summary(spark, sf):
    """How many prices went up, down, or moved exactly with the tax switch."""
    return menu.price_step_summary(menu.price_steps(
        prices.price_versions(prices.stored_price_counts(S.items(spark, sf)))))


@query("big_seller_price_steps", sql(f"""
SELECT {_STEP}, {f('halves / 2.0', 'units')} FROM {_STEPS}
JOIN (SELECT menu_item, sum(halves) AS halves FROM v_sales GROUP BY menu_item HAVING sum(halves) >= 400) USING (menu_item)
WHERE prev_c IS NOT NULL AND price_c IS NOT NULL ORDER BY halves DESC, menu_item, valid_from LIMIT 25"""))
def big_seller_price_steps(spark, sf):
    """Price changes of the items that sold most."""
    dim = frames.menu_items(spark, sf)
    return menu.big_seller_steps(menu.price_steps(dim), frames.sales(spark, sf, dim))
