"""Data-quality checks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from servicenight import rules
from servicenight.operators import checks, floorplan, merge, occupancy, prices, staging
from servicenight.plans import frames, standins as S, upsert  # noqa: F401  (defines the pull tables)
from servicenight.plans.registry import query
from servicenight.plans.sql_base import b, f, i, sql
from servicenight.plans.service import _BLOCKS
from servicenight.session import small_table


@query("check_unique_ids", sql(f"""
SELECT {i('count(*)', 'rows')}, {i('count(DISTINCT order_id)', 'ids')}, {i('count(DISTINCT order_id)', 'raw_ids')} FROM v_orders"""))
def check_unique_ids(spark, sf):
    """One staged row per id, every raw id covered."""
    raw = S.raw_orders(spark, sf)
    return checks.unique_and_complete(raw, "Order Id", staging.stage_orders(raw), "order_id")


@query("check_clocks", sql(f"SELECT {i('0', 'opened_missing')}, {i('0', 'closed_unparsed')}"))
def check_clocks(spark, sf):
    """Every timestamp parses."""
    raw = S.raw_orders(spark, sf)
    return checks.unparsed_clocks(staging.stage_orders(raw), raw)


@query("check_broken_clocks", sql(f"""
SELECT {i('count(*) FILTER (WHERE order_id % 77 = 0)', 'opened_missing')},
  {i('count(*) FILTER (WHERE order_id % 91 = 0 AND closed_at IS NOT NULL)', 'closed_unparsed')} FROM v_orders"""))
def check_broken_clocks(spark, sf):
    """The same check where some exports wrote clocks in another form."""
    key = F.col("`Order Id`").cast("bigint")
    raw = S.raw_orders(spark, sf).withColumns({
        "Opened": F.when(key % 77 == 0, F.lit("2026-01-05 19:00")).otherwise(F.col("Opened")),
        "Closed": F.when((key % 91 == 0) & (F.col("Closed") != ""), F.lit("later")).otherwise(F.col("Closed"))})
    return checks.unparsed_clocks(staging.stage_orders(raw), raw)


@query("check_item_reconciliation", sql(f"""
SELECT {i('count(*)', 'compared')}, {i('count(*) FILTER (WHERE amount_c <> items)', 'mismatches')} FROM v_orders
JOIN (SELECT order_id, sum(net_c) AS items FROM v_items WHERE NOT is_void GROUP BY order_id) USING (order_id)"""))
def check_item_reconciliation(spark, sf):
    """Item net prices against the order's amount."""
    return checks.item_reconciliation(S.orders(spark, sf), S.items(spark, sf))


@query("check_totals", sql(f"""
SELECT {i('count(*)', 'orders')}, {i('count(*) FILTER (WHERE amount_c + tax_c + tip_c + gratuity_c <> total_c)', 'wrong')}
FROM v_orders"""))
def check_totals(spark, sf):
    """Total = amount + tax + tip + gratuity."""
    return checks.total_identity(S.orders(spark, sf))


@query("check_placement", sql(f"SELECT seating_fit, {i('count(*)', 'orders')} FROM v_placed GROUP BY seating_fit"))
def check_placement(spark, sf):
    """Every order placed once; unknown tables show."""
    return checks.placement_counts(frames.placed_orders(spark, sf))


@query("check_facts_complete", sql(f"""
SELECT {i('count(*)', 'fact_rows')}, {f('sum(amount_c) / 100.0', 'fact_amount')},
  {i('(SELECT count(*) FROM v_orders)', 'staged_rows')}, {f('(SELECT sum(amount_c) FROM v_orders) / 100.0', 'staged_amount')}
FROM v_fact"""))
def check_facts_complete(spark, sf):
    """Facts keep every row and dollar."""
    return checks.facts_keep_everything(S.orders(spark, sf), frames.order_facts(spark, sf), "amount")


@query("check_versions", sql(f"""
SELECT {i('count(*)', 'versions')}, {i('count(*) FILTER (WHERE valid_to IS DISTINCT FROM following)', 'broken')}
FROM (SELECT *, lead(valid_from) OVER (PARTITION BY menu_item ORDER BY valid_from) AS following FROM p_versions)"""))
def check_versions(spark, sf):
    """Price versions are contiguous."""
    return checks.broken_versions(prices.price_versions(prices.stored_price_counts(S.items(spark, sf))))


@query("check_sales_covered", sql(f"""
SELECT {i('(SELECT count(*) FROM v_items)', 'sales')}, {i('(SELECT count(*) FROM v_items) - count(*)', 'uncovered')}
FROM v_item_fact"""))
def check_sales_covered(spark, sf):
    """Every sale has a price version."""
    facts = frames.item_facts(spark, sf, frames.menu_items(spark, sf))
    return checks.uncovered_sales(S.items(spark, sf), facts)


@query("check_dates", sql(f"""
SELECT {i('count(*)', 'undated')} FROM v_fact WHERE date_key NOT IN (SELECT date_key FROM v_dates)"""))
def check_dates(spark, sf):
    """Every service day is in the calendar."""
    return checks.undated_facts(frames.order_facts(spark, sf), frames.dates(spark, sf))


@query("check_units", sql(f"""
SELECT seating_fit, {i('count(*)', 'orders')} FROM v_fact
WHERE table_code IS NOT NULL AND section <> 'Bar' AND seating_unit_key IS NULL GROUP BY seating_fit"""))
def check_units(spark, sf):
    """Tabled orders outside the bar without a unit: only tables the plan does not know."""
    return checks.facts_without_unit(frames.order_facts(spark, sf))


@query("check_section_seats", sql(f"""
SELECT section, {i('sum(seats)', 'seats')}, {i('count(*)', 'units')}, {i('sum(codes)', 'tables')},
  {i('max(expected)', 'expected')}, {b('sum(seats) = max(expected)', 'ok')}, {i('sum(visits)', 'visits')}
FROM (SELECT CASE WHEN code LIKE 'BD%' THEN 'Black Duck' WHEN code LIKE 'B%' THEN 'Bar' WHEN code LIKE 'E%' THEN 'Evangeline' ELSE 'Open Lounge' END AS section,
        seating_unit, max(u.unit_capacity) AS seats, count(s.capacity_max) AS codes, sum(coalesce(v.n, 0)) AS visits,
        CASE section WHEN 'Open Lounge' THEN 22 WHEN 'Black Duck' THEN 14 WHEN 'Evangeline' THEN 10 WHEN 'Bar' THEN 12 END AS expected
      FROM units u LEFT JOIN solo s USING (code)
      LEFT JOIN (SELECT table_code AS code, count(*) AS n FROM t_clean GROUP BY table_code) v USING (code)
      GROUP BY section, seating_unit) GROUP BY section"""))
def check_section_seats(spark, sf):
    """Seats, units and tables per section of the whole unit map against the known totals, and its visits."""
    units = floorplan.unit_dimension(spark)
    visits = frames.cleaned(spark, sf).join(units, F.col("table_code") == F.col("code")).groupBy("unit_section").agg(
        F.count(F.lit(1)).alias("visits"))
    return checks.section_seat_totals(units).join(visits, F.col("section") == F.col("unit_section"), "left").drop(
        "unit_section").fillna(0, ["visits"])


@query("check_one_unit_per_code", sql(f"""
SELECT code, {i('count(DISTINCT seating_unit)', 'units')} FROM (
  SELECT table_code AS code, seating_unit FROM t_clean WHERE table_code IS NOT NULL
  UNION ALL SELECT code, seating_unit FROM solo LEFT JOIN units USING (code))
GROUP BY code HAVING count(DISTINCT seating_unit) <> 1"""))
def check_one_unit_per_code(spark, sf):
    """Codes in use or with a capacity that do not belong to exactly one unit."""
    units = floorplan.unit_dimension(spark)
    known = small_table(spark, [(code,) for code, _, _ in rules.SOLO_CAPACITY], "table_code string")
    used = frames.cleaned(spark, sf).where("table_code is not null").select("table_code").union(known).distinct()
    rows = used.join(units, F.col("code") == F.col("table_code"), "left").select(
        F.col("table_code").alias("code"), "seating_unit")
    return checks.codes_in_several_units(rows)


@query("check_cutoff", sql(f"""
SELECT {i("count(*) FILTER (WHERE service_dow = 'Monday')", 'monday_rows')},
  {i("count(*) FILTER (WHERE service_dow = 'Monday' AND order_type = 'Seated')", 'monday_seated')},
  {i('count(*) FILTER (WHERE hour(opened_at) IN (3, 4))', 'near_cutoff')} FROM t_clean"""))
def check_cutoff(spark, sf):
    """Trade at the day boundary and on the closed weekday."""
    return checks.cutoff_and_closed_day(frames.cleaned(spark, sf))


@query("check_order_types", sql(f"""
SELECT {i('count(*)', 'orders')}, {i("count(*) FILTER (WHERE order_type NOT IN ('Seated', 'Event-Catering', 'To-Go'))", 'unknown')}
FROM t_clean"""))
def check_order_types(spark, sf):
    """Every order has one of three types."""
    return checks.order_types_known(frames.cleaned(spark, sf))


@query("check_room", sql(f"""
SELECT {i('max(tables_occupied)', 'peak')}, {i(f'count(*) FILTER (WHERE tables_occupied > {rules.RESERVATION_TABLES})', 'over_floor')}
FROM t_room"""))
def check_room(spark, sf):
    """Never more tables taken than there are."""
    return checks.room_within_floor(frames.room(spark, sf))


@query("check_spans", sql(f"""
SELECT {i('count(*) FILTER (WHERE n >= 2 AND NOT overlap)', 'clean_table_nights')},
  {i('count(*) FILTER (WHERE n >= 2 AND overlap)', 'overlap_nights')},
  {i('count(*) FILTER (WHERE n >= 2 AND NOT overlap AND abs(span - used) >= 0.01)', 'unreconciled')}
FROM (SELECT count(*) AS n, bool_or(turn_overlap) AS overlap,
        date_diff('second', min(opened_at), max(paid_at)) / 60.0::DOUBLE AS span,
        sum(seconds) / 60.0::DOUBLE + coalesce(sum(turn_gap), 0) AS used
      FROM t_res GROUP BY service_date, table_code)"""))
def check_spans(spark, sf):
    """Occupied plus gap time fills each clean table-night."""
    return checks.span_reconciliation(frames.reserved_turns(spark, sf))


@query("check_gaps", sql(f"""
SELECT {i('count(turn_gap)', 'gaps')}, {f('min(turn_gap)', 'least')}, {i('count(*) FILTER (WHERE turn_gap < 0)', 'negative')}
FROM t_turns"""))
def check_gaps(spark, sf):
    """No negative gap survives."""
    return checks.negative_gaps(frames.turned(spark, sf))


@query("check_merge", sql(f"""
SELECT {i('(SELECT count(*) FROM u_merged)', 'merged_rows')},
  {i('count(DISTINCT (k_opened, k_table, k_guests, occurrence))', 'identities')}, {i('0', 'lost')},
  {f("""(SELECT max(abs(m - o)) / 100.0 FROM (SELECT CAST(opened - INTERVAL 4 HOUR AS DATE) AS day, min(source_file) AS source_file,
      sum(amount_c) AS m FROM u_merged GROUP BY 1 HAVING count(DISTINCT source_file) = 1)
    JOIN (SELECT CAST(opened - INTERVAL 4 HOUR AS DATE) AS day, source_file, sum(amount_c) AS o FROM u_pulls GROUP BY 1, 2)
    USING (day, source_file))""", 'worst_drift')} FROM u_pulls"""))
def check_merge(spark, sf):
    """The merge loses no order and no dollar."""
    rows = frames.pulls(spark, sf)
    return checks.merge_is_lossless(rows, merge.merge_pulls(rows))


@query("check_blocks", sql(f"""
SELECT section, {f('median_block')}, {f('median_night')}, {b('median_block <= median_night', 'ok')} FROM
  (SELECT section, median(best_block) AS median_block FROM {_BLOCKS} AS k GROUP BY section)
JOIN (SELECT section, median(revenue) AS median_night FROM (SELECT section, service_date, sum(amount_c) / 100.0::DOUBLE AS revenue
      FROM t_seated GROUP BY ALL) GROUP BY section) USING (section)"""))
def check_blocks(spark, sf):
    """A three-hour block never beats the whole night."""
    return checks.block_within_night(occupancy.best_blocks(frames.timeline(spark, sf)), frames.seated(spark, sf))


@query("check_hour_split", sql(f"""
SELECT section, {f('sum(recorded) / 100.0', 'recorded')}, {f('round(sum(split), 6)', 'split')} FROM (
  SELECT section, sum(amount_c) AS recorded, 0 AS split FROM t_seated
  WHERE order_type = 'Seated' AND seconds <= 21600 GROUP BY section
  UNION ALL SELECT section, 0, sum(slot_revenue) FROM t_occ GROUP BY section) GROUP BY section"""))
def check_hour_split(spark, sf):
    """Slot-spread revenue equals recorded revenue of stays up to six hours, per section."""
    recorded = occupancy.stay_slots(frames.seated(spark, sf)).groupBy("section").agg(
        F.sum("amount").alias("recorded"))
    split = frames.timeline(spark, sf).groupBy("section").agg(F.round(F.sum("slot_revenue"), 6).alias("split"))
    return recorded.join(split, "section")
