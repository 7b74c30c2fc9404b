"""Queries on visits: cleaning, turns, occupancy, rates, party economics and nights."""

from __future__ import annotations

from pyspark.sql import functions as F

from servicenight import rules
from servicenight.functions import calendar
from servicenight.operators import cleaning, floorplan, intervals, medians, occupancy, peaks, rates, regression, trend, turns
from servicenight.plans import frames, standins as S
from servicenight.plans.registry import ORACLES, query
from servicenight.session import materialize
from servicenight.plans.sql_base import RESERVED, b, d, f, i, quoted, sql, t

NT = rules.RESERVATION_TABLES
WEEKDAYS = ["Monday", *rules.TRADING_DAYS]

# --- cleaning and the per-order frame --------------------------------------------------------------

_CLEAN = f"""{i('order_id')}, {t('opened_at')}, table_code, {i('guests')}, {f('amount_c / 100.0', 'amount')},
  {i('seconds', 'duration_seconds')}, section, order_type, seating_unit, {i('unit_capacity')}, {i('capacity_min')},
  {i('capacity_max')}, {b('likely_combined')}, {b('exceeds_solo')}, {d('service_date')}, service_dow,
  {f('open_clock / 60.0::DOUBLE', 'clock_minutes')}, {f('duration')}, {t('paid_at')}"""


@query("clean_visits", sql(f"SELECT {_CLEAN} FROM t_clean"))
def clean_visits(spark, sf):
    """Cleaned visits with section, unit, capacity flags, order type and night."""
    return frames.cleaned(spark, sf)


@query("cleaning_report", sql(f"""
SELECT {i('(SELECT count(*) FROM t_raw)', 'rows_read')},
  {i('(SELECT count(*) FROM t_raw) - count(*)', 'duplicate_rows')},
  {i('count(*) FILTER (WHERE amount_c > 0 AND guests > 20)', 'implausible_guests')},
  {i("count(*) FILTER (WHERE amount_c > 0 AND guests <= 20 AND table_code = 'BD4')", 'retired_table')},
  {i("count(*) FILTER (WHERE amount_c > 0 AND guests <= 20 AND table_code IS DISTINCT FROM 'BD4')", 'kept')}
FROM (SELECT DISTINCT * FROM t_raw)"""))
def cleaning_report(spark, sf):
    """Rows each cleaning rule removes."""
    return cleaning.cleaning_report(S.visits(spark, sf))


@query("duration_floor_report", sql(f"""
SELECT section, {i('count(*)', 'before')}, {i('count(*) FILTER (WHERE seconds >= 900)', 'after')},
  {i('count(*) - count(*) FILTER (WHERE seconds >= 900)', 'dropped')},
  {f('round(100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE seconds >= 900)) / count(*), 1)', 'drop_pct')}
FROM t_clean GROUP BY section"""))
def duration_floor_report(spark, sf):
    """What the 15-minute floor removes per section."""
    return cleaning.duration_floor_report(frames.cleaned(spark, sf))


@query("opened_near_cutoff", sql(f"""
SELECT {i('order_id')}, {t('opened_at')}, {d('service_date')} FROM t_clean WHERE hour(opened_at) IN (3, 4)"""))
def opened_near_cutoff(spark, sf):
    """Visits within an hour of the service-day boundary."""
    return cleaning.near_cutoff(frames.cleaned(spark, sf)).select("order_id", "opened_at", "service_date")


@query("unit_map", sql(f"""
SELECT DISTINCT table_code, section, seating_unit, {i('unit_capacity')}, {i('capacity_min')}, {i('capacity_max')}
FROM t_clean"""))
def unit_map(spark, sf):
    """Codes in use with their unit and capacities."""
    return rates.unit_map(frames.cleaned(spark, sf))


@query("tables_without_capacity", sql(f"""
SELECT table_code, {i('count(*)', 'orders')} FROM t_clean
WHERE table_code IS NOT NULL AND capacity_max IS NULL GROUP BY table_code"""))
def tables_without_capacity(spark, sf):
    """Codes in use that have no seats on the floor plan."""
    return rates.tables_without_capacity(frames.cleaned(spark, sf), floorplan.unit_dimension(spark))


@query("order_type_share", sql(f"""
SELECT order_type, {i('count(*)', 'orders')}, {f('sum(amount_c) / 100.0', 'revenue')},
  {f('round(100.0::DOUBLE * (sum(amount_c) / 100.0::DOUBLE) / (sum(sum(amount_c)) OVER () / 100.0::DOUBLE), 1)', 'share_pct')}
FROM t_clean GROUP BY order_type"""))
def order_type_share(spark, sf):
    """Revenue share by order type."""
    return rates.order_type_share(frames.cleaned(spark, sf))


@query("excluded_revenue", sql(f"""
SELECT order_type, {i('count(*)', 'orders')}, {f('sum(amount_c) / 100.0', 'revenue')}
FROM t_clean WHERE order_type <> 'Seated' GROUP BY order_type"""))
def excluded_revenue(spark, sf):
    """Revenue left out of table figures."""
    return rates.excluded_revenue(frames.cleaned(spark, sf))


@query("masthead", sql(f"""
SELECT {d('min(service_date)', 'first_night')}, {d('max(service_date)', 'last_night')}, {i('count(*)', 'orders')},
  {i(f'count(DISTINCT service_date) FILTER (WHERE section IN ({RESERVED}) AND seconds >= 900)', 'trading_nights')},
  {f('sum(amount_c) / 100.0', 'sales')} FROM t_clean"""))
def masthead(spark, sf):
    """Period, orders, trading nights and sales."""
    return rates.masthead(frames.cleaned(spark, sf))


@query("amounts_descending", sql(f"""
SELECT {i('order_id')}, {f('amount_c / 100.0', 'amount')} FROM t_clean ORDER BY amount_c DESC, order_id"""))
def amounts_descending(spark, sf):
    """Every order by amount, largest first."""
    return rates.amounts_descending(frames.cleaned(spark, sf))


# --- turns -----------------------------------------------------------------------------------------

@query("turn_gaps", sql(f"""
SELECT {i('order_id')}, table_code, {d('service_date')}, {i('turn_index')}, {b('turn_overlap')}, {f('turn_gap')}
FROM t_turns"""))
def turn_gaps(spark, sf):
    """Minutes from one party's payment to the next party of the table that night."""
    return frames.turned(spark, sf).select(
        "order_id", "table_code", "service_date", "turn_index", "turn_overlap", "turn_gap")


_GAP = f"{i('count(*)', 'turns')}, {f('median(turn_gap)', 'median_gap')}, {f('avg(turn_gap)', 'mean_gap')}"


@query("gap_medians", sql(f"""
SELECT table_code, service_dow, {f('median(turn_gap)', 'median_gap')} FROM t_res WHERE turn_gap IS NOT NULL GROUP BY table_code, service_dow"""))
def gap_medians(spark, sf):
    """The median gap per table and weekday, selected by refining histograms."""
    return medians.median_of(materialize(frames.reserved_turns(spark, sf)), ["table_code", "service_dow"], "turn_gap", "median_gap")


@query("gap_by_weekday", sql(f"""
SELECT service_dow, {i('turns')}, {f('median_gap')}, {f('mean_gap')}, {f('turns_per_table_night')} FROM
  (SELECT service_dow, count(*) AS turns, median(turn_gap) AS median_gap, avg(turn_gap) AS mean_gap
   FROM t_res WHERE turn_gap IS NOT NULL GROUP BY service_dow)
JOIN (SELECT service_dow, avg(n) AS turns_per_table_night FROM (SELECT service_dow, count(*) AS n
      FROM t_res GROUP BY service_date, service_dow, table_code) GROUP BY service_dow) USING (service_dow)"""))
def gap_by_weekday(spark, sf):
    """Gaps per weekday and parties per table and night."""
    return turns.gap_by_weekday(frames.reserved_turns(spark, sf))


@query("gap_by_paid_hour", sql(f"""
SELECT {i('hour(paid_at)', 'paid_hour')}, {_GAP} FROM t_res WHERE turn_gap IS NOT NULL
GROUP BY hour(paid_at) HAVING count(*) >= 20"""))
def gap_by_paid_hour(spark, sf):
    """Gaps by the hour the table came free."""
    return turns.gap_by_paid_hour(frames.reserved_turns(spark, sf))


@query("gap_by_table", sql(f"""
SELECT section, table_code, {i('turns')}, {f('median_gap')}, {f('median_duration')}, {i('orders')}, {f('revenue')},
  {f('median_gap - section_median', 'vs_section')} FROM
  (SELECT section, table_code, count(turn_gap) AS turns, median(turn_gap) AS median_gap,
     median(duration) AS median_duration, count(*) AS orders, sum(amount_c) / 100.0 AS revenue
   FROM t_res GROUP BY section, table_code)
JOIN (SELECT section, median(turn_gap) AS section_median FROM t_res GROUP BY section) USING (section)
WHERE turns >= 30"""))
def gap_by_table(spark, sf):
    """Tables against their section's median gap."""
    return turns.gap_by_table(frames.reserved_turns(spark, sf))


@query("gaps_with_room_fullness", sql(f"""
SELECT {i('order_id')}, {i('slot')}, {f('turn_gap')}, {f('room_pct')}, room_fullness FROM t_bands"""))
def gaps_with_room_fullness(spark, sf):
    """Each gap with how full the room was when the table came free."""
    return frames.gaps(spark, sf).select("order_id", "slot", "turn_gap", "room_pct", "room_fullness")


@query("gap_by_fullness", sql(f"""
SELECT room_fullness, {_GAP}, {f('round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1)', 'share_pct')}
FROM t_bands WHERE room_fullness IS NOT NULL GROUP BY room_fullness"""))
def gap_by_fullness(spark, sf):
    """Gap length against room fullness."""
    return turns.gap_by_fullness(frames.gaps(spark, sf))


_PEAK = "SELECT * FROM t_gaps WHERE hour(paid_at) BETWEEN 17 AND 22"
_RESET = "(SELECT median(turn_gap) FROM t_gaps WHERE room_pct > 75)"
_OVER = "CASE WHEN turn_gap < {x} THEN 0 ELSE turn_gap - {x} END"


@query("faster_turning_value", sql(f"""
SELECT {i('scenario')}, {f('idle', 'idle_minutes')}, {f('''idle / 15 * (SELECT sum(amount_c) / 100.0::DOUBLE /
  (sum(seconds) / 900.0::DOUBLE) FROM t_res) * 2''', 'value_per_year')} FROM (
  SELECT 1 AS scenario, sum({_OVER.format(x='15')}) AS idle FROM ({_PEAK})
  UNION ALL SELECT 2, sum(CASE WHEN {_RESET} IS NOT NULL THEN {_OVER.format(x=_RESET)} END) FROM ({_PEAK})
  UNION ALL SELECT 3, coalesce(sum({_OVER.format(x=_RESET)}), 0) FROM ({_PEAK}) WHERE room_pct > 75)"""))
def faster_turning_value(spark, sf):
    """What faster turning is worth under three assumptions."""
    return turns.faster_turning_value(frames.gaps(spark, sf), frames.reserved(spark, sf))


# --- occupancy ---------------------------------------------------------------------------------------

_CLOCK = "printf('%02d:%02d', clock_minutes // 60, clock_minutes % 60)"


@query("occupancy_timeline", sql(f"""
SELECT {d('service_date')}, service_dow, table_code, section, {i('slot')}, {f('slot_revenue')}, {i('clock_minutes')},
  {_CLOCK} AS clock_label FROM t_occ"""))
def occupancy_timeline(spark, sf):
    """One row per visit and occupied quarter hour."""
    return frames.timeline(spark, sf)


@query("room_fullness", sql(f"""
SELECT {d('service_date')}, {i('slot')}, {i('tables_occupied')}, {f('room_pct')} FROM t_room"""))
def room_fullness(spark, sf):
    """Distinct reservation tables taken per night and slot."""
    return frames.room(spark, sf)


@query("room_summary", sql(f"""
SELECT {f('max(room_pct)', 'peak_pct')}, {f('median(room_pct)', 'median_pct')},
  {i(f'count(*) FILTER (WHERE tables_occupied = {NT})', 'full_slots')},
  {i('count(*) FILTER (WHERE tables_occupied >= 15)', 'nearly_full_slots')}, {i('count(*)', 'open_slots')}
FROM t_room"""))
def room_summary(spark, sf):
    """Peak, median and full slots."""
    return occupancy.room_summary(frames.room(spark, sf))


_TAKEN = f"""(SELECT service_date, minute, count(DISTINCT table_code) AS tables FROM (
  SELECT service_date, table_code, unnest(range(open_clock // 60, paid_clock // 60 + 1)) AS minute FROM t_seated
  WHERE order_type = 'Seated' AND seconds BETWEEN 0 AND 21600 AND section IN ({RESERVED})) GROUP BY service_date, minute)"""


@query("minute_peaks", sql(f"""
SELECT {d('service_date')}, {i('tables', 'peak_tables')}, {i('minute', 'peak_minute')},
  printf('%02d:%02d', minute // 60, minute % 60) AS peak_clock
FROM (SELECT *, row_number() OVER (PARTITION BY service_date ORDER BY tables DESC, minute) AS k FROM {_TAKEN}) WHERE k = 1"""))
def minute_peaks(spark, sf):
    """Most reservation tables taken at one time, per night."""
    return peaks.minute_peaks(frames.reserved(spark, sf))


@query("check_minute_peaks", sql(f"""
SELECT {i('count(*)', 'nights')}, {i(f'count(*) FILTER (WHERE peak > {NT})', 'over_floor')},
  {i('count(*) FILTER (WHERE peak > slots)', 'over_slots')}, {i('count(*) FILTER (WHERE peak < slots)', 'under_slots')}
FROM (SELECT service_date, max(tables) AS peak FROM {_TAKEN} GROUP BY service_date)
JOIN (SELECT service_date, max(tables_occupied) AS slots FROM t_room GROUP BY service_date) USING (service_date)"""))
def check_minute_peaks(spark, sf):
    """No night's peak is over the floor or over the peak of its quarter hours."""
    return peaks.against_slots(peaks.minute_peaks(frames.reserved(spark, sf)), frames.room(spark, sf), NT)


@query("utilization_by_slot", sql(f"""
SELECT service_dow, {_CLOCK} AS clock_label, {i('clock_minutes')}, {i('tables_occupied')}, {i('nights')}, {f('revenue')},
  {f(f'100.0::DOUBLE * tables_occupied / (nights * {NT})', 'utilization_pct')},
  {f(f'100.0::DOUBLE * table_nights / (nights * {NT})', 'mean_utilization_pct')},
  {f('revenue / nights', 'revenue_per_night')} FROM
  (SELECT service_dow, clock_minutes, count(DISTINCT table_code) AS tables_occupied,
     count(DISTINCT (service_date, table_code)) AS table_nights, round(sum(slot_revenue), 6) AS revenue
   FROM t_occ WHERE section IN ({RESERVED}) GROUP BY service_dow, clock_minutes)
JOIN (SELECT service_dow, count(DISTINCT service_date) AS nights FROM t_occ WHERE section IN ({RESERVED})
      GROUP BY service_dow) USING (service_dow)"""))
def utilization_by_slot(spark, sf):
    """Share of the floor taken per weekday and slot."""
    return occupancy.utilization_by_slot(frames.timeline(spark, sf), rules.RESERVATION_SECTIONS, NT)


_PEAK_SLOTS = f"slot BETWEEN {rules.PEAK_SLOTS[0]} AND {rules.PEAK_SLOTS[1]}"


@query("unit_peak_share", sql(f"""
SELECT seating_unit, {i('busy', 'busy_slots')}, {f('100.0::DOUBLE * busy / open', 'peak_pct')} FROM (
  SELECT u.seating_unit, count(DISTINCT CASE WHEN t.slot IS NOT NULL THEN (t.service_date, t.slot) END) AS busy,
    (SELECT nullif(count(DISTINCT (service_date, slot)), 0) FROM t_occ WHERE {_PEAK_SLOTS}) AS open
  FROM units u LEFT JOIN (SELECT * FROM t_occ WHERE {_PEAK_SLOTS}) t ON t.table_code = u.code GROUP BY u.seating_unit)"""))
def unit_peak_share(spark, sf):
    """How often each unit is taken between 7 and 11 PM."""
    return occupancy.unit_peak_share(frames.timeline(spark, sf), floorplan.unit_dimension(spark))


_SHAPE = """(SELECT service_dow, hour, revenue, revenue / nights AS per_night FROM
  (SELECT service_dow, clock_minutes // 60 AS hour, round(sum(slot_revenue), 6) AS revenue FROM t_occ GROUP BY ALL)
  JOIN (SELECT service_dow, count(DISTINCT service_date) AS nights FROM t_seated GROUP BY service_dow) USING (service_dow))"""


def _shape(spark, sf):
    visits = frames.seated(spark, sf)
    return occupancy.hour_shape(occupancy.build_occupancy(visits), occupancy.nights_by_weekday(visits))


@query("hour_shape", sql(f"SELECT service_dow, {i('hour')}, {f('revenue')}, {f('per_night')} FROM {_SHAPE}"))
def hour_shape(spark, sf):
    """Slot-spread revenue per weekday and clock hour."""
    return _shape(spark, sf)


@query("hour_by_weekday", sql(f"""
SELECT {i('hour')}, {', '.join(f(f"coalesce(sum(per_night) FILTER (WHERE service_dow = '{day}'), 0)", day)
  for day in rules.TRADING_DAYS)} FROM {_SHAPE} GROUP BY hour"""))
def hour_by_weekday(spark, sf):
    """Hours down, weekdays across."""
    return occupancy.pivot_hours(_shape(spark, sf))


def _at(*hours):
    return f"coalesce(sum(per_night) FILTER (WHERE hour IN ({', '.join(map(str, hours))})), 0)"


@query("edge_hours", sql(f"""
SELECT service_dow, {f(_at(16), 'opens_4pm')}, {f(_at(17), 'opens_5pm')}, {f(_at(23), 'hour_11pm')},
  {f(_at(24), 'midnight_hour')}, {f(_at(25), 'hour_1am')}, {f('sum(per_night)', 'whole_night')},
  {f(f'100.0::DOUBLE * {_at(16, 17)} / sum(per_night)', 'early_pct')},
  {f(f'100.0::DOUBLE * {_at(24, 25, 26)} / sum(per_night)', 'late_pct')}
FROM {_SHAPE} WHERE service_dow IN ({quoted(rules.TRADING_DAYS)}) GROUP BY service_dow"""))
def edge_hours(spark, sf):
    """What the first and last hours of the night earn."""
    return occupancy.edge_hours(_shape(spark, sf))


_SLOTS = """(SELECT section, service_date, service_dow, slot, sum(slot_revenue) AS revenue FROM t_occ GROUP BY ALL)"""
_BLOCKS = f"""(SELECT section, service_date, service_dow, max(total) AS best_block FROM (
  SELECT section, service_date, service_dow, sum(coalesce(revenue, 0)) OVER w AS total, count(*) OVER w AS slots
  FROM (SELECT section, service_date, service_dow, unnest(range(min(slot), max(slot) + 1)) AS slot FROM {_SLOTS} AS a
        GROUP BY section, service_date, service_dow)
  LEFT JOIN {_SLOTS} AS z USING (section, service_date, service_dow, slot)
  WINDOW w AS (PARTITION BY section, service_date ORDER BY slot ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
  WHERE slots = 12 GROUP BY ALL)"""


@query("best_blocks", sql(f"""
SELECT section, {d('service_date')}, service_dow, {f('best_block')} FROM {_BLOCKS} AS k"""))
def best_blocks(spark, sf):
    """Each section's best three hours of each night."""
    return occupancy.best_blocks(frames.timeline(spark, sf))


def _verdict(by_weekday: bool) -> str:
    extra = "service_dow, " if by_weekday else ""
    return sql(f"""
    SELECT section, {extra}{i('price')}, {i('count(*)', 'nights')}, {f('median(best_block)', 'median_block')},
      {f('max(best_block)', 'best_ever')},
      {f('100.0::DOUBLE * count(*) FILTER (WHERE best_block < price) / count(*)', 'price_wins_pct')},
      {f('price - median(best_block)', 'event_premium')}
    FROM (SELECT *, CASE section WHEN 'Black Duck' THEN 1200 WHEN 'Evangeline' THEN 900 END AS price FROM {_BLOCKS} AS k)
    WHERE price IS NOT NULL GROUP BY section, {extra}price""")


@query("event_price_verdict", _verdict(False))
def event_price_verdict(spark, sf):
    """Event prices against the best three hours of ordinary nights."""
    return occupancy.event_price_verdict(occupancy.best_blocks(frames.timeline(spark, sf)), False)


@query("event_price_by_weekday", _verdict(True))
def event_price_by_weekday(spark, sf):
    """Event prices per weekday."""
    return occupancy.event_price_verdict(occupancy.best_blocks(frames.timeline(spark, sf)), True)


@query("arrival_conflicts", sql(f"""
SELECT {i('order_id')}, {d('service_date')}, {i('open_clock // 900', 'slot')}, {i('guests')}, {f('amount_c / 100.0', 'amount')}
FROM t_res r WHERE guests BETWEEN 5 AND 6 AND EXISTS (SELECT 1 FROM t_res h WHERE h.table_code = 'E3' AND h.guests <= 4
  AND h.service_date = r.service_date AND r.open_clock // 900 BETWEEN h.open_clock // 900 AND h.paid_clock // 900)"""))
def arrival_conflicts(spark, sf):
    """Parties of five and six that arrived while the large table was held by a small one."""
    return occupancy.arrival_conflicts(frames.reserved(spark, sf), "E3", 4, (5, 6)).select(
        "order_id", "service_date", "slot", "guests", "amount")


@query("arrival_conflicts_swept", ORACLES["arrival_conflicts"])
def arrival_conflicts_swept(spark, sf):
    """The same by a sweep over arrivals and stays, without a row per slot of a stay."""
    reserved = materialize(frames.reserved(spark, sf))
    slot = lambda c: calendar.slot_of(F.col(c), F.col("service_date"))
    stays = reserved.where("table_code = 'E3' AND guests <= 4 AND paid_at IS NOT NULL").select(
        F.col("service_date").alias("_night"), slot("opened_at").alias("_from"), slot("paid_at").alias("_to"))
    arrivals = reserved.where("guests BETWEEN 5 AND 6").withColumn("slot", slot("opened_at"))
    joined = intervals.interval_join(arrivals, stays, [("service_date", "_night")], "slot", "_from", "_to", "left_semi", closed=True)
    return joined.select("order_id", "service_date", "slot", "guests", "amount")


@query("partner_free", sql(f"""
SELECT anchor, partner, {i('count(*)', 'parties')}, {i('count(*) FILTER (WHERE NOT taken)', 'free')},
  {f('100.0::DOUBLE * count(*) FILTER (WHERE NOT taken) / count(*)', 'free_pct')} FROM (
  SELECT s.table_code AS anchor, p.code AS partner, EXISTS (SELECT 1 FROM t_occ o WHERE o.table_code = p.code
    AND o.service_date = s.service_date AND o.slot = s.open_clock // 900) AS taken
  FROM t_seated s JOIN units a ON a.code = s.table_code AND a.unit_codes = 2
  JOIN units p ON p.seating_unit = a.seating_unit AND p.code <> a.code WHERE s.guests > s.capacity_max)
GROUP BY anchor, partner HAVING count(*) >= 20"""))
def partner_free(spark, sf):
    """How often a code's partner is empty when a party needs the whole unit."""
    return occupancy.partner_free(frames.seated(spark, sf), frames.timeline(spark, sf),
                                  floorplan.unit_dimension(spark))


@query("slot_split_reconciliation", sql(f"""
SELECT {f('sum(amount_c) / 100.0', 'recorded')}, {f('(SELECT sum(slot_revenue) FROM t_occ)', 'split')},
  {i('count(*) FILTER (WHERE seconds > 21600)', 'long_stays')},
  {f('coalesce(sum(amount_c) FILTER (WHERE seconds > 21600), 0) / 100.0', 'long_revenue')}
FROM t_seated WHERE order_type = 'Seated'"""))
def slot_split_reconciliation(spark, sf):
    """Slot-spread revenue against the recorded total."""
    return occupancy.slot_split_shortfall(frames.seated(spark, sf), frames.timeline(spark, sf))


# --- rates and shrinkage ---------------------------------------------------------------------------------

_RATE = f"""{f('exp(avg(ln(vpcpm)))', 'vpcpm')}, {f('avg(tpcpm)', 'mean_tpcpm')}, {i('count(*)', 'orders')},
  {b('count(*) < 10', 'thin_sample')}"""


@query("rate_by_party_size", sql(f"""
SELECT {i('guests')}, {_RATE} FROM t_rated WHERE section <> 'Unknown/To-Go' GROUP BY guests"""))
def rate_by_party_size(spark, sf):
    """Geometric mean spend per guest and quarter hour by party size."""
    return rates.rate_by_party_size(frames.rated(spark, sf).where("section <> 'Unknown/To-Go'"))


@query("rate_by_section_and_size", sql(f"SELECT section, {i('guests')}, {_RATE} FROM t_rated GROUP BY section, guests"))
def rate_by_section_and_size(spark, sf):
    """The same within every section."""
    return rates.rate_by_party_size(frames.rated(spark, sf), ["section"])


@query("bar_rates", sql(f"SELECT {i('guests')}, {_RATE} FROM t_rated WHERE section = 'Bar' GROUP BY guests"))
def bar_rates(spark, sf):
    """Spend rates at the bar by party size."""
    return rates.rate_by_party_size(frames.rated(spark, sf).where("section = 'Bar'"))


@query("table_rate_by_section", sql(f"""
SELECT section, {i('guests')}, {f('avg(tpcpm)', 'mean_tpcpm')}, {i('count(*)', 'orders')}
FROM t_rated GROUP BY section, guests"""))
def table_rate_by_section(spark, sf):
    """Mean revenue per table and quarter hour."""
    return rates.table_rate_by_section(frames.rated(spark, sf))


def _errors(value: str) -> str:
    """Leave-one-out errors row by row, as the definition says."""
    return f"""(SELECT section, k, sum((v - pred) * (v - pred)) AS error FROM (
      SELECT section, k, v, (gn - 1) / (gn - 1 + k) * (gs - v) / (gn - 1)
        + (1 - (gn - 1) / (gn - 1 + k)) * (ss - v) / (sn - 1) AS pred
      FROM (SELECT section, v, sum(v) OVER g AS gs, CAST(count(*) OVER g AS DOUBLE) AS gn,
              sum(v) OVER x AS ss, CAST(count(*) OVER x AS DOUBLE) AS sn
            FROM (SELECT section, guests, ln({value}) AS v FROM t_single)
            WINDOW g AS (PARTITION BY section, guests), x AS (PARTITION BY section)),
        (SELECT unnest([{', '.join(f'{k}.0::DOUBLE' for k in rules.SHRINKAGE_GRID)}]) AS k)
      WHERE gn > 1) GROUP BY section, k)"""


@query("shrinkage_errors", sql(f"""
SELECT section, {f('k')}, {f('error')} FROM {_errors('vpcpm')} AS e"""))
def shrinkage_errors(spark, sf):
    """Leave-one-out error of every shrinkage weight."""
    return rates.loocv_errors(rates.group_statistics(frames.single_tables(spark, sf), "log_vpcpm"))


def _best(value: str) -> str:
    return f"(SELECT section, arg_min(k, {{'e': error, 'k': k}}) AS k FROM {_errors(value)} AS e GROUP BY section)"


def _shrunk(value: str) -> str:
    return f"""(SELECT g.section, g.guests, g.n, k, exp(m) AS mean_rate,
      exp(n / (n + k) * m + k / (n + k) * sm) AS weighted_rate
      FROM (SELECT section, guests, CAST(count(*) AS DOUBLE) AS n, avg(ln({value})) AS m FROM t_single GROUP BY ALL) g
      JOIN (SELECT section, avg(ln({value})) AS sm FROM t_single GROUP BY section) USING (section)
      JOIN {_best(value)} AS w USING (section))"""


@query("shrinkage_summary", sql(f"""
SELECT section, {i('guests')}, {i('a.n', 'orders')}, {i('a.k', 'vpcpm_k')}, {i('z.k', 'tpcpm_k')},
  {f('a.mean_rate', 'mean_vpcpm')}, {f('a.weighted_rate', 'weighted_vpcpm')},
  {f('z.mean_rate', 'mean_tpcpm')}, {f('z.weighted_rate', 'weighted_tpcpm')}, {b('a.n < 10', 'thin_sample')}
FROM {_shrunk('vpcpm')} AS a JOIN {_shrunk('tpcpm')} AS z USING (section, guests)"""))
def shrinkage_summary(spark, sf):
    """Spend rates by section and party size, raw and shrunk."""
    return rates.shrinkage_summary(frames.single_tables(spark, sf))


# --- party economics ---------------------------------------------------------------------------------------

_HOURLY = f("exp(avg(ln(tpcpm))) * 4", "per_table_hour")
_STAY = f"{f('median(duration)', 'median_stay')}, {f('median(amount_c / 100.0::DOUBLE)', 'median_check')}"


@query("party_economics", sql(f"""
SELECT {i('guests')}, {i('count(*)', 'orders')}, {_STAY}, {_HOURLY} FROM t_single GROUP BY guests"""))
def party_economics(spark, sf):
    """Stay, check and revenue per table-hour by party size."""
    return rates.party_economics(frames.single_tables(spark, sf))


@query("oversized_seatings", sql(f"""
SELECT {i('count(*)', 'seatings')}, {i('count(*) FILTER (WHERE spare)', 'oversized')},
  {i('count(*) FILTER (WHERE spare AND room_pct > 75)', 'while_busy')},
  {f('100.0::DOUBLE * count(*) FILTER (WHERE spare AND room_pct > 75) / nullif(count(*) FILTER (WHERE spare), 0)', 'busy_pct')}
FROM (SELECT coalesce(capacity_max - guests >= 1, FALSE) AS spare, coalesce(room_pct, 0) AS room_pct
      FROM (SELECT *, open_clock // 900 AS slot FROM t_single) LEFT JOIN t_room USING (service_date, slot))"""))
def oversized_seatings(spark, sf):
    """Seatings with a seat to spare, and those while the room was busy."""
    return rates.oversized_seatings(frames.reserved(spark, sf), frames.room(spark, sf))


@query("large_party_share", sql(f"""
SELECT {i('count(*)', 'seatings')}, {i('count(*) FILTER (WHERE guests >= 5)', 'large')},
  {f('100.0::DOUBLE * count(*) FILTER (WHERE guests >= 5) / count(*)', 'large_pct')},
  {f('100.0::DOUBLE * (sum(amount_c) FILTER (WHERE guests >= 5) / 100.0::DOUBLE) / (sum(amount_c) / 100.0::DOUBLE)', 'large_revenue_pct')}
FROM t_res"""))
def large_party_share(spark, sf):
    """Parties of five and more: share of seatings and revenue."""
    return rates.large_party_share(frames.reserved(spark, sf))


@query("large_party_placement", sql(f"""
SELECT seating_unit, {i('count(*)', 'seatings')}, {f('median(guests)', 'median_guests')},
  {f('sum(amount_c) / 100.0', 'revenue')}, {i('count(*) FILTER (WHERE NOT likely_combined)', 'fitting')},
  {f('100.0::DOUBLE * count(*) FILTER (WHERE NOT likely_combined) / count(*)', 'fitting_pct')}
FROM t_res WHERE guests >= 5 AND seating_unit IS NOT NULL GROUP BY seating_unit"""))
def large_party_placement(spark, sf):
    """Where large parties sat and whether they fit."""
    return rates.large_party_placement(frames.reserved(spark, sf))


@query("overbooking", sql(f"""
SELECT section, {i('count(*)', 'orders')}, {i('count(*) FILTER (WHERE exceeds_solo)', 'over_code')},
  {i('count(*) FILTER (WHERE likely_combined)', 'over_unit')},
  {f('round(100.0::DOUBLE * count(*) FILTER (WHERE exceeds_solo) / count(*))', 'code_pct')},
  {f('round(100.0::DOUBLE * count(*) FILTER (WHERE likely_combined) / count(*))', 'unit_pct')}
FROM t_clean WHERE section IN ({RESERVED}) GROUP BY section"""))
def overbooking(spark, sf):
    """Parties over capacity, per code and per unit."""
    return rates.overbooking(cleaning.reservation_only(frames.cleaned(spark, sf)))


@query("combined_bookings", sql(f"""
SELECT section, {f('sum(amount_c) / 100.0', 'revenue')}, {i('count(*)', 'orders')},
  {f('median(guests)', 'median_guests')}, {i('max(guests)', 'max_guests')}
FROM t_res WHERE likely_combined GROUP BY section"""))
def combined_bookings(spark, sf):
    """Bookings that span units."""
    return rates.combined_bookings(frames.reserved(spark, sf))


@query("unit_drilldown", sql(f"""
SELECT table_code, {i('count(*)', 'parties')}, {b('bool_and(NOT likely_combined)', 'all_fit')}, {_STAY}, {_HOURLY}
FROM t_rated WHERE seating_unit = 'BD 6-top banquette' AND guests = 5 GROUP BY table_code"""))
def unit_drilldown(spark, sf):
    """Parties of five on the six-seat banquette, by anchor code."""
    return rates.unit_drilldown(frames.rated(spark, sf), "BD 6-top banquette", 5)


@query("party_mix_at_table", sql(f"""
SELECT {i('count(*)', 'seatings')}, {i('count(*) FILTER (WHERE guests >= 5)', 'large')},
  {i('count(*) FILTER (WHERE guests < 5)', 'small')} FROM t_res WHERE table_code = 'E3'"""))
def party_mix_at_table(spark, sf):
    """Large and small parties at the large table."""
    return rates.party_mix_at_table(frames.reserved(spark, sf), "E3")


_ALLOWED = "CASE guests " + " ".join(f"WHEN {g} THEN {m}" for g, m in rules.ALLOWANCE_MINUTES.items()) + " END"


@query("allowance_report", sql(f"""
SELECT {i('guests')}, {i('allowed')}, {i('count(*)', 'orders')}, {f('median(duration)', 'median_stay')},
  {f('100.0::DOUBLE * count(*) FILTER (WHERE duration > allowed) / count(*)', 'over_pct')},
  {f('median(duration) FILTER (WHERE duration > allowed) - allowed', 'median_overstay')}
FROM (SELECT *, {_ALLOWED} AS allowed FROM t_res) WHERE allowed IS NOT NULL
GROUP BY guests, allowed HAVING count(*) >= 10"""))
def allowance_report(spark, sf):
    """Stays past the allowance by party size."""
    return rates.allowance_report(frames.reserved(spark, sf))


@query("overstays_while_busy", sql(f"""
SELECT {i('count(*)', 'overstays')}, {i('count(*) FILTER (WHERE coalesce(room_pct, 0) > 75)', 'while_busy')},
  {f('median(coalesce(room_pct, 0))', 'median_room_pct')}
FROM (SELECT *, paid_clock // 900 AS slot FROM t_res WHERE duration > {_ALLOWED}) LEFT JOIN t_room USING (service_date, slot)"""))
def overstays_while_busy(spark, sf):
    """How full the room was when overstaying parties left."""
    return rates.overstays_while_busy(frames.reserved(spark, sf), frames.room(spark, sf))


_SPANS = f"""(SELECT service_date, service_dow, date_diff('second', min(opened_at), max(paid_at)) * {NT} / 60.0::DOUBLE AS available,
  sum(seconds) / 60.0::DOUBLE AS occupied FROM t_res GROUP BY ALL)"""


@query("table_time_by_weekday", sql(f"""
SELECT service_dow, {i('count(*)', 'nights')}, {f('sum(available)', 'available')}, {f('sum(occupied)', 'occupied')},
  {f('100.0::DOUBLE * sum(occupied) / sum(available)', 'sold_pct')},
  {f('(sum(available) - sum(occupied)) / count(*) / 60', 'unsold_hours_per_night')} FROM {_SPANS} AS n GROUP BY service_dow"""))
def table_time_by_weekday(spark, sf):
    """Table time sold and unsold per weekday."""
    return rates.table_time_by_weekday(rates.night_spans(frames.reserved(spark, sf)))


@query("table_time_budget", sql(f"""
SELECT {f('available')}, {f('occupied')}, {f('available - occupied', 'unsold')}, {f('gap', 'gap_minutes')},
  {f('100.0::DOUBLE * gap / (available - occupied)', 'gap_pct_of_unsold')}
FROM (SELECT sum(available) AS available, sum(occupied) AS occupied FROM {_SPANS} AS n), (SELECT sum(turn_gap) AS gap FROM t_res)"""))
def table_time_budget(spark, sf):
    """How much of the unsold table time lies between parties."""
    return rates.table_time_budget(rates.night_spans(frames.reserved(spark, sf)), frames.reserved_turns(spark, sf))


@query("monthly_parties", sql(f"""
SELECT {d('month_start')}, {i('nights')}, {i('parties')}, {f('mean_party')}, {f('revenue')},
  {f('round(parties / nights::DOUBLE, 1)', 'parties_per_night')}, {f('round(revenue / nights)', 'revenue_per_night')}
FROM (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month_start, count(DISTINCT service_date) AS nights,
  count(*) AS parties, avg(guests) AS mean_party, sum(amount_c) / 100.0::DOUBLE AS revenue FROM t_res GROUP BY 1)"""))
def monthly_parties(spark, sf):
    """Nights, parties, mean party and revenue by month."""
    return trend.monthly_parties(frames.reserved(spark, sf))


# --- nights, weather, holidays ---------------------------------------------------------------------------------

@query("visit_nights", sql(f"""
SELECT {d('service_date')}, service_dow, {f('revenue')}, {i('parties')}, {i('guests')}, {f('temp_high_f')},
  {f('temp_low_f')}, {f('precip_in')}, {f('wind_max_mph')}, holiday, {b('holiday IS NOT NULL', 'is_holiday')} FROM t_wx"""))
def visit_nights(spark, sf):
    """Seated revenue per night with weather and holiday."""
    return frames.visit_nights(spark, sf)


_WEEKEND = "service_dow IN ('Friday', 'Saturday')"


@query("weather_correlation", sql(" UNION ALL ".join(f"""
SELECT '{m}' AS measure, {f(f'corr(revenue, {m})', 'all_nights')},
  {f(f'corr(revenue, {m}) FILTER (WHERE {_WEEKEND})', 'fri_sat')} FROM t_wx"""
                                     for m in ("temp_high_f", "precip_in", "wind_max_mph"))))
def weather_correlation(spark, sf):
    """Revenue against weather."""
    return trend.weather_correlation(frames.visit_nights(spark, sf))


@query("wet_or_dry", sql(f"""
SELECT {b('coalesce(precip_in > 0.05, FALSE)', 'wet')}, {i('count(*)', 'nights')}, {f('avg(revenue)', 'mean_revenue')}
FROM t_wx WHERE {_WEEKEND} GROUP BY 1"""))
def wet_or_dry(spark, sf):
    """Wet and dry weekend nights."""
    return trend.wet_or_dry(frames.visit_nights(spark, sf))


@query("holiday_nights", sql(f"""
SELECT {d('service_date')}, service_dow, holiday, {f('revenue')}, {f('typical')}, {f('revenue - typical', 'vs_typical')}
FROM t_wx JOIN (SELECT service_dow, median(revenue) AS typical FROM t_wx GROUP BY service_dow) USING (service_dow)
WHERE holiday IS NOT NULL"""))
def holiday_nights(spark, sf):
    """Holidays against the typical night of their weekday."""
    return trend.holiday_nights(frames.visit_nights(spark, sf))


@query("untraded_holidays", sql(f"""
SELECT {d('service_date')}, holiday FROM holidays WHERE service_date NOT IN (SELECT service_date FROM t_nights)"""))
def untraded_holidays(spark, sf):
    """Holidays without a trading night."""
    return trend.untraded_holidays(trend.holidays_frame(spark), frames.visit_nights(spark, sf))


@query("untraded_saturdays", sql(f"""
SELECT {d('x', 'service_date')} FROM (
  SELECT unnest(generate_series(min(service_date), max(service_date), INTERVAL 1 DAY)) AS x FROM v_flagged)
WHERE isodow(x) = 6 AND CAST(x AS DATE) NOT IN (SELECT service_date FROM v_flagged
  WHERE table_code IS NOT NULL AND duration_usable)"""))
def untraded_saturdays(spark, sf):
    """Saturdays of the covered span without a usable seated order."""
    orders = S.orders(spark, sf)
    from_to = orders.agg(F.min("service_date").alias("a"), F.max("service_date").alias("b"))
    traded = orders.where("table_code is not null and duration_usable").select("service_date")
    ends = from_to.select(F.explode(F.array("a", "b")).alias("service_date"))
    saturdays = trend.untraded_days(traded.unionByName(ends).distinct(), 6)
    ends_only = ends.join(traded, "service_date", "left_anti").where(F.weekday("service_date") == 5)
    return saturdays.unionByName(ends_only)


@query("within_month_correlation", sql(f"""
SELECT 'pooled' AS month, {i('count(*)', 'nights')}, {f('corr(r, t)', 'r')} FROM (
  SELECT revenue - avg(revenue) OVER m AS r, temp_high_f - avg(temp_high_f) OVER m AS t FROM t_wx WHERE {_WEEKEND}
  WINDOW m AS (PARTITION BY date_trunc('month', service_date)))
UNION ALL SELECT strftime(service_date, '%Y-%m'), {i('count(*)', 'nights')}, {f('corr(revenue, temp_high_f)', 'r')}
FROM t_wx WHERE {_WEEKEND} GROUP BY 1 HAVING count(*) >= 6"""))
def within_month_correlation(spark, sf):
    """Weekend revenue against the day's high, inside months."""
    return trend.within_month_correlation(frames.visit_nights(spark, sf))


def _r2_sql() -> str:
    """Weekday effects are taken out first; one or two regressors remain in closed form."""
    def demean(c):
        return f"{c} - avg({c}) OVER (PARTITION BY service_dow) AS {c}"

    def one(design, x, source):
        slope = f"sum({x} * y) / sum({x} * {x})"
        return f"""SELECT '{design}' AS design, {i('count(*)', 'n')},
          {f(f'1 - (sum(y * y) - sum({x} * y) * sum({x} * y) / sum({x} * {x})) / max(sst)', 'r2')},
          {f(slope if design == 'time' else 'NULL', 'per_week')} FROM {source} AS q"""
    base = """(SELECT *, (service_date - min(service_date) OVER ()) / 7.0::DOUBLE AS week FROM t_wx)"""
    plain = f"(SELECT sst, {demean('y')}, {demean('week')} FROM (SELECT *, revenue AS y, var_pop(revenue) OVER () * count(*) OVER () AS sst FROM {base} AS a) AS c)"
    known = f"(SELECT sst, {demean('y')}, {demean('week')}, {demean('temp_high_f')} FROM (SELECT *, revenue AS y, var_pop(revenue) OVER () * count(*) OVER () AS sst FROM {base} AS a WHERE temp_high_f IS NOT NULL) AS c)"
    det = "(sum(week * week) * sum(temp_high_f * temp_high_f) - sum(week * temp_high_f) * sum(week * temp_high_f))"
    b1 = f"((sum(week * y) * sum(temp_high_f * temp_high_f) - sum(temp_high_f * y) * sum(week * temp_high_f)) / {det})"
    b2 = f"((sum(temp_high_f * y) * sum(week * week) - sum(week * y) * sum(week * temp_high_f)) / {det})"
    both = f"""SELECT 'both' AS design, {i('count(*)', 'n')},
      {f(f'1 - (sum(y * y) - {b1} * sum(week * y) - {b2} * sum(temp_high_f * y)) / max(sst)', 'r2')},
      {f(b1, 'per_week')} FROM {known} AS q"""
    return sql(" UNION ALL ".join([one("time", "week", plain), one("temperature", "temp_high_f", known), both]))


@query("season_or_decline", _r2_sql())
def season_or_decline(spark, sf):
    """R² of time, temperature and both, net of weekday."""
    return regression.season_or_decline(frames.visit_nights(spark, sf), WEEKDAYS)
