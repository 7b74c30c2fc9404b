"""Queries on venue orders: staging, placement, facts, nights, hours and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from servicenight import rules
from servicenight.functions import calendar, measures, parse
from servicenight.operators import floorplan, hours, intervals, regression, staging, trend
from servicenight.plans import frames, standins as S
from servicenight.plans.registry import ORACLES, query
from servicenight.plans.sql_base import FORCE, b, d, f, i, literal, money, s, sql, t

# --- parsing ----------------------------------------------------------------------------------

_CLOCK_TEXT = {0: "M/d/yy h:mm a", 1: "M/d/yy HH:mm 'PM'", 2: "yyyy-MM-dd HH:mm", 3: "MM/dd/yy hh:mm a"}


def _clock_text(orders):
    text = None
    for rest, pattern in _CLOCK_TEXT.items():
        form = F.date_format("opened_at", pattern)
        test = F.col("order_id") % 4 == rest
        text = F.when(test, form) if text is None else text.when(test, form)
    return orders.select("order_id", text.alias("text"))


@query("parse_clock_text", sql(f"""
SELECT {i('order_id')}, {t('''CASE order_id % 4 WHEN 0 THEN opened_at WHEN 3 THEN opened_at WHEN 1 THEN
  date_trunc('day', opened_at) + to_hours(hour(opened_at) % 12 + 12) + to_minutes(minute(opened_at)) END''', 'clock')}
FROM v_orders"""))
def parse_clock_text(spark, sf):
    """Clock texts in and out of the usual form; the hour is read modulo 12."""
    return _clock_text(S.orders(spark, sf)).select("order_id", parse.parse_clock(F.col("text")).alias("clock"))


@query("parse_clock_any_format", sql(f"""
SELECT {i('order_id')}, {t('''CASE WHEN order_id % 4 = 1 AND hour(opened_at) BETWEEN 1 AND 12 THEN
  date_trunc('day', opened_at) + to_hours(hour(opened_at) % 12 + 12) + to_minutes(minute(opened_at))
  WHEN order_id % 4 <> 1 THEN opened_at END''', 'clock')},
  {b('order_id % 4 = 2 OR (order_id % 4 = 1 AND hour(opened_at) NOT BETWEEN 1 AND 12)', 'unusual')}
FROM v_orders"""))
def parse_clock_any_format(spark, sf):
    """Tolerant reading over a list of formats, unusual values marked."""
    text = F.col("text")
    return _clock_text(S.orders(spark, sf)).select(
        "order_id", parse.parse_clock_tolerant(text).alias("clock"), parse.unusual_clock(text).alias("unusual"))


@query("parse_durations", sql(f"""
SELECT {i('order_id')}, {i('seconds')}, {f('duration_minutes')}, {b('is_long_session')},
  {b('is_negative_duration')}, {b('duration_usable')} FROM v_flagged"""))
def parse_durations(spark, sf):
    """Duration text with any number of hours and signed parts, and its flags."""
    raw = S.raw_orders(spark, sf).select("Order Id", "Duration (Opened to Paid)").distinct()
    seconds = parse.parse_duration_seconds(parse.blank_to_null(F.col("Duration (Opened to Paid)")))
    return raw.select(F.col("Order Id").cast("bigint").alias("order_id"), seconds.alias("seconds")).select(
        "order_id", "seconds", measures.duration_minutes(F.col("seconds")).alias("duration_minutes"),
        measures.is_long_session(F.col("seconds")).alias("is_long_session"),
        measures.is_negative_duration(F.col("seconds")).alias("is_negative_duration"),
        measures.duration_usable(F.col("seconds")).alias("duration_usable"))


_FILES = literal(S.EXPORT_FILES)
_COPIES = "CAST(pr[1] AS INTEGER)"


@query("export_end_dates", sql(f"""
SELECT source_file, {i('count(*)', 'rows')},
  CASE WHEN regexp_matches(source_file, '_\\d{{4}}_\\d{{2}}_\\d{{2}}-\\d{{4}}_\\d{{2}}_\\d{{2}}\\.csv$')
       THEN replace(regexp_extract(source_file, '-(\\d{{4}}_\\d{{2}}_\\d{{2}})\\.csv$', 1), '_', '-') END AS range_end
FROM (SELECT {_FILES}[unnest(range(1, {_COPIES} + 1))] AS source_file FROM v_orders) GROUP BY source_file"""))
def export_end_dates(spark, sf):
    """Rows per export with the end of its date range."""
    files = S.raw_orders(spark, sf).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    return files.withColumn("range_end", parse.export_end_date(F.col("source_file")))


# --- staging ------------------------------------------------------------------------------------

@query("stage_orders", sql(f"""
SELECT {i('order_id')}, {i('order_number')}, array_to_string(check_numbers, ',') AS check_numbers,
  {t('opened_at')}, {d('service_date')}, {i('coalesce(guests, 0)', 'guests')}, table_code,
  {f('discount_c / 100.0', 'discount_amount')}, {money('amount', 'tax', 'gratuity', 'total')},
  {f('(tip_c + load * 100) / 100.0', 'tip')}, {t('closed_at')}, {i('seconds', 'duration_seconds')},
  {f('duration_minutes')}, {b('is_long_session')}, {b('is_negative_duration')}, {b('duration_usable')},
  {i('load', 'load_id')}, {_FILES}[load] AS source_file, {i(_COPIES, 'copies_in_raw')}
FROM (SELECT *, CASE WHEN {_COPIES} >= 4 THEN 4 WHEN {_COPIES} >= 2 THEN 2 ELSE 1 END AS load FROM v_flagged)"""))
def stage_orders(spark, sf):
    """Text copies of every order reduced to the preferred one, typed and flagged."""
    return staging.stage_orders(S.raw_orders(spark, sf)).drop("duration", "source_row_number")


_ITEM_FILE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ITEM_FILES.items())


@query("stage_items", sql(f"""
SELECT {i('item_selection_id')}, {i('abs(order_id)', 'order_id')}, {i('check_id')}, {t('sent_at')}, menu_item,
  'Group ' || (l_suppkey % 6) AS menu_group, {s('NULL', 'menu')}, sales_category,
  {literal(S.TABLE_CODES)}[l_suppkey % 40 + 1] AS table_code,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Lounge' END AS dining_area,
  {f('price_c / 100.0', 'gross_price')}, {f('discount_c / 100.0', 'discount')}, {f('net_c / 100.0', 'net_price')},
  {f('halves / 2.0', 'qty')}, {b('is_void')}, {i('l_suppkey', 'load_id')},
  CASE l_returnflag {_ITEM_FILE} END AS source_file, {i('copies', 'copies_in_raw')}
FROM (SELECT *, count(*) OVER (PARTITION BY item_selection_id) AS copies, row_number() OVER (
        PARTITION BY item_selection_id ORDER BY
        CASE l_returnflag WHEN 'A' THEN DATE '2026-01-31' WHEN 'N' THEN DATE '2026-06-30' END DESC NULLS LAST,
        l_suppkey DESC, CAST(round(l_extendedprice * 100) AS BIGINT)) AS copy_rank FROM v_items)
WHERE copy_rank = 1"""))
def stage_items(spark, sf):
    """Both item layouts together, the preferred copy of every selection, typed."""
    staged = staging.stage_items(*S.raw_items(spark, sf))
    return staged.drop("source_row_number", "order_number", "ordered_at")


@query("order_flags", sql(f"""
SELECT {i('order_id')}, {d('service_date')}, dayname(service_date) AS service_dow,
  {f("date_diff('second', CAST(service_date AS TIMESTAMP), opened_at) / 60.0::DOUBLE", 'clock_minutes')},
  {f('duration_minutes')}, {b('duration_usable')}, {t('opened_at + to_seconds(seconds)', 'paid_at')},
  {i('checks')} FROM v_flagged"""))
def order_flags(spark, sf):
    """Night, minutes since its midnight, duration flags and paid time per order."""
    day = F.col("service_date")
    return S.orders(spark, sf).select(
        "order_id", "service_date", calendar.day_name(day).alias("service_dow"),
        calendar.clock_minutes(F.col("opened_at"), day).alias("clock_minutes"), "duration_minutes",
        "duration_usable", measures.paid_at(F.col("opened_at"), F.col("duration_seconds")).alias("paid_at"),
        F.size("check_numbers").alias("checks"))


# --- placement -------------------------------------------------------------------------------------

@query("table_in_force", sql(f"""
SELECT {i('o.order_id', 'order_id')}, o.table_code, t.section, {i('t.seats_max', 'seats_max')}
FROM v_orders o LEFT JOIN floor_tables t
  ON t.table_code = o.table_code AND {FORCE.format(day='o.service_date', p='t')}"""))
def table_in_force(spark, sf):
    """As-of join of every order to the floor-plan row of its table on that night."""
    return floorplan.table_in_force(S.orders(spark, sf), floorplan.tables(spark)).select(
        "order_id", "table_code", "section", "seats_max")


@query("table_in_force_swept", ORACLES["table_in_force"])
def table_in_force_swept(spark, sf):
    """The same by a sweep over orders and floor-plan rows, as if both were large."""
    plan = floorplan.tables(spark).withColumnRenamed("table_code", "_code")
    joined = intervals.interval_join(S.orders(spark, sf), plan, [("table_code", "_code")], "service_date", "valid_from", "valid_to", "left")
    return joined.select("order_id", "table_code", "section", "seats_max")


@query("order_seating", sql(f"""
SELECT {i('order_id')}, {d('service_date')}, table_code, {i('guests')}, section, seating_fit, seating_unit,
  {i('unit_seats')}, {b('guests_implausible')} FROM v_placed"""))
def order_seating(spark, sf):
    """Where each order sat: table, combination, whole room or over capacity."""
    return floorplan.place_orders(S.orders(spark, sf), floorplan.tables(spark), floorplan.combinations(spark))


@query("seating_unit_usage", sql(f"""
SELECT {i('u.seating_unit_key', 'seating_unit_key')}, unit_name, unit_type, u.section,
  array_to_string(table_codes, ',') AS table_codes, {i('u.seats', 'seats')}, {d('valid_from')}, {d('valid_to')},
  {b('is_current')}, {i('count(f.order_id)', 'orders')}
FROM dim_unit u LEFT JOIN v_fact f USING (seating_unit_key) GROUP BY ALL"""))
def seating_unit_usage(spark, sf):
    """The seating-unit dimension with the orders placed on each version."""
    used = frames.order_facts(spark, sf).groupBy("seating_unit_key").agg(F.count(F.lit(1)).alias("_n"))
    return frames.seating_units(spark).join(used, "seating_unit_key", "left").withColumn(
        "orders", F.coalesce("_n", F.lit(0))).drop("_n")


# --- facts -------------------------------------------------------------------------------------------

@query("date_dimension", sql(f"""
SELECT {i('date_key')}, {d('service_date')}, day_name, {i('iso_day_of_week')}, {b('is_fri_or_sat')},
  {d('week_start')}, {d('month_start')}, {i('year')} FROM v_dates"""))
def date_dimension(spark, sf):
    """Every day between the first and last service date."""
    return frames.dates(spark, sf)


def _ratio4(top: str, bottom: str) -> str:
    """top / bottom rounded half up to four places in whole numbers."""
    return f"(2 * ({top})::HUGEINT * 10000 + {bottom}) // (2 * {bottom}) / 10000.0"


@query("order_facts", sql(f"""
SELECT {i('order_id')}, {i('date_key')}, {i('seating_unit_key')}, table_code, section, order_type, seating_fit,
  {t('opened_at')}, {i('guests')}, {i('checks')}, {f('discount_c / 100.0', 'discount_amount')},
  {money('amount', 'tax', 'tip', 'gratuity', 'total')}, {f('duration_minutes')}, {b('is_long_session')},
  {b('is_negative_duration')}, {b('duration_usable')}, {b('guests_implausible')}, {b('in_time_metrics')},
  {f(f"CASE WHEN in_time_metrics THEN {_ratio4('amount_c * 15', '(guests * minutes_c)')} END", 'vpcpm')},
  {f(f"CASE WHEN in_time_metrics THEN {_ratio4('amount_c * 15', 'minutes_c')} END", 'tpcpm')}
FROM v_fact"""))
def order_facts(spark, sf):
    """Order facts: placement version, order type, time-metric gate and spend rates."""
    return frames.order_facts(spark, sf)


_NIGHTLY = f"""{d('service_date')}, day_name, {i('iso_day_of_week')}, {b('is_fri_or_sat')}, {d('month_start')},
  {i('year')}, {i('orders')}, {f('revenue_c / 100.0', 'revenue')}, {f('seated_c / 100.0', 'seated_revenue')},
  {f('event_c / 100.0', 'event_revenue')}, {f('togo_c / 100.0', 'togo_revenue')}, {i('parties')}, {i('guests')}"""


@query("nightly_summary", sql(f"SELECT {_NIGHTLY} FROM v_nightly"))
def nightly_summary(spark, sf):
    """One row per day of the calendar, days without orders as zeros."""
    return frames.nightly(spark, sf)


@query("regular_nights", sql(f"""
SELECT {_NIGHTLY}, {f('regular_c / 100.0', 'regular_revenue')}, {f('years')}, {i('month_of_year')},
  {f('spend_per_guest')} FROM v_nights"""))
def regular_nights(spark, sf):
    """Tuesday to Sunday nights that traded, with derived night columns."""
    return trend.with_night_columns(trend.regular_nights(frames.nightly(spark, sf)))


@query("monday_bookings", sql(f"""
SELECT {i('count(*)', 'nights')}, {f('coalesce(sum(revenue_c), 0) / 100.0', 'revenue')}
FROM v_nightly WHERE iso_day_of_week = 1 AND orders > 0"""))
def monday_bookings(spark, sf):
    """Private bookings on the closed weekday."""
    return trend.monday_bookings(frames.nightly(spark, sf))


# --- hours of the night ---------------------------------------------------------------------------------

def _hour_sql(select: str) -> str:
    base = f"""
    (SELECT order_id, service_date, day_name, hour, revenue FROM (
      SELECT *, unnest(range({rules.NIGHT_HOURS[0]}, {rules.NIGHT_HOURS[1]} + 1)) AS hour,
        amount_c / 100.0::DOUBLE * CASE WHEN spread THEN
          greatest(least(start_m + duration_minutes, (hour + 1) * 60) - greatest(start_m, hour * 60), 0) / duration_minutes
          ELSE CASE WHEN start_m >= hour * 60 AND start_m < (hour + 1) * 60 THEN 1 ELSE 0 END END AS revenue
      FROM seated_days) WHERE revenue <> 0)"""
    days = f"""
    (SELECT *, dayname(service_date) AS day_name, duration_usable AND seconds > 0 AS spread,
       date_diff('second', CAST(service_date AS TIMESTAMP), opened_at) / 60.0::DOUBLE AS start_m
     FROM v_flagged WHERE table_code IS NOT NULL AND isodow(service_date) <> 1)"""
    return sql(select.replace("HOURLY", base).replace("seated_days", days))


def _between(window) -> str:
    return f"service_date BETWEEN DATE '{window[0]}' AND DATE '{window[1]}'"


@query("revenue_by_hour", _hour_sql(f"""
SELECT {i('order_id')}, {d('service_date')}, day_name, {i('hour')}, {f('revenue')} FROM HOURLY AS h"""))
def revenue_by_hour(spark, sf):
    """Every seated order's revenue spread over the clock hours it sat."""
    return hours.revenue_by_hour(hours.seated_on_trading_days(frames.typed_orders(spark, sf)))


def _cells(hours) -> str:
    return f"SELECT unnest({literal(rules.TRADING_DAYS)}) AS day_name, hour FROM (SELECT unnest({literal(list(hours))}) AS hour)"


def _per_night(window) -> str:
    return f"""SELECT c.day_name, c.hour, coalesce(n.nights, 0) AS nights, coalesce(t.revenue, 0) / nullif(coalesce(n.nights, 0), 0) AS per_night
      FROM ({_cells(range(rules.NIGHT_HOURS[0], rules.NIGHT_HOURS[1] + 1))}) c
      LEFT JOIN (SELECT day_name, count(DISTINCT service_date) AS nights FROM seated_days AS q
            WHERE {_between(window)} GROUP BY day_name) n USING (day_name)
      LEFT JOIN (SELECT day_name, hour, sum(revenue) AS revenue FROM HOURLY AS h
            WHERE {_between(window)} GROUP BY day_name, hour) t ON t.day_name = c.day_name AND t.hour = c.hour"""


_LABEL = ("(CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END)::VARCHAR || "
          "CASE WHEN {h} % 24 < 12 THEN 'am' ELSE 'pm' END")


@query("mean_revenue_by_hour", _hour_sql(f"""
SELECT day_name, {i('hour')}, {_LABEL.format(h='hour')} || '-' || {_LABEL.format(h='(hour + 1)')} AS span,
  {i('nights')}, {f('per_night')} FROM ({_per_night(rules.REPORT_YEAR)})"""))
def mean_revenue_by_hour(spark, sf):
    """What each clock hour earns on an average night of each weekday, latest year."""
    return hours.mean_by_hour(frames.typed_orders(spark, sf), rules.REPORT_YEAR)


@query("unplaced_revenue", _hour_sql(f"""
SELECT {f('recorded')}, {f('placed')}, {f('recorded - placed', 'unplaced')} FROM
  (SELECT sum(amount_c) / 100.0::DOUBLE AS recorded FROM seated_days AS q),
  (SELECT sum(revenue) AS placed FROM HOURLY AS h)"""))
def unplaced_revenue(spark, sf):
    """Seated revenue outside the night's hours."""
    return hours.unplaced_revenue(frames.typed_orders(spark, sf))


_WINDOWS = {"year": rules.REPORT_YEAR, "first_summer": rules.FIRST_SUMMER, "last_summer": rules.LAST_SUMMER}


@query("edge_hours_compared", _hour_sql(f"""
SELECT c.day_name, {i('c.hour', 'hour')}, {', '.join(f(f'coalesce(sum(revenue) FILTER (WHERE {_between(w)}), 0) / nullif(max(n_{n}), 0)', n)
  for n, w in _WINDOWS.items())}
FROM ({_cells([16, 17, 23, 24])}) c LEFT JOIN HOURLY AS h ON h.day_name = c.day_name AND h.hour = c.hour
LEFT JOIN (SELECT day_name, {', '.join(f'count(DISTINCT service_date) FILTER (WHERE {_between(w)}) AS n_{n}'
  for n, w in _WINDOWS.items())} FROM seated_days AS q GROUP BY day_name) n ON n.day_name = c.day_name
GROUP BY c.day_name, c.hour"""))
def edge_hours_compared(spark, sf):
    """The first and last hours in three windows."""
    return hours.edge_comparison(frames.typed_orders(spark, sf), _WINDOWS)


@query("edge_hour_shares", _hour_sql(f"""
SELECT day_name, {f('sum(per_night)', 'whole_night')},
  {f('coalesce(sum(per_night) FILTER (WHERE hour < 17), 0)', 'early')},
  {f('coalesce(sum(per_night) FILTER (WHERE hour >= 24), 0)', 'late')},
  {f('coalesce(sum(per_night) FILTER (WHERE hour < 17), 0) / sum(per_night)', 'early_share')},
  {f('coalesce(sum(per_night) FILTER (WHERE hour >= 24), 0) / sum(per_night)', 'late_share')}
FROM ({_per_night(rules.REPORT_YEAR)}) GROUP BY day_name"""))
def edge_hour_shares(spark, sf):
    """Share of the night earned before 5 PM and after midnight."""
    return hours.edge_shares(hours.mean_by_hour(frames.typed_orders(spark, sf), rules.REPORT_YEAR))


@query("untabled_totals", sql(f"""
SELECT order_type, {i('count(*)', 'orders')}, {f('sum(amount_c) / 100.0', 'revenue')} FROM v_fact
WHERE order_type <> 'Seated' AND isodow(service_date) <> 1 AND {_between(rules.REPORT_YEAR)} GROUP BY order_type"""))
def untabled_totals(spark, sf):
    """Event and to-go revenue of the latest year."""
    return hours.untabled_totals(frames.typed_orders(spark, sf), rules.REPORT_YEAR)


# --- trend ---------------------------------------------------------------------------------------------

@query("month_by_month", sql(f"""
SELECT {d('month_start')}, {i('count(*)', 'nights')}, {f('sum(revenue_c) / 100.0', 'revenue')},
  {f('sum(regular_c) / 100.0', 'regular')}, {i('sum(parties)', 'parties')}, {i('sum(guests)', 'guests')},
  {f('avg(temp_high_f)', 'mean_high')}, {f('sum(revenue_c) / 100.0::DOUBLE / count(*)', 'revenue_per_night')},
  {f('sum(regular_c) / 100.0::DOUBLE / count(*)', 'regular_per_night')},
  {f('sum(parties)::DOUBLE / count(*)', 'parties_per_night')},
  {f('sum(seated_c) / 100.0::DOUBLE / nullif(sum(guests), 0)', 'spend_per_guest')}
FROM v_nights GROUP BY month_start"""))
def month_by_month(spark, sf):
    """Regular nights by month."""
    return trend.month_by_month(frames.trading_nights(spark, sf))


def _year_columns() -> str:
    out = []
    for tag, year in zip(("before", "after"), rules.COMPARED_YEARS):
        y = f"FILTER (WHERE year = {year})"
        w = f"FILTER (WHERE year = {year} AND is_fri_or_sat)"
        m = f"FILTER (WHERE year = {year} AND NOT is_fri_or_sat)"
        out.append(f"""count(*) {y} AS nights_{tag},
          sum(regular_c) {y} / 100.0::DOUBLE / count(*) {y} AS regular_{tag},
          sum(parties) {y}::DOUBLE / count(*) {y} AS parties_{tag},
          sum(seated_c) {y} / 100.0::DOUBLE / nullif(sum(guests) {y}, 0) AS spend_{tag},
          sum(regular_c) {w} / 100.0::DOUBLE / count(*) {w} AS weekend_{tag},
          sum(regular_c) {m} / 100.0::DOUBLE / count(*) {m} AS midweek_{tag}""")
    return ", ".join(out)


_COMPARED = ("regular", "parties", "spend", "weekend", "midweek")
_YOY = ", ".join([i("nights_before"), i("nights_after")]
                 + [f(f"{m}_{tag}") for m in _COMPARED for tag in ("before", "after")]
                 + [f(f"{m}_after / nullif({m}_before, 0) - 1", f"{m}_change") for m in _COMPARED])
_MONTHS = f"SELECT month_of_year, {_year_columns()} FROM v_nights GROUP BY month_of_year"


@query("same_month_comparison", sql(f"""
SELECT {i('month_of_year')}, {_YOY} FROM ({_MONTHS}) WHERE least(nights_before, nights_after) >= 15"""))
def same_month_comparison(spark, sf):
    """The same months of two years side by side."""
    return trend.same_month_comparison(frames.trading_nights(spark, sf))


@query("pooled_comparison", sql(f"""
SELECT {_YOY} FROM (SELECT {_year_columns()} FROM v_nights WHERE month_of_year IN
  (SELECT month_of_year FROM ({_MONTHS}) WHERE least(nights_before, nights_after) >= 15))"""))
def pooled_comparison(spark, sf):
    """All comparable months together."""
    return trend.pooled_comparison(frames.trading_nights(spark, sf))


def _trend_sql(column: str, measure: str, season: str, since=None) -> str:
    """Weekday effects are taken out by centring, then one regressor after another is projected out.

    What is left of the measure and of the years gives the regression's slope and its HC1 error.
    """
    seasonal = (["temp_high_f", "temp_high_f * temp_high_f"] if season == "temperature"
                else [f"CAST(month_of_year = {m} AS INTEGER)::DOUBLE" for m in range(2, 13)])
    names = [f"r{k}" for k in range(len(seasonal))]
    when = f" AND service_date >= DATE '{since}'" if since else ""
    gap = " AND temp_high_f IS NOT NULL" if season == "temperature" else ""
    body = f"""SELECT day_name, ln({column}) AS y, years AS x, month_of_year,
      {', '.join(f'{e} AS {n}' for e, n in zip(seasonal, names))} FROM v_nights WHERE {column} > 0{gap}{when}"""
    freedom = ("count(DISTINCT day_name) + 3" if season == "temperature"
               else "count(DISTINCT day_name) + count(DISTINCT month_of_year)")
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY day_name) AS {c}" for c in ["y", "x", *names])
    level = f"SELECT {centred} FROM base"
    for k, name in enumerate(names):
        rest = ", ".join(f"{c} - {name} * coalesce(sum({c} * {name}) OVER () / nullif(sum({name} * {name}) OVER (), 0), 0) AS {c}"
                         for c in ["y", "x", *names[k + 1:]])
        level = f"SELECT {rest} FROM ({level})"
    return sql(f"""
    SELECT '{measure}' AS measure, '{season}' AS season, {i('n')}, {f('exp(slope) - 1', 'coefficient_pct')},
      {f(f'exp(slope - {regression.NORMAL_975} * se) - 1', 'low_pct')},
      {f(f'exp(slope + {regression.NORMAL_975} * se) - 1', 'high_pct')}
    FROM (SELECT max(n) AS n, max(slope) AS slope,
            sqrt(max(n)::DOUBLE / (max(n) - max(p)) * sum((y - slope * x) * (y - slope * x) * x * x)
                 / (sum(x * x) * sum(x * x))) AS se
      FROM (SELECT *, (SELECT {freedom} FROM base) AS p, count(*) OVER () AS n,
              sum(x * y) OVER () / sum(x * x) OVER () AS slope FROM ({level})))""", {"base": body})


_WEEKDAYS = rules.TRADING_DAYS
_REGULAR, _TOTAL = "(regular_c / 100.0::DOUBLE)", "(revenue_c / 100.0::DOUBLE)"


def _trend(name, column, sql_column, season, doc, since=None):
    def run(spark, sf):
        nights = frames.trading_nights(spark, sf)
        if since:
            nights = nights.where(F.col("service_date") >= F.lit(since))
        return regression.log_trend(nights, column, season, _WEEKDAYS)
    run.__doc__ = doc
    return query(name, _trend_sql(sql_column, column, season, since))(run)


_SWITCH = rules.TAX_INCLUSIVE_UNTIL
_trend("trend_regular_month", "regular_revenue", _REGULAR, "month", "Yearly trend net of weekday and month.")
_trend("trend_total_month", "revenue", _TOTAL, "month", "Yearly trend of total revenue net of weekday and month.")
_trend("trend_regular_temperature", "regular_revenue", _REGULAR, "temperature", "Yearly trend net of weekday and temperature.")
_trend("trend_total_temperature", "revenue", _TOTAL, "temperature", "Yearly trend of total revenue net of weekday and temperature.")
_trend("trend_regular_after_tax_switch", "regular_revenue", _REGULAR, "month", "Yearly trend over nights priced without tax.", _SWITCH)
_trend("trend_total_after_tax_switch", "revenue", _TOTAL, "month", "Total revenue over nights priced without tax.", _SWITCH)
_trend("trend_regular_temperature_after_tax_switch", "regular_revenue", _REGULAR, "temperature",
       "Yearly trend net of temperature over nights priced without tax.", _SWITCH)
_trend("trend_total_temperature_after_tax_switch", "revenue", _TOTAL, "temperature",
       "Total revenue net of temperature over nights priced without tax.", _SWITCH)
_trend("trend_parties_month", "parties", "parties", "month", "Yearly trend of parties per night.")
_trend("trend_spend_month", "spend_per_guest", "spend_per_guest", "month", "Yearly trend of seated spend per guest.")


@query("time_against_temperature", sql(f"""
SELECT {f("corr(CAST(service_date - DATE '2000-01-01' AS DOUBLE), temp_high_f)", 'r')} FROM v_nights"""))
def time_against_temperature(spark, sf):
    """Correlation of elapsed time with the day's high."""
    return trend.time_against_temperature(frames.trading_nights(spark, sf))


@query("nights_without_weather", sql(f"""
SELECT {i('count(*) FILTER (WHERE temp_high_f IS NULL)', 'unmatched')}, {i('count(*)', 'nights')} FROM v_nights"""))
def nights_without_weather(spark, sf):
    """Nights the weather table lacks."""
    return trend.nights_without_weather(frames.trading_nights(spark, sf))


@query("missing_weather_days", sql(f"""
SELECT {d('service_date')} FROM v_dates WHERE service_date NOT IN (SELECT service_date FROM v_weather)"""))
def missing_weather_days(spark, sf):
    """Days of the covered span to be fetched for the weather table."""
    nightly = frames.nightly(spark, sf)
    return trend.missing_weather_days(nightly, S.daily_weather(nightly))
