"""Queries on overlapping pulls without order ids: identity, merge and coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from servicenight.functions import measures
from servicenight.operators import cleaning, floorplan, merge, turns
from servicenight.plans import frames, standins as S
from servicenight.plans.registry import ORACLES, query
from servicenight.session import ensure_checkpoint_dir, materialize
from servicenight.sources import exports, legacy, merged
from servicenight.plans.sql_base import b, cte, d, f, i, literal, s, sql, t

_FIELDS = ["opened", "guests", "table_code", "discount_c", "amount_c", "tax_c", "tip_c", "gratuity_c",
           "closed", "duration_text"]

cte("u_rows", f"""
SELECT {literal(S.PULL_FILES)}[pull_rank + 1] AS source_file, pull_rank, chunk AS source_chunk,
  event_id * 2 + chunk AS source_row_number,
  date_trunc('hour', ts) + INTERVAL {S.VISIT_SHIFT_DAYS} DAY AS opened,
  CASE WHEN event_id % 31 <> 0 THEN 1 + event_id % 8 END AS guests,
  {literal(S.TABLE_CODES)}[user_id % 40 + 1] AS table_code, event_id % 7 * 100 AS discount_c,
  CAST(round(value * 100) AS BIGINT) AS amount_c, CAST(round(value * 100) AS BIGINT) * 8 // 100 AS tax_c,
  CASE WHEN event_id % 5 = 0 AND pull_rank > 0 THEN NULL ELSE pull_rank * 100 + event_id % 9 END AS tip_c,
  0 AS gratuity_c, date_trunc('hour', ts) + INTERVAL {S.VISIT_SHIFT_DAYS} DAY + to_days(CAST(pull_rank AS INTEGER)) AS closed,
  CASE WHEN pull_rank <> 1 THEN printf('1:%02d:00', event_id % 60) END AS duration_text
FROM events e JOIN (VALUES (0), (1), (2)) AS p(pull_rank) ON day(ts) BETWEEN pull_rank * 10 AND pull_rank * 10 + 12
  AND (CAST(ts AS DATE) - DATE '2000-01-01') % 29 NOT IN ({', '.join(map(str, S.DARK_DAYS))}),
  LATERAL (SELECT unnest(range(0, CASE WHEN e.event_id % 40 = 0 THEN 2 ELSE 1 END)) AS chunk)""")
cte("u_pulls", f"""
SELECT *, row_number() OVER (PARTITION BY source_file, opened, coalesce(table_code, ''), coalesce(guests, -1)
    ORDER BY amount_c, discount_c, source_row_number) - 1 AS occurrence,
  opened AS k_opened, coalesce(table_code, '') AS k_table, coalesce(guests, -1) AS k_guests
FROM (SELECT {', '.join(_FIELDS)}, source_file, pull_rank, min(source_row_number) AS source_row_number,
        min(source_chunk) AS source_chunk FROM u_rows GROUP BY {', '.join(_FIELDS)}, source_file, pull_rank)""")
_KEYS = "k_opened, k_table, k_guests, occurrence"
cte("u_merged", f"""
SELECT {_KEYS}, {', '.join(f'arg_max({c}, pull_rank) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in [*_FIELDS, 'source_file'])}
FROM u_pulls GROUP BY {_KEYS}""")

_ROW = f"""{t('opened')}, {i('guests')}, table_code, {f('discount_c / 100.0', 'discount_amount')},
  {', '.join(f(f'{m}_c / 100.0', m) for m in ('amount', 'tax', 'tip', 'gratuity'))}, {t('closed')}, duration_text, source_file"""
_KEY = f"{t('k_opened')}, k_table, {i('k_guests')}, {i('occurrence')}"


@query("pull_order", sql(f"""
SELECT source_file, {s("CASE WHEN source_file LIKE '%-2026%' THEN replace(left(right(source_file, 14), 10), '_', '-') END", 'range_end')},
  {b("source_file NOT LIKE '%-2026%'", 'undated')}, {i('row_number() OVER (ORDER BY pull_rank) - 1', 'pull_rank')}
FROM (SELECT DISTINCT source_file, pull_rank FROM u_rows)"""))
def pull_order(spark, sf):
    """Pulls oldest first by the end of their range; undated ones first of all."""
    files = S.pull_rows(spark, sf).groupBy("source_file").agg(F.min("opened").alias("modified"))
    return merge.rank_pulls(files)


@query("pull_identities", sql(f"""
SELECT source_file, {_KEY}, {f('amount_c / 100.0', 'amount')}, {i('source_row_number')} FROM u_pulls"""))
def pull_identities(spark, sf):
    """Every row's identity: null-safe key and occurrence number."""
    return frames.pulls(spark, sf).select("source_file", *merge.KEY, "amount", "source_row_number")


@query("merge_pulls", sql(f"SELECT {_KEY}, {_ROW} FROM u_merged"))
def merge_pulls(spark, sf):
    """One row per order; each field from the newest pull that supplied it."""
    return merge.merge_pulls(frames.pulls(spark, sf))


@query("merged_in_steps", ORACLES["merge_pulls"])
def merged_in_steps(spark, sf):
    """The same from a stored target that the pulls are merged into one by one, the last one first and the first one twice."""
    rows = materialize(frames.pulls(spark, sf))
    root = f"{ensure_checkpoint_dir(spark)}/merged-{uuid.uuid4().hex}"
    for rank in (2, 0, 1, 0):
        merged.merge_into(spark, root, rows.where(F.col("pull_rank") == rank), buckets=8)
    return merged.read(spark, root)


_REVISED = " OR ".join(f"(p.{c} IS NOT NULL AND p.{c} IS DISTINCT FROM m.{c})" for c in _FIELDS)


@query("pull_supersession", sql(f"""
SELECT source_file, {i('count(*)', 'rows')}, {i('count(*) FILTER (WHERE pull_rank = lo)', 'first_seen')},
  {i('count(*) FILTER (WHERE pull_rank < hi AND revised)', 'superseded')},
  {i('count(*) FILTER (WHERE pull_rank < hi AND NOT revised)', 'confirmed')}
FROM (SELECT p.source_file, p.pull_rank, min(p.pull_rank) OVER w AS lo, max(p.pull_rank) OVER w AS hi,
        ({_REVISED}) AS revised
      FROM u_pulls p JOIN u_merged m USING ({_KEYS})
      WINDOW w AS (PARTITION BY p.k_opened, p.k_table, p.k_guests, p.occurrence)) GROUP BY source_file"""))
def pull_supersession(spark, sf):
    """What each pull added, what later pulls revised or confirmed."""
    rows = frames.pulls(spark, sf)
    return merge.supersession(rows, merge.merge_pulls(rows))


@query("pull_read_report", sql(f"""
SELECT r.source_file, {i('rows_read')}, {i('chunks')}, {b('has_duration')}, {i('rows')},
  {i('rows_read - rows', 'duplicates_dropped')} FROM
  (SELECT source_file, count(*) AS rows_read, max(source_chunk) + 1 AS chunks,
     bool_or(duration_text IS NOT NULL) AS has_duration FROM u_rows GROUP BY source_file) r
JOIN (SELECT source_file, count(*) AS rows FROM u_pulls GROUP BY source_file) USING (source_file)"""))
def pull_read_report(spark, sf):
    """Rows, chunks and duplicates per pull."""
    rows = S.pull_rows(spark, sf)
    return merge.read_report(rows, merge.drop_chunk_duplicates(rows))


@query("merge_coverage", sql(f"""
SELECT {i('count(*)', 'orders')}, {i('count(DISTINCT day)', 'days')}, {d('min(day)', 'first_day')},
  {d('max(day)', 'last_day')}, {i('count(duration_text)', 'with_duration')}
FROM (SELECT *, CAST(opened - INTERVAL 4 HOUR AS DATE) AS day FROM u_merged)"""))
def merge_coverage(spark, sf):
    """Orders, days and durations of the merged set."""
    return merge.coverage(merge.merge_pulls(frames.pulls(spark, sf)))


@query("merge_lost_identities", sql(f"""
SELECT source_file, {_KEY} FROM u_pulls p WHERE NOT EXISTS (SELECT 1 FROM u_merged m WHERE m.k_opened = p.k_opened
  AND m.k_table = p.k_table AND m.k_guests = p.k_guests AND m.occurrence = p.occurrence)"""))
def merge_lost_identities(spark, sf):
    """Orders of a pull that the merged set lacks: none."""
    rows = frames.pulls(spark, sf)
    return merge.lost_identities(rows, merge.merge_pulls(rows))


@query("partial_merge_lost_identities", sql(f"""
SELECT source_file, {_KEY} FROM u_pulls p WHERE NOT EXISTS (SELECT 1 FROM u_pulls m WHERE m.pull_rank < 2 AND m.k_opened = p.k_opened
  AND m.k_table = p.k_table AND m.k_guests = p.k_guests AND m.occurrence = p.occurrence)"""))
def partial_merge_lost_identities(spark, sf):
    """Orders that a merge without the last pull would lose."""
    rows = frames.pulls(spark, sf)
    return merge.lost_identities(rows, merge.merge_pulls(rows.where("pull_rank < 2")))


# --- the same from export files: two layouts, repeated headers, an extra column --------------------

cte("l_rows", f"""
SELECT kind, event_id, event_id // {S.FILE_ROWS} AS n, kind * 1000000000 + event_id // {S.FILE_ROWS} AS pull_rank,
  printf(CASE WHEN kind = 0 THEN '{S.LEGACY_FILES[0]}' ELSE '{S.LEGACY_FILES[1]}' END, event_id // {S.FILE_ROWS}) AS source_file,
  date_trunc('hour', ts) + INTERVAL {S.VISIT_SHIFT_DAYS} DAY AS opened, 1 + event_id % 8 AS guests,
  {literal(S.TABLE_CODES)}[user_id % 40 + 1] AS table_code, event_id % 7 * 100 AS discount_c, v AS amount_c,
  v * 8 // 100 AS tax_c, event_id % 9 * 100 + kind * 100 AS tip_c, 0 AS gratuity_c,
  v + v * 8 // 100 + event_id % 9 * 100 + kind * 100 AS total_c,
  date_trunc('hour', ts) + INTERVAL {S.VISIT_SHIFT_DAYS + 1} DAY AS closed,
  CASE WHEN kind = 0 THEN printf('1:%02d:00', event_id % 60) END AS duration_text,
  CASE WHEN kind = 1 THEN 'S' || event_id % 4 END AS server
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events), (VALUES (0), (1)) AS k(kind)
WHERE kind = 0 OR event_id % 3 = 0""")
cte("l_pulls", """
SELECT *, row_number() OVER (PARTITION BY source_file, opened, coalesce(table_code, ''), guests
    ORDER BY amount_c, discount_c, event_id) - 1 AS occurrence,
  opened AS k_opened, coalesce(table_code, '') AS k_table, guests AS k_guests FROM l_rows""")
_LEGACY = ["opened", "guests", "table_code", "discount_c", "amount_c", "tax_c", "tip_c", "gratuity_c", "total_c", "closed",
           "duration_text", "server", "source_file"]
cte("l_merged", f"""
SELECT {_KEYS}, {', '.join(f'arg_max({c}, pull_rank) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in _LEGACY)}
FROM l_pulls GROUP BY {_KEYS}""")


def _legacy_files(spark, sf):
    return exports.describe_files(S.legacy_files(spark, sf))


@query("legacy_merged", sql(f"""
SELECT {_KEY}, {_ROW}, {f('total_c / 100.0', 'total')}, server AS "Server" FROM l_merged"""))
def legacy_merged(spark, sf):
    """Export files without ids, merged: tax from total, total from tax, the extra column carried."""
    return legacy.build(_legacy_files(spark, sf))


@query("legacy_gaps_by_table", sql(f"""
SELECT table_code, {i('count(*)', 'turns')}, {f('median(gap)', 'median_gap')}, {f('avg(gap)', 'mean_gap')} FROM (
  SELECT table_code, date_diff('second', opened + to_seconds(60 * (60 + CAST(duration_text[3:4] AS BIGINT))),
      lead(opened) OVER (PARTITION BY table_code, day ORDER BY opened, guests, occurrence)) / 60.0::DOUBLE AS gap
  FROM (SELECT *, CAST(opened - INTERVAL 4 HOUR AS DATE) AS day FROM l_merged)
  WHERE amount_c > 0 AND guests <= 20 AND table_code IS DISTINCT FROM 'BD4' AND table_code IS NOT NULL)
WHERE gap >= 0 GROUP BY table_code"""))
def legacy_gaps_by_table(spark, sf):
    """From export files to turn gaps: merged, cleaned, turned."""
    seated = cleaning.clean_orders(legacy.visits(legacy.build(_legacy_files(spark, sf))), floorplan.unit_dimension(spark))
    return turns.gap_summary(turns.add_turn_gaps(cleaning.above_duration_floor(seated)), "table_code")


@query("merge_export_form", sql(f"""
SELECT strftime(opened, '%m/%d/%y %I:%M %p') AS "Opened", {i('guests', '"# of Guests"')}, table_code AS "Table",
  {f('discount_c / 100.0', '"Discount Amount"')}, {f('amount_c / 100.0', '"Amount"')}, {f('tip_c / 100.0', '"Tip"')},
  {f('gratuity_c / 100.0', '"Gratuity"')}, strftime(closed, '%m/%d/%y %I:%M %p') AS "Closed",
  {f('tax_c / 100.0', '"Tax"')}, {f('CASE WHEN tip_c IS NOT NULL THEN amount_c + tax_c + tip_c + gratuity_c END / 100.0', '"Total"')},
  duration_text AS "Duration (Opened to Paid)", source_file AS "Source_File" FROM u_merged"""))
def merge_export_form(spark, sf):
    """The merged set in export columns and formats."""
    merged = merge.merge_pulls(frames.pulls(spark, sf))
    total = measures.missing_total(*[F.col(c) for c in ("amount", "tax", "tip", "gratuity")], F.lit(None))
    return merge.export_form(merged.withColumn("total", total.cast("decimal(12,2)")))


_MERGED_DAYS = "(SELECT DISTINCT CAST(opened - INTERVAL 4 HOUR AS DATE) AS day FROM u_merged)"
_RUNS = """SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (
  SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM {days} AS q) GROUP BY island"""


def _merged_days(spark, sf):
    return merge.with_service_date(merge.merge_pulls(frames.pulls(spark, sf)))


@query("contiguous_runs", sql(f"""
SELECT {d('first_day')}, {d('last_day')}, {i('days')} FROM ({_RUNS.format(days=_MERGED_DAYS)})"""))
def contiguous_runs(spark, sf):
    """Runs of consecutive service days that the merged set covers."""
    return merge.contiguous_runs(_merged_days(spark, sf))


@query("missing_runs", sql(f"""
SELECT {d('first_day')}, {d('last_day')}, {i('days')} FROM ({_RUNS.format(days=f'''(
  SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS x FROM {_MERGED_DAYS} AS e)
  WHERE CAST(x AS DATE) NOT IN (SELECT day FROM {_MERGED_DAYS} AS e))''')}) WHERE days >= 2"""))
def missing_runs(spark, sf):
    """Runs of at least two service days that no pull covers."""
    return merge.missing_runs(_merged_days(spark, sf))


@query("days_without_duration", sql(f"""
SELECT {d('day', 'service_date')} FROM (SELECT CAST(opened - INTERVAL 4 HOUR AS DATE) AS day, duration_text
  FROM u_merged) GROUP BY day HAVING count(duration_text) = 0"""))
def days_without_duration(spark, sf):
    """Service days on which no merged order has a duration."""
    return merge.blind_days(merge.merge_pulls(frames.pulls(spark, sf)))


@query("merge_revenue_drift", sql(f"""
SELECT {d('day', 'service_date')}, source_file, {f('merged / 100.0', 'merged_amount')}, {f('own / 100.0', 'source_amount')},
  {f('abs(merged - own) / 100.0', 'drift')} FROM
  (SELECT CAST(opened - INTERVAL 4 HOUR AS DATE) AS day, min(source_file) AS source_file, sum(amount_c) AS merged
   FROM u_merged GROUP BY 1 HAVING count(DISTINCT source_file) = 1)
JOIN (SELECT CAST(opened - INTERVAL 4 HOUR AS DATE) AS day, source_file, sum(amount_c) AS own FROM u_pulls GROUP BY 1, 2)
USING (day, source_file)"""))
def merge_revenue_drift(spark, sf):
    """Revenue on days whose merged rows come from one pull."""
    rows = frames.pulls(spark, sf)
    return merge.revenue_drift(rows, merge.merge_pulls(rows))
