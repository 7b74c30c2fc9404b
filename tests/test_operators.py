"""Operators on small frames, against values worked out by hand or by brute force."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from servicenight import rules
from servicenight.functions import calendar, measures, parse
from servicenight.operators import (cleaning, floorplan, hours, menu, merge, occupancy, ordering, prices,
                                    rates, regression, staging, turns)

NIGHT = dt.datetime(2026, 1, 10, 18, 0)


def at(minutes, day=0):
    return NIGHT + dt.timedelta(minutes=minutes, days=day)


def visits(spark, rows):
    """(order_id, opened, table, guests, amount, seconds)"""
    raw = spark.createDataFrame(
        [(i, o, t, g, Decimal(str(a)), s) for i, o, t, g, a, s in rows],
        "order_id bigint, opened_at timestamp_ntz, table_code string, guests int, amount decimal(10,2), "
        "duration_seconds bigint")
    return cleaning.clean_orders(raw, floorplan.unit_dimension(spark))


def column(df, name, order="order_id"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_clock_text(spark):
    texts = ["1/2/26 12:05 AM", "1/2/26 12:05 PM", "1/2/26 13:05 PM", "1/2/2026 1:05 PM", "1/2/26 1:05 pm",
             "1/2/26 1:05 PM\n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "order_id int, t string")
    got = column(df.select("order_id", parse.parse_clock(F.col("t")).alias("c")), "c")
    assert got == [dt.datetime(2026, 1, 2, 0, 5), dt.datetime(2026, 1, 2, 12, 5), dt.datetime(2026, 1, 2, 13, 5),
                   None, None, None, None, None]


def test_file_dates(spark):
    names = ["OrderDetails_2025_10_24-2026_01_15.csv", "OrderDetails_2025_10_24-2026_01_15 (1).csv", "x.csv"]
    df = spark.createDataFrame(list(enumerate(names)), "order_id int, f string")
    assert column(df.select("order_id", parse.export_end_date(F.col("f")).alias("d")), "d") == [
        dt.date(2026, 1, 15), None, None]
    assert column(df.select("order_id", parse.pull_end_date(F.col("f")).alias("d")), "d") == [
        dt.date(2026, 1, 15), dt.date(2026, 1, 15), None]


def test_labels_and_bands(spark):
    df = spark.createDataFrame([(0, 1530, 25.0), (1, 1080, 25.1), (2, 60, 101.0)], "order_id int, m int, p double")
    out = df.select("order_id", calendar.clock_label(F.col("m")).alias("label"),
                    calendar.hour_span(F.floor(F.col("m") / 60)).alias("span"),
                    measures.fullness_band(F.col("p")).alias("band"))
    assert column(out, "label") == ["25:30", "18:00", "01:00"]
    assert column(out, "span") == ["1am-2am", "6pm-7pm", "1am-2am"]
    assert column(out, "band") == ["<25% full", "25-50%", None]


def test_guest_flag_is_three_valued(spark):
    df = spark.createDataFrame([(0, 13, None), (1, 31, None), (2, 13, "Bar"), (3, 12, "Bar")],
                               "order_id int, g int, s string")
    assert column(df.select("order_id", measures.guests_implausible(F.col("g"), F.col("s")).alias("f")), "f") == [
        None, True, True, False]


def test_turn_gaps(spark):
    rows = [(1, at(0), "O3", 2, 50, 3600), (2, at(75), "O3", 2, 50, 3600), (3, at(100), "O3", 2, 50, 3600),
            (4, at(0, 1), "O3", 2, 50, 3600), (5, at(0), None, 2, 50, 3600), (6, at(90), None, 2, 50, 3600)]
    turned = turns.add_turn_gaps(visits(spark, rows))
    assert column(turned, "turn_gap") == [15.0, None, None, None, None, None]
    assert column(turned, "turn_overlap") == [False, True, False, False, False, False]
    assert column(turned, "turn_index") == [1, 2, 3, 1, None, None]


@pytest.fixture
def many_ranges(spark):
    """Keep small ranges apart, as large ones would be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("hot_share", [0.34, 0.95])
def test_positions_in_hot_groups_equal_the_plain_window(spark, many_ranges, hot_share):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < hot_share else rng.choice(["a", "b", None]),
             rng.randrange(50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "order_id bigint, k string, t int").repartition(6)
    order = [F.col("t"), F.col("order_id")]
    window = Window.partitionBy("k").orderBy(*order)
    plain = df.select("*", F.row_number().over(window).cast("bigint").alias("pos"),
                      F.lead("t").over(window).alias("next_t"), F.lead("order_id").over(window).alias("next_id"))
    ranged = ordering.with_position(df, ["k"], order, "pos", {"next_t": "t", "next_id": "order_id"})
    key = lambda r: r.order_id
    assert sorted(plain.collect(), key=key) == sorted(ranged.select(*plain.columns).collect(), key=key)


def test_turn_gaps_read_the_visits_once(spark):
    rows = [(k, at(k), "O3" if k % 3 else None, 2, 50, 600) for k in range(50)]
    path = spark.sparkContext.getCheckpointDir() + "/visits_read_once"
    visits(spark, rows).write.mode("overwrite").parquet(path)
    seen = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    turned = turns.add_turn_gaps(spark.read.parquet(path))
    plan = turned._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Union" not in plan  # the stored ranges are all that is left to read
    assert turned.count() == 50 and spark.sparkContext._jsc.sc().getPersistentRDDs().size() == seen


def test_hot_groups_are_spread_over_tasks(spark, many_ranges):
    df = spark.range(4000).withColumns({"k": F.lit("hot"), "t": F.col("id") % 7})
    ranged = df.repartitionByRange("k", "t", "id")
    sizes = [r[0] for r in ranged.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) < 1200


def test_consecutive_numbers(spark, many_ranges):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    got = ordering.number_rows(df, [F.col("v")], "n").collect()
    assert sorted((r.v, r.n) for r in got) == [(i, i + 1) for i in range(1000)]


def test_cleaning(spark):
    raw = spark.createDataFrame(
        [(1, at(0), "O3", 2, Decimal(10), 60), (1, at(0), "O3", 2, Decimal(10), 60), (2, at(0), "BD4", 2, Decimal(10), 60),
         (3, at(0), None, 2, Decimal(10), 60), (4, at(0), "O3", 21, Decimal(10), 60), (5, at(0), "O3", 2, Decimal(0), 60),
         (6, at(0), "O3", None, Decimal(10), 60)],
        "order_id bigint, opened_at timestamp_ntz, table_code string, guests int, amount decimal(10,2), duration_seconds bigint")
    kept = cleaning.clean_orders(raw, floorplan.unit_dimension(spark))
    assert column(kept, "order_id") == [1, 3]
    assert column(kept, "section") == ["Open Lounge", "Unknown/To-Go"]
    assert tuple(cleaning.cleaning_report(raw).first()) == (7, 1, 1, 1, 2)


def test_occupancy_counts_the_slot_a_stay_ends_in(spark):
    occ = occupancy.build_occupancy(visits(spark, [(1, at(0), "E1", 2, 100, 3600), (2, at(7), "E2", 2, 30, 600),
                                                   (3, at(0), "O3", 2, 99, 7 * 3600)]))
    first = occ.where("table_code = 'E1'").orderBy("slot").collect()
    assert [r.slot for r in first] == [72, 73, 74, 75, 76]
    assert {r.slot_revenue for r in first} == {20.0} and first[0].clock_label == "18:00"
    assert [r.slot for r in occ.where("table_code = 'E2'").orderBy("slot").collect()] == [72, 73]
    assert occ.where("table_code = 'O3'").count() == 0
    room = {r.slot: r.tables_occupied for r in occupancy.room_fullness(occ).collect()}
    assert room[72] == 2 and room[74] == 1


def test_best_block_fills_quiet_slots_and_needs_a_full_window(spark):
    short = [(1, at(0), "E1", 2, 100, 3600)]
    long = [(2, at(0, 1), "E1", 2, 50, 3540), (3, at(210, 1), "E1", 2, 80, 3540)]
    blocks = occupancy.best_blocks(occupancy.build_occupancy(visits(spark, short + long))).collect()
    assert [(r.service_date, round(r.best_block, 6)) for r in blocks] == [(dt.date(2026, 1, 11), 80.0)]


def test_hour_spread(spark):
    opened = dt.datetime(2026, 1, 10, 21, 30)
    typed = spark.createDataFrame(
        [(1, opened, "O3", Decimal("300.00"), 7200), (2, opened, "O3", Decimal("40.00"), None),
         (3, dt.datetime(2026, 1, 10, 10, 30), "O3", Decimal("60.00"), 3600)],
        "order_id bigint, opened_at timestamp_ntz, table_code string, amount decimal(10,2), duration_seconds bigint")
    orders = staging.with_order_flags(typed).withColumn("order_type", F.lit("Seated"))
    got = {(r.order_id, r.hour): r.revenue for r in hours.revenue_by_hour(
        hours.seated_on_trading_days(orders)).collect()}
    assert got == {(1, 21): 75.0, (1, 22): 150.0, (1, 23): 75.0, (2, 21): 40.0, (3, 11): 30.0}
    assert tuple(hours.unplaced_revenue(orders).first()) == (400.0, 370.0, 30.0)


def sale(item, when, price, qty=1, void=False, group="Cocktails"):
    p = Decimal(str(price))
    return (item, when, p, Decimal(0), p, Decimal(qty), void, group, "Menu", "Liquor")


def sales(spark, *rows):
    return spark.createDataFrame(list(rows), "menu_item string, sent_at timestamp_ntz, gross_price decimal(10,2), "
                                 "discount decimal(10,2), net_price decimal(10,2), qty decimal(6,2), is_void boolean, "
                                 "menu_group string, menu string, sales_category string")


def day(month, d, hour=19):
    return dt.datetime(2026, month, d, hour)


def versions(spark, *rows):
    found = prices.price_versions(prices.price_counts(sales(spark, *rows))).orderBy("menu_item", "valid_from")
    return [(r.menu_item, r.list_price, r.valid_from, r.valid_to) for r in found.collect()]


def test_price_versions(spark):
    # counts per month and price, drawn at random; the expectation follows the definition sale by sale
    rng = random.Random(12)
    rows, expected = [], []
    for item in (f"Item {k}" for k in range(25)):
        sold = []
        for month in range(1, 7):
            for price in (11, 12, 13):
                for _ in range(rng.choice([0, 0, 1, 2, 4])):
                    kind = rng.choice(["clean"] * 6 + ["void", "double"])
                    sold.append((dt.datetime(2026, month, rng.randrange(1, 28), rng.randrange(12, 24), rng.randrange(60), rng.randrange(60)), price, kind))
        rows += [sale(item, t, p * (2 if k == "double" else 1), qty=2 if k == "double" else 1, void=k == "void") for t, p, k in sold]
        if not sold:
            continue
        clean, seen = sorted((t, p) for t, p, k in sold if k == "clean"), min(t for t, _, _ in sold)
        dominant = lambda chosen: next((p for p in (11, 12, 13) if 2 * sum(q == p for _, q in chosen) > len(chosen)), None)
        steps, last = [], None
        for month in range(1, 7):
            chosen = [c for c in clean if c[0].month == month]
            price = dominant(chosen) if len(chosen) >= 3 else None
            if price and price != last:
                steps.append((price, next(t for t, p in chosen if p == price)))
                last = price
        steps = [(steps[0][0], seen), *steps[1:]] if steps else [(dominant(clean), seen)]
        night = lambda t: (t - dt.timedelta(hours=rules.SERVICE_CUTOFF_HOURS)).date()
        for (price, start), after in zip(steps, [*[s for _, s in steps[1:]], None]):
            if after is None or night(after) > night(start):
                expected.append((item, price and Decimal(price), night(start), after and night(after)))
    assert versions(spark, *rows) == sorted(expected, key=lambda r: (r[0], r[2]))


def test_two_changes_on_one_service_day_keep_the_later(spark):
    night = dt.datetime(2026, 5, 31, 21)
    before = [sale("Tea", night + dt.timedelta(minutes=m), 4) for m in range(3)]
    after = [sale("Tea", night + dt.timedelta(hours=h), 5) for h in (4, 30, 54)]
    assert versions(spark, *before, *after) == [("Tea", Decimal(5), dt.date(2026, 5, 31), None)]


def test_version_description_takes_the_mode_and_the_smallest_on_a_tie(spark):
    rows = [sale("Gin", day(1, d), 10, group=g) for d, g in ((5, "B"), (6, "A"), (7, None), (8, "A"), (9, "B"))]
    items = sales(spark, *rows)
    [row] = prices.menu_item_dimension(items).collect()
    assert (row.menu_item_key, row.menu_group, row.menu, row.is_current) == (1, "A", "Menu", True)


def pull(rank, line, table="O1", guests=2, tip=None, duration=None, amount=50, discount=0, name=None, chunk=0):
    return (dt.datetime(2026, 6, 5, 18, 37), guests, table, Decimal(discount), Decimal(amount),
            None if tip is None else Decimal(str(tip)), duration, name or f"pull{rank}.csv", rank, line, chunk)


def pulls(spark, *rows):
    return spark.createDataFrame(list(rows), "opened timestamp_ntz, guests int, table_code string, "
                                 "discount_amount decimal(12,2), amount decimal(12,2), tip decimal(12,2), "
                                 "duration_text string, source_file string, pull_rank int, source_row_number bigint, "
                                 "source_chunk int")


def test_merge_takes_the_newest_supplied_value_per_field(spark):
    rows = pulls(spark,
                 pull(0, 2, tip="23.70", duration="1:00:00"), pull(0, 9, tip="23.70", duration="1:00:00", chunk=1),
                 pull(0, 3, table=None, guests=None, amount=10), pull(1, 2, tip="47.38"),
                 pull(1, 5, amount=70, tip=1), pull(1, 4, amount=60, tip=1))
    kept = merge.drop_chunk_duplicates(rows)
    assert kept.count() == 5
    numbered = merge.add_occurrence(kept)
    merged = merge.merge_pulls(numbered)
    got = {(r.k_table, r.k_guests, r.occurrence): (r.tip, r.duration_text, r.amount, r.source_file) for r in merged.collect()}
    assert got == {
        ("O1", 2, 0): (Decimal("47.38"), "1:00:00", Decimal(50), "pull1.csv"),
        ("O1", 2, 1): (Decimal(1), None, Decimal(60), "pull1.csv"),
        ("O1", 2, 2): (Decimal(1), None, Decimal(70), "pull1.csv"),
        ("", -1, 0): (None, None, Decimal(10), "pull0.csv")}
    stats = {r.source_file: (r.rows, r.first_seen, r.superseded, r.confirmed)
             for r in merge.supersession(numbered, merged).collect()}
    assert stats == {"pull0.csv": (2, 2, 1, 0), "pull1.csv": (3, 2, 0, 0)}
    assert merge.lost_identities(numbered, merged).count() == 0


def test_runs_of_days(spark):
    days = [dt.date(2026, 1, d) for d in (1, 2, 3, 6, 7, 9, 13)]
    df = spark.createDataFrame([(d,) for d in days], "service_date date")
    runs = sorted((r.first_day.day, r.last_day.day) for r in merge.contiguous_runs(df).collect())
    assert runs == [(1, 3), (6, 7), (9, 9), (13, 13)]
    assert sorted((r.first_day.day, r.last_day.day, r.days) for r in merge.missing_runs(df).collect()) == [
        (4, 5, 2), (10, 12, 3)]


def test_shrinkage_errors_equal_the_row_by_row_definition(spark):
    rng = np.random.default_rng(3)
    rows = [("S", int(g), float(v)) for g, v in zip(rng.integers(1, 5, 60), rng.normal(2, 1, 60))] + [("S", 9, 4.0)]
    df = spark.createDataFrame(rows, "section string, guests int, v double")
    got = {int(r.k): r.error for r in rates.loocv_errors(rates.group_statistics(df, "v")).collect()}
    for k in rules.SHRINKAGE_GRID:
        error = 0.0
        for i, (_, g, v) in enumerate(rows):
            mates = [x for j, (_, h, x) in enumerate(rows) if h == g and j != i]
            others = [x for j, (_, _, x) in enumerate(rows) if j != i]
            if mates:
                w = len(mates) / (len(mates) + k)
                error += (v - w * np.mean(mates) - (1 - w) * np.mean(others)) ** 2
        assert got[k] == pytest.approx(error)


def test_robust_fit_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 300
    frame = pd.DataFrame({"d": rng.choice(["Friday", "Sunday", "Tuesday"], n), "x": rng.normal(0, 2, n)})
    frame["y"] = 1 + 0.5 * frame.x + (frame.d == "Sunday") * 2 + rng.normal(0, 1 + np.abs(frame.x), n)
    terms = [("d", ["Friday", "Sunday", "Tuesday"]), "x"]
    got = {r.term: r for r in regression.robust_fit(spark.createDataFrame(frame).repartition(5), terms, "y").collect()}
    x = np.column_stack([np.ones(n), frame.d == "Sunday", frame.d == "Tuesday", frame.x]).astype(float)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ frame.y.to_numpy()
    e = frame.y.to_numpy() - x @ beta
    error = np.sqrt(np.diag(inverse @ (x.T * e ** 2) @ x @ inverse * n / (n - 4)))
    for i, name in enumerate(["const", "d=Sunday", "d=Tuesday", "x"]):
        assert got[name].coefficient == pytest.approx(beta[i])
        assert got[name].std_error == pytest.approx(error[i])
        assert got[name].low == pytest.approx(beta[i] - regression.NORMAL_975 * error[i])
    r2 = regression.r_squared(spark.createDataFrame(frame), terms, "y").first().r2
    assert r2 == pytest.approx(1 - (e ** 2).sum() / ((frame.y - frame.y.mean()) ** 2).sum())


def test_month_trend_against_numpy(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2025-05-01", "2026-09-30")
    days = days[days.dayofweek != 0]
    frame = pd.DataFrame({"service_date": days.date, "day_name": days.day_name(), "month_of_year": days.month,
                          "years": (days - days[0]).days / 365.25, "temp_high_f": rng.normal(60, 15, len(days))})
    frame["revenue"] = np.exp(7 + 0.1 * frame.years + 0.02 * frame.month_of_year + rng.normal(0, .2, len(days)))
    nights = spark.createDataFrame(frame)
    row = regression.log_trend(nights, "revenue", "month", rules.TRADING_DAYS).first()
    names = sorted(rules.TRADING_DAYS)
    x = np.column_stack([np.ones(len(frame)), *[(frame.day_name == d) for d in names[1:]],
                         *[(frame.month_of_year == m) for m in range(2, 13)], frame.years]).astype(float)
    beta = np.linalg.lstsq(x, np.log(frame.revenue.to_numpy()), rcond=None)[0]
    assert row.coefficient_pct == pytest.approx(np.exp(beta[-1]) - 1)
    assert row.low_pct < row.coefficient_pct < row.high_pct


def test_section_totals(spark):
    got = {r.section: (r.seats, r.tables) for r in floorplan.section_capacity(floorplan.unit_dimension(spark)).collect()}
    assert {s: v[0] for s, v in got.items()} == rules.EXPECTED_SECTION_SEATS
    assert sum(got[s][1] for s in rules.RESERVATION_SECTIONS) == rules.RESERVATION_TABLES


def test_tax_switch(spark):
    until = rules.TAX_SWITCH_UNTIL
    switched = lambda p: round(Decimal(p) * Decimal(str(rules.TAX_SWITCH_FACTOR)), 2)
    start = until - dt.timedelta(days=40)
    dim = spark.createDataFrame(
        [("Tea", Decimal(8), start), ("Tea", switched(8), until), ("Ale", Decimal(6), start), ("Ale", switched(6) + 1, until),
         ("Ale", None, until + dt.timedelta(days=9)), ("Ale", Decimal(3), until + dt.timedelta(days=20)),
         ("Pie", Decimal(9), start), ("Pie", switched(9), until + dt.timedelta(days=1))],
        "menu_item string, list_price decimal(10,2), valid_from date")
    # the price after a gap has no step before it
    assert tuple(menu.price_step_summary(menu.price_steps(dim)).first()) == (3, 3, 3, 0, 1)
