"""Staging and the stored layers, against expectations computed from the rules."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from servicenight import rules
from servicenight.operators import facts, floorplan, staging
from servicenight.sources import warehouse
from tests.fixtures import Venue, clock, line, span


@pytest.fixture
def venue(spark, tmp_path):
    return Venue(spark, tmp_path)


def staged(venue):
    venue.load()
    return staging.stage_orders(venue.raw("C"))


def test_the_preferred_copy(venue):
    """Later range end, then later load, then earlier line; files without a range come last."""
    names = ["OrderDetails_2026_02_01-2026_02_20.csv", "OrderDetails_2025_12_01-2026_01_05.csv", "copy.csv", "another.csv",
             "OrderDetails_2026_02_05-2026_02_20.csv"]
    r = random.Random(4)
    expected, ends = {}, [dt.date(2026, 2, 20), dt.date(2026, 1, 5), None, None, dt.date(2026, 2, 20)]
    for load, (name, end) in enumerate(zip(names, ends)):
        lines = []
        for position in range(12):
            order, amount = r.randrange(8), f"{r.randrange(10, 90)}.{load}{position % 10}"
            lines.append(line("C", Order_Id=order, Amount=amount))
            best = ((end is not None, end or dt.date.min), load, -position, Decimal(amount))
            expected.setdefault(order, []).append(best)
        venue.write(name, "C", *lines)
        venue.load()
    got = {o.order_id: (o.amount, o.copies_in_raw) for o in staged(venue).collect()}
    assert got == {order: (max(copies)[3], len(copies)) for order, copies in expected.items()}


def test_service_days_turn_at_the_cutoff(venue):
    instants = [dt.datetime(2026, month, day) + dt.timedelta(hours=rules.SERVICE_CUTOFF_HOURS, minutes=shift)
                for month, day in ((1, 1), (3, 1), (12, 31)) for shift in (-200, -1, 0, 1, 700)]
    venue.write("t.csv", "C", *[line("C", Order_Id=k, Opened=clock(t)) for k, t in enumerate(instants)])
    got = {r.order_id: (r.opened_at, r.service_date) for r in staged(venue).collect()}
    assert got == {k: (t, (t - dt.timedelta(hours=rules.SERVICE_CUTOFF_HOURS)).date()) for k, t in enumerate(instants)}


def test_durations_and_flags(venue):
    edge = rules.LONG_SESSION_SECONDS
    lengths = [0, 1, 59, 61, 3599, edge - 1, edge, edge + 1, 30 * edge + 7, -1, -60, -edge - 11]
    texts = [span(s) for s in lengths] + ["", "soon", "1:2", "1:00:00 "]
    venue.write("d.csv", "C", *[line("C", Order_Id=k, Duration=t) for k, t in enumerate(texts)])
    minutes = lambda s: (Decimal(s) / 60).quantize(Decimal("0.01"), ROUND_HALF_UP)
    wanted = [(minutes(s), s > edge, s < 0, 0 <= s <= edge) for s in lengths] + [(None, None, None, False)] * 4
    got = {r.order_id: (r.duration_minutes, r.is_long_session, r.is_negative_duration, r.duration_usable) for r in staged(venue).collect()}
    assert got == dict(enumerate(wanted))


def test_blank_cells_and_number_lists(venue):
    venue.write("b.csv", "C", line("C", Order_Id=1, Table="", Closed="", Checks="40, 7,  12"), line("C", Order_Id=2, Checks=""))
    got = {r.order_id: r for r in staged(venue).collect()}
    assert (got[1].table_code, got[1].closed_at, got[1].check_numbers) == (None, None, [40, 7, 12])
    assert got[2].check_numbers == [] and got[2].table_code == "O6"


def test_a_bad_number_is_an_error(venue):
    venue.write("n.csv", "C", line("C", Guests="several"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        staged(venue).collect()


def test_items_of_both_layouts(venue):
    venue.write("first.csv", "ITEM", line("ITEM", Item_Selection_Id=11, Net_Price="8.00"), line("ITEM", Item_Selection_Id=12, Net_Price="3.00"))
    venue.load()
    venue.write("second.csv", "ITEM_B", line("ITEM_B", Item_Selection_Id=12, Net_Price="5.00"), line("ITEM_B", Item_Selection_Id=13, Void="true", Qty="0.5"))
    venue.load()
    items = staging.stage_items(venue.raw("ITEM"), venue.raw("ITEM_B"))
    got = {r.item_selection_id: (r.net_price, r.is_void, r.qty, r.copies_in_raw) for r in items.collect()}
    assert got == {11: (Decimal("8.00"), False, Decimal("1.00"), 1), 12: (Decimal("5.00"), False, Decimal("1.00"), 2),
                   13: (Decimal("9.50"), True, Decimal("0.50"), 1)}


def placement(code, day, guests):
    """Fit, unit and seats by trying every option that is in force."""
    live = lambda row: row[-2] <= day and (row[-1] is None or day < row[-1])
    table = next((t for t in rules.FLOOR_PLAN_TABLES if t[0] == code and live(t)), None)
    if code is None:
        return "no_table", None, None
    if table is None:
        return "unknown_table", None, None
    if table[1] == "Bar":
        return "bar", None, None
    if guests <= table[3]:
        return "table", code, table[3]
    options = [(c[3], len(c[2]), c[0], c[4]) for c in rules.FLOOR_PLAN_COMBINATIONS if code in c[2] and live(c)]
    for whole_room, fit in ((False, "combination"), (True, "whole_room")):
        enough = sorted(o for o in options if o[3] == whole_room and o[0] >= guests)
        if enough:
            return fit, enough[0][2], enough[0][0]
    largest = min(options, key=lambda o: (-o[0], not o[3], o[2]), default=(table[3], 1, code, False))
    return "over_capacity", largest[2], largest[0]


def test_placement_of_every_code_and_party_around_every_change(spark):
    changes = sorted({d for row in rules.FLOOR_PLAN_TABLES for d in row[-2:] if d})
    days = sorted({c + dt.timedelta(days=shift) for c in changes for shift in (-1, 0, 1)})
    codes = sorted({row[0] for row in rules.FLOOR_PLAN_TABLES}) + [None, "Z9"]
    cases = [(k, day, code, guests) for k, (day, code, guests) in enumerate(
        (d, c, g) for d in days for c in codes for g in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15, 31))]
    orders = spark.createDataFrame(cases, "order_id long, service_date date, table_code string, guests int")
    placed = floorplan.place_orders(orders, floorplan.tables(spark), floorplan.combinations(spark))
    got = {r.order_id: (r.seating_fit, r.seating_unit, r.unit_seats) for r in placed.collect()}
    assert got == {k: placement(code, day, guests) for k, day, code, guests in cases}


def test_full_refresh_and_what_is_kept_of_it(venue, spark):
    """Exports to facts, SQL and period reads; a failed refresh changes nothing."""
    r = random.Random(9)
    orders, lines = {}, []
    for k in range(60):
        opened = dt.datetime(2025, 11, 1, 18) + dt.timedelta(days=k)
        guests, seconds = r.choice([0, 1, 2]), r.choice([300, 899, 900, 5000, rules.LONG_SESSION_SECONDS + 60])
        amount, table = Decimal(r.randrange(30000, 50000)) / 100, r.choice(["O6", ""])
        orders[k] = (opened.date(), guests, seconds, amount, table)
        lines.append(line("C", Order_Id=k, Opened=clock(opened), Guests=guests, Amount=amount, Table=table, Duration=span(seconds)))
    venue.write("orders.csv", "C", *lines)
    sold = [line("ITEM_B", Order_Id=k if k < 60 else 10_000, Sent_Date=clock(dt.datetime(2025, 11, 1, 19) + dt.timedelta(days=k)),
                 Menu_Item="Cider", Gross_Price=price, Net_Price=price) for k in range(62) for price in ["7.00" if k < 30 else "8.25"]]
    venue.write("items.csv", "ITEM_B", *sold)
    warehouse.load_and_refresh(spark, str(venue.exports), venue.root)

    places = lambda value: value.quantize(Decimal("0.0001"), ROUND_HALF_UP)
    for f in warehouse.read(spark, venue.root, "analytics/fact_order").collect():
        day, guests, seconds, amount, table = orders[f.order_id]
        kind = "Seated" if table else "Event-Catering" if amount >= rules.EVENT_AMOUNT else "To-Go"
        gate = bool(table) and guests > 0 and rules.DURATION_FLOOR_MINUTES * 60 <= seconds <= rules.LONG_SESSION_SECONDS
        minutes = (Decimal(seconds) / 60).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert (f.order_type, f.in_time_metrics, f.date_key) == (kind, gate, int(f"{day:%Y%m%d}"))
        assert f.vpcpm == (places(amount * 15 / (guests * minutes)) if gate else None)

    sql = """SELECT m.list_price, count(*) AS n, count(f.minutes_after_open) AS linked, min(f.date_key) AS first
             FROM fact_item_selection f JOIN dim_menu_item m USING (menu_item_key) WHERE m.menu_item = :item GROUP BY 1"""
    got = {x.list_price: (x.n, x.linked) for x in warehouse.query(spark, venue.root, sql, item="Cider").collect()}
    assert got == {Decimal("7.00"): (30, 30), Decimal("8.25"): (32, 30)}

    december = warehouse.read_days(spark, venue.root, "analytics/fact_order", dt.date(2025, 12, 5), dt.date(2025, 12, 31))
    assert december.count() == sum(dt.date(2025, 12, 5) <= o[0] <= dt.date(2025, 12, 31) for o in orders.values())
    plan = december._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and "(month_key" in plan

    before = sorted(map(str, warehouse.read(spark, venue.root, "analytics/fact_order").collect()))
    current = warehouse.current(spark, venue.root)
    half = f"{venue.root}/versions/29990101T000000-dead/analytics/fact_order"
    spark.range(3).write.parquet(half)  # a refresh that died before its end
    assert warehouse.current(spark, venue.root) == current
    for _ in range(3):
        venue.refresh()
    assert sorted(map(str, warehouse.read(spark, venue.root, "analytics/fact_order").collect())) == before
    assert len(warehouse.versions(spark, venue.root)) == 2


def test_dates_of_an_empty_venue_are_today(spark):
    empty = spark.createDataFrame([], "service_date date")
    assert facts.date_dimension(empty).count() == 1
