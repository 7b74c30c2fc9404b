"""Monthly order tables after single loads against tables refreshed as a whole."""

import pathlib

import pytest

from servicenight.sources import ledger, monthly, warehouse
from tests.fixtures import Venue, line


@pytest.fixture
def venue(spark, tmp_path):
    return Venue(spark, tmp_path)


def opened(month, day, hour="6:00 PM"):
    return f"{month}/{day}/26 {hour}"


def as_rows(frame, columns):
    return sorted((tuple(x) for x in frame.select(*columns).collect()), key=repr)


def equal_to_a_full_refresh(venue):
    whole = warehouse.refresh(venue.spark, venue.root)
    for name, full in (("orders", "orders"), ("order_seating", "order_seating"), ("fact_order", "fact_order")):
        columns = [c for c in whole[full].columns if c != "month_key"]
        assert as_rows(monthly.read(venue.spark, venue.root, name), columns) == as_rows(whole[full], columns), name
    dates = whole["dim_date"]
    assert as_rows(monthly.date_dimension(venue.spark, venue.root), dates.columns) == as_rows(dates, dates.columns)


def hide(venue, month):
    """Move a month's folders of the current version out of sight; return what brings them back."""
    moved = []
    for r in monthly.manifest(venue.spark, venue.root):
        if r.part == month:
            path = pathlib.Path(r.path.removeprefix("file:"))
            path.rename(path.with_name("away-" + path.name))
            moved.append(path)
    assert moved
    return lambda: [p.with_name("away-" + p.name).rename(p) for p in moved]


def test_late_copies_touch_their_months_alone(venue, spark):
    venue.write("first.csv", "C", *[line("C", n, Opened=opened(4 + n % 4, 1 + n), Table="O6") for n in range(12)])
    venue.write("items.csv", "ITEM", line("ITEM", 1))
    venue.load()
    assert monthly.refresh(spark, venue.root)["orders"] == [202604, 202605, 202606, 202607]
    assert monthly.refresh(spark, venue.root) == {}
    # an amended order of April, one that moves from May to July over midnight rules, a new one in August
    venue.write("late.csv", "C", line("C", 0, Opened=opened(4, 1), Amount="99.00", Table="O7"),
                line("C", 1, Opened=opened(7, 3, "1:30 AM")), line("C", 40, Opened=opened(8, 2)))
    venue.load()
    bring_back = hide(venue, 202606)
    written = monthly.refresh(spark, venue.root)
    bring_back()
    assert written["orders"] == written["fact_order"] == [202604, 202605, 202607, 202608]
    equal_to_a_full_refresh(venue)
    amended = monthly.read(spark, venue.root, "orders").where("order_id = 70000").first()
    assert (float(amended.amount), amended.copies_in_raw) == (99.0, 2)

    # an older copy that comes late changes nothing but the count; a month may lose its last order
    venue.write("OrderDetails_2026_01_01-2026_12_31.csv", "C", line("C", 40, Opened=opened(9, 2)))
    venue.load()
    monthly.refresh(spark, venue.root)
    venue.write("zz.csv", "C", line("C", 40, Opened=opened(8, 2)))
    venue.load()
    assert monthly.refresh(spark, venue.root)["orders"] == [202609]
    equal_to_a_full_refresh(venue)
    assert len(monthly.versions(spark, venue.root)) == 2


def test_a_period_reads_its_months(venue, spark):
    import datetime as dt
    venue.write("a.csv", "C", *[line("C", n, Opened=opened(3 + n, 5)) for n in range(4)])
    venue.load()
    monthly.refresh(spark, venue.root)
    bring_back = hide(venue, 202603)
    rows = monthly.read_days(spark, venue.root, dt.date(2026, 4, 1), dt.date(2026, 5, 31)).count()
    bring_back()
    assert rows == 2


def test_a_refresh_that_dies_leaves_the_version_before(venue, spark, monkeypatch):
    venue.write("a.csv", "C", line("C", 1))
    venue.load()
    monthly.refresh(spark, venue.root)
    venue.write("b.csv", "C", line("C", 2))
    venue.load()
    with monkeypatch.context() as m:
        m.setattr(monthly, "_index", lambda orders: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            monthly.refresh(spark, venue.root)
    assert monthly.read(spark, venue.root, "orders").count() == 1
    monthly.refresh(spark, venue.root)
    assert monthly.read(spark, venue.root, "orders").count() == ledger.read_raw(spark, venue.root, "C").count() == 2
