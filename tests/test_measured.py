"""Checks of a refresh during its writes."""

import datetime as dt

import pytest

from servicenight.operators import facts
from servicenight.sources import measured, warehouse
from tests.fixtures import Venue, clock, line


@pytest.fixture
def venue(spark, tmp_path):
    made = Venue(spark, tmp_path)
    made.write("a.csv", "C", *[line("C", Order_Id=k) for k in range(1, 9)])
    made.write("i.csv", "ITEM_B", *[line("ITEM_B", Order_Id=k, Sent_Date=clock(dt.datetime(2026, 5, 1, 19, k)), Menu_Item="Cider",
                                         Gross_Price="7.00", Net_Price="7.00") for k in range(1, 9)])
    made.load()
    return made


def test_what_fits_is_read_no_second_time(venue, spark, monkeypatch):
    read = []
    original = measured.again
    monkeypatch.setattr(measured, "again", lambda taken, names, stored: (read.extend(names), original(taken, names, stored)))
    warehouse.refresh(spark, venue.root)
    assert read == [] and len(warehouse.versions(spark, venue.root)) == 1


@pytest.mark.parametrize("name, fault", [
    ("order_facts", lambda df: df.where("order_id <> 3")), ("order_facts", lambda df: df.union(df.where("order_id = 3"))),
    ("item_facts", lambda df: df.withColumn("net_price", df["net_price"] * 2))])
def test_a_fault_stops_the_switch(venue, spark, monkeypatch, name, fault):
    warehouse.refresh(spark, venue.root)
    before, original = warehouse.current(spark, venue.root), getattr(facts, name)
    with monkeypatch.context() as m:
        m.setattr(facts, name, lambda *args: fault(original(*args)))
        with pytest.raises(measured.BrokenRefresh):
            warehouse.refresh(spark, venue.root)
    assert warehouse.current(spark, venue.root) == before


def test_a_miscount_is_not_believed(venue, spark, monkeypatch):
    """Rows counted twice by a stage that ran again: the stored table decides."""
    class Twice(measured.Observation):
        @property
        def get(self):
            return {k: v * 2 if k == "rows" else v for k, v in super().get.items()}

    made = []

    def first_twice():
        made.append(Twice() if not made else original())
        return made[-1]

    original = measured.Observation
    monkeypatch.setattr(measured, "Observation", first_twice)
    warehouse.refresh(spark, venue.root)
    assert len(warehouse.versions(spark, venue.root)) == 1
