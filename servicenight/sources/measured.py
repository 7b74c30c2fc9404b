"""Checks of a refresh that cost no scan: each table is measured while it is written.

The measures ride along with the write (``DataFrame.observe``). A stage that runs again after the
loss of an executor can count rows twice, so what does not fit is measured again from the stored
table before it is believed; a table that fits is read no second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, functions as F

#: Taken of each table as it is written.
MEASURES = {
    "staging/orders": {"rows": "count(1)", "amount": "sum(amount)", "without_id": "count_if(order_id IS NULL)", "undated": "count_if(service_date IS NULL)"},
    "staging/item_selections": {"rows": "count(1)", "net": "sum(net_price)", "without_id": "count_if(item_selection_id IS NULL)"},
    "staging/order_seating": {"rows": "count(1)"},
    "analytics/dim_menu_item": {"without_key": "count_if(menu_item_key IS NULL)"},
    "analytics/fact_order": {"rows": "count(1)", "amount": "sum(amount)", "undated": "count_if(date_key IS NULL)"},
    "analytics/fact_item_selection": {"rows": "count(1)", "net": "sum(net_price)"},
}
#: Measures that are equal in two tables: no row and no dollar is lost or doubled on the way to the facts.
EQUAL = [("staging/orders", "analytics/fact_order", measure) for measure in ("rows", "amount", "undated")] + [
    ("staging/orders", "staging/order_seating", "rows"),
    ("staging/item_selections", "analytics/fact_item_selection", "rows"), ("staging/item_selections", "analytics/fact_item_selection", "net")]
#: Measures that are zero.
ZERO = [("staging/orders", "without_id"), ("staging/item_selections", "without_id"), ("analytics/dim_menu_item", "without_key")]


class BrokenRefresh(RuntimeError):
    """A refresh whose tables do not fit together; its version is not marked done."""


def _columns(name: str) -> list:
    return [F.expr(text).alias(measure) for measure, text in MEASURES[name].items()]


def again(taken: dict[str, dict], names: Iterable[str], stored: Callable[[str], DataFrame]) -> None:
    """Measure tables that are written already."""
    for name in names:
        taken[name] = stored(name).agg(*_columns(name)).first().asDict()


class Measured:
    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        """The frame, measured by the action that writes it."""
        if name not in MEASURES:
            return df
        self.seen[name] = Observation()
        return df.observe(self.seen[name], *_columns(name))

    def broken(self, stored: Callable[[str], DataFrame]) -> list[str]:
        """What does not hold of the tables that were written."""
        taken = {name: seen.get for name, seen in self.seen.items()}
        # a write that was planned as empty has no measures
        again(taken, [name for name, found in taken.items() if set(found) != set(MEASURES[name])], stored)
        again(taken, {name for tables, _ in self._faults(taken) for name in tables}, stored)
        return [text for _, text in self._faults(taken)]

    @staticmethod
    def _faults(taken: dict[str, dict]) -> list[tuple[tuple[str, ...], str]]:
        faults = [((a, b), f"{measure} of {a} is {taken[a][measure]}, of {b} {taken[b][measure]}")
                  for a, b, measure in EQUAL if a in taken and b in taken and taken[a][measure] != taken[b][measure]]
        return faults + [((a,), f"{measure} of {a} is {taken[a][measure]}") for a, measure in ZERO if a in taken and taken[a][measure]]


def settle(measured: Measured, stored: Callable[[str], DataFrame]) -> None:
    """Raise ``BrokenRefresh`` unless everything holds."""
    faults = measured.broken(stored)
    if faults:
        raise BrokenRefresh("; ".join(faults))
