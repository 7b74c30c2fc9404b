"""Exports written the way the point of sale writes them, with cells computed from a running number."""

import csv
import datetime as dt
import io
from itertools import count

from servicenight.rules import LAYOUTS
from servicenight.sources import ledger, warehouse

_numbers = count(1)


def clock(instant):
    """A timestamp in the form of the exports."""
    return f"{instant.month}/{instant.day}/{instant:%y} {instant.hour % 12 or 12}:{instant.minute:02d} {'PM' if instant.hour > 11 else 'AM'}"


def span(seconds):
    """A duration in the form of the exports; a negative one has a sign on each part."""
    sign, size = ("-" if seconds < 0 else ""), abs(seconds)
    return f"{sign}{size // 3600}:{sign}{size // 60 % 60:02d}:{sign}{size % 60:02d}"


def cells(n, **given):
    """Plausible cells for any layout; ``given`` overrides by column name (underscores for blanks)."""
    opened = dt.datetime(2026, 4, 1, 17) + dt.timedelta(minutes=13 * n)
    own = {
        "Order Id": 70_000 + n, "Order #": n % 90, "Checks": n, "Opened": clock(opened), "# of Guests": 1 + n % 2, "Table": "O6",
        "Discount Amount": "0.00", "Amount": f"{20 + n}.25", "Tax": "1.75", "Tip": "4.00", "Gratuity": "0.00", "Total": f"{26 + n}.00",
        "Closed": clock(opened + dt.timedelta(hours=9)), "Duration (Opened to Paid)": span(2400 + 60 * n),
        "Sent Date": clock(opened), "Order Date": clock(opened), "Check Id": 500 + n, "Dining Area": "Hall", "Service": "",
        "Item Selection Id": 900_000 + n, "Menu Item": "Soup", "Menu Group": "Kitchen", "Menu": "Main", "Sales Category": "Food",
        "Gross Price": "9.50", "Discount": "0.00", "Net Price": "9.50", "Qty": "1.0", "Void?": "false"}
    named = {k.replace("_", " "): v for k, v in given.items()}
    return own | {("# of Guests" if k == "Guests" else "Duration (Opened to Paid)" if k == "Duration" else "Void?" if k == "Void" else k): v
                  for k, v in named.items()}


def line(kind, n=None, **given):
    values = cells(next(_numbers) if n is None else n, **given)
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([values[c] for c in LAYOUTS[kind]])
    return out.getvalue()


def header(kind):
    return ",".join(LAYOUTS[kind])


class Venue:
    """A folder of exports and the warehouse built from it."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.exports = folder / "exports"
        self.exports.mkdir()
        self.root = str(folder / "warehouse")

    def write(self, name, kind, *lines, encoding="utf-8"):
        return self.write_bytes(name, "\r\n".join([header(kind), *lines, ""]).encode(encoding))

    def write_bytes(self, name, content):
        path = self.exports / name
        path.write_bytes(content)
        return path

    def load(self, **options):
        return ledger.load_folder(self.spark, str(self.exports), self.root, **options).count()

    def refresh(self):
        return warehouse.refresh(self.spark, self.root)

    def raw(self, kind):
        return ledger.read_raw(self.spark, self.root, kind)

    def log(self):
        return ledger.read_log(self.spark, self.root)
