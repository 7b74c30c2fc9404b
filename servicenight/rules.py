"""Domain rules of the venue: fixed values that results depend on."""

from __future__ import annotations

import datetime as dt

# --- fixed values: time rules -------------------------------------------------------------
SERVICE_CUTOFF_HOURS = 4            # 3:59 AM belongs to the previous night, 4:00 AM to the new one
LONG_SESSION_SECONDS = 6 * 3600     # strictly above is a check left open, not a party
DURATION_FLOOR_MINUTES = 15
SLOT_MINUTES = 15
NIGHT_HOURS = (11, 27)              # 11 AM .. 3 AM; hour 24 is midnight to 1 AM
PEAK_PAID_HOURS = (17, 22)
PEAK_SLOTS = (76, 92)               # 19:00 .. 23:00
BLOCK_SLOTS = 12                    # a three-hour event

# --- fixed values: money and guests --------------------------------------------------------
EVENT_AMOUNT = 400                  # untabled check of at least this much: event or catering
GUESTS_IMPLAUSIBLE = 30
BAR_GUESTS_IMPLAUSIBLE = 12
GUESTS_SANITY_MAX = 20              # cleaning of exports without ids drops larger parties
RETIRED_TABLE = "BD4"
TAX_SWITCH_FACTOR = 1.08625
TAX_SWITCH_UNTIL = dt.date(2025, 6, 15)
TAX_INCLUSIVE_UNTIL = dt.date(2025, 6, 5)
EVENT_PRICES = {"Black Duck": 1200, "Evangeline": 900}
ALLOWANCE_MINUTES = {2: 90, 3: 90, 4: 105, 5: 120, 6: 120, 7: 120, 8: 120}
SHRINKAGE_GRID = [1, 2, 3, 5, 8, 12, 20, 30, 50, 75, 100, 150, 200]
DRINK_CATEGORIES = ["Liquor", "Glass Wine", "Draft Beer", "Bottle Wine", "NA Beverage"]
FOOD_CATEGORY = "Food"

# --- fixed values: reporting windows ---------------------------------------------------------
REPORT_YEAR = (dt.date(2025, 10, 1), dt.date(2026, 9, 29))
FIRST_SUMMER = (dt.date(2025, 6, 5), dt.date(2025, 9, 30))
LAST_SUMMER = (dt.date(2026, 6, 5), dt.date(2026, 9, 29))
COMPARED_YEARS = (2025, 2026)
COMPARED_MONTHS = [5, 6, 7, 8, 9]
TRADING_DAYS = ["Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: floor plan over time ------------------------------------------------------
# (table_code, section, seats_min, seats_max, valid_from, valid_to); valid_to is exclusive.
OPENING = dt.date(2025, 4, 25)
EVANGELINE_CHANGE = dt.date(2025, 11, 24)
BLACK_DUCK_CHANGE = dt.date(2026, 2, 14)

FLOOR_PLAN_TABLES = [
    ("BD1", "Black Duck", 2, 2, OPENING, BLACK_DUCK_CHANGE),
    ("BD2", "Black Duck", 2, 3, OPENING, BLACK_DUCK_CHANGE),
    ("BD3", "Black Duck", 3, 4, OPENING, BLACK_DUCK_CHANGE),
    ("BD4", "Black Duck", 1, 1, OPENING, BLACK_DUCK_CHANGE),
    ("BD5", "Black Duck", 2, 2, OPENING, BLACK_DUCK_CHANGE),
    ("BD1", "Black Duck", 3, 4, BLACK_DUCK_CHANGE, None),
    ("BD2", "Black Duck", 2, 3, BLACK_DUCK_CHANGE, None),
    ("BD3", "Black Duck", 3, 4, BLACK_DUCK_CHANGE, None),
    ("BD5", "Black Duck", 4, 5, BLACK_DUCK_CHANGE, None),
    ("E1", "Evangeline", 2, 2, OPENING, EVANGELINE_CHANGE),
    ("E2", "Evangeline", 2, 2, OPENING, EVANGELINE_CHANGE),
    ("E3", "Evangeline", 2, 2, OPENING, EVANGELINE_CHANGE),
    ("E4", "Evangeline", 1, 2, OPENING, EVANGELINE_CHANGE),
    ("E5", "Evangeline", 1, 2, OPENING, EVANGELINE_CHANGE),
    ("E1", "Evangeline", 2, 2, EVANGELINE_CHANGE, None),
    ("E2", "Evangeline", 2, 2, EVANGELINE_CHANGE, None),
    ("E3", "Evangeline", 5, 6, EVANGELINE_CHANGE, None),
    ("O1", "Open Lounge", 3, 3, OPENING, None),
    ("O2", "Open Lounge", 2, 2, OPENING, None),
    ("O3", "Open Lounge", 2, 2, OPENING, None),
    ("O4", "Open Lounge", 2, 2, OPENING, None),
    ("O5", "Open Lounge", 2, 2, OPENING, None),
    ("O6", "Open Lounge", 2, 2, OPENING, None),
    ("O7", "Open Lounge", 2, 2, OPENING, None),
    ("O8", "Open Lounge", 3, 3, OPENING, None),
    ("O9", "Open Lounge", 2, 2, OPENING, None),
    ("O10", "Open Lounge", 2, 2, OPENING, None),
    ("B1", "Bar", 1, 1, OPENING, None),
    ("B2", "Bar", 1, 1, OPENING, None),
    ("B3", "Bar", 1, 1, OPENING, None),
    ("B4", "Bar", 1, 1, OPENING, None),
    ("B5", "Bar", 1, 1, OPENING, None),
    ("B6", "Bar", 1, 1, OPENING, None),
    ("B7", "Bar", 1, 1, OPENING, None),
    ("B8", "Bar", 1, 1, OPENING, None),
    ("B9", "Bar", 1, 1, OPENING, None),
    ("B10", "Bar", 1, 1, OPENING, None),
    ("B11", "Bar", 1, 1, OPENING, None),
    ("B12", "Bar", 1, 1, OPENING, None),
    # standing places, not seats
    ("B13", "Bar", 0, 0, OPENING, None),
    ("B14", "Bar", 0, 0, OPENING, None),
]

# (combination, section, table_codes, seats, is_whole_room, valid_from, valid_to)
FLOOR_PLAN_COMBINATIONS = [
    ("BD1+BD2", "Black Duck", ["BD1", "BD2"], 6, False, OPENING, BLACK_DUCK_CHANGE),
    ("BD3+BD5", "Black Duck", ["BD3", "BD5"], 6, False, OPENING, BLACK_DUCK_CHANGE),
    ("BD3+BD4+BD5", "Black Duck", ["BD3", "BD4", "BD5"], 7, False, OPENING, BLACK_DUCK_CHANGE),
    ("Black Duck (whole room)", "Black Duck", ["BD1", "BD2", "BD3", "BD4", "BD5"], 13, True,
     OPENING, BLACK_DUCK_CHANGE),
    ("BD1+BD2", "Black Duck", ["BD1", "BD2"], 6, False, BLACK_DUCK_CHANGE, None),
    ("BD3+BD5", "Black Duck", ["BD3", "BD5"], 8, False, BLACK_DUCK_CHANGE, None),
    ("Black Duck (whole room)", "Black Duck", ["BD1", "BD2", "BD3", "BD5"], 14, True,
     BLACK_DUCK_CHANGE, None),
    ("E1+E2", "Evangeline", ["E1", "E2"], 4, False, OPENING, EVANGELINE_CHANGE),
    ("E1+E2+E3", "Evangeline", ["E1", "E2", "E3"], 6, False, OPENING, EVANGELINE_CHANGE),
    ("E4+E5", "Evangeline", ["E4", "E5"], 4, False, OPENING, EVANGELINE_CHANGE),
    ("Evangeline (whole room)", "Evangeline", ["E1", "E2", "E3", "E4", "E5"], 10, True,
     OPENING, EVANGELINE_CHANGE),
    ("E1+E2", "Evangeline", ["E1", "E2"], 4, False, EVANGELINE_CHANGE, None),
    ("E1+E2+E3", "Evangeline", ["E1", "E2", "E3"], 10, False, EVANGELINE_CHANGE, None),
    ("Evangeline (whole room)", "Evangeline", ["E1", "E2", "E3"], 10, True, EVANGELINE_CHANGE, None),
    ("O1+O2", "Open Lounge", ["O1", "O2"], 5, False, OPENING, None),
    ("O4+O5", "Open Lounge", ["O4", "O5"], 4, False, OPENING, None),
    ("O7+O8", "Open Lounge", ["O7", "O8"], 5, False, OPENING, None),
    ("O9+O10", "Open Lounge", ["O9", "O10"], 4, False, OPENING, None),
]

# --- fixed values: current physical units ------------------------------------------------------
RESERVATION_SECTIONS = ["Black Duck", "Evangeline", "Open Lounge"]

# (unit, table codes, seats)
SEATING_UNITS = [
    ("BD 8-top banquette", ["BD3", "BD5"], 8),
    ("BD 6-top banquette", ["BD1", "BD2"], 6),
    ("E 2+2 pair", ["E1", "E2"], 4),
    ("E3 large", ["E3"], 6),
    ("O1+O2", ["O1", "O2"], 5),
    ("O4+O5", ["O4", "O5"], 4),
    ("O7+O8", ["O7", "O8"], 5),
    ("O9+O10", ["O9", "O10"], 4),
    ("O3", ["O3"], 2),
    ("O6", ["O6"], 2),
    ("B1", ["B1"], 1),
    ("B2", ["B2"], 1),
    ("B3", ["B3"], 1),
    ("B4", ["B4"], 1),
    ("B5", ["B5"], 1),
    ("B6", ["B6"], 1),
    ("B7", ["B7"], 1),
    ("B8", ["B8"], 1),
    ("B9", ["B9"], 1),
    ("B10", ["B10"], 1),
    ("B11", ["B11"], 1),
    ("B12", ["B12"], 1),
]

# (table code, fewest, most) guests a code seats by itself
SOLO_CAPACITY = [
    ("BD1", 3, 4),
    ("BD2", 2, 3),
    ("BD3", 3, 4),
    ("BD5", 4, 5),
    ("E1", 2, 2),
    ("E2", 2, 2),
    ("E3", 5, 6),
    ("O1", 3, 3),
    ("O2", 2, 2),
    ("O3", 2, 2),
    ("O4", 2, 2),
    ("O5", 2, 2),
    ("O6", 2, 2),
    ("O7", 2, 2),
    ("O8", 3, 3),
    ("O9", 2, 2),
    ("O10", 2, 2),
    ("B1", 1, 1),
    ("B2", 1, 1),
    ("B3", 1, 1),
    ("B4", 1, 1),
    ("B5", 1, 1),
    ("B6", 1, 1),
    ("B7", 1, 1),
    ("B8", 1, 1),
    ("B9", 1, 1),
    ("B10", 1, 1),
    ("B11", 1, 1),
    ("B12", 1, 1),
]

RESERVATION_TABLES = 17
EXPECTED_SECTION_SEATS = {"Open Lounge": 22, "Black Duck": 14, "Evangeline": 10, "Bar": 12}

# --- fixed values: holidays a bar notices -------------------------------------------------------
HOLIDAYS = [
    (dt.date(2026, 2, 14), "Valentine's Day"),
    (dt.date(2026, 2, 16), "Presidents' Day"),
    (dt.date(2026, 3, 17), "St Patrick's Day"),
    (dt.date(2026, 4, 5), "Easter Sunday"),
    (dt.date(2026, 5, 10), "Mother's Day"),
    (dt.date(2026, 5, 25), "Memorial Day"),
    (dt.date(2026, 6, 21), "Father's Day"),
    (dt.date(2026, 7, 4), "Independence Day"),
]

# --- fixed values: export layouts, chosen by exact header ----------------------------------------
LAYOUTS = {
    "A": ["Opened", "# of Guests", "Table", "Discount Amount", "Amount", "Tip", "Gratuity",
          "Total", "Closed", "Duration (Opened to Paid)"],
    "B": ["Opened", "# of Guests", "Table", "Discount Amount", "Amount", "Tax", "Tip",
          "Gratuity", "Closed"],
    "C": ["Order Id", "Order #", "Checks", "Opened", "# of Guests", "Table", "Discount Amount",
          "Amount", "Tax", "Tip", "Gratuity", "Total", "Closed", "Duration (Opened to Paid)"],
    "ITEM": ["Order Id", "Order #", "Sent Date", "Order Date", "Check Id", "Table", "Dining Area",
             "Service", "Item Selection Id", "Menu Item", "Menu Group", "Menu", "Sales Category",
             "Gross Price", "Discount", "Net Price", "Qty", "Void?"],
    "ITEM_B": ["Order Id", "Order #", "Sent Date", "Order Date", "Check Id", "Table",
               "Dining Area", "Item Selection Id", "Menu Item", "Menu Group", "Menu",
               "Sales Category", "Gross Price", "Discount", "Net Price", "Qty", "Void?"],
}
RAW_TABLES = {
    "A": "order_details_a",
    "B": "order_details_b",
    "C": "order_details_c",
    "ITEM": "item_selection_details_a",
    "ITEM_B": "item_selection_details_b",
}
CORE_COLUMNS = ["Opened", "# of Guests", "Table", "Discount Amount", "Amount", "Tip",
                "Gratuity", "Closed"]
DURATION_COLUMN = "Duration (Opened to Paid)"
MONEY_COLUMNS = ["Discount Amount", "Amount", "Tax", "Tip", "Gratuity", "Total"]
