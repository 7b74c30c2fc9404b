"""Spend rates by party size, shrinkage, and party economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from servicenight import rules
from servicenight.functions import calendar, measures
from servicenight.operators.turns import with_room_fullness
from servicenight.session import materialize

THIN_SAMPLE = 10


def with_rates(orders: DataFrame) -> DataFrame:
    """Spend per guest and per table for each 15 minutes, with their logs.

    A party of zero has no per-guest rate; a rate needs a positive duration.
    """
    quarters = F.col("duration_seconds") / F.lit(900.0)
    per_table = F.col("amount").cast("double") / F.nullif(quarters, F.lit(0.0))
    per_guest = (F.col("amount").cast("double") / F.nullif(F.col("guests"), F.lit(0))
                 / F.nullif(quarters, F.lit(0.0)))
    return orders.withColumns({"vpcpm": per_guest, "tpcpm": per_table}).withColumns({
        "log_vpcpm": F.log("vpcpm"), "log_tpcpm": F.log("tpcpm")})


def rate_by_party_size(rated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Geometric mean spend rate by party size, pooled or within ``by``."""
    summary = rated.groupBy(*(by or []), "guests").agg(
        F.exp(F.avg("log_vpcpm")).alias("vpcpm"), F.avg("tpcpm").alias("mean_tpcpm"),
        F.count("log_vpcpm").alias("orders"))
    return summary.withColumn("thin_sample", F.col("orders") < THIN_SAMPLE)


def table_rate_by_section(rated: DataFrame) -> DataFrame:
    return rated.groupBy("section", "guests").agg(
        F.avg("tpcpm").alias("mean_tpcpm"), F.count("tpcpm").alias("orders"))


# --- shrinkage -----------------------------------------------------------------------------------

def group_statistics(rated: DataFrame, value: str) -> DataFrame:
    """n, sum and sum of squares per section and party size: all that shrinkage needs."""
    v = F.col(value)
    return rated.where(v.isNotNull()).groupBy("section", "guests").agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def loocv_errors(stats: DataFrame, grid: list[int] | None = None) -> DataFrame:
    """Leave-one-out squared error per section and shrinkage weight.

    The residual of one value is linear in it, ``a*v - b``, so a group's error is
    ``a²·Σv² − 2ab·Σv + n·b²`` and the grid runs over groups instead of rows. Groups of
    one row have no left-out mean and add no error, though they count in their section.
    """
    section = stats.groupBy("section").agg(F.sum("n").alias("sn"), F.sum("s").alias("ss"))
    weights = F.array(*[F.lit(float(k)) for k in grid or rules.SHRINKAGE_GRID])
    cells = (stats.where("n > 1").join(section, "section")
             .withColumn("k", F.explode(weights))
             .withColumn("w", (F.col("n") - 1) / (F.col("n") - 1 + F.col("k"))))
    group, rest = F.col("w") / (F.col("n") - 1), (1 - F.col("w")) / (F.col("sn") - 1)
    cells = cells.withColumns({"a": 1 + group + rest,
                               "b": group * F.col("s") + rest * F.col("ss")})
    error = (F.col("a") * F.col("a") * F.col("q") - 2 * F.col("a") * F.col("b") * F.col("s")
             + F.col("n") * F.col("b") * F.col("b"))
    return cells.groupBy("section", "k").agg(F.sum(error).alias("error"))


def best_weights(errors: DataFrame) -> DataFrame:
    """The weight with the least error per section; the smaller one on a tie."""
    return errors.groupBy("section").agg(
        F.min_by("k", F.struct("error", "k")).cast("int").alias("k"))


def shrunk_means(stats: DataFrame, weights: DataFrame) -> DataFrame:
    """Group log means pulled toward their section's mean by the chosen weight."""
    section = stats.groupBy("section").agg((F.sum("s") / F.sum("n")).alias("section_mean"))
    n, k, mean = F.col("n"), F.col("k"), F.col("s") / F.col("n")
    return (stats.join(section, "section").join(weights, "section")
            .withColumn("shrunk", n / (n + k) * mean + k / (n + k) * F.col("section_mean"))
            .select("section", "guests", n.alias("orders"), "k",
                    F.exp(mean).alias("mean_rate"), F.exp("shrunk").alias("weighted_rate")))


def shrinkage_summary(rated: DataFrame) -> DataFrame:
    """Both spend rates by section and party size, raw and shrunk, each with its own weight.

    The orders are read once, for the group statistics of both rates; these few rows are
    stored and every later step reads them.
    """
    sums = []
    for tag in ("vpcpm", "tpcpm"):
        v = F.col(f"log_{tag}")
        sums += [F.count(v).alias(f"n_{tag}"), F.sum(v).alias(f"s_{tag}"), F.sum(v * v).alias(f"q_{tag}")]
    stored = materialize(rated.groupBy("section", "guests").agg(*sums))
    parts = []
    for tag in ("vpcpm", "tpcpm"):
        stats = stored.where(F.col(f"n_{tag}") > 0).select(
            "section", "guests", *[F.col(f"{x}_{tag}").alias(x) for x in "nsq"])
        shrunk = shrunk_means(stats, best_weights(loocv_errors(stats)))
        parts.append(shrunk.select(
            "section", "guests", F.col("orders").alias(f"_{tag}_n"), F.col("k").alias(f"{tag}_k"),
            F.col("mean_rate").alias(f"mean_{tag}"), F.col("weighted_rate").alias(f"weighted_{tag}")))
    return parts[0].join(parts[1], ["section", "guests"]).select(
        "section", "guests", F.col("_vpcpm_n").alias("orders"), "vpcpm_k", "tpcpm_k",
        "mean_vpcpm", "weighted_vpcpm", "mean_tpcpm", "weighted_tpcpm",
        (F.col("_vpcpm_n") < THIN_SAMPLE).alias("thin_sample"))


# --- party economics -------------------------------------------------------------------------------

def hourly_rate() -> Column:
    """Geometric mean revenue per table-hour."""
    return F.exp(F.avg("log_tpcpm")) * 4


def party_economics(rated: DataFrame) -> DataFrame:
    return rated.where(~F.col("likely_combined")).groupBy("guests").agg(
        F.count("amount").alias("orders"), F.median("duration").alias("median_stay"),
        F.median(F.col("amount").cast("double")).alias("median_check"),
        hourly_rate().alias("per_table_hour"))


def oversized_seatings(orders: DataFrame, room: DataFrame) -> DataFrame:
    """Seatings that left a seat unused, and how many of those while the room was busy."""
    single = orders.where(~F.col("likely_combined")).withColumns({
        "spare": F.coalesce(F.col("capacity_max") - F.col("guests") >= 1, F.lit(False)),
        "slot": calendar.slot_of(F.col("opened_at"), F.col("service_date"))})
    attached = with_room_fullness(single, room)
    counts = attached.agg(
        F.count(F.lit(1)).alias("seatings"), F.count_if("spare").alias("oversized"),
        F.count_if(F.col("spare") & (F.col("room_pct") > 75)).alias("while_busy"))
    return counts.withColumn("busy_pct", F.lit(100.0) * F.col("while_busy") / F.nullif("oversized", F.lit(0)))


def large_party_share(orders: DataFrame, size: int = 5) -> DataFrame:
    large = F.col("guests") >= size
    return orders.agg(
        F.count(F.lit(1)).alias("seatings"), F.count_if(large).alias("large"),
        (F.lit(100.0) * F.count_if(large) / F.count(F.lit(1))).alias("large_pct"),
        (F.lit(100.0) * F.sum(F.when(large, F.col("amount"))).cast("double")
         / F.sum("amount").cast("double")).alias("large_revenue_pct"))


def large_party_placement(orders: DataFrame, size: int = 5) -> DataFrame:
    """Where parties of ``size`` and more sat, and how many fit their unit."""
    placed = orders.where((F.col("guests") >= size) & F.col("seating_unit").isNotNull())
    return placed.groupBy("seating_unit").agg(
        F.count("amount").alias("seatings"), F.median("guests").alias("median_guests"),
        F.sum("amount").alias("revenue"), F.count_if(~F.col("likely_combined")).alias("fitting"),
    ).withColumn("fitting_pct", F.lit(100.0) * F.col("fitting") / F.col("seatings"))


def overbooking(orders: DataFrame) -> DataFrame:
    """Rate of parties over capacity, measured per code and per unit."""
    counts = orders.groupBy("section").agg(
        F.count("amount").alias("orders"), F.count_if("exceeds_solo").alias("over_code"),
        F.count_if("likely_combined").alias("over_unit"))
    pct = lambda c: F.round(F.lit(100.0) * F.col(c) / F.col("orders"), 0)
    return counts.withColumns({"code_pct": pct("over_code"), "unit_pct": pct("over_unit")})


def combined_bookings(orders: DataFrame) -> DataFrame:
    return orders.where("likely_combined").groupBy("section").agg(
        F.sum("amount").alias("revenue"), F.count("amount").alias("orders"),
        F.median("guests").alias("median_guests"), F.max("guests").alias("max_guests"))


def tables_without_capacity(orders: DataFrame, units: DataFrame) -> DataFrame:
    """Table codes in use that the floor plan gives no capacity, by number of orders."""
    known = units.where(F.col("capacity_max").isNotNull()).select(F.col("code").alias("table_code"))
    used = orders.where(F.col("table_code").isNotNull()).groupBy("table_code").agg(
        F.count(F.lit(1)).alias("orders"))
    return used.join(known, "table_code", "left_anti")


def unit_drilldown(rated: DataFrame, unit: str, guests: int) -> DataFrame:
    """Parties of one size at one unit, by the code the check was rung on."""
    chosen = rated.where((F.col("seating_unit") == unit) & (F.col("guests") == guests))
    return chosen.groupBy("table_code").agg(
        F.count(F.lit(1)).alias("parties"), F.bool_and(~F.col("likely_combined")).alias("all_fit"),
        F.median("duration").alias("median_stay"),
        F.median(F.col("amount").cast("double")).alias("median_check"),
        hourly_rate().alias("per_table_hour"))


def party_mix_at_table(orders: DataFrame, table_code: str, size: int = 5) -> DataFrame:
    return orders.where(F.col("table_code") == table_code).agg(
        F.count(F.lit(1)).alias("seatings"), F.count_if(F.col("guests") >= size).alias("large"),
        F.count_if(F.col("guests") < size).alias("small"))


# --- stay allowance ----------------------------------------------------------------------------------

def with_allowance(orders: DataFrame) -> DataFrame:
    allowed = F.create_map(*[F.lit(x) for pair in rules.ALLOWANCE_MINUTES.items() for x in pair])
    return (orders.where(F.col("guests").isin(list(rules.ALLOWANCE_MINUTES)))
            .withColumn("allowed", allowed[F.col("guests")])
            .withColumn("over", F.col("duration") > F.col("allowed")))


def allowance_report(orders: DataFrame, min_orders: int = THIN_SAMPLE) -> DataFrame:
    """Per party size: how many stay past their allowance, and by how much."""
    return with_allowance(orders).groupBy("guests", "allowed").agg(
        F.count(F.lit(1)).alias("orders"), F.median("duration").alias("median_stay"),
        (F.lit(100.0) * F.count_if("over") / F.count(F.lit(1))).alias("over_pct"),
        (F.median(F.when(F.col("over"), F.col("duration"))) - F.first("allowed")).alias("median_overstay"),
    ).where(F.col("orders") >= min_orders)


def overstays_while_busy(orders: DataFrame, room: DataFrame) -> DataFrame:
    """Room fullness at the moment overstaying parties paid."""
    over = with_allowance(orders).where("over").withColumn(
        "slot", calendar.slot_of(F.col("paid_at"), F.col("service_date")))
    return with_room_fullness(over, room).agg(
        F.count(F.lit(1)).alias("overstays"), F.count_if(F.col("room_pct") > 75).alias("while_busy"),
        F.median("room_pct").alias("median_room_pct"))


# --- table-time budget --------------------------------------------------------------------------------

def night_spans(orders: DataFrame, table_count: int = rules.RESERVATION_TABLES) -> DataFrame:
    """Per night, table-minutes from the first seating to the last payment, and those used."""
    spans = orders.groupBy("service_date", "service_dow").agg(
        F.min("opened_at").alias("first_open"), F.max("paid_at").alias("last_paid"),
        F.sum("duration_seconds").alias("used_seconds"))
    seconds = calendar.seconds_between(F.col("first_open"), F.col("last_paid"))
    return spans.select(
        "service_date", "service_dow", (seconds * table_count / F.lit(60.0)).alias("available"),
        (F.col("used_seconds") / F.lit(60.0)).alias("occupied"))


def table_time_by_weekday(spans: DataFrame) -> DataFrame:
    sums = spans.groupBy("service_dow").agg(
        F.count("available").alias("nights"), F.sum("available").alias("available"),
        F.sum("occupied").alias("occupied"))
    return sums.withColumns({
        "sold_pct": F.lit(100.0) * F.col("occupied") / F.col("available"),
        "unsold_hours_per_night": (F.col("available") - F.col("occupied")) / F.col("nights") / 60})


def table_time_budget(spans: DataFrame, turned: DataFrame) -> DataFrame:
    """Available, occupied and unsold table time, and how much of the unsold lay between parties."""
    gap = turned.agg(F.sum("turn_gap")).scalar()
    totals = spans.agg(F.sum("available").alias("available"), F.sum("occupied").alias("occupied"))
    unsold = F.col("available") - F.col("occupied")
    return totals.withColumns({"unsold": unsold, "gap_minutes": gap,
                               "gap_pct_of_unsold": F.lit(100.0) * gap / unsold})


# --- revenue by type ---------------------------------------------------------------------------------

def order_type_share(orders: DataFrame) -> DataFrame:
    sums = orders.groupBy("order_type").agg(
        F.count("amount").alias("orders"), F.sum("amount").alias("revenue"))
    total = sums.agg(F.sum("revenue").cast("double")).scalar()
    return sums.withColumn(
        "share_pct", F.round(F.lit(100.0) * F.col("revenue").cast("double") / total, 1))


def masthead(orders: DataFrame) -> DataFrame:
    """Period, orders, nights and recorded sales."""
    return orders.agg(
        F.min("service_date").alias("first_night"), F.max("service_date").alias("last_night"),
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct(F.when(F.col("section").isin(rules.RESERVATION_SECTIONS)
                               & (F.col("duration_seconds") >= rules.DURATION_FLOOR_MINUTES * 60),
                               F.col("service_date"))).alias("trading_nights"),
        F.sum("amount").alias("sales"))


def excluded_revenue(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_type") != "Seated").groupBy("order_type").agg(
        F.count("amount").alias("orders"), F.sum("amount").alias("revenue"))


def amounts_descending(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", "amount").orderBy(F.col("amount").desc(), "order_id")


def unit_map(orders: DataFrame) -> DataFrame:
    """Distinct table codes in use with their section, unit and capacities."""
    return orders.select("table_code", "section", "seating_unit", "unit_capacity",
                         "capacity_min", "capacity_max").distinct()
