"""Trend against season: nightly frames, year over year, weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight import rules
from servicenight.session import small_table


def regular_nights(nightly: DataFrame) -> DataFrame:
    """Tuesday to Sunday nights that traded."""
    return nightly.where((F.col("iso_day_of_week") != 1) & (F.col("orders") > 0))


def monday_bookings(nightly: DataFrame) -> DataFrame:
    mondays = nightly.where((F.col("iso_day_of_week") == 1) & (F.col("orders") > 0))
    return mondays.agg(F.count(F.lit(1)).alias("nights"),
                       F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"))


def with_night_columns(nights: DataFrame) -> DataFrame:
    """Regular revenue, years elapsed, month of year and spend per guest."""
    first = nights.agg(F.min("service_date")).scalar()
    return nights.withColumns({
        "regular_revenue": F.col("seated_revenue") + F.col("togo_revenue"),
        "years": F.datediff(F.col("service_date"), first) / F.lit(365.25),
        "month_of_year": F.month("service_date"),
        "spend_per_guest": (F.col("seated_revenue").cast("double")
                            / F.when(F.col("guests") > 0, F.col("guests")))})


def month_by_month(nights: DataFrame) -> DataFrame:
    """Per month: nights and per-night revenue, parties and spend per guest."""
    sums = nights.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("nights"), F.sum("revenue").cast("double").alias("revenue"),
        F.sum("regular_revenue").cast("double").alias("regular"), F.sum("parties").alias("parties"),
        F.sum("guests").alias("guests"), F.sum("seated_revenue").cast("double").alias("seated"),
        F.avg("temp_high_f").alias("mean_high"))
    return sums.select(
        "month_start", "nights", "revenue", "regular", "parties", "guests", "mean_high",
        (F.col("revenue") / F.col("nights")).alias("revenue_per_night"),
        (F.col("regular") / F.col("nights")).alias("regular_per_night"),
        (F.col("parties") / F.col("nights")).alias("parties_per_night"),
        (F.col("seated") / F.nullif("guests", F.lit(0))).alias("spend_per_guest"))


def _mean(value: str, when: Column) -> Column:
    chosen = F.when(when, F.col(value))
    return F.sum(chosen).cast("double") / F.count(chosen)


def _ratio(top: str, bottom: str, when: Column) -> Column:
    return (F.sum(F.when(when, F.col(top))).cast("double")
            / F.nullif(F.sum(F.when(when, F.col(bottom))), F.lit(0)))


def _compare(grouped, before: int, after: int) -> DataFrame:
    year, weekend = F.col("year"), F.col("is_fri_or_sat")
    columns = []
    for tag, y in (("before", before), ("after", after)):
        of_year = year == y
        columns += [
            F.count_if(of_year).alias(f"nights_{tag}"),
            _mean("regular_revenue", of_year).alias(f"regular_{tag}"),
            _mean("parties", of_year).alias(f"parties_{tag}"),
            _ratio("seated_revenue", "guests", of_year).alias(f"spend_{tag}"),
            _mean("regular_revenue", of_year & weekend).alias(f"weekend_{tag}"),
            _mean("regular_revenue", of_year & ~weekend).alias(f"midweek_{tag}")]
    return grouped.agg(*columns)


def _with_changes(compared: DataFrame) -> DataFrame:
    return compared.withColumns({
        f"{m}_change": F.col(f"{m}_after") / F.nullif(f"{m}_before", F.lit(0.0)) - 1
        for m in ("regular", "parties", "spend", "weekend", "midweek")})


def same_month_comparison(nights: DataFrame, years: tuple[int, int] = rules.COMPARED_YEARS,
                          min_nights: int = 15) -> DataFrame:
    """Months traded on enough nights in both years, side by side."""
    return _with_changes(_compare(nights.groupBy("month_of_year"), *years)).where(
        F.least("nights_before", "nights_after") >= min_nights)


def pooled_comparison(nights: DataFrame, years: tuple[int, int] = rules.COMPARED_YEARS,
                      min_nights: int = 15) -> DataFrame:
    """All comparable months of both years together."""
    comparable = same_month_comparison(nights, years, min_nights).select("month_of_year")
    return _with_changes(_compare(nights.join(comparable, "month_of_year", "left_semi").groupBy(), *years))


def monthly_parties(orders: DataFrame) -> DataFrame:
    """Per month: nights, parties, mean party and revenue per night."""
    month = F.trunc("service_date", "month").alias("month_start")
    sums = orders.groupBy(month).agg(
        F.countDistinct("service_date").alias("nights"), F.count("amount").alias("parties"),
        F.avg("guests").alias("mean_party"), F.sum("amount").cast("double").alias("revenue"))
    return sums.select(
        "month_start", "nights", "parties", "mean_party", "revenue",
        F.round(F.col("parties") / F.col("nights"), 1).alias("parties_per_night"),
        F.round(F.col("revenue") / F.col("nights"), 0).alias("revenue_per_night"))


def seated_nights(orders: DataFrame) -> DataFrame:
    """Revenue, parties and guests per night over all seated orders."""
    return orders.where(F.col("order_type") == "Seated").groupBy("service_date", "service_dow").agg(
        F.sum("amount").cast("double").alias("revenue"), F.count("amount").alias("parties"),
        F.sum("guests").alias("guests"))


# --- weather and holidays ------------------------------------------------------------------------

WEATHER = ["temp_high_f", "temp_low_f", "precip_in", "wind_max_mph"]


def with_weather(nights: DataFrame, weather: DataFrame) -> DataFrame:
    return nights.join(weather.select("service_date", *WEATHER), "service_date", "left")


def nights_without_weather(nights: DataFrame) -> DataFrame:
    return nights.agg(F.count_if(F.col("temp_high_f").isNull()).alias("unmatched"),
                      F.count(F.lit(1)).alias("nights"))


def with_holidays(nights: DataFrame, holidays: DataFrame) -> DataFrame:
    named = holidays.select("service_date", "holiday")
    return nights.join(named, "service_date", "left").withColumn(
        "is_holiday", F.col("holiday").isNotNull())


def holidays_frame(spark) -> DataFrame:
    return small_table(spark, rules.HOLIDAYS, "service_date date, holiday string")


def weather_correlation(nights: DataFrame) -> DataFrame:
    """Pearson correlation of revenue with each weather measure, all nights and Fri/Sat."""
    weekend = F.col("service_dow").isin("Friday", "Saturday")
    measures = ["temp_high_f", "precip_in", "wind_max_mph"]
    row = nights.agg(*[F.corr("revenue", m).alias(f"all_{m}") for m in measures],
                     *[F.corr(F.when(weekend, F.col("revenue")), F.col(m)).alias(f"we_{m}")
                       for m in measures])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"all_{m}").alias("all_nights"),
                 F.col(f"we_{m}").alias("fri_sat")) for m in measures])).alias("r")).select("r.*")


def wet_or_dry(nights: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Mean Friday and Saturday revenue on wet and dry nights; unknown weather counts as dry."""
    weekend = nights.where(F.col("service_dow").isin("Friday", "Saturday"))
    wet = F.coalesce(F.col("precip_in") > threshold, F.lit(False))
    return weekend.groupBy(wet.alias("wet")).agg(
        F.count(F.lit(1)).alias("nights"), F.avg("revenue").alias("mean_revenue"))


def holiday_nights(nights: DataFrame) -> DataFrame:
    """Holiday nights against the median night of their weekday."""
    typical = nights.groupBy("service_dow").agg(F.median("revenue").alias("typical"))
    return (nights.where("is_holiday").join(typical, "service_dow")
            .select("service_date", "service_dow", "holiday", "revenue", "typical",
                    (F.col("revenue") - F.col("typical")).alias("vs_typical")))


def untraded_holidays(holidays: DataFrame, nights: DataFrame) -> DataFrame:
    return holidays.join(nights.select("service_date"), "service_date", "left_anti")


def untraded_days(nights: DataFrame, iso_weekday: int | None = None) -> DataFrame:
    """Days between the first and last night without one; optionally of one weekday."""
    span = nights.agg(F.min("service_date").alias("a"), F.max("service_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("service_date"))
    if iso_weekday:
        days = days.where(F.weekday("service_date") + 1 == iso_weekday)
    return days.join(nights.select("service_date"), "service_date", "left_anti")


def missing_weather_days(nights: DataFrame, weather: DataFrame) -> DataFrame:
    """Days of the covered span the weather table lacks."""
    span = nights.agg(F.min("service_date").alias("a"), F.max("service_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("service_date"))
    return days.join(weather.select("service_date"), "service_date", "left_anti")


def demeaned_by_month(nights: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their month's mean (nights are at most 31 a month)."""
    month = Window.partitionBy(F.trunc("service_date", "month"))
    return nights.withColumns({f"{c}_dm": F.col(c) - F.avg(c).over(month) for c in columns})


def within_month_correlation(nights: DataFrame, min_nights: int = 6) -> DataFrame:
    """Friday and Saturday revenue against the day's high, inside months and pooled."""
    weekend = nights.where(F.col("service_dow").isin("Friday", "Saturday"))
    both = demeaned_by_month(weekend, ["revenue", "temp_high_f"])
    pooled = both.agg(F.lit("pooled").alias("month"), F.count(F.lit(1)).alias("nights"),
                      F.corr("revenue_dm", "temp_high_f_dm").alias("r"))
    monthly = weekend.groupBy(F.date_format("service_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("nights"), F.corr("revenue", "temp_high_f").alias("r"))
    return pooled.unionByName(monthly.where((F.col("nights") >= min_nights) & F.col("r").isNotNull()
                                            & ~F.isnan("r")))


def time_against_temperature(nights: DataFrame) -> DataFrame:
    return nights.agg(F.corr(F.datediff("service_date", F.lit("2000-01-01").cast("date")).cast("double"),
                             F.col("temp_high_f")).alias("r"))
