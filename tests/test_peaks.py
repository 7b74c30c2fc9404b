"""Peaks to the minute and distinct nights as bitmaps, against plain counts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from servicenight.functions import bitmaps
from servicenight.operators import occupancy, peaks

SCHEMA = ("order_id long, service_date date, service_dow int, table_code string, section string, order_type string, "
          "opened_at timestamp_ntz, paid_at timestamp_ntz, duration_seconds long, amount double")


def stays(seed=1, n=400, hot=0.6):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        day = dt.date(2024, 1, 1) if r.random() < hot else dt.date(2024, 1, r.randint(2, 6))
        start = dt.datetime.combine(day, dt.time(17)) + dt.timedelta(seconds=r.randint(0, 8 * 3600))
        length = r.choice([0, 30, 900, 3600, r.randint(0, 6 * 3600)])
        rows.append((k, day, day.isoweekday(), f"T{r.randint(1, 9)}", "Evangeline", "Seated", start, start + dt.timedelta(seconds=length), length, 10.0))
    return rows


def plain(rows):
    taken = {}
    for row in rows:
        minute = lambda t: int((t - dt.datetime.combine(row[1], dt.time())).total_seconds() // 60)  # noqa: B023, E731
        for m in range(minute(row[6]), minute(row[7]) + 1):
            taken.setdefault((row[1], m), set()).add(row[3])
    best = {}
    for (day, m), tables in sorted(taken.items()):
        if len(tables) > best.get(day, (0,))[0]:
            best[day] = (len(tables), m)
    return best


def found(frame):
    return {x.service_date: (x.peak_tables, x.peak_minute) for x in peaks.minute_peaks(frame).collect()}


def test_peaks_equal_a_count_of_minutes(spark):
    for seed in (1, 2):
        rows = stays(seed)
        assert found(spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(5)) == plain(rows)


def test_stays_that_touch_and_rows_without_a_table(spark):
    day = dt.date(2024, 3, 1)
    at = lambda h, m, s=0: dt.datetime(2024, 3, 1, h, m, s)
    row = lambda k, table, a, b: (k, day, 5, table, "Evangeline", "Seated", a, b, int((b - a).total_seconds()), 5.0)
    rows = [row(1, "T1", at(18, 0), at(19, 0, 10)), row(2, "T1", at(19, 0, 30), at(20, 0)), row(3, "T2", at(19, 1), at(19, 1)),
            row(4, None, at(18, 0), at(22, 0)), row(5, "T3", at(20, 0, 59), at(20, 30))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {day: (2, 19 * 60 + 1)}
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_peaks_are_never_over_those_of_the_quarter_hours(spark):
    frame = spark.createDataFrame(stays(3), SCHEMA)
    room = occupancy.room_fullness(occupancy.build_occupancy(frame))
    got = peaks.against_slots(peaks.minute_peaks(frame), room, 9).first()
    assert (got.nights, got.over_floor, got.over_slots) == (6, 0, 0)


def test_running_totals_cross_every_cut(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 7 - 3).alias("step")).repartition(9)
    got = {x.id: x.total for x in peaks.running_totals(frame, ["id"], "step").collect()}
    total, want = 0, {}
    for k in range(1000):
        total += k % 7 - 3
        want[k] = total
    assert got == want


def test_bitmaps_count_distinct_nights_of_a_weekday(spark):
    r = random.Random(6)
    rows = [(dt.date(1960, 1, 4) + dt.timedelta(days=r.randint(0, 30000)), r.choice("ab")) for _ in range(6000)]
    frame = spark.createDataFrame(rows + rows[:500], "day date, key string").withColumn("dow", F.dayofweek("day"))
    words = frame.groupBy("dow", "key", bitmaps.word_of(F.col("day")).alias("word")).agg(F.bit_or(bitmaps.bit_of(F.col("day"))).alias("bits"))
    got = words.groupBy("dow", "key").agg(F.sum(F.bit_count("bits")).alias("n"))
    want = frame.groupBy("dow", "key").agg(F.countDistinct("day").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
