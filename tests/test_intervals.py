"""The interval sweep and the stored merge against plain counterparts."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from servicenight.operators import intervals, merge
from servicenight.sources import merged


def lies_in(at, start, end, closed):
    return (start is None or at >= start) and (end is None or at < end or (closed and at == end))


@pytest.mark.parametrize("how,closed", [("inner", False), ("left", True), ("left_semi", False), ("left_anti", True)])
def test_interval_join(spark, monkeypatch, how, closed):
    """Overlapping, empty, reversed and open intervals; one key with most of the rows."""
    monkeypatch.setattr(intervals, "BLOCK", 4)
    r = random.Random(3)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", "c", None])
    pick = lambda: None if r.random() < 0.1 else r.randrange(40)
    points = [(i, key(), i % 2, pick()) for i in range(300)]
    spans = [(i, key(), i % 2, pick(), pick()) for i in range(80)]
    pairs = {(p, s) for p, k, g, at in points for s, k2, g2, a, b in spans
             if k is not None and at is not None and k == k2 and g == g2 and lies_in(at, a, b, closed) and not (a is not None and b is not None and (a > b or (a == b and not closed)))}
    hit = {p for p, _ in pairs}
    wanted = {"inner": pairs, "left": pairs | {(p[0], None) for p in points if p[0] not in hit},
              "left_semi": {(p, None) for p in hit}, "left_anti": {(p[0], None) for p in points if p[0] not in hit}}[how]
    left = spark.createDataFrame(points, "p long, k string, g long, at int").repartition(4)
    right = spark.createDataFrame(spans, "s long, k2 string, g2 long, a int, b int")
    got = intervals.interval_join(left, right, [("k", "k2"), ("g", "g2")], "at", "a", "b", how, closed)
    assert got.columns == (["p", "k", "g", "at"] if "_" in how else ["p", "k", "g", "at", "s", "k2", "g2", "a", "b"])
    rows = [(x["p"], x["s"] if "s" in got.columns else None) for x in got.collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted


def test_a_hot_key_is_spread(spark):
    """All points of one key and intervals over all of them: no task has more than its share."""
    day = dt.date(2026, 1, 1)
    left = spark.range(20_000).selectExpr("id", "'x' as k", "date_add(date'2026-01-01', cast(id % 300 as int)) as d")
    right = spark.createDataFrame([("x", day, None), ("x", day + dt.timedelta(200), day + dt.timedelta(201))], "k2 string, a date, b date")
    got = intervals.interval_join(left, right, [("k", "k2")], "d", "a", "b")
    assert got.count() == 20_000 + 66
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_empty_sides(spark):
    left, right = spark.createDataFrame([], "p long, k string, at int"), spark.createDataFrame([], "k2 string, a int, b int")
    assert intervals.interval_join(left, right, [("k", "k2")], "at", "a", "b", "left").count() == 0
    some = spark.createDataFrame([(1, "x", 3)], "p long, k string, at int")
    assert intervals.interval_join(some, right, [("k", "k2")], "at", "a", "b", "left").count() == 1


CELLS = "opened timestamp_ntz, guests int, table_code string, amount decimal(12,2), tip decimal(12,2), duration_text string, source_file string, source_row_number int, pull_rank int"


def pulls(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for rank in range(4):
        for n in range(60):
            opened = None if n == 59 else dt.datetime(2026, 1, 1 + r.randrange(6), 18)
            rows.append((opened, r.choice([None, 2, 4]), r.choice([None, "O1", "O2"]), None if r.random() < 0.2 else Decimal(n), None if r.random() < 0.3 else Decimal(rank),
                         None if rank == 2 else f"1:0{rank}", f"f{rank}", n, rank))
    frame = spark.createDataFrame(rows, CELLS).withColumn("discount_amount", intervals.F.lit(0).cast("decimal(12,2)")).withColumn("source_chunk", intervals.F.lit(0))
    return merge.add_occurrence(frame)


def as_rows(frame, columns):
    return sorted((tuple(x) for x in frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (2, 2, 3, 0, 1, 3)])
def test_pulls_merged_in_any_order(spark, tmp_path, order):
    rows = intervals.materialize(pulls(spark))
    root = str(tmp_path / "target")
    for rank in order:
        merged.merge_into(spark, root, rows.where(f"pull_rank = {rank}"), buckets=3)
    wanted = merge.merge_pulls(rows)
    assert as_rows(merged.read(spark, root), wanted.columns) == as_rows(wanted, wanted.columns)
    assert len(merged.versions(spark, root)) == 2


def test_the_target_is_not_shuffled(spark, tmp_path):
    rows = intervals.materialize(pulls(spark, 2))
    root = str(tmp_path / "target")
    merged.merge_into(spark, root, rows.where("pull_rank < 3"), buckets=3)
    target = merged._table(spark, root, merged.current(spark, root))
    delta = merged.one_row_each(rows.where("pull_rank = 3")).repartition(3, merged.IDENTITY)
    plan = merged.joined(target, delta)._jdf.queryExecution().executedPlan().toString()
    side = plan[:plan.index("FileScan")].splitlines() if "FileScan" in plan else []
    assert side and "Exchange" not in "\n".join(side[side.index(next(x for x in side if "Join" in x)):])


def test_a_pull_may_bring_a_column_of_its_own(spark, tmp_path):
    rows = intervals.materialize(pulls(spark, 4))
    root = str(tmp_path / "target")
    merged.merge_into(spark, root, rows.where("pull_rank = 0"), buckets=2)
    extra = rows.where("pull_rank = 1").withColumn("Server", intervals.F.lit("S1"))
    got = merged.merge_into(spark, root, extra, buckets=2)
    newer = rows.where("pull_rank = 1").count()
    assert got.where("Server = 'S1'").count() == newer and "Server" in got.columns
    again = merged.merge_into(spark, root, rows.where("pull_rank = 2"), buckets=2)
    assert again.where("Server = 'S1'").count() == newer
