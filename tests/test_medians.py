"""Medians by refining histograms against the plain median."""

import random
import statistics

import pytest

from servicenight.operators import medians


@pytest.mark.parametrize("bins", [2, 1024])
def test_medians_are_exact(spark, monkeypatch, bins):
    """Even and odd counts, ties, one value, near and far values, a null group, and one group with most of the rows."""
    monkeypatch.setattr(medians, "BINS", bins)
    r = random.Random(bins)
    groups = {"hot": [r.choice([3.5, 4.25, r.gauss(0, 10)]) for _ in range(3001)], "one": [7.0], "two": [1.0, 2.0], "ties": [5.0] * 40, "split": [1.0] * 5 + [9.0] * 5,
              "far": [-1e12, 0.1, 0.2, 1e12], "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51], None: [2.0, -3.0, 10.5]}
    rows = [(g, 1, v) for g, values in groups.items() for v in values] + [("one", 1, None), ("none", 1, None)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    got = {x.g: x.m for x in medians.median_of(frame, ["g", "h"], "v", "m").collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}


def test_no_rows(spark):
    assert medians.median_of(spark.createDataFrame([], "g string, v int"), ["g"], "v", "m").count() == 0
