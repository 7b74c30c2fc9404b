"""Every registered query against its SQL on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from servicenight.plans import catalog, frames
from servicenight.session import materialize

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


SHARED = ["menu_items", "pulls", "order_facts", "nightly", "cleaned", "timeline"]


@pytest.fixture(scope="module", autouse=True)
def shared_frames():
    """Frames that many queries build are built once; each is also what some query returns or checks."""
    built, original = {}, {name: getattr(frames, name) for name in SHARED}

    def once(name):
        def frame(spark, sf):
            if name not in built:
                built[name] = materialize(original[name](spark, sf))
            return built[name]
        return frame

    for name in SHARED:
        setattr(frames, name, once(name))
    yield
    for name in SHARED:
        setattr(frames, name, original[name])


def comparable(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert comparable(frame.collect(), frame.columns) == comparable(result.fetchall(), columns)


def test_every_venue_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
