"""The merged set of exports without ids as a stored target that pulls are merged into, one delta at a time.

The target is bucketed by identity and keeps, beside every cell, the rank of the pull that supplied it.
A delta is brought to one row per identity, dealt into the same buckets and joined with the target bucket
by bucket; the target itself is never shuffled. Since the ranks are stored, pulls may come in any order
and more than once. Every merge writes a version of its own and marks it done last; readers take the
last one that is done.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from servicenight.operators import merge
from servicenight.sources.warehouse import DONE, current, folder_of, versions

#: Buckets of a new target. A target keeps its number; choose it so that a bucket fits a task at the target's full size.
BUCKETS = 64
IDENTITY = "identity"
_RANK = "__rank"


def identity(rows: DataFrame) -> Column:
    """The four parts of a row's identity as one text that is never null; lengths keep the parts apart."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in merge.KEY]
    return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def cells(df: DataFrame) -> list[str]:
    """The columns that are merged cell by cell."""
    return [c for c in [*merge.content_columns(df), "source_file"] if c not in (IDENTITY, *merge.KEY) and not c.endswith(_RANK)]


def one_row_each(rows: DataFrame) -> DataFrame:
    """A delta (identity, key, each cell and its pull's rank): every cell the newest value any of its pulls has."""
    newest = []
    for c in cells(rows):
        given = F.when(F.col(c).isNotNull(), F.col("pull_rank"))
        newest += [F.max_by(F.col(c), given).alias(c), F.max(given).alias(c + _RANK)]
    return rows.withColumn(IDENTITY, identity(rows)).groupBy(IDENTITY, *merge.KEY).agg(*newest)


def _name(folder: str) -> str:
    return "merged_" + folder.rsplit("-", 1)[-1]


def _table(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """A stored version with its buckets known to the planner; the catalog may be that of a new application."""
    name = _name(folder)
    buckets = int(spark.read.text(f"{root}/buckets").first().value)
    schema = spark.read.parquet(folder).schema
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({IDENTITY}) SORTED BY ({IDENTITY}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def _write(spark: SparkSession, root: str, merged: DataFrame, buckets: int) -> str:
    stamp = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder, name = f"{root}/versions/{stamp}", f"written_{stamp[-8:]}"
    (merged.write.format("parquet").bucketBy(buckets, IDENTITY).sortBy(IDENTITY).option("path", folder).saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # the files stay
    done, fs = folder_of(spark, f"{folder}/{DONE}")
    fs.mkdirs(done)
    return folder


def joined(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Target and delta by identity; a cell of the delta wins if its pull is at least as new as the target's."""
    t, d = target.alias("t"), delta.alias("d")
    both = t.join(d, F.col(f"t.{IDENTITY}") == F.col(f"d.{IDENTITY}"), "full_outer")
    keys = [F.coalesce(f"d.{k}", f"t.{k}").alias(k) for k in (IDENTITY, *merge.KEY)]
    out = []
    for c in dict.fromkeys([*cells(target), *cells(delta)]):  # a pull may bring a column of its own
        if c not in target.columns or c not in delta.columns:
            side = "t" if c in target.columns else "d"
            out += [F.col(f"{side}.`{c}`"), F.col(f"{side}.`{c}{_RANK}`")]
            continue
        new, old = F.col(f"d.`{c}{_RANK}`"), F.col(f"t.`{c}{_RANK}`")
        newer = new.isNotNull() & (old.isNull() | (new >= old))
        out += [F.when(newer, F.col(f"d.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c), F.when(newer, new).otherwise(old).alias(c + _RANK)]
    return both.select(*keys, *out)


def merge_into(spark: SparkSession, root: str, rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Merge rows of some pulls (with identity, occurrence and ``pull_rank``) into the target at ``root``; return the new version.

    ``pull_rank`` may be a number or any other value that keeps its order as pulls are added. The last
    version but one stays for readers that are under way; older ones go.
    """
    delta = one_row_each(rows)
    if not versions(spark, root):
        spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/buckets")
        folder = _write(spark, root, delta.repartition(buckets, IDENTITY), buckets)
    else:
        kept = int(spark.read.text(f"{root}/buckets").first().value)
        folder = _write(spark, root, joined(_table(spark, root, current(spark, root)), delta.repartition(kept, IDENTITY)), kept)
    for old in versions(spark, root)[:-2]:
        spark.sql(f"DROP TABLE IF EXISTS {_name(old)}")
        place, fs = folder_of(spark, f"{root}/versions/{old}")
        fs.delete(place, True)
    return read(spark, root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The merged set: one row per order, without ranks."""
    stored = _table(spark, root, current(spark, root))
    return stored.select(*merge.KEY, *cells(stored))
