"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Wall-clock data stays TIMESTAMP_NTZ; UTC only matters for load times.
# ANSI mode makes a malformed cell an error instead of a silent NULL.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # stored frames go once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def travels(module: str) -> None:
    """Send a module's functions to workers with their code, so that no worker needs the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; extra settings use ``__`` for dots."""
    builder = SparkSession.builder.appName("servicenight")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A hand-kept table as a local relation.

    The planner knows its size, so a join with it is a broadcast join by estimate and the
    other side stays where it is; rows handed over as an RDD would have no known size.
    """
    struct = T.StructType.fromDDL(schema)
    records = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(struct)), schema=struct)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own, because on a
    cluster a machine-local folder is lost together with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="servicenight-checkpoint-")
    context.setCheckpointDir(named)
    return named


#: Spark 4.1 and later; before, shuffle files stay until the driver's garbage collector finds that nothing refers to them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go as soon as it has ended; for jobs that store what they read again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


class Spool:
    """Large frames stored compressed in a folder of their own, until ``drop`` or the application's end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/spool-{uuid.uuid4().hex}"
        place, fs = self._place(self.root)
        fs.mkdirs(place)
        fs.deleteOnExit(place)

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def store(self, name: str, df: DataFrame) -> DataFrame:
        with shuffles_freed(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one frame, or all of them."""
        place, fs = self._place(f"{self.root}/{name}".rstrip("/"))
        fs.delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Store a frame reliably so that later plans read it instead of recomputing it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()

