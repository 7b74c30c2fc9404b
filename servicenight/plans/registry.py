"""Registered queries: a Spark function and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from servicenight.session import SETTINGS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
                spark.conf.set(key, SETTINGS[key])
            return plain(function(spark, sf_dir))
        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in types any engine compares alike: bigint, double (6 places), text, boolean."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            # the same arithmetic in SQL, so ties fall alike
            c = F.floor(c.cast("double") * 1000000 + 0.5) / F.lit(1000000.0)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(kind, (T.DateType, T.NullType, T.DayTimeIntervalType)):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)
