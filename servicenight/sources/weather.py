"""Daily weather as an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("service_date date, temp_high_f double, temp_low_f double, precip_in double, "
          "wind_max_mph double")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """A cached daily table (CSV with a header, or Parquet), one row per day."""
    if path.endswith(".csv"):
        frame = spark.read.schema(SCHEMA).option("header", True).csv(path)
    else:
        frame = spark.read.schema(SCHEMA).parquet(path)
    return frame.dropDuplicates(["service_date"])
