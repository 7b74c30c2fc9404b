"""Column expressions and storage shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from servicenight.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the phrase operators: runs of digits, ASCII letters and everything beyond ASCII.
PHRASE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def phrase_words(text: Column) -> Column:
    """Lower-cased words of a whole text; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PHRASE_WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart when their texts differ; equal rows share it and their result."""
    return F.xxhash64(text)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def same_row(doc_id: str, key: str) -> Column:
    """Joins rows of the documents with rows keyed by doc_id (null equals null) and text key."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (text_key(F.col("text")) == F.col(key))


def without(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that are not among ``rows`` (doc_id, text_key)."""
    doc_id, key = fresh(documents, "gone_id", "gone_key")
    gone = rows.select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key)).distinct()
    return documents.join(gone, same_row(doc_id, key), "left_anti")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet under the shared checkpoint folder and read it back.

    Later plans read the files instead of recomputing, and survive the loss of any executor.
    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
