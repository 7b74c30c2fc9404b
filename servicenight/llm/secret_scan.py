"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

Every version of every path is addressed by the SHA-256 of its content. A ledger folder holds, per
blob, the rule versions it was scanned with and what they found; only pairs of blob and rule
version that it lacks are scanned, each blob once. Findings are joined back to all paths.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from servicenight.llm.common import fresh
from servicenight.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The capture group whose length counts, and its least length; shorter matches are dropped.
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


#: Base rules first, in the order that breaks ties between spans. A run of 24 hex digits and an
#: access key of 20 characters are found directly: a shorter run could not hold a longer match.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
]
LEDGER = "blob string, rules array<string>, spans array<struct<start:long,rank:int,end:long,kind:string,rule:string>>"


def content_address(documents: DataFrame) -> DataFrame:
    """(blob, text) of each document; null texts are the empty blob."""
    return documents.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; a folder that is not there yet is an empty ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(documents: DataFrame, ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, text, due): each blob once that some rule version has not scanned, and those versions."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    blobs = content_address(documents).groupBy("blob").agg(F.first("text").alias("text"))
    done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    due = F.array_except(versions, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", "text", due.alias("due")).where(F.size("due") > 0)


def scan(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Ledger rows of the blobs' due rule versions.

    A pattern cuts a text into its matches and the pieces between them; running sums of their
    lengths give the positions in code points. The windows run over one text's matches.
    """
    found = []
    for rank, rule in enumerate(rules):
        due = F.array_contains("due", rule.version) & F.col("text").rlike(rule.pattern)
        found.append(F.when(due, F.struct(
            F.lit(rank).alias("rank"),
            F.arrays_zip(F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
                         F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), F.length).alias("size"),
                         F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("counted")).alias("parts"))))
    table = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule"), F.lit(r.least).alias("least")) for r in rules])
    parts = blobs.select("blob", "due", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    matches = parts.select("blob", "due", F.explode_outer("found").alias("f")).select(
        "blob", "due", "f.rank", F.posexplode_outer("f.parts").alias("i", "p")).where(F.col("rank").isNull() | F.col("p.size").isNotNull())
    before = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(before)
    rule = F.element_at(table, F.col("rank") + 1)
    span = F.when(F.col("p.counted") >= rule["least"], F.struct(
        (end - F.col("p.size")).alias("start"), F.col("rank").alias("rank"), end.alias("end"), rule["kind"].alias("kind"), rule["rule"].alias("rule")))
    return matches.select("blob", "due", span.alias("span")).groupBy("blob").agg(
        F.first("due").alias("rules"), F.collect_list("span").alias("spans")).select(
        "blob", "rules", F.col("spans").cast("array<struct<start:long,rank:int,end:long,kind:string,rule:string>>").alias("spans"))


def update_ledger(documents: DataFrame, folder: str, rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the ledger. A failed append leaves no rows."""
    spark = documents.sparkSession
    scan(unseen(documents, read_ledger(spark, folder), rules), rules).write.mode("append").option("compression", "zstd").parquet(folder)
    return read_ledger(spark, folder)


def findings(documents: DataFrame, ledger: DataFrame, keep: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """(keep..., spans) of every path: the spans of the given rule versions in its blob, by start and rule."""
    path_blob, blob = fresh(documents, "path_blob", "ledger_blob")
    paths = documents.select(*keep, F.sha2(F.coalesce("text", F.lit("")), 256).alias(path_blob))
    versions = [r.version for r in rules]
    per_blob = ledger.select(F.col("blob").alias(blob), F.filter("spans", lambda s: s["rule"].isin(versions)).alias("spans")).where(F.size("spans") > 0)
    per_blob = per_blob.groupBy(blob).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return paths.join(per_blob, F.col(path_blob) == F.col(blob), "left").select(*keep, "spans")


def secret_report(documents: DataFrame, ledger_folder: str | None = None) -> DataFrame:
    """Counts and spans per document; without a folder the scan starts from an empty ledger."""
    spark = documents.sparkSession
    folder = ledger_folder or f"{ensure_checkpoint_dir(spark)}/llm-ledger-{uuid.uuid4().hex}"
    documents = documents.select("doc_id", "text")
    ledger = update_ledger(documents, folder)
    if ledger_folder is None:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    found = findings(documents, ledger, ["doc_id"]).withColumn("spans", F.coalesce("spans", F.array().cast(
        "array<struct<start:long,rank:int,end:long,kind:string,rule:string>>")))
    base = F.filter("spans", lambda s: s["rank"] < sum(r.base for r in RULES))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in RULES if r.base],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
