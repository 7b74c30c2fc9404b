"""Quality rules whose thresholds adapt to each language and source.

Measures of a document are counted over its whole text. Each measure is summed up per language and
source in a quantile sketch: a histogram over logarithmic bins, whose relative error is fixed by
the bin width and which merges by adding counts, in any order and with the same result. All
documents are in the sketches. Fences drawn from a sketch's quartiles and its own spread replace
fixed cutoffs and are joined back to the documents; the fewer documents a group has, the more its
fences lean on those of the whole table. A measure is a count over words or lines, so a document is
out only if its value is beyond a fence by more than the noise of such a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight.llm import textvec
from servicenight.llm.common import fresh, stored

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A sketch's bins are this factor wide; values under the smallest bin count as zero.
BIN_WIDTH = 1.02
SMALLEST = 1e-4
#: What the rules compare: a count of a document and the count it is a share of.
SHARES = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "line_share": ("n_dup_lines", "n_full_lines")}
#: Spreads of the sketch between a quartile and its fence (outer fences).
FENCE = 3.0
#: A group of this many documents has fences half its own, half the whole table's.
PRIOR = 30
#: Standard errors of a document's own count that a value may lie beyond its fence.
NOISE = 2.0

#: Counts travel under names with this prefix, out of the way of the table's own columns.
COUNT = "quality__"

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*MEASURES, "base_failed", "kept", "failed_rule"]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeated(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in their row, and which have an equal one before them."""
    key = textvec.mix(hashes + rows.astype(np.uint64) * np.uint64(textvec.BASE))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    shared, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    shared[order[1:][equal]] = shared[order[:-1][equal]] = True
    later[order[1:][equal]] = True
    return shared, later


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each row of a step."""
    starts, ends, n_words = textvec.word_spans(data, offsets)
    sums = textvec.prefix_sums(data)
    words = textvec.span_hashes(sums, starts, ends)
    windows, first = textvec.window_hashes(words, n_words, WINDOW)
    shared, _ = repeated(windows, textvec.row_of(n_words)[first])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first[shared], 1)
    np.add.at(cover, first[shared] + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    word_offsets = np.concatenate([[0], np.cumsum(n_words)])

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_rows = np.searchsorted(offsets, line_starts, "right") - 1
    # a line ends at its line feed or where its row ends
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)] if len(breaks) else np.full(len(line_starts), len(data))
    line_ends = np.minimum(next_break, offsets[line_rows + 1])
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[with_word], line_ends[with_word], line_rows[with_word]
    _, again = repeated(textvec.span_hashes(sums, line_starts, line_ends), line_rows)
    chars = ((data & 0xC0) != 0x80) & ~textvec.SPACE[data]
    return {"n_words": n_words, "word_chars": per_row(chars, offsets), "n_symbols": per_row(SYMBOL[data], offsets),
            "n_dup_lines": np.bincount(line_rows[again], minlength=len(n_words)),
            "n_repeat_words": per_row(covered, word_offsets),
            "n_full_lines": np.bincount(line_rows, minlength=len(n_words))}


def with_measures(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns and the counts of each whole text; null texts count as empty."""
    names = [*MEASURES, "n_full_lines"]
    schema = documents.select(*keep).schema
    (read,) = fresh(documents, "text_read")
    for name in names:
        schema = schema.add(f"{COUNT}{name}", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.column_bytes(batch.column(read))
            parts = [measures(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in textvec.steps(offsets)]
            columns = [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], schema.names)

    return documents.select(*keep, F.col("text").alias(read)).mapInArrow(work, schema)


def bin_of(value: Column) -> Column:
    return F.when(value < SMALLEST, F.lit(None).cast("int")).otherwise(F.floor(F.log(value / SMALLEST) / np.log(BIN_WIDTH)).cast("int"))


def bin_middle(number: Column) -> Column:
    return F.when(number.isNull(), 0.0).otherwise(SMALLEST * F.pow(F.lit(BIN_WIDTH), number + 0.5))


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Merged histograms: (groups, measure, bin, n). Sketches of parts of a table add up to the whole's."""
    long = rows.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bin_of(F.col(f"{COUNT}{m}")).alias("bin")) for m in SHARES])).alias("m"))
    return long.groupBy(*groups, "m.measure", "m.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Lower and upper fence of each measure per group, as columns ``<measure>_low`` and ``_high``.

    The spread is the distance of the quartiles or, if that is larger, the mean distance from the
    median, so that a measure which is zero for most documents has one too; it is never under the
    sketch's own error. The windows run over a group's bins, whose number the bin width bounds,
    not over documents.
    """
    one = Window.partitionBy(*groups, "measure") if groups else Window.partitionBy("measure")
    ranked = sketch.withColumn("seen", F.sum("n").over(one.orderBy(F.col("bin").asc_nulls_first()))).withColumn("total", F.sum("n").over(one))
    least = lambda q: F.min(F.when(F.col("seen") >= q * F.col("total"), F.struct(F.coalesce("bin", F.lit(-1)).alias("k"), bin_middle(F.col("bin")).alias("v"))))
    ranked = ranked.withColumn("off", F.col("n") * F.abs(bin_middle(F.col("bin")) - least(0.5).over(one)["v"]))
    low_high = ranked.groupBy(*groups, "measure").agg(
        least(0.25)["v"].alias("q1"), least(0.75)["v"].alias("q3"), (F.sum("off") / F.max("total")).alias("off"), F.max("total").alias("total"))
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.col("off"), (BIN_WIDTH - 1) * F.col("q3"))
    edges = low_high.select(*groups, "measure", "total", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    return edges.groupBy(*groups).agg(
        *[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in SHARES for side in ("low", "high")],
        F.max("total").alias("group_size"))


def counted(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns, the counts of each whole text, language and source, and what the rules compare."""
    lang, source = (f"{COUNT}lang", f"{COUNT}source")
    named = documents.withColumns({lang: F.col("lang").cast("string"), source: F.col("source").cast("string")})
    rows = with_measures(named, [*keep, lang, source])
    n = F.col(f"{COUNT}n_words")
    share = lambda part, of: F.when(F.col(f"{COUNT}{of}") > 0, F.col(f"{COUNT}{part}") / F.col(f"{COUNT}{of}")).otherwise(0.0)
    return rows.withColumns({
        f"{COUNT}base_failed": (n < MIN_WORDS) | (100 * F.col(f"{COUNT}n_repeat_words") > REPEAT_PERCENT * n),
        **{f"{COUNT}{m}": share(part, of) for m, (part, of) in SHARES.items()}})


def judged(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns of counted rows with the counts, ``base_failed``, ``kept`` and ``failed_rule``.

    Language and source may be null; null is a group of its own. A group of n documents has
    fences that are its own by n / (n + ``PRIOR``) and the whole table's by the rest.
    """
    groups = [f"{COUNT}lang", f"{COUNT}source"]
    sketch = sketches(rows, groups)
    whole = sketch.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    edges = [f"{m}_{side}" for m in SHARES for side in ("low", "high")]
    common = (fences(whole, []).select(*edges).first() or {e: None for e in edges})  # one row for the whole table
    weight = F.col("group_size") / (F.col("group_size") + PRIOR)
    own = fences(sketch, groups).select(*[F.col(g).alias(f"{g}_group") for g in groups], *[
        (weight * F.col(e) + (1 - weight) * F.lit(common[e]).cast("double")).alias(f"{COUNT}{e}") for e in edges])
    same = [F.col(g).eqNullSafe(F.col(f"{g}_group")) for g in groups]
    marked = rows.join(own, same[0] & same[1], "left")
    rule = F.lit(None).cast("string")
    for m, (_, of) in SHARES.items():
        value = F.col(f"{COUNT}{m}")
        noise = NOISE * F.sqrt(value / F.greatest(F.col(f"{COUNT}{of}"), F.lit(1)))
        rule = F.coalesce(rule, F.when((value - noise > F.col(f"{COUNT}{m}_high")) | (value + noise < F.col(f"{COUNT}{m}_low")), F.lit(m)))
    rule = F.when(F.col(f"{COUNT}base_failed"), F.lit("base")).otherwise(rule)
    keep = [c for c in keep if c not in ADDED]
    return marked.select(*keep, *[F.col(f"{COUNT}{c}").alias(c) for c in (*MEASURES, "base_failed")], rule.isNull().alias("kept"), rule.alias("failed_rule"))


def judge(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Count, sketch and judge a table of documents; ``keep`` names the columns that stay (all by default).

    Columns named like the ones added are replaced. The counts are stored once for both uses;
    texts are not stored with them unless they are to stay.
    """
    keep = [c for c in (keep if keep is not None else documents.columns) if c not in ADDED]
    rows = counted(documents, keep)
    return judged(rows if "text" in keep else stored(rows), keep)


def quality_report(documents: DataFrame) -> DataFrame:
    return judge(documents.select("doc_id", "text", "lang", "source"), ["doc_id"])


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass the base rules and their group's fences, with their own columns."""
    kept = judge(documents.withColumn(fresh(documents, "own_columns")[0], F.struct(*documents.columns)), fresh(documents, "own_columns"))
    return kept.where("kept").select(f"{kept.columns[0]}.*")
