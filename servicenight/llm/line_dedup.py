"""Line de-duplication across documents, returned as keep bitmaps.

Every long enough line becomes a row of two 64-bit hashes, its document and its position. Rows
are range-partitioned and sorted by hash, then document (largest first), then position, so a
much-repeated line is cut into as many ranges as its rows need. Runs that touch a range's edge
are summed up first, two rows per range; then each range is streamed, the first document of a
line keeps it and the others lose it. What moves on is one compressed bitmap per document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from servicenight.llm import textvec
from servicenight.llm.common import ascii_lower, fresh, same_row, stored, text_key
from servicenight.session import materialize

MIN_CHARS = 20
MIN_DOCUMENTS = 3
STRIPPED = " \t\n\x0b\f\r"
_ROWS = ["h1", "h2", "doc", "known", "text_key", "pos"]


def line_rows(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points; a null doc_id is the smallest document."""
    lines = documents.select(
        F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc"), F.col("doc_id").isNotNull().cast("int").alias("known"),
        text_key(F.col("text")).alias("text_key"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(STRIPPED)))
    return lines.withColumn("key", key).where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "known", "text_key", "pos")


class Runs:
    """Sorted rows as numpy columns, with the starts of lines (runs) and of documents inside them."""

    def __init__(self, table: pa.Table):
        self.h1, self.h2, self.doc, self.known, self.text_key, self.pos = (table.column(c).to_numpy() for c in _ROWS)
        n = len(self.h1)
        new_line = np.ones(n, bool)
        new_line[1:] = (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1])
        new_doc = new_line.copy()
        new_doc[1:] |= (self.doc[1:] != self.doc[:-1]) | (self.known[1:] != self.known[:-1])
        self.starts, self.line = np.flatnonzero(new_line), np.cumsum(new_line) - 1
        self.n_docs = np.add.reduceat(new_doc.astype(np.int64), self.starts)

    def key(self, run: int) -> tuple[int, int]:
        return int(self.h1[self.starts[run]]), int(self.h2[self.starts[run]])

    def top(self, run: int) -> tuple[int, int]:
        """The largest document of a run: real ids before the null one."""
        return int(self.known[self.starts[run]]), int(self.doc[self.starts[run]])


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    """Complete runs of a sorted range, batch by batch; only the last run of a batch waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = (batch.column("h1")[batch.num_rows - 1], batch.column("h2")[batch.num_rows - 1])
        if (batch.column("h1")[0], batch.column("h2")[0]) == last and (not waiting or _last(waiting) == last):
            waiting.append(batch)
            continue
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        same = (h1 == h1[-1]) & (h2 == h2[-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        waiting.append(batch.slice(0, cut))
        table = pa.Table.from_batches([b for b in waiting if b.num_rows])
        if table.num_rows:
            yield Runs(table)
        waiting = [batch.slice(cut)]
    if waiting:
        yield Runs(pa.Table.from_batches(waiting))


def _last(waiting: list[pa.RecordBatch]) -> tuple:
    b = waiting[-1]
    return b.column("h1")[b.num_rows - 1], b.column("h2")[b.num_rows - 1]


def edge_runs(ranged: DataFrame) -> dict[tuple[int, int], tuple[int, tuple[int, int]]]:
    """Documents and largest document of the first and last line of each range: two entries per range at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for runs in streamed(batches):
            for run in {0, len(runs.starts) - 1}:
                last = (*runs.key(run), int(runs.n_docs[run]), *runs.top(run))
                first = first or last
            last = (*runs.key(len(runs.starts) - 1), int(runs.n_docs[-1]), *runs.top(len(runs.starts) - 1))
        rows = [r for r in dict.fromkeys([first, last]) if r]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "n", "known", "doc"])

    edges: dict = {}
    for r in ranged.mapInArrow(work, "h1 long, h2 long, n long, known long, doc long").collect():
        n, top = edges.get((r.h1, r.h2), (0, (-1, 0)))
        edges[r.h1, r.h2] = (n + r.n, max(top, (r.known, r.doc)))
    return edges


def dropped_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Positions that lose their line: (doc, known, text_key, pos)."""
    keys = ["h1", "h2", F.col("known").desc(), F.col("doc").desc()]
    # stored, so that cutting ranges samples these rows and does not split the texts twice
    rows = stored(line_rows(documents, min_chars))
    ranged = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text_key", "pos"))
    edges = documents.sparkSession.sparkContext.broadcast(edge_runs(ranged))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in streamed(batches):
            n_docs = runs.n_docs.copy()
            doc, known = runs.doc[runs.starts].copy(), runs.known[runs.starts].copy()
            for run in {0, len(runs.starts) - 1}:
                if runs.key(run) in edges.value:
                    n_docs[run], (known[run], doc[run]) = edges.value[runs.key(run)]
            lost = (n_docs >= min_documents)[runs.line] & ((runs.doc != doc[runs.line]) | (runs.known != known[runs.line]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[lost]) for x in (runs.doc, runs.known, runs.text_key, runs.pos)], ["doc", "known", "text_key", "pos"])

    return ranged.mapInArrow(work, "doc long, known int, text_key long, pos int")


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep): for each text that loses lines, zlib over packed bits, line 0 first.

    Lines beyond the last bit are kept. A line's key is the line stripped of white space with A-Z
    lower-cased; keys of ``min_chars`` code points in ``min_documents`` documents stay in the
    largest doc_id alone. Rows of one doc_id are one document; those with unequal texts have a
    bitmap each. Null ids are one document below all others; null texts are one empty line.
    """
    lost = dropped_lines(documents, min_chars, min_documents).groupBy("doc", "known", "text_key").agg(F.collect_set("pos").alias("lost"))
    lost = lost.select(F.when(F.col("known") == 1, F.col("doc")).alias("doc_id"), "text_key", "lost")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps, sizes = [], []
            for value in batch.column("lost"):
                places = value.values.to_numpy()
                bits = np.ones(int(places.max()) // 8 * 8 + 8, np.uint8)
                bits[places] = 0
                bitmaps.append(zlib.compress(np.packbits(bits).tobytes()))
                sizes.append(len(places))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                                              pa.array(bitmaps, pa.binary())], ["doc_id", "text_key", "n_dropped", "keep"])

    return lost.mapInArrow(work, "doc_id long, text_key long, n_dropped long, keep binary")


def kept_text(text: str | None, keep: bytes | None) -> str:
    """The lines of a text that its bitmap keeps."""
    text = text or ""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)]
    return "\n".join([line for i, line in enumerate(lines) if i >= len(bits) or bits[i]])


def with_bitmaps(documents: DataFrame, **limits: int) -> DataFrame:
    """Every document with its bitmap (null if nothing goes) and dropped lines in two columns more, the last ones."""
    doc_id, key, keep, n_dropped = fresh(documents, "line_doc_id", "line_text_key", "keep", "n_dropped")
    bitmaps = keep_bitmaps(documents.select("doc_id", "text"), **limits).select(
        F.col("doc_id").alias(doc_id), F.col("text_key").alias(key), F.col("keep").alias(keep), F.col("n_dropped").alias(n_dropped))
    return documents.join(bitmaps, same_row(doc_id, key), "left").drop(doc_id, key)


def line_report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document; an empty remainder hashes the empty text."""
    marked = with_bitmaps(documents.select("doc_id", "text")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "keep",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(kept_text(t.as_py(), k.as_py()).encode()).hexdigest()
                       for t, k in zip(batch.column("text"), batch.column("keep"))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")] + [textvec.strings(digests)],
                                             ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.mapInArrow(work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents with their repeated lines gone; ``n_chars``, where present, follows the new text.

    A document that loses every line keeps its row with an empty text; a null text stays null.
    """
    marked = with_bitmaps(documents)
    schema, names = documents.schema, documents.columns
    keep, n_dropped = marked.columns[-2:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else kept_text(t.as_py(), k.as_py())
                     for t, k in zip(batch.column("text"), batch.column(keep))]
            columns = [textvec.strings(texts) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = marked.drop(n_dropped).mapInArrow(work, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
