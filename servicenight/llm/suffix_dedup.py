"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

Every string of ``LENGTH`` bytes holds an anchor: the k-gram with the least hash, leftmost first.
Equal strings have equal anchors at equal offsets, so only strings with the same anchor can be
equal. Anchors that stand at two places or more are found by counting; the text around each of
them (its context: all strings that have this anchor) is gathered by anchor, equal contexts as one
with a weight. A group of contexts then gets a suffix array over the places where a string may
start: suffixes smaller than their successors are sorted directly, the others are induced by
scanning the buckets of first bytes, and neighbours with a common prefix of ``LENGTH`` bytes mark
repeated strings. An anchor with very many contexts is split by string instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from servicenight.llm import textvec
from servicenight.llm.common import stored, text_key

LENGTH = 200
GRAM = 80
#: Bytes of context that one suffix array takes in, and the contexts of one anchor beyond which it is split.
ARRAY_BYTES = 1 << 20
SPLIT_CONTEXTS = 1000
#: Bits of a place within one vector step; the same everywhere, so that ties fall alike everywhere.
PLACE_BITS = 31


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, first and last start (within the row) of each run of strings with one anchor."""
    n, width = len(data), length - gram + 1
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    sums = textvec.prefix_sums(data)
    hashes = textvec.mix((sums[gram:] - sums[:-gram]) * textvec.powers(n - gram + 1, inverse=True))
    # hash above, place below: the least value is the least hash, leftmost first
    bits = np.uint64(PLACE_BITS)
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(keys) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:len(keys)] = keys
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[width - 1:width - 1 + count])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # a start counts if its string ends inside its row
    valid = np.zeros(n + 1, np.int64)
    long = sizes >= length
    valid[offsets[:-1][long]] += 1
    np.subtract.at(valid, offsets[1:][long] - length + 1, 1)
    starts = np.flatnonzero(np.cumsum(valid)[:count] > 0)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    rows = np.searchsorted(offsets, starts[first], "right") - 1
    return rows, hashes[place[first]], starts[first] - offsets[rows], starts[last] - offsets[rows]


def text_identity(text: Column) -> list[Column]:
    """Two hashes and the byte length: what equal texts share."""
    text = F.coalesce(text, F.lit(""))
    return [text_key(text).alias("text_key"), F.xxhash64(F.lit("second"), text).alias("second_key"), F.octet_length(text).cast("bigint").alias("n_bytes")]


def distinct_texts(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(text_key, second_key, n_bytes, doc_id, copies, anchors): one row per text, under its smallest doc_id."""
    named = documents.select("doc_id", *text_identity(F.col("text")), "text")
    columns = ["doc_id", "text_key", "second_key", "n_bytes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.column_bytes(batch.column("text"))
            values, counts = [], []
            for i, j in textvec.steps(offsets):
                rows, hashes, _, _ = anchors(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length, gram)
                values.append(hashes.view(np.int64))
                counts.append(np.bincount(rows, minlength=j - i))
            places = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists], [*columns, "anchors"])

    schema = named.select(*columns).schema.add("anchors", T.ArrayType(T.LongType()))
    return named.mapInArrow(work, schema).groupBy("text_key", "second_key", "n_bytes").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("anchors").alias("anchors"))


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, shared): the anchors of each text that stand elsewhere too, once each."""
    posted = texts.select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    # stored, so that the join meets two plain shuffles and a frequent anchor can be split
    often = stored(posted.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"))
    return posted.join(often, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("shared"))


def contexts(documents: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_key, first, anchor, context): the bytes of all strings around each shared anchor."""
    wanted = shared.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "shared")
    texts = documents.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")))
    names = ["doc_id", "text_key", "first", "anchor", "context"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.column_bytes(batch.column("text"))
            for i, j in textvec.steps(offsets):
                piece, place = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                rows, hashes, first, last = anchors(piece, place, length, gram)
                listed = np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in batch.column("shared")[i:j])])
                keep = np.flatnonzero(np.isin(hashes.view(np.int64), listed))
                rows, hashes, first, last = rows[keep], hashes[keep], first[keep], last[keep]
                content = piece.tobytes()
                begin = (place[rows] + first).tolist()
                end = (place[rows] + last + length).tolist()
                source = pa.array(rows + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(source), batch.column("text_key").take(source), pa.array(first, pa.int64()),
                     pa.array(hashes.view(np.int64)), pa.array([content[a:b] for a, b in zip(begin, end)], pa.binary())], names)

    schema = texts.select("doc_id", "text_key").schema.add("first", "long").add("anchor", "long").add("context", "binary")
    return texts.select("doc_id", "text_key", "text", "shared").mapInArrow(work, schema)


def suffix_order(content: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places where a string of ``length`` bytes starts, in the order of their suffixes.

    ``starts`` and ``ends`` bound the contexts in ``content``; each context is followed by one
    byte that is not part of it and counts as smaller than all others.
    """
    n = len(content)
    letters = np.frombuffer(content, np.uint8).astype(np.int16) + 1
    letters[ends] = 0
    # smaller than its successor: decided by the first change of letter from here on
    change = np.sign(np.diff(letters, append=np.int16(0)))
    decided = np.where(change != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    direct = change[decided] > 0
    direct[ends] = True
    # each context's places, on to the first directly sorted one behind its last start
    next_direct = np.minimum.accumulate(np.where(direct, np.arange(n), n)[::-1])[::-1]
    stop = np.minimum(next_direct[ends - length], ends)
    used = np.zeros(n + 1, np.int64)
    np.add.at(used, starts, 1)
    np.add.at(used, stop + 1, -1)
    used = np.cumsum(used)[:n] > 0
    context_end = np.repeat(ends, np.diff(np.append(starts, n)))
    seeds = np.flatnonzero(used & direct)
    limits = context_end[seeds]
    ranked = [p for _, p in sorted(zip((content[a:b] for a, b in zip(seeds.tolist(), limits.tolist())), seeds.tolist()))]
    ranked = np.array(ranked, np.int64)
    induced = used & ~direct
    # buckets by first letter: induced places first, then the directly sorted ones
    by_letter = np.argsort(letters[ranked], kind="stable")
    ranked = ranked[by_letter]
    cut = np.searchsorted(letters[ranked], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
    order = []
    for letter in range(257):
        parts = waiting[letter]
        level = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = []
        while len(level):  # places whose predecessor has the same letter follow in this bucket
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[induced[before] & (letters[before] == letter)]
        bucket.append(ranked[cut[letter]:cut[letter + 1]])
        bucket = np.concatenate(bucket)
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (letters[before] > letter)]
        for value in np.unique(letters[before]):
            waiting[value].append(before[letters[before] == value])
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[(order + length) <= context_end[order]]


def common_prefix_reaches(content: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each place and the next in order share ``length`` bytes, compared eight at a time."""
    letters = np.frombuffer(content + bytes(8), np.uint8)
    words = np.zeros(len(content) + 1, np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | letters[i:len(words) + i]
    same = np.ones(max(0, len(order) - 1), bool)
    live = np.arange(len(same))
    for step in [*range(0, length - 7, 8), max(0, length - 8)]:
        equal = words[order[live] + step] == words[order[live + 1] + step]
        same[live[~equal]] = False
        live = live[equal]
    return same


def repeated_starts(texts: list[bytes], weights: np.ndarray, keys: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the starts in it whose string occurs again; contexts under no common anchor never meet."""
    sizes = np.array([len(t) for t in texts])
    marks = [np.arange(size - length + 1) if weight > 1 else None for size, weight in zip(sizes, weights)]
    _, group, members = np.unique(keys, return_inverse=True, return_counts=True)
    met = np.flatnonzero(members[group] > 1)  # a context alone under its anchor is judged by its weight
    if len(met):
        content = b"\0".join([texts[i] for i in met]) + b"\0"
        ends = np.cumsum(sizes[met] + 1) - 1
        starts = ends - sizes[met]
        order = suffix_order(content, starts, ends, length)
        same = common_prefix_reaches(content, order, length)
        hit = np.zeros(len(content), bool)
        hit[order[:-1][same]] = True
        hit[order[1:][same]] = True
        for k, i in enumerate(met):
            if marks[i] is None:
                marks[i] = np.flatnonzero(hit[starts[k]:ends[k]])
    return [m if m is not None else np.zeros(0, np.int64) for m in marks]


def runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that strings starting at the sorted places cover."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + length).tolist()))


SPANS = "array<struct<lo:long,hi:long>>"


def _spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"lo": a, "hi": b} for a, b in f] for f in found], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))


def repeated_spans(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, spans): removed byte ranges of each text, as they come from its contexts."""
    found = stored(found)
    named = found.withColumns({"c1": F.xxhash64("context"), "c2": F.xxhash64(F.lit("second"), "context")})
    weighted = stored(named.groupBy("anchor", "c1", "c2", "context").agg(F.count("*").alias("weight")))
    per_anchor = weighted.groupBy("anchor").agg(F.count("*").alias("n_contexts"))
    hot = stored(per_anchor.where(F.col("n_contexts") > SPLIT_CONTEXTS).select("anchor"))
    total = weighted.agg(F.sum(F.length("context"))).first()[0] or 0
    groups = weighted.join(hot, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(total // ARRAY_BYTES + 1)))

    def sort_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        starts = repeated_starts(table.column("context").to_pylist(), table.column("weight").to_numpy(), table.column("anchor").to_numpy(), length)
        out = pa.table([table.column("anchor"), table.column("c1"), table.column("c2"), _spans([runs(s, length) for s in starts])], ["anchor", "c1", "c2", "spans"])
        yield from out.filter(pa.compute.greater(pa.compute.list_value_length(out.column("spans")), 0)).to_batches()

    by_array = groups.groupBy("bucket").applyInArrow(sort_group, f"anchor long, c1 long, c2 long, spans {SPANS}")
    from_arrays = named.select("doc_id", "text_key", "first", "anchor", "c1", "c2").join(by_array, ["anchor", "c1", "c2"]).select(
        "doc_id", "text_key", F.transform("spans", lambda s: F.struct((F.col("first") + s["lo"]).alias("lo"), (F.col("first") + s["hi"]).alias("hi"))).alias("spans"))

    # a hot anchor: each of its strings is a group by itself, counted before it moves
    strings = found.join(hot, "anchor").select("doc_id", "text_key", "first", "context", F.explode(
        F.sequence(F.lit(0), F.length("context") - length)).alias("i")).select(
        "doc_id", "text_key", (F.col("first") + F.col("i")).alias("lo"), F.expr(f"substring(context, i + 1, {length})").alias("s")).select(
        "doc_id", "text_key", "lo", F.xxhash64("s").alias("s1"), F.xxhash64(F.lit("second"), "s").alias("s2"))
    twice = stored(strings.groupBy("s1", "s2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("s1", "s2"))
    from_strings = strings.join(twice, ["s1", "s2"]).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("lo", (F.col("lo") + length).alias("hi"))).alias("spans"))
    return from_arrays.union(from_strings).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remaining(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])


def with_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, whole, spans) of every row: all its bytes go (``whole``), or else those in ``spans``.

    Each row is a document: rows with equal texts of ``length`` bytes or more lose everything.
    Null texts are empty; texts under ``length`` bytes lose nothing.
    """
    documents = documents.select("doc_id", "text")
    texts = stored(distinct_texts(documents, length, gram))
    found = contexts(documents, shared_anchors(texts), length, gram)
    identity = ["text_key", "second_key", "n_bytes"]
    copied = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(*identity)
    copies = documents.select("doc_id", *text_identity(F.col("text"))).join(copied, identity).select("doc_id", "text_key")
    marks = repeated_spans(found, length).select("doc_id", "text_key", "spans", F.lit(False).alias("whole")).union(
        copies.select("doc_id", "text_key", F.array().cast(SPANS), F.lit(True)))
    marks = marks.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("whole").alias("whole")).alias("m")
    rows = documents.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).alias("r")
    rows = rows.join(marks, F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.text_key") == F.col("m.text_key")), "left")
    return rows.select("r.doc_id", "r.text", F.coalesce("m.whole", F.lit(False)).alias("whole"), "m.spans")


def repeat_report(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    marked = with_spans(documents, length, gram)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, whole, spans in zip(batch.column("text"), batch.column("whole"), batch.column("spans")):
                text = text.as_buffer().to_pybytes()
                gone = [(0, len(text))] if whole.as_py() else merged(spans.as_py())
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(remaining(text, gone)).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), textvec.strings(list(columns[3]))], names)

    schema = marked.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return marked.mapInArrow(work, schema)
