"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A fingerprint is two halves of 32 bits; of three differing bits at most one is in one of them. A
half is 23 bits and 9 more. Every 23-bit word is within three bits of exactly one word of the perfect
Golay code, so 23-bit segments that differ in a bit share that codeword, or, where both are three
bits away from it, one of the five others at four bits. A fingerprint is posted under its own
codeword and under the nearby ones with the 9 bits beside them, and under the 23 bits alone; what
meets is compared bit by bit. Keys that many fingerprints share are parted by the same codes of the
other half, and what is still crowded by the 560 ways to leave out three of sixteen nibbles, which
leave at most 4,096 fingerprints together. A group returns links that connect it, not its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from servicenight.llm import textvec
from servicenight.llm.common import stored, text_key, without
from servicenight.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints under one key that are compared in one task; more are parted by further keys.
TOGETHER = 1024
#: Groups up to this size are compared place by place along the rows, larger ones one by one.
_SMALL = 12
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(textvec.LOWER)

# the perfect binary Golay code of length 23: 12 message bits above 11 check bits
_GENERATOR = 0b110001110101
_BODY, _REST = 23, 9


def _remainder(word: int) -> int:
    for bit in range(_BODY - 1, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


_SYNDROMES = [_remainder(1 << bit) for bit in range(_BODY)]


def _error_patterns() -> np.ndarray:
    """For each syndrome the errors of up to three bits that explain it, then the five of four bits where there are such."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(_BODY), weight):
            syndrome, pattern = 0, 0
            for b in bits:
                syndrome, pattern = syndrome ^ _SYNDROMES[b], pattern | 1 << b
            if weight < 4 or found[syndrome][0].bit_count() == 3:
                found[syndrome].append(pattern)
    return np.array([row + [-1] * (6 - len(row)) for row in found], np.int64)


_PATTERNS = _error_patterns()
_MASKS = np.array([sum(0xF << 4 * k for k in three) for three in combinations(range(16), 3)], np.uint64)


def codewords(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords near 23-bit words, the nearest first, and which of them exist."""
    syndrome = np.zeros(len(body), np.int64)
    for bit, s in enumerate(_SYNDROMES):
        syndrome ^= (body >> bit & 1) * s
    patterns = _PATTERNS[syndrome]
    return (body[:, None] ^ np.maximum(patterns, 0)) >> 11, patterns >= 0


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first:first + (1 << 14)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def text_fingerprint(text: bytes) -> int:
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:].tolist())), np.uint64, len(words) - SHINGLE + 1))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint) of each row; the fingerprint's 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint((t.as_py() or "").encode()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))],
                                             ["doc_id", "text_key", "fingerprint"])

    chosen = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return chosen.mapInArrow(work, chosen.select("doc_id", "text_key").schema.add("fingerprint", "long"))


Keys = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(32)).astype(np.int64), (fp & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def half_keys(kind: np.ndarray, key: np.ndarray, own: np.ndarray, fp: np.ndarray) -> Keys:
    """Keys that fingerprints with at most one error in some half share; one of two has it as its own."""
    out, every = [], np.arange(len(fp))
    for h, half in enumerate(_halves(fp)):
        body, rest = half >> _REST, half & (1 << _REST) - 1
        near, real = codewords(body)
        out.append((every, np.full(len(fp), 2 * h), body, np.ones(len(fp), bool)))
        for k in range(6):
            rows = np.flatnonzero(real[:, k])
            out.append((rows, np.full(len(rows), 2 * h + 1), near[rows, k] << _REST | rest[rows], np.full(len(rows), k == 0)))
    return out


def other_half_keys(kind: np.ndarray, key: np.ndarray, own: np.ndarray, fp: np.ndarray) -> Keys:
    """The crowded keys, each with what up to three errors leave of the other half: a codeword, or nine bits with one error."""
    halves = _halves(fp)
    half = np.where(kind < 2, halves[1], halves[0])
    body, rest = half >> _REST, half & (1 << _REST) - 1
    near, real = codewords(body)
    out = []
    for k in range(6):
        rows = np.flatnonzero(real[:, k])
        out.append((rows, kind[rows] + 4, key[rows] << 12 | near[rows, k], own[rows] & (k == 0)))
    every = np.arange(len(fp))
    for bit in range(-1, _REST):
        out.append((every, kind + 8, key << 12 | (rest ^ (1 << bit if bit >= 0 else 0)), own & (bit < 0)))
    return out


def nibble_keys(kind: np.ndarray, key: np.ndarray, own: np.ndarray, fp: np.ndarray) -> Keys:
    """The fingerprint without three of its sixteen nibbles, in every way."""
    every = np.arange(len(fp))
    return [(every, np.full(len(fp), 12 + m), (fp & ~mask).view(np.int64), np.ones(len(fp), bool)) for m, mask in enumerate(_MASKS)]


_KEY_SCHEMA = "kind int, key long, own boolean, fingerprint long"


def posted(members: DataFrame, keys: Callable[..., Keys]) -> DataFrame:
    """Members (kind, key, own, fingerprint) under their next keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                kind, key, own, fp = (part.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "own", "fingerprint"))
                for rows, kinds, values, owns in keys(kind.astype(np.int64), key, own, fp.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kinds.astype(np.int32)), pa.array(values), pa.array(owns), pa.array(fp[rows])], ["kind", "key", "own", "fingerprint"])

    return members.mapInArrow(work, _KEY_SCHEMA)


def connect(members: np.ndarray) -> list[tuple[int, int]]:
    """Links of one group, one for each member beyond the first of a component."""
    left, out = members, []
    while len(left) > 1:
        open_, left = [left[0]], left[1:]
        while open_ and len(left):
            x = open_.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                out += [(x, y) for y in left[near]]
                open_ += list(left[near])
                left = left[~near]
    return out


def group_links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group of a sorted run of rows."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(group)))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    small = np.flatnonzero(size <= _SMALL)
    for lag in range(1, _SMALL):
        i = small[small + lag < len(fp)]
        i = i[(group[i] == group[i + lag]) & (np.bitwise_count(fp[i] ^ fp[i + lag]) <= DISTANCE)]
        a.append(fp[i])
        b.append(fp[i + lag])
    for k in np.flatnonzero(sizes > _SMALL):
        links = np.array(connect(fp[first[k]:first[k] + sizes[k]]), np.uint64).reshape(-1, 2)
        a.append(links[:, 0])
        b.append(links[:, 1])
    return np.concatenate(a), np.concatenate(b)


def compared(groups: DataFrame) -> DataFrame:
    """Links (a, b) inside groups of bounded size; a group's rows come together and are dropped once compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            kind, key, fp = (table.column(c).to_numpy() for c in ("kind", "key", "fingerprint"))
            group = np.cumsum(np.concatenate([[0], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])) if len(kind) else kind
            a, b = group_links(group, fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            kind, key = table.column("kind").to_numpy(), table.column("key").to_numpy()
            last = int(np.flatnonzero((kind != kind[-1]) | (key != key[-1]))[-1]) + 1 if (kind[0], key[0]) != (kind[-1], key[-1]) else 0
            if last:
                yield links(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield links(held)

    return groups.select("kind", "key", "fingerprint").repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(work, "a long, b long")


def meetings(rows: DataFrame) -> DataFrame:
    """The rows whose key several fingerprints have, one of them as its own; with the number of them."""
    # stored, so that a crowded key's rows can be split where they meet its count
    shared = stored(rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 AND owners > 0"))
    return stored(rows.join(shared.select("kind", "key", "n"), ["kind", "key"]))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``DISTANCE`` bits of each other."""
    start = distinct.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(True).alias("own"), "fingerprint")
    met = meetings(posted(start, half_keys))
    found = compared(met.where(F.col("n") <= TOGETHER))
    crowded = met.where(F.col("n") > TOGETHER).drop("n")
    if not crowded.isEmpty():
        met = meetings(posted(crowded, other_half_keys))
        found = found.union(compared(met.where(F.col("n") <= TOGETHER)))
        crowded = met.where(F.col("n") > TOGETHER).drop("n")
        if not crowded.isEmpty():
            rest = crowded.groupBy("fingerprint").agg(F.first("kind").alias("kind"), F.first("key").alias("key"), F.lit(True).alias("own"))
            found = found.union(compared(posted(rest.select("kind", "key", "own", "fingerprint"), nibble_keys)))
    return found.distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) of every row.

    Null and empty texts have the fingerprint zero and are linked like any other. A null doc_id
    never names a component that has another id. Repeated rows all come out; an empty table gives
    no rows; further columns are not read.
    """
    rows = stored(fingerprints(documents))
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fingerprint")))
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id")


def simhash_report(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint in hexadecimal, component_id) of every row."""
    return near_duplicates(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns."""
    found = near_duplicates(documents.select("doc_id", "text"))
    return without(documents, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
