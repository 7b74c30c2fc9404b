"""Phrase collocations from FM-indexes over word ids, one index per shard of text.

Texts are cut into shards of one language, each with a dictionary of its own. Words frequent enough
over all shards get an id; every shard then holds the Burrows-Wheeler transforms of its frequent words,
forwards and backwards. A phrase is a pair of intervals, one in each. Extending all intervals of a
length by a word, to the left in one transform or to the right in the other, gives the phrases one word
longer with their counts; the other interval follows from the counts of smaller words. Each new
phrase also tells which phrases it is without its first and without its last word: both have to be frequent.
Counts are summed across shards. A sieve of bounded size holds the frequent phrases of a length; for the next
length each shard goes on from those of its phrases that the sieve lets through. What it lets through in
excess costs work, but no result: a longer phrase counts only if both its shorter ones are frequent in fact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight.llm import textvec
from servicenight.llm.common import stored

LONGEST = 4
LEAST_COUNT = 30
#: A candidate goes if some longer candidate has so many percent of its occurrences.
ABSORBED_PERCENT = 80
TOP = 2000
NO_LANGUAGE = "und"
#: Words of one shard, and of all shards that a task holds open.
SHARD_WORDS = 1 << 20
OPEN_WORDS = 3 << 20
#: Rows that a task gathers from its shards before it adds up those of one phrase.
GATHERED_ROWS = 1 << 18
#: Tasks per core that extend phrases from the second sieve on: each sends such a phrase once, however many shards it has.
TASKS_PER_CORE = 2
#: Bits of the largest sieve; more phrases let more others through, and lose none.
SIEVE_BITS = 1 << 28

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACED = textvec.LOWER.copy()
_SPACED[_BREAKS] = 0x20
_SPACED[0x09] = 0x20


class OpenShard:
    """Words of one language seen by a task, as hashes with zero between pieces."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.words: dict[int, bytes] = {0: b""}
        self.n_words = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        spaced = _SPACED[data]
        starts, ends, n_words = textvec.word_spans(spaced, offsets)
        if not len(starts):
            return
        hashes = textvec.span_hashes(textvec.prefix_sums(spaced), starts, ends)
        hashes[hashes == 0] = 1
        breaks = np.concatenate([[0], np.cumsum(_BREAKS[data])])
        row = textvec.row_of(n_words)
        apart = np.flatnonzero((breaks[starts[1:]] != breaks[ends[:-1]]) | (row[1:] != row[:-1])) + 1
        known, first = np.unique(hashes, return_index=True)
        content = spaced.tobytes()
        for h, k in zip(known.tolist(), first.tolist()):
            if h not in self.words:
                self.words[h] = content[starts[k]:ends[k]]
        self.parts += [np.insert(hashes, apart, np.uint64(0)), np.zeros(1, np.uint64)]
        self.n_words += len(hashes)

    def row(self, lang: str) -> dict:
        found, ids = np.unique(np.concatenate(self.parts), return_inverse=True)
        return {"lang": lang, "n_words": self.n_words, "n_tokens": len(ids), "tokens": packed(ids),
                "words": [self.words[h].decode() for h in found[1:].tolist()], "counts": np.bincount(ids)[1:]}


def packed(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype(np.int32).tobytes(), "zstd", asbytes=True)


def unpacked(content: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(content, 4 * n, "zstd"), np.int32)


_SHARD_SCHEMA = "lang string, n_words long, n_tokens long, tokens binary, words array<string>, counts array<long>"


def shards(documents: DataFrame) -> DataFrame:
    """(shard, lang, n_words, n_tokens, tokens, words, counts): the texts as ids of a dictionary per shard, 0 between pieces."""

    schema = pa.schema([("lang", pa.string()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary()),
                        ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, OpenShard] = {}

        def close(lang: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([open_.pop(lang).row(lang)], schema)

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pa.array(langs.indices.to_numpy() == k))
                data, offsets = textvec.column_bytes(texts)
                for first, last in textvec.steps(offsets):
                    open_.setdefault(lang, OpenShard()).add(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                    if open_[lang].n_words >= SHARD_WORDS:
                        yield close(lang)
                    elif sum(s.n_words for s in open_.values()) >= OPEN_WORDS:
                        yield close(max(open_, key=lambda x: open_[x].n_words))
        for lang in [x for x in open_ if open_[x].n_words]:
            yield close(lang)

    texts = documents.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text").where(F.col("text").isNotNull())
    return stored(texts.mapInArrow(work, _SHARD_SCHEMA).withColumn("shard", F.monotonically_increasing_id()))


@dataclass
class Phrases:
    """Phrases of one length in a shard: the ids of their words, one column per word, and their intervals in both transforms."""

    words: np.ndarray
    low: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def take(self, rows: np.ndarray) -> Phrases:
        return Phrases(self.words[rows], self.low[rows], self.back[rows], self.size[rows])


def transform(text: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform with rotations in order of their first three words, which is all that intervals of ``LONGEST - 1`` words need."""
    wide, n = text.astype(np.int64), int(text.max()) + 1
    return text[np.argsort((wide * n + np.roll(wide, -1)) * n + np.roll(wide, -2)) - 1]


def last_to_first(column: np.ndarray) -> np.ndarray:
    """Where each row of a transform goes when its last word is put in front."""
    out = np.empty(len(column), np.int64)
    out[np.argsort(column.astype(np.int64) * len(column) + np.arange(len(column)))] = np.arange(len(column))
    return out


class Index:
    """Both transforms of a shard; ``ids`` are the frequent words in the order of their numbers from 1, 0 stands between pieces."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, ids: np.ndarray):
        self.forward, self.backward, self.ids = forward, backward, ids
        self._steps: dict[bool, np.ndarray] = {}

    def single_words(self) -> Phrases:
        size = np.bincount(self.forward, minlength=len(self.ids) + 1)
        low = (np.cumsum(size) - size)[1:]
        return Phrases(self.ids[:, None], low, low, size[1:])

    def extended(self, phrases: Phrases, left: bool) -> Phrases:
        """The phrases with one more word on a side, where both of their shorter phrases are among the given ones."""
        column = self.forward if left else self.backward
        if left not in self._steps:
            self._steps[left] = last_to_first(column)
        here, there = (phrases.low, phrases.back) if left else (phrases.back, phrases.low)
        size = phrases.size
        if not len(size):
            none = np.zeros(0, np.int64)
            return Phrases(np.zeros((0, phrases.words.shape[1] + 1), np.int64), none, none, none)
        owner = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        rows = np.arange(int(size.sum())) - begin[owner] + here[owner]
        key = owner * (len(self.ids) + 1) + column[rows]
        order = np.argsort(key)
        key, rows = key[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        owner, word = key[first] // (len(self.ids) + 1), key[first] % (len(self.ids) + 1)
        low = self._steps[left][np.minimum.reduceat(rows, first)]
        other = there[owner] + first - begin[owner]
        by_low = np.argsort(here)
        place = by_low[np.maximum(np.searchsorted(here[by_low], low, "right") - 1, 0)]
        keep = (word > 0) & (low >= here[place]) & (low < here[place] + size[place])
        low, other, count, owner, place = low[keep], other[keep], count[keep], owner[keep], place[keep]
        prefix, suffix = (place, owner) if left else (owner, place)
        words = np.column_stack([phrases.words[prefix], phrases.words[suffix][:, -1]])
        return Phrases(words, low, other, count) if left else Phrases(words, other, low, count)


_INDEX_SCHEMA = "shard long, n_tokens long, forward binary, backward binary, ids array<long>"


def build_indexes(cut: DataFrame, frequent: DataFrame) -> DataFrame:
    """(shard, n_tokens, forward, backward, ids): the stored indexes over the frequent words of each shard."""
    places = cut.select("shard", "lang", F.posexplode("words").alias("place", "word"))
    ids = places.join(frequent.select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"])
    lists = ids.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("known"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, tokens, n_local, known in zip(*(batch.column(c) for c in ("shard", "n_tokens", "tokens", "n_local", "known"))):
                numbers = np.zeros(n_local.as_py() + 1, np.int32)
                place, ids = (known.values.field(k).to_numpy() for k in ("place", "id"))
                numbers[place + 1] = np.arange(1, len(place) + 1)
                text = numbers[unpacked(tokens.as_py(), n.as_py())]
                text = np.append(text[(text != 0) | (np.roll(text, 1) != 0)], np.int32(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()]), pa.array([len(text)]), pa.array([packed(transform(text))], pa.binary()),
                     pa.array([packed(transform(text[::-1]))], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["shard", "n_tokens", "forward", "backward", "ids"])

    joined = cut.select("shard", "n_tokens", "tokens", F.size("words").alias("n_local")).join(lists, "shard")
    return stored(joined.mapInArrow(work, _INDEX_SCHEMA))


def word_columns(size: int) -> list[str]:
    return [f"w{k}" for k in range(1, size + 1)]


def sieve_places(words: np.ndarray, bits: int) -> list[np.ndarray]:
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h = textvec.mix(h * np.uint64(textvec.BASE) + words[:, k].astype(np.uint64) + np.uint64(1))
    g = textvec.mix(h)
    return [(part & np.uint64(bits - 1)).astype(np.int64) for part in (h, h >> np.uint64(32), g, g >> np.uint64(32))]


def sifted(phrases: Phrases, sieve: np.ndarray) -> Phrases:
    through = np.ones(len(phrases.size), np.uint64)
    for at in sieve_places(phrases.words, 64 * len(sieve)):
        through &= sieve[at >> 6] >> (at & 63).astype(np.uint64)
    return phrases.take(np.flatnonzero(through))


def make_sieve(frequent: DataFrame, size: int) -> np.ndarray:
    """Bits at four places of every frequent phrase, as words of 64; of ``SIEVE_BITS`` at most, whatever the number of phrases."""
    bits, names = min(SIEVE_BITS, 1 << max(12, (64 * frequent.count()).bit_length())), word_columns(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(sieve_places(np.column_stack([batch.column(c).to_numpy() for c in names]), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    filled = frequent.select(*names).mapInArrow(work, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return out.view(np.uint64)


def added_up(parts: list[pa.RecordBatch]) -> pa.Table:
    *words, n = parts[0].schema.names
    total = pa.Table.from_batches(parts).group_by(words, use_threads=False).aggregate([(n, "sum")])
    return pa.table([*(total.column(c) for c in words), total.column(f"{n}_sum")], [*words, n])


def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with those of one phrase added up, as far as ``GATHERED_ROWS`` rows at a time allow."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= GATHERED_ROWS:
            total = added_up(held)
            held, rows = total.to_batches(), total.num_rows
            if 2 * rows > GATHERED_ROWS:
                yield from total.to_batches(1 << 17)
                held, rows = [], 0
    if held:
        yield from added_up(held).to_batches(1 << 17)


def extensions(indexes: DataFrame, sieves: list[np.ndarray]) -> DataFrame:
    """(w1, w2, ..., n): each shard's phrases one word longer than the last sieve's, which start with two words, and their counts there.

    Left and right extension take turns, so that each needs the interval that the other kept up. Phrases that two sieves
    have let through are few and recur from shard to shard, so a few tasks take many shards each and add their counts up.
    """
    cores, recurring = indexes.sparkSession.sparkContext.defaultParallelism, len(sieves) > 1
    names = [*word_columns(len(sieves) + 2), "n"]
    held = indexes.sparkSession.sparkContext.broadcast(sieves)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, forward, backward, ids in zip(*(batch.column(c) for c in ("n_tokens", "forward", "backward", "ids"))):
                index = Index(unpacked(forward.as_py(), n.as_py()), unpacked(backward.as_py(), n.as_py()), ids.values.to_numpy())
                found = index.extended(index.single_words(), True)
                for depth, sieve in enumerate(held.value):
                    found = index.extended(sifted(found, sieve), depth % 2 == 1)
                for first in range(0, len(found.size), 1 << 17):
                    part = slice(first, first + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*found.words[part].T, found.size[part])], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(counted(batches)) if recurring else counted(batches)

    read = indexes.select("n_tokens", "forward", "backward", "ids")
    return (read.coalesce(TASKS_PER_CORE * cores) if recurring else read).mapInArrow(work, ", ".join(f"{c} long" for c in names))


def summed(found: DataFrame, least: int) -> DataFrame:
    """(w1, w2, ..., a) of the phrases frequent over all shards; a shard or a task with several sends each phrase once, already counted."""
    names = found.columns[:-1]
    return stored(found.repartition(*names).groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least))


def described(frequent: DataFrame, shorter: DataFrame, size: int) -> DataFrame:
    """Phrases with their text and the counts of their parts, from the phrases one word shorter, which both have to be there."""
    names = word_columns(size)
    p = shorter.select(*[F.col(c).alias(f"p_{c}") for c in shorter.columns])
    s = shorter.select(*[F.col(c).alias(f"s_{c}") for c in shorter.columns])
    starts = [F.col(c) == F.col(f"p_{c}") for c in names[:-1]]
    ends = [F.col(c) == F.col(f"s_w{k}") for k, c in enumerate(names[1:], 1)]
    return stored(frequent.join(p, starts).join(s, ends).select(
        *names, F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "s_last_word").alias("phrase"), F.col("s_last_word").alias("last_word"), "a",
        F.col("p_first").alias("first"), F.col("s_last").alias("last"), F.col("p_a").alias("head"), F.col("s_a").alias("tail"),
        F.col("p_head").alias("inner_head"), F.col("s_tail").alias("inner_tail")))


def frequent_phrases(documents: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words counted, and the frequent phrases of each length from one word on."""
    cut = shards(documents)
    totals = cut.groupBy("lang").agg(F.sum("n_words").alias("n"))
    counts = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a"))
    words = stored(counts.where(F.col("a") >= least).withColumn("id", F.monotonically_increasing_id()))
    indexes = build_indexes(cut, words)
    none = F.lit(None).cast("long")
    levels = [words.select(F.col("id").alias("w1"), "lang", "phrase", F.col("phrase").alias("last_word"), "a", F.col("a").alias("first"), F.col("a").alias("last"),
                           none.alias("head"), none.alias("tail"), none.alias("inner_head"), none.alias("inner_tail"))]
    sieves: list[np.ndarray] = []
    while len(levels) < longest:
        frequent = summed(extensions(indexes, sieves), least)
        levels.append(described(frequent, levels[-1], len(levels) + 1))
        if len(levels) < longest:
            sieves.append(make_sieve(frequent, len(levels)))
    return totals, levels


def candidates(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score, best_left, best_right) of all phrases from two words on.

    ``best_left`` and ``best_right`` are the counts of the most frequent candidates one word longer on that
    side; no phrase that is longer still can have more.
    """
    def cut(k: int, left: str, right: str) -> Column:
        # decimals, since the product may pass 64 bits
        worth = F.expr(f"(cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0))) div ({left} + {right})")
        return F.struct(worth.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    cuts = {2: [cut(1, "head", "tail")], 3: [cut(1, "first", "tail"), cut(2, "head", "last")],
            4: [cut(1, "first", "tail"), cut(2, "inner_head", "inner_tail"), cut(3, "head", "last")]}
    out = None
    for size, phrases in enumerate(levels[1:], 2):
        told = phrases.withColumn("c", F.array_min(F.array(*cuts[size])))
        names = word_columns(size)
        for side, shift in (("best_left", 1), ("best_right", 0)):
            if size < len(levels):
                inner = [F.col(f"w{k + shift}").alias(c) for k, c in enumerate(names, 1)]
                told = told.join(levels[size].groupBy(*inner).agg(F.max("a").alias(side)), names, "left")
            else:
                told = told.withColumn(side, F.lit(None).cast("long"))
        rows = told.select("lang", "phrase", "a", "c.l", "c.r", "c.score", "best_left", "best_right")
        out = rows if out is None else out.union(rows)
    return out


def collocations(documents: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases, with the counts of their best extensions.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they
    stand there; equal scores are ranked by count, then by the phrase's bytes. An empty table gives no rows.
    Other columns than text and lang are not read.
    """
    totals, levels = frequent_phrases(documents)
    best = F.coalesce(F.greatest("best_left", "best_right"), F.lit(0).cast("long"))
    left = candidates(levels).where(100 * best < ABSORBED_PERCENT * F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                              F.col("score").cast("long").alias("score"), "best_left", "best_right")
