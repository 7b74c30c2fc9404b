"""Byte-pair encoding and decoding with a pair occurrence index.

A task cuts its texts at white space, the runs between into words, and encodes each distinct run and
word once. All new short words of a batch are laid end to end as symbols; in each round every word merges
its own lowest pair, wherever it stands, in vector steps. Long words share an index that maps every
adjacent pair that has a merge to all its positions. Active ranks are taken in ascending order: every
listed position that still holds the pair is merged, and the pairs that this makes join the index under
their own ranks. A pair's merges rank behind those that made its parts, so a new pair never ranks
before the current one.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from servicenight.llm import textvec
from servicenight.llm.common import fresh

#: Words a task remembers before it starts over, and new words that one index takes in.
KNOWN_WORDS = 300_000
INDEX_WORDS = 25_000
#: Letters of a word that is merged in rounds; a round passes over the whole word, so longer ones go by the index.
SHORT_WORD = 64

_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of str.split that is none of the words'.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_NO_RANK = np.int32(2**31 - 1)
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_WORD_OR_BREAK = regex.compile(_WORD.pattern + r"|\n")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else 256 onwards."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the word-end kind: lower case, white space dropped, last symbol marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        #: (left id, right id) -> (rank, merged id); the key packs both ids into one integer
        self.merges: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, out = self.ids[left], self.ids[right], self.ids[left + right]
            if max(made.get(a, -1), made.get(b, -1)) >= rank or made.setdefault(out, rank) != rank:
                raise ValueError("a merge ranks before one that makes its parts")
            self.merges[a << 32 | b] = (rank, out)
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.end] for c in letters]
        #: the merges as sorted arrays, for vector steps, and what each rank makes
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.made = np.array([self.merges[k][1] for k in self.pair_keys[np.argsort(self.pair_ranks)].tolist()], np.int32)
        self.byte_ids = np.array([self.inner, self.last], np.int32)
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: ids and tokens of words and of whole runs between white space; a special token's key begins with a space
        self.ids_of: dict[str, bytes] = {}
        self.tokens_of: dict[str, str] = {}

    @staticmethod
    def lowered(text: str) -> str:
        """Letters are lowered one by one, without context."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def parts(self, text: str) -> list[str]:
        """A text as what stands between its white space, which no word reaches over, or as words where that is not the words' own; special tokens with a space."""
        if not any(t in text for t in self.special):
            lowered = self.lowered(text)
            return _WORD.findall(lowered) if any(c in text for c in _SEPARATORS) else lowered.split()
        out = []
        for i, part in enumerate(self.split_special.split(text)):
            out += [" " + part] if i % 2 else _WORD.findall(self.lowered(part))
        return out

    def learn(self, new: list[str]) -> None:
        """Encode distinct words and remember their ids and tokens."""
        self.learn_by_rounds([w for w in new if len(w) <= SHORT_WORD])
        self.learn_by_index([w for w in new if len(w) > SHORT_WORD])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, ``_NO_RANK`` where it has none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_RANK)

    def learn_by_rounds(self, new: list[str]) -> None:
        """Short words: in each round every word merges its lowest pair, from left to right."""
        if not new:
            return
        coded = [w.encode() for w in new]
        sizes = np.array([len(c) for c in coded])
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.zeros(len(data), np.intp)
        ends[np.cumsum(sizes) - 1] = 1
        symbols, word = self.byte_ids[ends, data], np.repeat(np.arange(len(new), dtype=np.int32), sizes)
        rank = np.full(len(data), _NO_RANK)
        if len(self.pair_keys) and len(data) > 1:
            rank[:-1] = np.where(ends[:-1] == 0, self.ranks(symbols[:-1], symbols[1:]), _NO_RANK)
        done = []
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(word)))
            over = lowest == _NO_RANK
            done.append((word[over], symbols[over]))
            symbols, word, rank, lowest = (x[~over] for x in (symbols, word, rank, lowest))
            at = np.flatnonzero(rank == lowest)
            # one symbol in a row merges by twos from the left
            turn = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(turn, np.diff(turn, append=len(at)))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            symbols, word, rank = symbols[left], word[left], rank[left]
            at = at - np.arange(len(at))
            for touched in (at, at[at > 0] - 1):
                touched, last = touched[touched < len(word) - 1], touched[touched == len(word) - 1]
                rank[last] = _NO_RANK
                rank[touched] = np.where(word[touched] == word[touched + 1], self.ranks(symbols[touched], symbols[touched + 1]), _NO_RANK)
        word, symbols = (np.concatenate(x) for x in zip(*done))
        symbols = symbols[np.argsort(word, kind="stable")]
        places = np.cumsum(np.bincount(word, minlength=len(new))).tolist()
        ids, tokens, names, start = symbols.astype("<u4").tobytes(), symbols.tolist(), self.names, 0
        for w, stop in zip(new, places):
            self.ids_of[w], self.tokens_of[w] = ids[4 * start:4 * stop], " ".join([names[x] for x in tokens[start:stop]])
            start = stop

    def learn_by_index(self, new: list[str]) -> None:
        """Long words: all go through one pair occurrence index."""
        symbols, word_starts = array("i"), []
        for word in new:
            word_starts.append(len(symbols))
            data = word.encode()
            symbols.extend([self.inner[b] for b in data[:-1]])
            symbols.append(self.last[data[-1]])
            symbols.append(-1)  # no pair reaches over the end of a word
        n = len(symbols)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        merges = self.merges
        index: dict[int, list[int]] = defaultdict(list)
        pair_of: dict[int, tuple[int, int, int]] = {}
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0 and (hit := merges.get(a << 32 | b)):
                index[hit[0]].append(i)
                pair_of[hit[0]] = (a, b, hit[1])
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, out = pair_of[rank]
            for i in sorted(index.pop(rank)):
                if symbols[i] != a:
                    continue
                j = after[i]
                if symbols[j] != b:
                    continue
                symbols[i], symbols[j] = out, -2  # -2: swallowed by the symbol before it
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                for left, at in ((symbols[h] if h >= 0 else -1, h), (out, i)):
                    right = out if at == h else symbols[k]
                    if left >= 0 and right >= 0 and (hit := merges.get(left << 32 | right)):
                        if hit[0] not in index:
                            heapq.heappush(active, hit[0])
                            pair_of[hit[0]] = (left, right, hit[1])
                        index[hit[0]].append(at)
        names = self.names
        for word, i in zip(new, word_starts):
            ids = []
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            self.ids_of[word], self.tokens_of[word] = array("I", ids).tobytes(), " ".join([names[x] for x in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text of a batch."""
        ids_of, tokens_of = self.ids_of, self.tokens_of
        if len(ids_of) > KNOWN_WORDS:
            ids_of.clear()
            tokens_of.clear()
        for token, number in self.special.items():
            ids_of[" " + token], tokens_of[" " + token] = array("I", [number]).tobytes(), token
        cut = [self.parts(t) for t in texts]
        coded = pa.array(itertools.chain.from_iterable(cut), pa.string()).dictionary_encode()
        seen = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh_parts = [p for p in seen if p not in ids_of]
        # a word by itself is cut as it is in its run
        found = _WORD_OR_BREAK.findall("\n".join(fresh_parts))
        new = [w for w in set(found) if w not in ids_of and w != "\n"]
        for i in range(0, len(new), INDEX_WORDS):
            self.learn(new[i:i + INDEX_WORDS])
        start = 0
        for part in fresh_parts:
            stop = found.index("\n", start) if part is not fresh_parts[-1] else len(found)
            if stop > start + 1:
                ids_of[part], tokens_of[part] = b"".join([ids_of[w] for w in found[start:stop]]), " ".join([tokens_of[w] for w in found[start:stop]])
            start = stop + 1
        places = pa.array(np.cumsum([0, *map(len, cut)]), pa.int64())
        joined = lambda known, kind, between: pc.binary_join(
            pa.LargeListArray.from_arrays(places, pa.array([known[p] for p in seen], kind).take(coded.indices)), between).to_pylist()
        yield from zip(joined(ids_of, pa.binary(), b""), joined(tokens_of, pa.string(), " "))

    def decode(self, ids: bytes) -> str:
        """Tokens of little-endian unsigned 32-bit ids, joined by spaces; special tokens stay."""
        return " ".join([self.names[i] for i in array("I", ids)])


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The task's tokenizer, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(documents: DataFrame, keep: list[str], path: str, outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Add the outputs: ``n_tokens``, ``ids`` (array of int), ``ids_sha256`` or ``decoded_sha256``.

    ``path`` must be readable on every executor. Null and empty texts have no ids; the decoded
    text of no ids is empty. Columns of the same names are replaced.
    """
    keep, (read,) = [c for c in keep if c not in outputs], fresh(documents, "text_read")
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    schema = documents.select(*keep).schema
    for name in outputs:
        schema = schema.add(name, kinds[name])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            _, offsets = textvec.column_bytes(batch.column(read))
            for first, last in textvec.steps(offsets, 4 << 20):
                part = batch.slice(first, last - first)
                made: dict[str, list] = {name: [] for name in outputs}
                for coded, text in bpe.encode([t or "" for t in part.column(read).to_pylist()]):
                    for name in outputs:
                        made[name].append(_output(name, coded, text))
                columns = [id_lists(made[c]) if c == "ids" else pa.array(made[c], pa.int64() if c == "n_tokens" else pa.string()) for c in outputs]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], schema.names)

    return documents.select(*keep, F.col("text").alias(read)).mapInArrow(work, schema)


def _output(name: str, coded: bytes, text: str) -> int | bytes | str:
    if name == "n_tokens":
        return len(coded) // 4
    return coded if name == "ids" else hashlib.sha256(coded if name == "ids_sha256" else text.encode()).hexdigest()


def id_lists(coded: list[bytes]) -> pa.Array:
    places = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def decode_documents(encoded: DataFrame, keep: list[str], path: str) -> DataFrame:
    """Add ``decoded``, the text of each row's ``ids``; null ids decode to the empty text."""
    keep, (read,) = [c for c in keep if c != "decoded"], fresh(encoded, "ids_read")
    schema = encoded.select(*keep).schema.add("decoded", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(array("I", ids or []).tobytes()) for ids in batch.column(read).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), textvec.strings(texts)], schema.names)

    return encoded.select(*keep, F.col("ids").alias(read)).mapInArrow(work, schema)


def encoding_report(documents: DataFrame, path: str | None = None) -> DataFrame:
    return encode_documents(documents.select("doc_id", "text"), ["doc_id"], path or vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))
