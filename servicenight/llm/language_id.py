"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document is the mean embedding of its byte n-grams, hashed into buckets; a linear layer and a
softmax turn it into language probabilities. Embeddings and layer are trained together by
stochastic gradient descent in numpy on a bounded sample. Since the mean and the layer are both
linear, a prediction averages one score row per n-gram, which Arrow tasks do over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from servicenight.llm import textvec
from servicenight.llm.common import fresh

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
DIMENSIONS = 16
#: The classifier is fitted on about this many rows of each language (picked by a hash of doc_id), for
#: the most frequent languages; none is longer than so many characters. This bounds what the driver holds.
TRAIN_ROWS = 600
TRAIN_LANGUAGES = 200
TRAIN_CHARS = 40_000
EPOCHS = 6
RATE = 8.0
#: Share of rightly named calibration rows that rejection may cost.
REJECT_SHARE = 0.001
#: Scores that are less than this under the threshold differ from it by rounding alone.
ROUNDING = 1e-9
#: For calibration, fold after fold is held back and scored by a model fitted without it, until so many rows
#: are scored or every row is.
FOLDS, CALIBRATION_ROWS = 5, 2000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a space, A-Z lower case; bytes of other characters stay.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray        # language x bucket: embedding times layer
    bias: np.ndarray
    temperature: float
    threshold: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def folded(data: np.ndarray) -> np.ndarray:
    out = FOLD[data]
    capital = np.flatnonzero((out[1:] >= 0x80) & (out[1:] < 0x9F) & (out[:-1] == 0xC3)) + 1
    out[capital] += 0x20  # capitals of the Latin-1 block
    return out


def ngram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; the last ``order - 1`` bytes start none."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = np.full(n, order, np.uint32)
    for i in range(order):
        code *= np.uint32(0x01000193)
        code ^= data[i:n + i]
    code *= np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - BUCKET_BITS)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares."""
    data = folded(np.frombuffer(text.encode(), np.uint8))
    buckets = np.concatenate([ngram_buckets(data, order) for order in ORDERS])
    distinct, counts = np.unique(buckets, return_counts=True)
    return distinct.astype(np.int32), (counts / max(1, len(buckets))).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descend(features: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, rows: np.ndarray, n_languages: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Score of each bucket for each language, and bias, fitted on the numbered rows.

    A single language has no other to be told from: a bucket's score is then how much more often
    it occurs than if all were alike.
    """
    if n_languages == 1:
        seen = np.full(1 << BUCKET_BITS, 0.5 / (1 << BUCKET_BITS))
        for i in rows:
            seen[features[i][0]] += features[i][1] / max(1, len(rows))
        return np.log(seen / seen.mean())[:, None], np.zeros(1)
    embeddings = random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    layer = random.normal(0, 0.3, (DIMENSIONS, n_languages))
    bias = np.zeros(n_languages)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(rows):
            buckets, shares = features[i]
            mean = shares @ embeddings[buckets]
            error = softmax(mean @ layer + bias)
            error[wanted[i]] -= 1
            back = layer @ error
            layer -= 0.05 * rate * np.outer(mean, error)
            bias -= 0.001 * rate * error
            embeddings[buckets] -= rate * np.outer(shares, back)
    return embeddings @ layer, bias


def probabilities(raw: np.ndarray, temperature: float) -> np.ndarray:
    """Of each language; a single one is weighed against text in which all n-grams are alike."""
    alone = raw.shape[1] == 1
    return softmax((np.column_stack([raw, np.zeros(len(raw))]) if alone else raw) * temperature)[:, :raw.shape[1]]


def train(rows: list[tuple[str, str]]) -> Model | None:
    """Fit the model on (text, language) rows; None without any usable row."""
    rows = sorted({(t, l) for t, l in rows if t and l is not None and _LETTER.search(t)})
    if not rows:
        return None
    languages = sorted({l for _, l in rows})
    place = {l: i for i, l in enumerate(languages)}
    random = np.random.Generator(np.random.PCG64(11))
    rows = [rows[i] for i in random.permutation(len(rows))]
    features = [document_features(t) for t, _ in rows]
    wanted = np.array([place[l] for _, l in rows])
    everyone = np.arange(len(rows))
    scores, bias = descend(features, wanted, everyone, len(languages), random)
    held = everyone[:0]
    raw = np.empty((len(rows), len(languages)))
    for k in range(min(FOLDS, len(rows))):
        if len(held) >= CALIBRATION_ROWS:
            break
        fold = everyone[k::FOLDS]
        others, b = descend(features, wanted, np.delete(everyone, np.s_[k::FOLDS]), len(languages), random)
        raw[fold] = [features[i][1] @ others[features[i][0]] + b for i in fold]
        held = np.concatenate([held, fold])
    raw, truth = raw[held], wanted[held]
    losses = {t: -np.log(probabilities(raw, t)[np.arange(len(raw)), truth] + 1e-12).mean()
              for t in np.geomspace(0.25, 4, 17)}
    temperature = float(min(losses, key=losses.get)) if len(languages) > 1 else 1.0
    probable = probabilities(raw, temperature)
    right = probable.max(axis=1)[probable.argmax(axis=1) == truth]
    threshold = float(np.quantile(right, REJECT_SHARE, method="lower")) if len(right) else 0.0
    return Model(languages, np.ascontiguousarray(scores.T), bias, temperature, max(0.0, threshold - ROUNDING))


def predictions(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a column."""
    names, scores = [UNKNOWN] * len(column), np.zeros(len(column))
    data, offsets = textvec.column_bytes(column)
    for first, last in textvec.steps(offsets):
        place = offsets[first:last + 1] - offsets[first]
        piece = data[offsets[first]:offsets[last]]
        lengths = np.diff(place)
        plain = folded(piece)
        letters = np.diff(np.concatenate([[0], np.cumsum((plain >= 0x61) & (plain < 0x7B))])[place]) > 0
        for i in np.flatnonzero(~letters & (lengths > 0)):
            letters[i] = bool(_LETTER.search(column[first + int(i)].as_py()))
        if model is None or not letters.any():
            continue
        chosen = np.flatnonzero(letters)
        sums, grams = np.zeros((len(model.languages), len(chosen))), np.zeros(len(chosen))
        for order in ORDERS:
            buckets = ngram_buckets(plain, order)
            long = lengths[chosen] >= order
            if not long.any():
                continue
            # an n-gram belongs to a row if it ends inside it: cut each row's range short
            starts, ends = place[chosen[long]], place[chosen[long] + 1] - order + 1
            marks = np.column_stack([starts, ends]).ravel()
            for k, row in enumerate(model.scores):
                values = np.append(row[buckets], 0.0)
                sums[k, long] += np.add.reduceat(values, np.minimum(marks, len(buckets)))[::2]
            grams[long] += ends - starts
        probable = probabilities((sums / grams + model.bias[:, None]).T, model.temperature)
        best = probable.argmax(axis=1)
        for i, k in zip(chosen, best):
            names[first + int(i)] = model.languages[k]
        scores[first + chosen] = probable[np.arange(len(chosen)), best]
    known = np.array([n != UNKNOWN for n in names], bool)
    return names, scores, ~known | (scores < (model.threshold if model else 0))


def training_rows(documents: DataFrame) -> DataFrame:
    """A bounded sample of labelled rows that are not held out, the same on every run.

    Rows are counted per language; then each language's share of the hash range is set so that
    about ``TRAIN_ROWS`` of its rows fall into it. Nothing is sorted or gathered by language.
    """
    usable = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
        & (F.length("text") <= TRAIN_CHARS))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGUAGES).collect()
    if not counts:
        return usable.limit(0).select("text", "lang")
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, TRAIN_ROWS / r.n))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return usable.where(place < shares[F.col("lang")]).select("text", "lang")


def fit(documents: DataFrame) -> Model | None:
    return train([(r.text, r.lang) for r in training_rows(documents).collect()])


def identify(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to the columns named in ``keep`` (all by default).

    Null, empty and letterless texts are ``und`` with score 0 and rejected. Columns of the same
    names that the table already has are replaced. Prediction reads the text alone.
    """
    (text,) = fresh(documents, "text_read")
    sent = documents.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in (keep if keep is not None else documents.columns) if c not in ("lang_pred", "score", "rejected")]
    schema = documents.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = predictions(sent.value, batch.column(text))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, textvec.strings(names), pa.array(scores), pa.array(rejected)], [*columns, "lang_pred", "score", "rejected"])

    return documents.select(*columns, F.col("text").alias(text)).mapInArrow(work, schema)


def language_of(documents: DataFrame) -> DataFrame:
    """Fit on the table's own labels and name the language of every document."""
    model = fit(documents)
    return identify(documents.select("doc_id", "text"), model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(documents: DataFrame) -> DataFrame:
    """The documents whose language the fitted model does not reject, with their own columns."""
    marked = identify(documents, fit(documents))
    return marked.where(~F.col("rejected")).select(*documents.columns)
