"""Spelling variants grouped by PartEnum signatures of their letters.

A word's letters are a set of elements (letter, which occurrence of it), for each half of the word. An
edit falls into one half; the other stays as it is. Replacing a letter takes one element away and adds
one, so two words of one length that differ by it are sets at distance two; an inserted or deleted
letter is a distance of one. A half's elements are partitioned into ``PARTS`` parts. Sets at distance
two differ in two parts at most, so they agree in all others: each way of leaving out two parts (one,
for words whose lengths differ by one) makes one exact signature together with the half that stays.
Equal signatures are joined, and what meets is verified by edit distance.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from servicenight.llm.common import ascii_lower, stored

#: A maximal run of letters; runs of fewer than ``LEAST_LENGTH`` cannot give a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One run in so many loses a letter, chosen by the checksum of its document and itself.
SLIP = 31
#: How many times as frequent as a word its form has to be.
FORM_FACTOR = 10
PARTS = 4
#: Letters by how often they are used, dealt out in turn so that the parts of a word are of like size.
_ALPHABET = "etaoinshrdlucmfwypvbgkjqxz" + "".join(map(chr, range(0xC0, 0x100)))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without one of its letters where the checksum of ``<doc_id>:<run>`` says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): the distinct words with their occurrences over all documents."""
    long_runs = F.regexp_extract_all("text", F.lit(LETTERS + "{%d,}" % LEAST_LENGTH), F.lit(0))
    runs = documents.where(F.col("text").isNotNull()).select("doc_id", F.explode(long_runs).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), ascii_lower(F.col("run"))).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_parts(piece: Column) -> Column:
    """The letters of a piece of a word in order, dealt into ``PARTS`` strings; all of one letter are in one of them."""
    letters = F.array_join(F.array_sort(F.split(piece, "")), "")
    others = ["".join(c for i, c in enumerate(_ALPHABET) if i % PARTS != k) for k in range(PARTS)]
    return F.array(*[F.translate(letters, gone, "") for gone in others])


def signatures(words: DataFrame) -> DataFrame:
    """(signature, longer, word, n): every word under each of its signatures.

    For words of one length (``longer`` is null) a signature leaves out two parts of the half with the
    edit. For lengths that differ by one it leaves out one part, and both words are cut where the
    shorter one is.
    """
    def halves(shorter: Column) -> list[tuple[str, Column, Column]]:
        head = F.floor(shorter / 2).cast("int")
        tail = (shorter - head).cast("int")
        length = F.char_length("word")
        return [("tail", F.substr("word", F.lit(1), head), letter_parts(F.substr("word", head + 1, length))),
                ("head", F.substr("word", length - tail + 1, tail), letter_parts(F.substr("word", F.lit(1), length - tail)))]

    def row(kind: str, shorter: Column, side: str, k: int, gone: tuple, longer: bool | None) -> Column:
        stays, parts = F.col(f"{kind}_{side}"), F.col(f"{kind}_{side}_parts")
        key = F.xxhash64(F.lit("same" if longer is None else "apart"), shorter, F.lit(side), F.lit(k), stays, *[parts[i] for i in range(PARTS) if i not in gone])
        return F.struct(key.alias("signature"), F.lit(longer).cast("boolean").alias("longer"))

    length = F.char_length("word")
    cut = words.select("word", "n", *[c for kind, shorter in (("own", length), ("less", length - 1)) for side, stays, parts in halves(shorter)
                                      for c in (stays.alias(f"{kind}_{side}"), parts.alias(f"{kind}_{side}_parts"))])
    rows = [row("own", length, side, k, gone, None) for side in ("tail", "head") for k, gone in enumerate(combinations(range(PARTS), 2))]
    rows += [row(kind, shorter, side, k, (k,), kind == "less") for kind, shorter in (("own", length), ("less", length - 1))
             for side in ("tail", "head") for k in range(PARTS)]
    return cut.select("word", "n", F.inline(F.array(*rows)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): every pair of words one edit apart, once, with their counts."""
    # words are dealt out anew, since each becomes many rows; both sides of the join read one shuffle
    dealt = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posted = signatures(dealt).repartition("signature")
    # one expression over both sides: a part of it pushed to one side would make two shuffles
    meet = F.when(F.col("a.longer").isNull(), F.col("a.word") < F.col("b.word")).otherwise(F.col("a.longer") & ~F.col("b.longer"))
    pairs = posted.alias("a").join(posted.alias("b"), (F.col("a.signature") == F.col("b.signature")) & meet & (F.levenshtein("a.word", "b.word", 1) == 1))
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("an"), F.col("b.word").alias("b"), F.col("b.n").alias("bn")).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; a form is ten times as frequent, so chains are short and have an end."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.alias("w").join(reached.alias("f"), F.col("w.root") == F.col("f.word"), "left").select(
            "w.word", F.coalesce("f.root", "w.root").alias("root"), F.col("f.root").isNotNull().alias("moved"))
        further = stored(further)
        reached = further.select("word", "root")
        if further.where("moved").isEmpty():
            return reached


def spelling_report(documents: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    Null and empty texts have no words; a null doc_id counts as an empty one in the checksum. Repeated
    rows count as often as they stand there; an empty table gives no rows; other columns are not read.
    """
    words = stored(word_counts(documents))
    pairs = stored(near_words(words))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n")).union(pairs.select("b", "a", "an"))
    # of equal counts the smallest in code-point order, which is UTF-8 order
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.minus") >= FORM_FACTOR * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("f"))
    told = stored(told.select("word", "n", "n_near", "f.form", "f.form_n"))
    roots = roots_of(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def unified(documents: DataFrame) -> DataFrame:
    """(word, root) of the words that another spelling stands for; what a normaliser needs."""
    return spelling_report(documents).where(F.col("root") != F.col("word")).select("word", "root")
