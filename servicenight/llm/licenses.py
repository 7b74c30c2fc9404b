"""Licence scans over a positional index of licence words, in DataFrame operations alone.

One pass over the texts stores, per file, the positions of the words that any licence template
uses. Their document frequencies over the whole corpus give each template its rarest word. Every
file's occurrences of such words propose places for a template; the neighbouring postings must
stand at the template's relative positions, and its mandatory phrase must be complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from servicenight.llm.common import fresh, phrase_words, stored

#: The phrases whose every place is counted, and their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Further templates: label, template words, and the phrase in them that must be complete.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: A template counts from this share of its words at the right relative positions.
MIN_SHARE = 0.5


def template_table() -> list[dict]:
    """Templates with their words, and where their mandatory phrase stands in them."""
    rows = [(label, phrase, phrase, True) for phrase, label in BASE_PHRASES] + [(*t, False) for t in TEMPLATES]
    out = []
    for label, text, phrase, base in rows:
        words, must = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i:i + len(must)] == must)
        out.append({"label": label, "words": words, "first": at, "length": len(must), "base": base})
    return out


def build_index(documents: DataFrame, templates: list[dict], keep: list[str]) -> DataFrame:
    """Stored rows (keep..., n_words, postings): the licence words of each file, by position."""
    vocabulary = sorted({w for t in templates for w in t["words"]})
    (read,) = fresh(documents, "words_read")
    words = documents.select(*keep, phrase_words(F.col("text")).alias(read))
    postings = F.filter(F.transform(read, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda p: p["word"].isin(vocabulary))
    return stored(words.select(*keep, F.size(read).cast("bigint").alias("n_words"), postings.alias("postings")))


def document_frequencies(index: DataFrame) -> dict[str, int]:
    """Files per licence word, over all files; no more entries than the templates have words."""
    words = index.select(F.explode(F.array_distinct(F.transform("postings", lambda p: p["word"]))).alias("word"))
    return {r.word: r.n for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rarest_word(template: dict, frequency: dict[str, int]) -> int:
    """The offset of the mandatory word with the highest inverse document frequency."""
    inside = range(template["first"], template["first"] + template["length"])
    return min(inside, key=lambda i: (frequency.get(template["words"][i], 0), i))


def places(template: dict, frequency: dict[str, int]) -> Column:
    """Array of (start, share): starts of the mandatory phrase, share of template words in place."""
    words, first, length = template["words"], template["first"], template["length"]
    rare = rarest_word(template, frequency)
    phrase = F.array(*[F.lit(w) for w in words[first:first + length]])
    numbered = F.filter(F.transform("postings", lambda p, i: F.struct(p["pos"].alias("pos"), p["word"].alias("word"), i.alias("i"))),
                        lambda p: p["word"] == words[rare])

    def around(p: Column, before: int, after: int) -> Column:
        """The postings from ``before`` entries ahead of p to ``after`` behind it."""
        begin = F.greatest(p["i"] - before, F.lit(0))
        return F.slice("postings", begin + 1, p["i"] + after + 1 - begin)

    def complete(p: Column) -> Column:
        run = around(p, rare - first, first + length - 1 - rare)
        return (F.size(run) == length) & (F.transform(run, lambda x: x["word"]) == phrase) & (
            F.element_at(run, -1)["pos"] - F.element_at(run, 1)["pos"] == length - 1)

    def share(p: Column) -> Column:
        if length == len(words):
            return F.lit(1.0)
        near = F.transform(around(p, rare, len(words) - 1 - rare), lambda x: F.struct((x["pos"] - p["pos"] + rare).alias("o"), x["word"].alias("w")))
        wanted = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w).alias("w")) for i, w in enumerate(words)])
        return F.size(F.array_intersect(near, wanted)) / float(len(words))

    found = F.filter(numbered, complete)
    return F.transform(found, lambda p: F.struct((p["pos"] - (rare - first)).alias("start"), share(p).alias("share"),
                                                 F.lit(template["label"]).alias("label"), F.lit(template["base"]).alias("base")))


def scan(documents: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., n_words, places): every confirmed place of a template, with label and share.

    Null and empty texts have no words and no places. All rows are judged by themselves.
    """
    templates = template_table()
    index = build_index(documents, templates, keep)
    frequency = document_frequencies(index)
    known = [t for t in templates if all(w in frequency for w in t["words"][t["first"]:t["first"] + t["length"]])]
    none = "array<struct<start:int,share:double,label:string,base:boolean>>"
    found = F.concat(*[places(t, frequency).cast(none) for t in known]) if known else F.array().cast(none)
    # only files that hold a mandatory phrase's rarest word are looked at closely
    rare = sorted({t["words"][rarest_word(t, frequency)] for t in known})
    close = F.exists("postings", lambda p: p["word"].isin(rare)) if rare else F.lit(False)
    return index.select(*keep, "n_words", F.when(close, found).otherwise(F.array().cast(none)).alias("places"))


def license_report(documents: DataFrame) -> DataFrame:
    """One row per file: base places and labels, all labels, and the best share of a template in place."""
    found = scan(documents.select("doc_id", "text"), ["doc_id"])
    base = F.filter("places", lambda p: p["base"])
    good = F.filter("places", lambda p: p["base"] | (p["share"] >= MIN_SHARE))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(good).alias("labels"),
        F.coalesce(F.array_max(F.transform(good, lambda p: p["share"])), F.lit(0.0)).alias("score"))
