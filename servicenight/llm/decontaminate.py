"""Benchmark decontamination over a positional inverted index, in DataFrame operations alone.

The training texts are tokenised once; every token that occurs in some test item is stored as a
posting (term, document, position). Each test window is looked up by its two rarest terms: their
posting lists, shifted by the terms' offsets, meet where the item could stand. The texts at these
places then confirm every window word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servicenight.llm.common import phrase_words, stored, text_key, without

WINDOW = 10
#: Words to either side of a window's rarest term in which proximity looks for the others.
REACH = 20
#: Test vocabularies up to this many words are broadcast (a few MB); larger ones are joined by shuffle.
BROADCAST_WORDS = 200_000
#: Follows the last word of each document in the index, so that its position is the word count.
END = ""


def term(word: Column) -> Column:
    """Terms are stored by hash; a collision could only add a place that the texts then refute."""
    return F.xxhash64(word)


def test_items(items: DataFrame) -> DataFrame:
    """(item, item_id, words): null texts and texts without words have no row."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), phrase_words(F.col("text")).alias("words"))
    return words.where(F.size("words") > 0).withColumn("item", F.xxhash64(F.array_join("words", " "))).distinct()


def build_index(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, text_key, pos) of all test terms, and one end mark per document row."""
    vocabulary = items.select(F.explode("words").alias("word")).distinct().union(
        items.sparkSession.createDataFrame([(END,)], "word string")).select(term(F.col("word")).alias("term")).distinct()
    vocabulary = stored(vocabulary)
    if vocabulary.count() <= BROADCAST_WORDS:
        vocabulary = F.broadcast(vocabulary)
    tokens = documents.select(
        "doc_id", text_key(F.col("text")).alias("text_key"),
        F.posexplode(F.concat(phrase_words(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    return stored(tokens.select(term(F.col("word")).alias("term"), "doc_id", "text_key", "pos").join(vocabulary, "term"))


def rarest_terms(index: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(item, first, length, o1, o2): each window with the offsets of its two rarest terms in the item.

    Windows with a term that no document has are gone. A window of one word has o1 = o2.
    """
    frequency = index.groupBy("term").agg(F.count("*").alias("frequency"))
    items = items.select("item", "words").dropDuplicates(["item", "words"])
    last = F.greatest(F.size("words") - size, F.lit(0))
    windows = items.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("first")).select(
        "item", "first", F.least(F.size("words") - F.col("first"), F.lit(size)).alias("length"), "words")
    places = windows.select("item", "first", "length", F.posexplode(F.slice("words", F.col("first") + 1, F.col("length"))).alias("place", "word"))
    ranked = places.withColumn("term", term(F.col("word"))).join(frequency, "term")
    # one window's words: ``size`` rows at most
    order = Window.partitionBy("item", "first").orderBy("frequency", "place")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("item", "first", "length").agg(
        F.count("*").alias("present"),
        (F.col("first") + F.max(F.when(F.col("rank") == 1, F.col("place")))).alias("o1"),
        (F.col("first") + F.max(F.when(F.col("rank") == F.least(F.lit(2), F.col("length")), F.col("place")))).alias("o2"),
    ).where(F.col("present") == F.col("length")).drop("present")


def alignments(index: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, item, start, firsts): where both rarest terms of some windows stand as in the item.

    ``start`` is the document position of the item's first word and may be negative.
    """
    windows = stored(rarest_terms(index, items, size))
    words = items.select("item", F.posexplode("words").alias("offset", "word")).distinct()
    offsets = windows.select("item", F.explode(F.array("o1", "o2")).alias("offset")).distinct()
    looked_up = offsets.join(words, ["item", "offset"]).select("item", "offset", term(F.col("word")).alias("term"))
    places = index.join(looked_up, "term").select("doc_id", "text_key", "item", (F.col("pos") - F.col("offset")).alias("start"), "offset")
    met = places.groupBy("doc_id", "text_key", "item", "start").agg(F.collect_set("offset").alias("offsets"))
    by_item = windows.groupBy("item").agg(F.collect_list(F.struct("first", "length", "o1", "o2")).alias("windows"))
    both = F.filter("windows", lambda w: F.array_contains("offsets", w["o1"]) & F.array_contains("offsets", w["o2"]))
    return met.join(by_item, "item").select("doc_id", "text_key", "item", "start", both.alias("windows")).where(F.size("windows") > 0)


def exact_matches(documents: DataFrame, items: DataFrame, index: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, item, at, length): every place where a window stands word for word."""
    met = alignments(index, items, size)
    per_document = met.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item", "start", "windows")).alias("met"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))) & (F.col("d.text_key") == F.col("m.text_key"))
    texts = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").alias("d")
    texts = texts.join(per_document.alias("m"), same).select(
        "d.doc_id", "d.text_key", phrase_words(F.col("d.text")).alias("doc_words"), "m.met")
    spread = texts.select("doc_id", "text_key", "doc_words", F.explode("met").alias("m")).select("doc_id", "text_key", "doc_words", "m.*")
    words = items.select("item", "words").dropDuplicates(["item", "words"])
    holds = lambda w: (F.col("start") + w["first"] >= 0) & (
        F.slice("doc_words", F.greatest(F.col("start") + w["first"], F.lit(0)) + 1, w["length"]) == F.slice("words", w["first"] + 1, w["length"]))
    return spread.join(words, "item").select("doc_id", "text_key", "item", "words", "start", F.explode(F.filter("windows", holds)).alias("w")).select(
        "doc_id", "text_key", "item", "words", (F.col("start") + F.col("w.first")).alias("at"), F.col("w.length").alias("length"))


def proximity_matches(items: DataFrame, index: DataFrame, distance: int, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, item_id, first, at): places of a window's rarest term in whose reach all its words stand.

    Reach is ``distance`` words to either side, in any order. Every window of an item is looked up;
    ``first`` is the item's word that it begins with.
    """
    words = items.select("item", "words").dropDuplicates(["item", "words"])
    windows = rarest_terms(index, items, size).join(words, "item").select(
        "item", "first", term(F.element_at("words", (F.col("o1") + 1).cast("int"))).alias("term"),
        F.array_distinct(F.transform(F.slice("words", F.col("first") + 1, F.col("length")), term)).alias("terms"))
    by_term = stored(windows.groupBy("term").agg(F.collect_list(F.struct("item", "first", "terms")).alias("windows")))
    # one document's postings: each with the terms around it, compared with all windows of its term in one row
    reach = Window.partitionBy("doc_id", "text_key").orderBy("pos").rangeBetween(-distance, distance)
    places = index.select("term", "doc_id", "text_key", "pos", F.collect_list("term").over(reach).alias("near")).join(by_term, "term")
    met = F.filter("windows", lambda w: F.size(F.array_except(w["terms"], F.col("near"))) == 0)
    found = places.select("doc_id", "text_key", F.col("pos").alias("at"), F.explode(met).alias("w")).select(
        "doc_id", "text_key", F.col("w.item").alias("item"), F.col("w.first").alias("first"), "at").distinct()
    return found.join(items.select("item", "item_id").distinct(), "item").select("doc_id", "text_key", "item_id", "first", "at")


def proximity_report(documents: DataFrame, benchmark: DataFrame, distance: int = REACH, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_near_windows, n_near_items) of every document row: the items' windows that stand close together in it."""
    items = stored(test_items(benchmark))
    index = build_index(documents, items)
    key = ["doc_id", "text_key"]
    near = proximity_matches(items, index, distance, size).groupBy(*key).agg(
        F.count_distinct("item_id", "first").alias("n_near_windows"), F.count_distinct("item_id").alias("n_near_items")).alias("r")
    marks = index.where(F.col("term") == term(F.lit(END))).select(*key).alias("d")
    return marks.join(near, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key")), "left").select(
        "d.doc_id", F.coalesce("n_near_windows", F.lit(0)).cast("bigint").alias("n_near_windows"), F.coalesce("n_near_items", F.lit(0)).cast("bigint").alias("n_near_items"))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, item_ids) of every document row, ``item_ids`` sorted as strings.

    Null and wordless texts have no words and no hits; an empty benchmark hits nothing. A null
    item_id counts as the empty string. Equal rows get equal results.
    """
    items = stored(test_items(benchmark))
    index = build_index(documents, items)
    matches = stored(exact_matches(documents, items, index, size))
    key = ["doc_id", "text_key"]
    hit = matches.select(*key, F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    found = matches.select(*key, "item", "words").distinct().join(items, ["item", "words"]).groupBy(*key).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    marks = index.where(F.col("term") == term(F.lit(END))).select(*key, F.col("pos").cast("bigint").alias("n_words")).alias("d")
    hits = hit.alias("h").join(found.alias("f"), F.col("h.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h.text_key") == F.col("f.text_key"))).select(
        "h.doc_id", "h.text_key", "n_hit", "item_ids").alias("r")
    return marks.join(hits, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key")), "left").select(
        "d.doc_id", "d.text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    return without(documents, contamination(documents.select("doc_id", "text"), benchmark).where(F.col("n_hit") > 0))
