"""The document operators against brute force, on rows made to be awkward."""

import array
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from servicenight.llm import (bpe, decontaminate, language_id, licenses, line_dedup, near_dedup, quality, secret_scan,
                              suffix_dedup)
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables absent")
#: Columns that the operators do not know, some named like their own helpers.
CLASHING = ["text_key", "gone_id", "line_doc_id", "keep", "n_dropped", "text_read", "words_read", "path_blob", "spans", "h1", "pos", "score_", "quality__x", "TEXT_READ_"]


def words(random_, n, vocabulary=400):
    return " ".join(f"w{random_.randrange(vocabulary)}" for _ in range(n))


def awkward_rows():
    r = random.Random(5)
    base = words(r, 120)
    passage = "This Passage stands in several documents, and it is longer than two hundred bytes: " + words(r, 40, 90)
    near = base.split()
    long = words(r, 20_000, 5000)
    item = words(r, 25, 60)
    rows = [
        (1, None), (2, ""), (3, " \n\t \n"), (4, "word"), (5, "Two words"), (None, "no id here, but a line that repeats often enough"),
        (None, None), (6, base), (7, base), (7, base), (8, " ".join(near[:50] + ["changed"] + near[51:])), (9, " ".join(near[5:] + ["tail"] * 5)),
        (10, long), (11, long[:-20] + " another end of this very long text"), (12, passage + " and then some " + words(r, 30)), (13, words(r, 30) + "\n" + passage),
        (14, "x" * 900), (15, "ab" * 300), (16, "Ein Satz mit Umlauten: äöü ÄÖÜ ß — und „Zeichen“ \U0001f600 " * 8),
        (17, f"intro {item} outro"), (18, item.upper()), (19, "lead in " + " ".join(item.split()[8:]) + " end"), (20, " ".join(item.split()[:10])),
        (21, "password = hunter22 and token:'abc' and API_KEY := \"Zz9+/=aa.b-c\" secret=short token=token=abcdef"),
        (22, "AKIA" + "A1" * 8 + " AKIA123 AKIA" + "Z" * 30 + " " + "0123456789abcdef" * 3 + "g" + "f" * 23), (23, "é" * 7 + "passwd:=secret1" + "é" + "a" * 24),
        (24, "Released Under the MIT License. under the mit license"), (25, "Licensed under the Apache License, Version 2.0; cc-by-nc CC BY NC"),
        (26, "the license the license under the mit under the mit license"), (27, "GNU General Public License, version 3"),
        (28, "   no id here, but A line that repeats often enough \r\nother line that is only in one place\n"), (29, "x\nNO ID here, but a line that repeats often enough"),
        (30, "a b c d e " * 30), (31, "### %%% $$$ " * 40), (32, "line\nline\nline\n\n\nline"), (33, "a b c d"), (34, "A b c D"), (35, "one two three four five"),
        (36, "<|endoftext|>It's  ǅ Σας 12½"), (2**60, base + " x"), (-5, passage),
    ]
    for i in range(40, 60):
        changed = list(near)
        changed[i] = "other"
        rows.append((i, " ".join(changed)))
    rows += [(i, "shared by very many documents, this line\nline of " + words(r, 6)) for i in range(60, 100)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def documents(spark, rows):
    langs = ["en", "de", None]
    data = [(i, t, langs[k % 3], None if k % 5 == 0 else f"s{k % 4}", len(t or ""), *range(len(CLASHING))) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHING)
    return spark.createDataFrame(data, schema).repartition(5)


def same(frame, columns, wanted):
    got = [tuple(r[c] for c in columns.split()) for r in frame.select(*columns.split()).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def item_rows(rows):
    texts = dict((i, t) for i, t in rows if i is not None)
    item = texts[17][len("intro "):-len(" outro")]
    return [("b1", item), ("b2", " ".join(item.split()[3:9])), ("b3", "Word"), ("b4", None), ("b5", "..."), ("b1", item), ("b6", item), ("b7", "never said anywhere " * 5)]


def test_suffix_dedup(documents, rows):
    same(suffix_dedup.repeat_report(documents), "doc_id n_bytes n_removed n_spans kept_sha256", brute.suffix_dedup(rows))


@pytest.mark.parametrize("hot", [1, 1000])
def test_suffix_dedup_of_short_strings(spark, monkeypatch, hot):
    """Small alphabets make runs, periods and overlaps; a low limit sends every anchor down the splitting path."""
    monkeypatch.setattr(suffix_dedup, "SPLIT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 500)
    r = random.Random(hot)
    rows = [(i, "".join(r.choice("ab" if i % 3 else "abcdé") for _ in range(r.randrange(120)))) for i in range(60)] + [(100, "a" * 90), (101, "ab" * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(suffix_dedup.repeat_report(frame, 20, 8), "doc_id n_bytes n_removed n_spans kept_sha256", brute.suffix_dedup(rows, 20))


def test_two_stage_order_is_the_suffix_order():
    r = random.Random(3)
    for trial in range(200):
        length = r.randrange(3, 9)
        texts = [bytes(r.choice(b"ab" if trial % 2 else b"\x00abc\xff") for _ in range(length + r.randrange(12))) for _ in range(r.randrange(1, 9))]
        content = b"\0".join(texts) + b"\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = ends - [len(t) for t in texts]
        order = suffix_dedup.suffix_order(content, starts, ends, length)
        places = [(content[p:e], p) for s, e in zip(starts, ends) for p in range(s, e - length + 1)]
        assert [content[p:ends[np.searchsorted(ends, p)]] for p in order] == [t for t, _ in sorted(places)]
        assert sorted(order) == sorted(p for _, p in places)
        same_ = [content[a:a + length] == content[b:b + length] for a, b in zip(order, order[1:])]
        assert suffix_dedup.common_prefix_reaches(content, order, length).tolist() == same_ or length < 8


def test_decontamination(spark, documents, rows):
    items = item_rows(rows)
    frame = spark.createDataFrame(items, "item_id string, text string")
    wanted = brute.decontaminate(rows, [(i, t) for i, t in items if t])
    same(decontaminate.contamination_report(documents, frame), "doc_id n_words n_hit n_items items_sha256 contaminated", wanted)
    clean = {r[0] for r in wanted if not r[5]}
    assert {r.doc_id for r in decontaminate.drop_contaminated(documents, frame).collect()} == clean


def test_a_large_vocabulary_is_joined_without_broadcast(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    test_decontamination(spark, documents, rows)


def test_proximity(spark):
    docs = [(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha"), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = decontaminate.test_items(spark.createDataFrame([("q", "Alpha beta gamma")], "item_id string, text string"))
    index = decontaminate.build_index(frame, items)
    found = decontaminate.proximity_matches(items, index, distance=5)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, "q"), (3, "q")}


def brute_proximity(docs, items, distance, size=10):
    found = set()
    texts = [(i, brute.PHRASE_WORD.findall(brute.lower(t))) for i, t in docs]
    count = {}
    for _, w in texts:
        for x in w:
            count[x] = count.get(x, 0) + 1
    for item_id, text in items:
        item = brute.PHRASE_WORD.findall(brute.lower(text))
        for first in range(max(1, len(item) - size + 1) if item else 0):
            window = item[first:first + size]
            rarest = min(window, key=lambda x: (count.get(x, 0), window.index(x)))
            found |= {(i, item_id, first, at) for i, w in texts for at, x in enumerate(w)
                      if x == rarest and set(window) <= set(w[max(0, at - distance):at + distance + 1])}
    return found


def test_proximity_of_long_items(spark):
    """Passages from all parts of long items, shuffled and spread, against brute force."""
    r = random.Random(11)
    items = [(f"q{k}", words(r, n, 150)) for k, n in enumerate((40, 25, 11, 10, 3))] + [("same", None), ("none", "never said in any document at all")]
    items.append(("twin", items[1][1]))
    docs = []
    for i in range(60):
        item = items[i % 5][1].split()
        start = r.randrange(max(1, len(item) - 12))
        part = item[start:start + 12]
        r.shuffle(part)
        docs.append((i, words(r, 15, 150) + " " + " ".join(x for w in part for x in ([w, "between"] if r.random() < 0.3 else [w])) + " " + words(r, 15, 150)))
    docs += [(100, items[0][1]), (101, " ".join(items[0][1].split()[25:][::-1])), (None, items[1][1]), (102, None), (100, items[0][1]), (103, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    tested = decontaminate.test_items(benchmark)
    wanted = brute_proximity(docs, items, 8)
    got = {(x.doc_id, x.item_id, x.first, x.at) for x in decontaminate.proximity_matches(tested, decontaminate.build_index(frame, tested), 8).collect()}
    assert got == wanted and {f for i, q, f, _ in got if i == 101} >= {25, 30}
    windows = lambda i: len({(q, f) for d, q, f, _ in wanted if d == i})
    near = lambda i: len({q for d, q, _, _ in wanted if d == i})
    same(decontaminate.proximity_report(frame, benchmark, 8), "doc_id n_near_windows n_near_items", [(i, windows(i), near(i)) for i, _ in docs])


def test_license_base(documents, rows):
    same(licenses.license_report(documents), "doc_id n_words n_base first_word last_word base_labels", brute.license_base(rows))


def test_license_labels(documents):
    got = {r.doc_id: r for r in licenses.license_report(documents).where("doc_id between 24 and 27").collect()}
    assert [got[i].labels for i in range(24, 28)] == ["mit", "apache-2,cc-by-nc", "mit", "gpl-3"]
    assert got[24].score == 1.0 and 0.5 <= got[27].score < 1.0


def test_secret_base(documents, rows):
    same(secret_scan.secret_report(documents), "doc_id n_assign n_access n_hex base_sha256", brute.secrets(rows))


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "token = abcdefgh"), (2, "nothing"), (3, "token = abcdefgh")], "doc_id long, text string")
    assert secret_scan.update_ledger(first, folder).count() == 2
    more = first.union(spark.createDataFrame([(4, "secret: 12345678 " + "a" * 30), (5, None)], first.schema))
    assert secret_scan.update_ledger(more, folder).count() == 4
    changed = [secret_scan.RULES[0], secret_scan.Rule("hex", "[0-9a-f]{30,}", 0, 30, True)]
    due = secret_scan.unseen(more, secret_scan.read_ledger(spark, folder), changed)
    assert {tuple(r.due) for r in due.collect()} == {(changed[1].version,)}
    ledger = secret_scan.update_ledger(more, folder, changed)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans or []] for r in secret_scan.findings(more, ledger, ["doc_id"], changed).collect()}
    assert found == {1: [("assign", 0, 16)], 2: [], 3: [("assign", 0, 16)], 4: [("assign", 0, 16), ("hex", 17, 47)], 5: []}


def test_line_dedup(spark, documents, rows):
    same(line_dedup.line_report(documents), "doc_id n_lines n_dropped kept_sha256", brute.line_dedup(rows))


def test_a_line_in_many_ranges(spark):
    """A line that most rows hold is cut over several ranges."""
    rows = [(i, "the very same line in all of them\n" + ("and one that half of them have" if i % 2 else f"only here, number {i:05d}")) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(line_dedup.line_report(frame), "doc_id n_lines n_dropped kept_sha256", brute.line_dedup(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def library_tokens(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.vocabulary_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


ODD = ["Hello   World's I'LL <|endoftext|> x<|startoftext|>y", "ΣΑΣ İstanbul ß ẞ ſ K Å", "a\x1cb\x1fc\x85d\xa0e f​g h　j﻿", "१२३ ½ Ⅷ ① ﬁ é",
       "a\u2003b\u3000c\u1680d\u2028e\u202ff\u205fg\u180eh\u200bi\ufeffj\u0085k\u00a0l",
       "a" * 400, "abab" * 99, "日本語 한국어 العربية 👨‍👩‍👧", "it'S 'Sup ''''s 'rescue <|endoftext|", "\x00\x01", ""]


def test_bpe(spark, documents, rows):
    texts = [t for _, t in rows]
    ids, library = library_tokens(texts)
    wanted = [(i, len(x), hashlib.sha256(array.array("I", x).tobytes()).hexdigest(),
               hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(rows, ids)]
    same(bpe.encoding_report(documents), "doc_id n_tokens ids_sha256 decoded_sha256", wanted)


def test_bpe_of_odd_texts_and_decoding(spark, monkeypatch):
    monkeypatch.setattr(bpe, "INDEX_WORDS", 3)
    frame = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    encoded = bpe.encode_documents(frame, ["doc_id", "text"], bpe.vocabulary_path())
    got = {r.doc_id: r for r in bpe.decode_documents(encoded, ["doc_id", "ids"], bpe.vocabulary_path()).collect()}
    ids, library = library_tokens(ODD)
    for i, x in enumerate(ids):
        assert got[i].ids == x and got[i].decoded == library.decode(x, skip_special_tokens=False)


def test_bpe_rounds_equal_the_index():
    """Short words merge in vector rounds, whatever stands around them."""
    r = random.Random(3)
    new = sorted({"".join(r.choice("aabehlnorst" if k % 2 else "aé日'!9ß") for _ in range(r.randrange(1, 30))) for k in range(600)} | {"a" * 64, "ab" * 32, "é"})
    by_rounds, by_index = (bpe.WordBpe(bpe.vocabulary_path()) for _ in range(2))
    by_rounds.learn_by_rounds(new)
    by_index.learn_by_index(new)
    assert by_rounds.ids_of == by_index.ids_of and by_rounds.tokens_of == by_index.tokens_of and len(by_index.ids_of) == len(new)
    texts = ["Runs, of words; don't<|ENDOFTEXT|> <|endoftext|>x", "a\x1db c", "", "  "]
    ids, _ = library_tokens(texts)
    assert [array.array("I", x).tolist() for x, _ in by_rounds.encode(texts)] == ids


def test_runs_between_white_space_hold_whole_words():
    """All that str.split cuts at is white space of the words, but for the separators told apart."""
    cuts = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and len(f"a{c}b".split()) == 2]
    assert [c for c in cuts if bpe._WORD.findall(c)] == list(bpe._SEPARATORS)


def test_quality_counts(documents, rows):
    same(quality.quality_report(documents), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", brute.quality(rows))


def test_quality_fences_follow_the_group(spark):
    r = random.Random(1)
    rows = [(i, words(r, 60), "en", "plain") for i in range(200)] + [(i, " ".join(f"{w}|" for w in words(r, 60).split()), "en", "tables") for i in range(200, 400)]
    rows += [(900, " ".join(f"{w}###" for w in words(r, 60).split()), "en", "plain"), (901, words(r, 60), None, None), (902, "", None, "x")]
    kept = {x.doc_id: (x.kept, x.failed_rule) for x in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i][0] for i in range(400)) and kept[901][0]
    assert kept[900] in [(False, "symbol_share"), (False, "word_length")] and kept[902] == (False, "base")


def test_each_quality_rule_fires_on_its_kind(spark):
    r = random.Random(4)
    lines = lambda n: [words(r, 8) for _ in range(n)]
    rows = [(i, "\n".join(lines(12)), f"s{i % 2}") for i in range(120)]
    rows.append((500, "\n".join(x for line in lines(40) for x in (line, "more")), "s0"))  # no five words stand there twice
    rows.append((501, "\n".join(lines(12)) + " #|" * 60, "s1"))
    rows.append((502, " ".join(w * 4 for w in words(r, 90).split()), "s0"))
    rows.append((503, "\n".join(lines(12)) + " cost $ 5", "s1"))  # a single symbol is within its noise
    rows.append((504, "\n".join([*lines(2), "more", "more"]), "s0"))  # and so is a single line
    frame = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.failed_rule for x in quality.quality_report(frame).collect()}
    assert {i: got[i] for i in (500, 502, 503, 504)} == {500: "line_share", 502: "word_length", 503: None, 504: None}
    assert got[501] in ("symbol_share", "base") and not any(got[i] for i in range(120))


def test_small_groups_lean_on_the_whole_table(spark):
    r = random.Random(5)
    odd = lambda: " ".join(w + "|" for w in words(r, 60).split())
    rows = [(i, words(r, 60), "en", "plain") for i in range(200)] + [(i, odd(), "en", "large") for i in range(1000, 1200)] + [(2000, odd(), "de", "small")]
    rows += [(i, words(r, 60), "de", "plain") for i in range(3000, 4000)]
    got = {x.doc_id: x.kept for x in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(1000, 1200)) and not got[2000]


def test_sketches_merge_and_keep_their_error(spark):
    r = np.random.Generator(np.random.PCG64(2))
    values = r.lognormal(1, 1, 4000)
    frame = spark.createDataFrame([(float(v), 0.0, 0.0) for v in values], "word_length double, symbol_share double, line_share double")
    frame = frame.select(*[F.col(c).alias(quality.COUNT + c) for c in frame.columns])
    whole = quality.sketches(frame, [])
    halves = quality.sketches(frame.limit(1500), []).union(quality.sketches(frame.exceptAll(frame.limit(1500)), []))
    key = lambda d: sorted(map(tuple, d.groupBy("measure", "bin").agg(F.sum("n")).collect()), key=repr)
    assert key(whole) == key(halves)
    edges = quality.fences(whole, []).first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert edges.word_length_high == pytest.approx(q3 + quality.FENCE * (q3 - q1), rel=0.05)


def test_near_duplicates(documents, rows):
    same(near_dedup.near_duplicate_report(documents), "doc_id n_shingles component_id kept", brute.near_duplicates(rows))


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicates_in_chains_and_clusters(spark, monkeypatch, block):
    """Texts that drift apart step by step, so that many links hang on others; also with lists cut into many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(8)
    rows = []
    for group in range(12):
        text = words(r, 60, 100_000).split()
        for step in range(15):
            rows.append((len(rows), " ".join(text)))
            for _ in range(1 + group % 3):
                text[r.randrange(len(text))] = f"n{r.randrange(10**6)}"
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_dedup.near_duplicate_report(frame), "doc_id n_shingles component_id kept", brute.near_duplicates(rows))


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    """Copies of one text, many of them too far from each other to link: what is compared in blocks does not grow with their square."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    dealt, in_blocks = [], near_dedup.in_blocks
    monkeypatch.setattr(near_dedup, "in_blocks", lambda *a: dealt.append(in_blocks(*a)) or dealt[-1])
    r = random.Random(5)
    base = words(r, 150, 100_000).split()
    rows = []
    for k in range(160):
        text = list(base)
        for place in r.sample(range(0, 150, 5), r.randrange(2, 8)):
            text[place] = f"n{r.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute.near_duplicates(rows)
    assert 10 < len({w[2] for w in wanted}) < 120
    same(near_dedup.near_duplicate_report(frame), "doc_id n_shingles component_id kept", wanted)
    assert dealt[0].count() < 32 * len(rows)


def test_near_duplicates_probe_no_shingle_once_per_band(spark, monkeypatch):
    """Copies of one text of many lengths: a shared shingle stands in many bands of sizes, and its classes do not meet each of them."""
    r = random.Random(13)
    base = words(r, 150, 100_000).split()
    rows = []
    for k in range(160):
        text = list(base)
        for place in r.sample(range(0, 150, 5), r.randrange(2, 8)):
            text[place] = f"n{r.randrange(10**6)}"
        rows.append((k, " ".join(text + [f"t{k}x{i}" for i in range(r.randrange(30))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    met, held, frames, probes = [], [], type(frame), near_dedup.probes
    join = frames.join

    def counted(left, right, on=None, how=None):
        out = join(left, right, on, how)
        if isinstance(on, str) and on == "shingle" and "own_rank" in out.columns:
            met.append(out)
        return out

    monkeypatch.setattr(near_dedup, "probes", lambda members, sets: held.append(members) or probes(members, sets))
    monkeypatch.setattr(frames, "join", counted)
    same(near_dedup.near_duplicate_report(frame), "doc_id n_shingles component_id kept", brute.near_duplicates(rows))
    shingles = held[0].agg(F.sum("n_shingles")).first()[0]
    assert held[0].select("band").distinct().count() > 5
    assert 0 < met[0].count() <= shingles


def test_near_duplicates_compare_no_list_twice(spark, monkeypatch):
    """A run of shingles that the same texts share makes the same list for each of them; one is compared."""
    lists, in_blocks = [], near_dedup.in_blocks
    monkeypatch.setattr(near_dedup, "in_blocks", lambda given: lists.append(given) or in_blocks(given))
    r = random.Random(21)
    rows = []
    for _ in range(30):
        base = words(r, 400, 100_000).split()
        for _ in range(6):
            text = list(base)
            for place in r.sample(range(400), r.randrange(4, 16)):
                text[place] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_dedup.near_duplicate_report(frame), "doc_id n_shingles component_id kept", brute.near_duplicates(rows))
    held = [tuple(sorted(x.rows)) for x in lists[0].groupBy("token").agg(F.collect_list(F.struct("node", "probe")).alias("rows")).collect()]
    assert held and len(held) == len(set(held))


def test_language_rules(documents, rows):
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language_id.language_of(documents).collect()}
    assert {x[1] for x in got} <= {"en", "de", "und"}
    import zlib
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, _, h in got)
    for i, text in rows:
        assert ((i, "und") in {x[:2] for x in got}) == (not any(c.isalpha() for c in text or "")) or i in (None, 7)


@given
def test_language_accuracy_on_held_out_rows(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    marked = language_id.language_of(documents).where("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    n, right, rejected = marked.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 100 and right / n >= 0.97 and rejected / n <= 0.01


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    model = language_id.train([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 5)
    import pyarrow as pa
    texts = ["und die", None, "", "x", "1 2 3", "the", "Ünd", "der Hund" * 50]
    alone = [language_id.predictions(model, pa.array([t], pa.string())) for t in texts]
    together = language_id.predictions(model, pa.array(texts, pa.string()))
    assert [a[0][0] for a in alone] == together[0]
    assert np.allclose([a[1][0] for a in alone], together[1], rtol=0, atol=1e-12)


SPOKEN = {
    "en": "the of and to in that was with for this have from they which one were there their what would about when more other time these people water after where".split(),
    "de": "der die und das nicht ist ein mit sich auch auf für eine werden wird haben sind über nach durch zwischen schon wieder gegen während Menschen Wasser Straße größer".split(),
    "fr": "le la les des est que dans une pour qui sur avec plus par elle sont cette comme mais nous vous leur être après même aussi toujours français où déjà".split(),
    "es": "el los las una por con para como más pero sus este entre cuando todo esta ser son dos también fue había era muy años hasta desde está niño mañana".split()}


@pytest.mark.parametrize("languages, n", [("en", 60), ("en de", 60), ("en de fr es", 60), ("en de", 12)])
def test_texts_of_no_learned_language_are_rejected(languages, n):
    import pyarrow as pa
    r = random.Random(4)
    clean = lambda count: [(" ".join(r.choice(SPOKEN[l]) for _ in range(r.randrange(25, 60))), l) for l in languages.split() for _ in range(count)]
    model = language_id.train(clean(n))
    strange = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randrange(2, 9))) for _ in range(40)) for _ in range(50)]
    strange += ["Съешь же ещё этих мягких булок да выпей чаю " * 5, "これは日本語の文章です。学習していない文字です。" * 5, "Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί " * 4]
    _, _, rejected = language_id.predictions(model, pa.array(strange, pa.string()))
    assert rejected.all()
    fresh = clean(200)
    names, _, rejected = language_id.predictions(model, pa.array([t for t, _ in fresh], pa.string()))
    assert names == [l for _, l in fresh] and rejected.mean() <= (0.03 if n == 60 else 0.15)


DOCUMENT_QUERIES = {
    "op1": suffix_dedup.repeat_report, "op3": licenses.license_report, "op5": secret_scan.secret_report, "op6": line_dedup.line_report,
    "op7": bpe.encoding_report, "op8": quality.quality_report, "op9": near_dedup.near_duplicate_report, "op10": language_id.language_of}


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_tables_and_tables_of_nulls(spark, name):
    schema = "doc_id long, text string, lang string, source string"
    assert DOCUMENT_QUERIES[name](spark.createDataFrame([], schema)).count() == 0
    assert DOCUMENT_QUERIES[name](spark.createDataFrame([(None, None, None, None)] * 2, schema)).count() == 2


def test_decontamination_of_and_with_empty_tables(spark, documents, rows):
    items = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination_report(documents, items).where("contaminated").count() == 0
    assert decontaminate.contamination_report(documents.limit(0), spark.createDataFrame([("a", "b")], items.schema)).count() == 0


def test_filters_keep_the_columns(spark, documents, rows):
    items = spark.createDataFrame(item_rows(rows), "item_id string, text string")
    for kept in (language_id.drop_rejected(documents), line_dedup.drop_repeated_lines(documents), near_dedup.keep_one_each(documents),
                 decontaminate.drop_contaminated(documents, items), quality.keep_good(documents)):
        assert kept.schema.names == documents.schema.names
        assert 0 < kept.count() <= len(rows)


def test_pipeline(spark, documents, rows, tmp_path):
    """Every stage against its plain counterpart, each on what the one before kept."""
    documents.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(item_rows(rows), "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    docs = sorted((r.doc_id, r.text) for r in table.collect())

    import pyarrow as pa
    model = language_id.train([(r.text, r.lang) for r in table.collect() if r.lang and len(r.text or "") <= language_id.TRAIN_CHARS
                               and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 != 2])
    _, _, rejected = language_id.predictions(model, pa.array([t for _, t in docs], pa.string()))
    docs = [d for d, gone in zip(docs, rejected) if not gone]
    docs = [(i, "\n".join(kept)) for i, _, kept in brute.kept_lines(docs)]
    keep = {r[0] for r in brute.near_duplicates(docs) if r[3]}
    docs = [d for d in docs if d[0] in keep]
    clean = {r[0] for r in brute.decontaminate(docs, [(i, t) for i, t in item_rows(rows) if t]) if not r[5]}
    docs = [d for d in docs if d[0] in clean]
    ids, _ = library_tokens([t for _, t in docs])

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids for r in out.collect()} == {i: x for (i, _), x in zip(docs, ids)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]


@given
def test_queries_on_the_given_tables(spark):
    """The registered queries over whole given tables."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    run = lambda prefix: next(f for n, f in entry.queries().items() if n.startswith(prefix))(spark, SF_DIR)
    same(run("op1_"), "doc_id n_bytes n_removed n_spans kept_sha256", brute.suffix_dedup(docs))
    same(run("op2_"), "doc_id n_words n_hit n_items items_sha256 contaminated", brute.decontaminate(docs, items))
    same(run("op9_"), "doc_id n_shingles component_id kept", brute.near_duplicates(docs))
