"""SimHash groups, spelling variants and collocations against plain counterparts."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from servicenight.llm import collocations, simhash, spelling
from tests.llm.brute import WORD, lower
from tests.llm.test_documents import CLASHING, awkward_rows, words


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = awkward_rows()
    base = words(r, 300, 90).split()
    for i in range(200, 240):  # one word of many changed, so that a few bits differ
        changed = list(base)
        changed[r.randrange(300)] = f"w{r.randrange(90)}"
        out.append((i, " ".join(changed)))
    letters = ["wonderful", "wonderfull", "wonderfol", "wondrful", "wonderfully", "séparation", "séparétion", "separation", "straße!", "straßen", "aaaaaaa", "aaaaaaaa", "ÀÉÎÕÜýÿ", "éÉÎÕÜýÿ"]
    for i in range(300, 340):
        out.append((i, " ".join(r.choice(letters[:1] * 30 + letters) for _ in range(60)).replace("wo", "Wo" if i % 2 else "wo")))
    phrases = ["of the great house", "of the small house", "in the end", "a b c d", "New York, City", "of the"]
    for i in range(400, 420):
        out.append((i, "; ".join(r.choice(phrases) + " " + words(r, 2, 30) for _ in range(40)) + "\r\nof the\x0bgreat house"))
    return out


@pytest.fixture(scope="module")
def documents(spark, rows):
    langs = ["en", "de", None]
    data = [(i, t, langs[k % 3], *range(len(CLASHING))) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` long" for c in CLASHING)).repartition(5)


def rooted(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    roots = rooted(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 3])
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [(i, f"{m:016x}", least[r]) for (i, _), m, r in zip(rows, marks, roots)]


def same(frame, columns, wanted):
    got = [tuple(r[c] for c in columns.split()) for r in frame.select(*columns.split()).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_simhash(documents, rows):
    wanted = plain_simhash(rows)
    assert len({c for _, _, c in wanted}) < len({f for _, f, _ in wanted})
    same(simhash.simhash_report(documents), "doc_id fingerprint component_id", wanted)


def test_simhash_hashes_as_the_library_does(spark):
    text = "The  quick\tbrown fox — ÄÖ"
    assert simhash.text_fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.text_fingerprint(b"One") == xxhash.xxh64_intdigest(b"one", 42)


@pytest.mark.parametrize("together", [2, 20, 1024])
def test_crowded_keys(spark, monkeypatch, together):
    """Clusters around a few centres; small groups alone send them through all three kinds of keys."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    r = random.Random(together)
    marks = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            flips = r.sample(range(64), r.randrange(7)) if r.random() < 0.7 else r.sample(range(8), 3)
            marks.add(centre ^ sum(1 << b for b in flips))
    marks = sorted(marks)
    wanted = rooted(len(marks), [(a, b) for a in range(len(marks)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 3])
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(m,) for m in signed], "fingerprint long")
    place = {m: i for i, m in enumerate(signed)}
    links = [(place[x.a], place[x.b]) for x in simhash.links(frame).collect()]
    assert all((marks[a] ^ marks[b]).bit_count() <= 3 for a, b in links)
    got = rooted(len(marks), links)
    assert len(set(zip(got, wanted))) == len(set(got)) == len(set(wanted))


def test_golay_codewords_meet_at_one_bit():
    """Whatever bit differs, the own codeword of either word is near the other one."""
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 23, 4000)
    for bit in range(23):
        near_a, real_a = simhash.codewords(a)
        near_b, _ = simhash.codewords(a ^ (1 << bit))
        assert ((near_a == near_b[:, :1]) & real_a).any(axis=1).all()


def test_simhash_keeps_one_of_each(documents, rows):
    wanted = [i for i, _, c in plain_simhash(rows) if i == c]
    kept = simhash.keep_one_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(x for x in wanted if x is not None)


def plain_spelling(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, n_near = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if x != w and near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, n_near[w], form[w], counts.get(form[w]), root))
    return out


def test_spelling(documents, rows):
    wanted = plain_spelling(rows)
    assert sum(w[3] is not None for w in wanted) >= 3 and max(w[2] for w in wanted) >= 3
    same(spelling.spelling_report(documents), "word n n_near form form_n root", wanted)


def test_spelling_over_few_letters(spark):
    """Words of few letters share most of their letter sets; only the edit distance tells them apart."""
    r = random.Random(4)
    text = " ".join("".join(r.choice("abé") for _ in range(r.randrange(6, 10))) for _ in range(3000))
    rows = [(1, text), (2, text[:5000]), (None, text[100:4000])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(spelling.spelling_report(frame), "word n n_near form form_n root", plain_spelling(rows))


def plain_collocations(rows, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(a for p, a in counts.items() if len(p) == 1)
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= 30}
        absorbed = set()
        for p, a in found.items():
            absorbed.update(p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * found[p[i:j]])
        scored = []
        for p, a in found.items():
            if p not in absorbed:
                s, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return out


COLLOCATION = "lang rank phrase a l r n score"


@pytest.mark.parametrize("shard_words", [1 << 20, 700])
def test_collocations(documents, rows, monkeypatch, shard_words):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(collocations, "OPEN_WORDS", 2 * shard_words)
    langs = ["en", "de", None]
    wanted = plain_collocations([(langs[k % 3], t) for k, (_, t) in enumerate(rows)])
    assert {len(w[2].split()) for w in wanted} == {2, 3, 4}
    same(collocations.collocations(documents), COLLOCATION, wanted)


def test_few_of_many_collocations(spark):
    r = random.Random(2)
    rows = [("en" if i % 4 else None, " ".join(r.choice("abcde") for _ in range(200)) + ("." if i % 2 else "\f")) for i in range(60)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    same(collocations.collocations(frame, top=7), COLLOCATION, plain_collocations(rows, 7))


@pytest.mark.parametrize("gathered_rows", [1 << 20, 50])
def test_collocations_of_many_shards(spark, monkeypatch, gathered_rows):
    """What every shard has is not sent by every shard."""
    monkeypatch.setattr(collocations, "SHARD_WORDS", 100)
    monkeypatch.setattr(collocations, "OPEN_WORDS", 200)
    monkeypatch.setattr(collocations, "GATHERED_ROWS", gathered_rows)
    extensions, found = collocations.extensions, []
    monkeypatch.setattr(collocations, "extensions", lambda *a: found.append(extensions(*a)) or found[-1])
    r = random.Random(6)
    rows = [("en" if i % 3 else "de", " ".join(r.choice("abc") for _ in range(100))) for i in range(600)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    same(collocations.collocations(frame), COLLOCATION, plain_collocations(rows))
    tasks = collocations.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for longer in found[2:] if gathered_rows > 50 else []:
        phrases = longer.drop("n").distinct().count()
        assert phrases >= 2 * 3 ** (len(longer.columns) - 1)
        assert longer.count() <= tasks * phrases < 600 * phrases / 3


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "", "en"), (2, " . ;", "en")]])
def test_nothing_to_find(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert simhash.simhash_report(frame).count() == len(rows)
    assert spelling.spelling_report(frame).count() == 0
    assert collocations.collocations(frame).count() == 0
