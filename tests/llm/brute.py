"""Plain counterparts of the operators, written from their definitions; for small tables only."""

import hashlib
import re
from collections import Counter, defaultdict

PHRASE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return (text or "").translate(UPPER_TO_LOWER)


def suffix_dedup(docs, length=200):
    """docs: (doc_id, text) rows -> doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = Counter()
    for _, text in docs:
        data = (text or "").encode()
        seen.update(data[i:i + length] for i in range(len(data) - length + 1))
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen[data[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def decontaminate(docs, items, size=10):
    windows = defaultdict(set)
    for item_id, text in items:
        words = PHRASE_WORD.findall(lower(text))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[i:i + size])].add(item_id)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words = PHRASE_WORD.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                ids = windows.get(tuple(words[i:i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(docs):
    out = []
    for doc_id, text in docs:
        words = PHRASE_WORD.findall(lower(text))
        places = [(i, i + len(p) - 1, label) for phrase, label in PHRASES.items() for p in [phrase.split()]
                  for i in range(len(words)) if words[i:i + len(p)] == p]
        out.append((doc_id, len(words), len(places), min((p[0] for p in places), default=None),
                    max((p[0] for p in places), default=None), ",".join(sorted({p[2] for p in places}))))
    return out


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = ["assign", "access", "hex"]
        base = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
        out.append((doc_id, *(sum(k == i for _, k, _ in spans) for i in range(3)), sha(base)))
    return out


def kept_lines(docs, min_chars=20, min_documents=3):
    """(doc_id, lines, lines that stay) of each row."""
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    rank = lambda i: (i is not None, i or 0)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(holders[key(line)]) < min_documents or doc_id == max(holders[key(line)], key=rank)]
        out.append((doc_id, lines, kept))
    return out


def line_dedup(docs):
    return [(i, len(lines), len(lines) - len(kept), sha("\n".join(kept))) for i, lines, kept in kept_lines(docs)]


def quality(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        count = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
                    len(words) < 10 or 100 * len(covered) > 20 * len(words)))
    return out


def shingles(text):
    words = WORD.findall(lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_duplicates(docs):
    sets = [(doc_id, shingles(text)) for doc_id, text in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for shingle in s:
            index[shingle].append(i)
    common = Counter()
    for rows in index.values():
        for a in range(len(rows)):
            for b in range(a):
                common[rows[b], rows[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[root(a)] = root(b)
    smallest = {}
    for i, (doc_id, _) in enumerate(sets):
        ids = [x for x in (smallest.get(root(i)), doc_id) if x is not None]
        smallest[root(i)] = min(ids, default=None)
    return [(doc_id, len(s), smallest[root(i)], doc_id == smallest[root(i)]) for i, (doc_id, s) in enumerate(sets)]
