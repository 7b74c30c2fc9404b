"""Main text of web pages by consensus of each host's pages.

Each page is cut into blocks under generalised tag-class paths. A page's containers are scored by
the text of their paragraphs less that of links, and the page votes for the path of its best one.
Votes are counted per host in Spark; every page is then extracted again from the containers on its
host's winning path, or from its own best container where that path is absent or holds next to
nothing. A container is widened to its article and to the headline, paragraphs and sections around it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from servicenight.llm import textvec
from servicenight.llm.common import fresh, stored

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[a-z]+")

#: How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "thead": frozenset(["tr", "td", "th"]), "tbody": frozenset(["thead", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "tr", "td", "th"]),
}
CONTAINERS = frozenset("article main section div body td html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements beside the article, and words in a class, id or role that say the same.
DROPPED = frozenset("nav footer aside form button menu dialog fieldset datalist object embed audio video canvas head".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer colophon masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login search comment comments disqus respond replies reply share sharing social related "
    "recommended recommendations widget widgets pagination pager skip complementary contentinfo hidden".split())
#: Names that drop an element are made of such words alone, or stand between these: "site-footer", "ad-box".
#: Others ("has-sidebar", "menu-open", "notice-period") speak of something else.
_BEFORE = ("site|page|main|primary|secondary|global|mobile|desktop|sticky|fixed|floating|top|bottom|left|right|first|second|third|post|entry|article|blog|"
           "author|header|content|inline|in|google|dfp|gpt|wp|block|visually|[a-z]")
_AFTER = ("box|area|wrapper|wrap|container|inner|outer|list|items?|block|section|panel|bar|content|body|title|heading|links?|buttons?|icons?|form|unit|slot|row|"
          "columns?|col|group|posts?|articles?|stories|toggle|site|page|main|primary|secondary|top|bottom|left|right|[a-z]")
_WORDS = "|".join(sorted(DROPPED_WORDS))
_DROPPED_NAME = re.compile(rf"(?:(?:{_BEFORE})[^a-z]+)*(?:{_WORDS})(?:[^a-z]+(?:{_WORDS}|{_AFTER}))*[^a-z]*|is-hidden")
_HEADER_NAME = re.compile(r"(?:(?:site|global|main|top|mobile|desktop|sticky|fixed|[a-z])[^a-z]+)*header(?:[^a-z]+(?:wrapper|wrap|container|inner|outer|bar|top|bottom|main|site|[a-z]))*[^a-z]*")
#: What is dropped by other names or elements stays if it holds this share of the text in the page's paragraphs: it wraps the page.
MOST = 0.8
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments disqus respond replies reply "
    "nav navbar navigation menu breadcrumb breadcrumbs aside footer colophon contentinfo".split())
WRAPS = frozenset("form fieldset head header".split())
ARTICLE_WORDS = frozenset("article content post entry story main".split())

#: Text beside a container is taken for part of its article up to this share of link text.
LINK_SHARE = 0.2
#: The host's path is left if it holds under this share of a page's best container, whose text has so many
#: characters at least; the second share holds if the best container is marked as an article and the path's is not.
LOW_SHARE, LOW_SHARE_OF_ARTICLE, LEAST_CHARS = 0.1, 0.5, 100


@lru_cache(maxsize=10_000)
def says_dropped(name: str) -> tuple[bool, bool]:
    """Whether a class, id or role names a part beside the article, and whether it could yet wrap the page."""
    dropped = bool(_DROPPED_NAME.fullmatch(name))
    return dropped, not (dropped and BESIDE.intersection(_TOKEN.findall(name)))


class Page:
    """The blocks of a page: for each, its text, its link text, and the elements it stands in."""

    def __init__(self, source: str):
        self.parent, self.path, self.tag, self.dropped = [-1], [""], [""], [False]
        self.marked: dict[int, bool] = {}  # blocks to drop, and whether one that holds most of the page stays
        self.bonus, self.in_article = [1.0], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(source)
        self._drop()

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        names, labels, hidden = "", [], False
        if attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id", "role"):
                    names += f" {key}={(a or b or c).lower()}"
                    labels += (a or b or c).lower().split()
                elif key == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
                    hidden = True
                elif key == "hidden" or key == "aria-hidden" and (a or b or c).lower() == "true":
                    hidden = True
            if not hidden and "hidden" in attributes.lower():
                hidden = bool(re.search(r"(?:^|\s)hidden(?:$|[\s/])", _ATTRIBUTE.sub(" ", attributes).lower()))
        classes = sorted(_DIGITS.sub("#", c) for part in names.split(" class=")[1:] for c in part.split(" id=")[0].split(" role=")[0].split())
        words = set(_TOKEN.findall(names)) - {"class", "id", "role"} if names else set()
        inside_article = self.in_article[parent]
        named = tag not in HEADINGS and tag not in ("html", "body", "article", "main")
        said = [says_dropped(x) for x in labels] if named else []
        drop = hidden or tag in DROPPED or any(x for x, _ in said)
        drop = drop or (named and not inside_article and (tag == "header" or any(_HEADER_NAME.fullmatch(x) for x in labels)))
        if drop and tag not in INLINE:
            self.marked[len(self.parent)] = (tag not in DROPPED or tag in WRAPS) and all(x for _, x in said)
        self.parent.append(parent)
        self.path.append(f"{self.path[parent]}>{'.'.join([tag, *classes])}")
        self.tag.append(tag)
        self.dropped.append(self.dropped[parent] or drop and tag in INLINE)
        article = tag in ("article", "main") or bool(attributes) and "articlebody" in attributes.lower()
        self.bonus.append(1.5 if article else 1.2 if words & ARTICLE_WORDS else 1.0)
        self.in_article.append(inside_article or article)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack, names, text, links, at = [0], [""], [], 0, 0  # open elements, their tags, the block's pieces
        in_link = 0

        def flush() -> None:
            nonlocal links
            if text:
                joined = _SPACE.sub(" ", "".join(text)).strip(" ")
                if joined:
                    self.blocks.append((block(), joined, links))
                text.clear()
            links = 0

        def block() -> int:
            return next(e for e, name in zip(reversed(stack), reversed(names)) if name not in INLINE)

        def add(piece: str) -> None:
            nonlocal links
            if piece and not self.dropped[stack[-1]]:
                text.append(piece)
                if in_link:
                    links += len(piece.strip())

        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                piece = source[at:m.start()]
                add(entities.unescape(piece) if "&" in piece else piece)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    in_link = 0
                if tag in names:
                    if tag not in INLINE:
                        flush()
                    elif tag not in names[stack.index(block()):]:
                        continue  # closes an inline element outside of this block
                    while names.pop() != tag:
                        stack.pop()
                    stack.pop()
                continue
            if tag == "br" or tag == "hr":
                if not self.dropped[stack[-1]]:
                    text.append(" ")
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = closing.end() if closing else len(source)
                continue
            if tag in INLINE:
                in_link = in_link or tag == "a"
                stack.append(self._open(tag, m[3], stack[-1]) if m[3] else self._plain(tag, stack[-1]))
                names.append(tag)
                continue
            flush()
            in_link = 0
            closes = CLOSED_BY.get(tag)
            while len(stack) > 1 and (names[-1] in INLINE or names[-1] == "p" or (closes and names[-1] in closes)):
                stack.pop()
                names.pop()
            stack.append(self._open(tag, m[3], stack[-1]))
            names.append(tag)
        if at < len(source):
            piece = source[at:]
            if not re.match(r"<[a-zA-Z/!?]", piece):
                add(entities.unescape(piece))
        flush()

    def _drop(self) -> None:
        """Drop what is marked, but for elements that hold the page's article or most of its text.

        An element stays if the page's articles all stand in dropped elements and this one holds main,
        or articles and half of the paragraphs; or if it may wrap a page and holds ``MOST`` of them.
        """
        if not self.marked:
            return
        size = len(self.parent)
        paragraphs = [b for b in self.blocks if self.tag[b[0]] == "p"] or self.blocks
        value, mains, articles = [0] * size, [0] * size, [0] * size
        for element, text, links in paragraphs:
            value[element] += max(0, len(text) - 2 * links)
        total, below = sum(value), [0] * size
        for e in range(size - 1, 0, -1):
            up = self.parent[e]
            below[up] += below[e] + value[e]
            mains[up] += mains[e] + (self.tag[e] == "main")
            articles[up] += articles[e] + (self.tag[e] == "article")
        stays: set[int] = set()

        def drop_again() -> list[bool]:
            dropped = list(self.dropped)
            for e in range(1, size):
                dropped[e] = dropped[e] or dropped[self.parent[e]] or e in self.marked and e not in stays
            return dropped

        free_in = lambda dropped: any(t in ("article", "main") and not gone for t, gone in zip(self.tag, dropped))
        dropped = drop_again()
        free = free_in(dropped)
        for e, wraps in sorted(self.marked.items()):
            if dropped[self.parent[e]] or not (articles[e] or mains[e] or wraps and below[e] >= MOST * total > 0):
                continue
            if wraps and below[e] >= MOST * total > 0 or not free and (mains[e] or articles[e] and 2 * below[e] >= total):
                stays.add(e)
                dropped = drop_again()
                free = free_in(dropped)
        self.dropped = dropped
        self.blocks = [b for b in self.blocks if not dropped[b[0]]]

    def _plain(self, tag: str, parent: int) -> int:
        self.parent.append(parent)
        self.path.append(f"{self.path[parent]}>{tag}")
        self.tag.append(tag)
        self.dropped.append(self.dropped[parent])
        self.bonus.append(1.0)
        self.in_article.append(self.in_article[parent])
        return len(self.parent) - 1

    def scores(self) -> dict[int, float]:
        """Each container's score: the text of its own paragraphs, and half of those one level down."""
        out: dict[int, float] = {}
        for element, text, links in self.blocks:
            value = max(0, len(text) - 2 * links)
            share, e = 1.0, element
            while e >= 0 and share > 0.2:
                if e == 0 or self.tag[e] in CONTAINERS:
                    out[e] = out.get(e, 0.0) + value * share * self.bonus[e]
                    share /= 2
                e = self.parent[e]
        return out

    def best(self) -> tuple[int, float]:
        scores = self.scores()
        return max(scores.items(), key=lambda s: (s[1], -s[0]), default=(0, 0.0))

    def within(self, chosen: set[int]) -> list[bool]:
        """Which elements are inside any of the chosen ones."""
        inside = [False] * len(self.parent)
        for e in range(len(self.parent)):
            inside[e] = e in chosen or (e > 0 and inside[self.parent[e]])
        return inside

    def article_of(self, element: int) -> int:
        """The nearest article that the element is or stands in; the element itself where there is none."""
        e = element
        while e > 0 and self.tag[e] != "article":
            e = self.parent[e]
        return e if e > 0 else element

    def widened(self, chosen: set[int]) -> set[int]:
        """The blocks of the chosen containers' articles, with the parts of the same article around them.

        What hangs off each ancestor is judged branch by branch. Branches that are mostly links are
        left out. Paragraphs and headings that stand in an ancestor itself are taken until an h1 is
        among the blocks; so is a container with an h1. Whole containers beside it are taken inside
        main and inside a box that has own text, or where section stands beside section. Body and
        html lay out more than the article, and an article is complete but for its headline.
        """
        tops = {self.article_of(e) for e in chosen}
        inside = self.within(tops)
        taken = {i for i, (element, _, _) in enumerate(self.blocks) if inside[element]}
        first = self.longest(tops)
        chain, e = [], first
        while e > 0:
            e = self.parent[e]
            chain.append(e)
        if not chain:
            return taken
        # where each element leaves the chain, and the branch it leaves by (the ancestor itself for its own text)
        on_chain, branch = {first, *chain}, list(range(len(self.parent)))
        anchor, headed, boxed, articles = list(branch), set(), set(), set()
        for e in range(1, len(self.parent)):
            if e in on_chain:
                continue
            up = self.parent[e]
            anchor[e] = up if up in on_chain else anchor[up]
            branch[e] = e if up in on_chain else branch[up]
            if self.tag[e] in CONTAINERS:
                boxed.add(branch[e])
            if self.tag[e] in ("article", "main"):
                articles.add(branch[e])
        around: dict[int, dict[int, list[int]]] = {}
        for i, (element, _, _) in enumerate(self.blocks):
            if i not in taken and anchor[element] != first:
                around.setdefault(anchor[element], {}).setdefault(branch[element], []).append(i)
                if self.tag[element] == "h1":
                    headed.add(branch[element])
        has_title = any(self.tag[self.blocks[i][0]] == "h1" for i in taken)
        whole = self.tag[first] == "article"
        for a in chain:
            texts = {b: own for b, own in around.get(a, {}).items()
                     if sum(self.blocks[i][2] for i in own) <= LINK_SHARE * sum(len(self.blocks[i][1]) for i in own)}
            top = a == 0 or self.tag[a] in ("html", "body")
            titled = not has_title and any(b in headed for b in texts)
            box = not top and not whole and (self.tag[a] == "main" or titled or (
                (not has_title or a == chain[0]) and any(b not in boxed for b in texts)))
            for b, own in texts.items():
                plain = not has_title and (b not in boxed or b in headed) and b not in articles
                section = not top and not whole and self.tag[b] == self.tag[first] == "section"
                if plain or section or box and b not in articles:
                    taken.update(own)
            has_title = has_title or titled
            if self.tag[a] == "main":
                break
        return taken

    def longest(self, elements: set[int]) -> int:
        """The element with most text; ties go to the first."""
        owner, held = list(range(len(self.parent))), dict.fromkeys(sorted(elements), 0)
        for e in range(1, len(self.parent)):
            owner[e] = e if e in elements else owner[self.parent[e]]
        for element, text, _ in self.blocks:
            if owner[element] in held:
                held[owner[element]] += len(text)
        return max(held, key=held.get)

    def main_text(self, path: str | None) -> str:
        best, _ = self.best()
        along = lambda path: {e for e, p in enumerate(self.path) if e and p == path and not self.dropped[e]}
        taken = self.widened(along(self.path[best]) or {best})
        on_path = along(path) if path else set()
        if on_path and best not in on_path:
            own = self.widened(on_path)
            value = lambda blocks: sum(max(0, len(self.blocks[i][1]) - 2 * self.blocks[i][2]) for i in blocks)
            marked = self.bonus[best] > max(self.bonus[e] for e in on_path)
            low = value(taken) >= LEAST_CHARS and value(own) < (LOW_SHARE_OF_ARTICLE if marked else LOW_SHARE) * value(taken)
            taken = own if own and not low else taken
        return " ".join(text for i, (_, text, _) in enumerate(self.blocks) if i in taken)


def host_of(url: str = "url"):
    """The host of a URL in lower case; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): the path of each page's best container; pages without text do not vote."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = [], []
            for source in batch.column("html"):
                page = Page(source.as_py() or "")
                element, score = page.best()
                paths.append(page.path[element] if score > 0 else None)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("host"), textvec.strings(paths), pa.array(scores, pa.float64())], ["host", "path", "score"])

    return pages.select(host_of().alias("host"), "html").mapInArrow(work, "host string, path string, score double").where(F.col("path").isNotNull())


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, winner): the path with most votes; ties go to the one with more text, then by name."""
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score").cast("bigint")).alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("winner"))


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``text`` and ``n_chars`` to the columns in ``keep``.

    Null and empty html give an empty text. Pages without a host are a host of their own name ''.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    # stored, so that its size is known: few hosts are sent to the pages, many are joined with skew splitting
    winners = stored(winning_paths(votes(pages.select("url", "html"))))
    source, host, path = fresh(pages, "html_read", "page_host", "winner")
    rows = pages.select(*keep, F.col("html").alias(source), host_of().alias(host))
    rows = rows.join(winners.select(F.col("host").alias(f"{host}_"), F.col("winner").alias(path)), F.col(host) == F.col(f"{host}_"), "left").select(*keep, source, path)
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s.as_py() or "").main_text(w.as_py()) for s, w in zip(batch.column(source), batch.column(path))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), textvec.strings(texts), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return rows.mapInArrow(work, schema)


def page_report(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"])
