"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block has its word
count and link density (share of words inside links), those of the two blocks before and
after it, what it is (paragraph, heading, list item), how far it lies from the page's
end, and marks of the elements around it (page furniture or article, by tag or by class,
id and role words). A decision tree keeps or drops each block. It is trained on a labelled
table of blocks that ``labelled_pages`` writes by rule: pages of several layouts, with
marks, with few and with none, so that it learns to do without them. The kept blocks are
joined in page order.

Scripts, styles, comments and other elements without readable text never make blocks.
Character references are decoded, white space inside a block becomes one space.

Cases: null and empty html give an empty text. Broken markup (unclosed elements, a page
that ends inside a tag, a script or a reference) is read as far as it goes: an unclosed
script, style or comment hides the rest. Very long and deep pages are read whole, in
linear time: open elements are counted, not searched. Repeated rows are extracted each;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*>)")
#: The same without regard to quotes. A tag whose quotes never close makes all tags after it
#: end at their first >, so that no part of a page is searched for quotes again and again.
PLAIN_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)")
#: The same for a tag with an unclosed quote.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z0-9]+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea select svg math iframe object canvas audio video".split())
CLOSING = {tag: re.compile(f"</{tag}", re.I) for tag in HIDDEN}
FURNITURE_TAGS = frozenset("nav header footer aside form head menu dialog button fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote dd figcaption".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation footer header masthead "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager widget contentinfo complementary toolbar search copyright disclaimer hidden".split()
)
ARTICLE_WORDS = frozenset("article post entry content story main body text".split())
WRAPPER_WORDS = frozenset("wrap wrapper container layout page row grid with has no".split())

FEATURES = (
    "words density before_words before_density after_words after_density before2_words before2_density after2_words after2_density "
    "paragraph heading item from_end furniture article outside"
).split()
#: The last three: marks of elements around a block.
MARKS = FEATURES[-3:]


# --- the labelled table ----------------------------------------------------------------


class _Writer:
    """A page written block by block, each with its label."""

    def __init__(self, rnd: random.Random, marks: str):
        self.rnd, self.marks, self.parts, self.labels = rnd, marks, [], []

    def part(self, tag: str, name: str):
        """A section's start and end: a tag that tells, a named division, or neither."""
        if self.marks == "tags":
            return f"<{tag}>", f"</{tag}>"
        return (f'<div class="{name}">' if self.marks == "names" else "<div>"), "</div>"

    def block(self, tag: str, words: int, label: int, linked: int = 0) -> None:
        text = " ".join("w" * self.rnd.randint(1, 9) for _ in range(words - linked))
        link = '<a href="/">' + " ".join("l" * self.rnd.randint(1, 9) for _ in range(linked)) + "</a>" if linked else ""
        self.parts.append(f"<{tag}>{text} {link}</{tag}>" if tag else f"{text} {link}")
        self.labels.append(label)

    def section(self, tag: str, name: str, blocks: list[tuple]) -> None:
        start, end = self.part(tag, name)
        self.parts.append(start)
        for b in blocks:
            self.block(*b)
        self.parts.append(end)


def _paragraphs(rnd: random.Random, n: int, tag: str) -> list[tuple]:
    """Words of paragraphs are spread over all sizes, single words among them."""
    sizes = [rnd.choice([rnd.randint(1, 4), rnd.randint(3, 20), rnd.randint(15, 90), rnd.randint(60, 400)]) for _ in range(n)]
    return [(tag, w, 1, rnd.choice([0, 0, 0, 0, w // 8])) for w in sizes]


def labelled_pages(n: int = 300, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages with the label of each of their blocks (1: main text)."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        page = _Writer(rnd, ("tags", "names", "none")[k % 3])
        bare = page.marks == "none" and rnd.random() < 0.3  # no paragraphs either
        menu = lambda most=9: [(rnd.choice(["li", "li", "div"]), w, 0, w) for w in (rnd.randint(1, 4) for _ in range(rnd.randint(2, most)))]  # noqa: B023, E731
        aside = lambda tag="div", least=3, most=16: [(tag, rnd.randint(least, most), 0)]  # noqa: B023, E731
        if k % 9 == 8:  # nothing but text
            for b in _paragraphs(rnd, rnd.randint(1, 40), "p"):
                page.block(*b)
            out.append(("".join(page.parts), page.labels))
            continue
        if rnd.random() < 0.4:
            page.section("header", "header", [("div", rnd.randint(1, 5), 0, 1)] + (aside() if rnd.random() < 0.4 else []))
        if rnd.random() < 0.9:
            page.section("nav", "menu", menu())
        if rnd.random() < 0.5:
            page.section("aside", "ad", aside(""))
        if rnd.random() < 0.3:
            page.section("aside", "cookie-notice", aside(rnd.choice(["", "div"] if page.marks == "none" else ["", "p"]), 8, 40))
        start, end = page.part("article", "post") if not bare else ("", "")
        page.parts.append(start)
        if rnd.random() < 0.9:
            page.block("h1", rnd.randint(1, 16), 1)
        for _ in range(rnd.randint(1, 4)):
            body = _paragraphs(rnd, rnd.randint(1, 9), "div" if bare else "p")
            if bare:
                body = [(t, w + 8, y, x) for t, w, y, x in body]
            for b in body:
                page.block(*b)
            if rnd.random() < 0.3:
                page.block(rnd.choice(["h2", "h3"]), rnd.randint(1, 9), 1)
            if rnd.random() < 0.25 and not bare:
                for _ in range(rnd.randint(2, 6)):
                    page.block("li", rnd.randint(1, 20), 1)
            if rnd.random() < 0.2 and page.marks != "none":
                page.section("aside", "advert", aside(rnd.choice(["", "p"])))
        page.parts.append(end)
        if rnd.random() < 0.3:
            page.section("section", "related", menu(5)) if page.marks == "names" else page.section("aside", "related", menu(5))
        if rnd.random() < 0.3 and page.marks != "none":
            page.section("aside", "comments", [("p", rnd.randint(2, 70), 0) for _ in range(rnd.randint(1, 5))])
        if rnd.random() < 0.3 and page.marks != "none":
            page.section("form", "newsletter", [("label", rnd.randint(1, 4), 0)])
        if rnd.random() < 0.85:
            page.section("footer", "footer", rnd.choice([aside(""), menu(5), aside("div") + menu(3)]))
        out.append(("<html><body>" + "".join(page.parts) + "</body></html>", page.labels))
    return out


# --- the tree --------------------------------------------------------------------------


class Tree:
    """A binary decision tree by Gini impurity: nodes are (feature, threshold, low, high),
    leaves labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 7, least: int = 6):
        self.least = least  # rows of a leaf
        self.root = self._grow(rows, labels, depth)

    def _grow(self, rows: np.ndarray, labels: np.ndarray, depth: int):
        if depth == 0 or len(set(labels)) < 2:
            return int(labels.mean() > 0.5)
        best = None
        for f in range(rows.shape[1]):
            values = np.unique(np.quantile(rows[:, f], np.linspace(0, 1, 65), method="nearest"))
            for t in (values[:-1] + values[1:]) / 2:
                low = rows[:, f] <= t
                if min(low.sum(), (~low).sum()) < self.least:
                    continue
                impurity = sum(len(y) * y.mean() * (1 - y.mean()) for y in (labels[low], labels[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, float(t), low
        if best is None:
            return int(labels.mean() > 0.5)
        _, f, t, low = best
        return f, t, self._grow(rows[low], labels[low], depth - 1), self._grow(rows[~low], labels[~low], depth - 1)

    def keeps(self, row: tuple) -> bool:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return bool(node)


@lru_cache(maxsize=4)
def trained(without: tuple[str, ...] = (), depth: int = 9) -> Tree:
    """The tree of the labelled table; features of ``without`` are held at 0."""
    rows, labels = [], []
    for source, given in labelled_pages():
        found = rows_of(_Page(source).blocks)
        if len(found) != len(given):
            raise ValueError("a labelled page doesn't have its blocks")
        rows += found
        labels += given
    table_ = np.array(rows, dtype=float)
    table_[:, [FEATURES.index(x) for x in without]] = 0
    return Tree(table_, np.array(labels), depth)


def rows_of(blocks: list[tuple]) -> list[tuple]:
    """FEATURES of each block of a page."""
    none = (0, 0.0)
    beside = [none, none, *((b[1], b[2]) for b in blocks), none, none]
    framed = any(b[4] for b in blocks)
    return [
        (b[1], b[2], *beside[i + 1], *beside[i + 3], *beside[i], *beside[i + 4], *b[5:8], len(blocks) - 1 - i, b[3], b[4], framed and not b[4])
        for i, b in enumerate(blocks)
    ]


class _Page:
    """Blocks of a page: (text, words, link density, furniture, article, paragraph,
    heading, item)."""

    def __init__(self, source: str):
        self.blocks: list[tuple] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, furniture, article
        self.tags: Counter = Counter()  # open elements by tag
        self.kinds = [0, 0, 0, 0, 0]  # open elements: furniture, article, paragraph, heading, item
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.in_link = 0
        self._read(source)
        self._cut()

    def _cut(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(self.parts)).split())
        linked = len(html.unescape("".join(self.linked)).split())
        self.parts, self.linked = [], []
        if text:
            words = text.count(" ") + 1
            self.blocks.append((text, words, min(1.0, linked / words), *map(bool, self.kinds)))

    def _push(self, tag: str, furniture: bool, article: bool) -> None:
        self.open.append((tag, furniture, article))
        self._count(self.open[-1], 1)

    def _pop(self) -> str:
        last = self.open.pop()
        self._count(last, -1)
        return last[0]

    def _count(self, element: tuple[str, bool, bool], by: int) -> None:
        tag, furniture, article = element
        self.tags[tag] += by
        for k, is_so in enumerate((furniture, article, tag in PARAGRAPHS, tag in HEADINGS, tag == "li")):
            self.kinds[k] += by * is_so

    def _text(self, text: str) -> None:
        self.parts.append(text)
        if self.in_link:
            self.linked.append(text)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        last, strict = source.rfind(">"), True  # no tag closes beyond the last >
        while at < size:
            start = source.find("<", at)
            if start < 0:
                self._text(source[at:])
                return
            if start > at:
                self._text(source[at:start])
            m = None
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if start < last:
                m = (TAG if strict else PLAIN_TAG).match(source, start)
            if not m:
                m = LOOSE_TAG.match(source, start)
                if not m:
                    self._text("<")
                    at = start + 1
                    continue
                strict = False
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in HIDDEN:
                self._cut()
                if not m[3].endswith("/"):
                    close = CLOSING[tag].search(source, at)
                    at = source.find(">", close.end()) + 1 if close and close.end() <= last else size
            else:
                self._start(tag, m[3])

    def _start(self, tag: str, rest: str) -> None:
        furniture, article = self._marks(tag, rest)
        if tag in INLINE and not furniture:
            if tag == "br":
                self._text(" ")
            elif tag == "a":
                self.in_link += 1
            return
        self._cut()
        if self.open and self.open[-1][0] in ("p", *HEADINGS) and tag not in INLINE:
            self._pop()
        if self.open and self.open[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            self._pop()
        if tag not in VOID and not rest.endswith("/"):
            self._push(tag, furniture, article)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if self.tags[tag]:
            self._cut()
            while self._pop() != tag:
                pass
        elif tag not in INLINE:
            self._cut()

    @staticmethod
    def _marks(tag: str, rest: str) -> tuple[bool, bool]:
        furniture, article = tag in FURNITURE_TAGS, tag in ARTICLE_TAGS
        if rest and tag not in ("html", "body"):
            words: set[str] = set()
            for name, value in ATTRIBUTE.findall(rest):
                words.update(("hidden",) if name.lower() == "hidden" else WORD.findall(value.lower()))
            if words & FURNITURE_WORDS and not words & WRAPPER_WORDS:
                furniture = True
            elif words & ARTICLE_WORDS and not words & WRAPPER_WORDS:
                article = True
        return furniture, article


def extract(source: str | None, tree: Tree) -> str:
    """The main text of a page."""
    if not source:
        return ""
    blocks = _Page(source).blocks
    return "\n".join(b[0] for b, row in zip(blocks, rows_of(blocks)) if tree.keeps(row))


def with_text(pages: DataFrame, column: str = "text") -> DataFrame:
    """``pages`` (html) with the main text of each."""
    tree = trained()

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_html in batches:
            yield pd.Series([extract(x, tree) for x in pages_html], dtype=object)

    return pages.withColumn(column, main_text("html"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
