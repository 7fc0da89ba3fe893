"""Main-text extraction by the distribution of text over line blocks.

The page's markup is stripped to lines: one for each block-level element's own text. Lines that lie
in elements made for something else than the text (menus, headers, footers, forms, adverts, scripts,
comments of readers, told by tag, role, class or id) count with length 0. A class or id may mislead: an
element told by it alone counts after all if it holds main, the page's only article elements, or more
than half of the text (for comments of readers: all of it). Successive lines that are links count with
length 0 too: the density of links tells a menu that has no name. Over the lines a sliding
window of BLOCK lines sums the lengths; where that sum surges from 0 the text can begin, and where it
dives to 0 it ends. Of the stretches between surge and dive the one with most text is kept. Where it
lies in an article or main element, all text of that element is; elsewhere the other stretches that
hold a sentence or a heading (h1, h2) are. Every line in what is kept that carries text is returned.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import slices

BLOCK = 3
#: Share of a line's text in links from which it counts as one.
LINKED = 0.8
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template iframe svg math canvas object audio video head title select textarea button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that hold something beside the text.
BESIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that name something beside the text.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar comment comments reply replies discussion disqus respond notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar skip".split())
#: Those of them that name what readers write.
READERS = frozenset("comment comments reply replies discussion disqus respond".split())
#: Before a name, words that make it a word about the page's layout, and those that make a header the text's own.
LAYOUT = frozenset("no not non without with has have".split())
OWN_HEADER = frozenset("entry post article story content section".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that may stand in head; any other ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: An open element of these ends where one of the others, or its parent, begins or ends.
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: A slash that ends a value without quotes closes nothing.
VALUE_END = re.compile(r"=\s*[^\s\"'=<>`]*/$")
SENTENCE = re.compile(r"[.!?…。！？｡．।॥؟۔։።᙮။។][\"'”’»)\]」』】）》]*$")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Line:
    text: str
    beside: bool
    article: int  # number of the article or main element around it, 0 for none
    named: int = 0  # number of the innermost element around it that class or id tell beside, 0 for none
    heading: bool = False
    linked: bool = False  # most of it is the text of links


@dataclass
class Element:
    tag: str
    beside: bool
    article: int
    named: int


@dataclass
class Reader:
    """Reads markup into lines, in time that grows with the page's length alone."""

    lines: list[Line] = field(default_factory=list)
    open: list[Element] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)  # places in open of elements that are not inline
    count: Counter = field(default_factory=Counter)  # open elements by tag
    head: int = -1  # place of an open head
    text: list[tuple[str, bool]] = field(default_factory=list)  # with whether it is in a link
    articles: int = 0
    readers: list[bool] = field(default_factory=lambda: [False])  # of each named element: whether readers' comments are named
    parent: list[int] = field(default_factory=lambda: [0])  # the named element around each
    holders: dict[str, list[int]] = field(default_factory=lambda: {t: [] for t in ARTICLE})  # the named element around each

    def top(self) -> Element:
        return self.open[-1] if self.open else Element("", False, 0, 0)

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(x for x, _ in self.text)).split())
        if text:
            links = sum(len(x.strip()) for x, linked in self.text if linked)
            e = self.top()
            self.lines.append(Line(text, e.beside, e.article, e.named, self.count["h1"] + self.count["h2"] > 0, links > LINKED * sum(len(x.strip()) for x, _ in self.text)))
        self.text.clear()

    def push(self, e: Element) -> None:
        if e.tag not in INLINE:
            self.blocks.append(len(self.open))
        if e.tag == "head":
            self.head = len(self.open)
        self.count[e.tag] += 1
        self.open.append(e)

    def drop(self, at: int) -> None:
        for e in self.open[at:]:
            self.count[e.tag] -= 1
        del self.open[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        if self.head >= at:
            self.head = -1

    def pop(self, at: int) -> None:
        self.flush()
        self.drop(at)

    def write(self, text: str) -> None:
        if text:
            if self.open and self.open[-1].tag == "head" and text.strip():
                self.pop(len(self.open) - 1)
            self.text.append((text, self.count["a"] > 0))

    def start(self, tag: str, attributes: str) -> None:
        if self.head >= 0 and tag not in IN_HEAD and tag not in ("head", "html") and not self.count["template"] + self.count["noscript"]:
            self.pop(self.head)
        if self.open and tag in CLOSES.get(self.open[-1].tag, ()):
            self.pop(len(self.open) - 1)
        elif self.blocks and tag in CLOSES.get(self.open[self.blocks[-1]].tag, ()):
            self.pop(self.blocks[-1])  # inline elements left open inside a paragraph end with it
        e = self.top()
        beside = e.beside or is_beside(tag, attributes, e.article > 0)
        name = set() if beside or tag in ("html", "body") or tag in ARTICLE else told_by_name(attributes)
        if tag not in INLINE or beside != e.beside or name:
            self.flush()
        article, names = e.article, e.named
        if name:
            self.readers.append(bool(name & READERS))
            self.parent.append(names)
            names = len(self.parent) - 1
        if tag == "br":
            self.text.append((" ", False))
        if tag in ARTICLE and not beside:
            self.holders[tag].append(names)
            if not article:
                self.articles += 1
                article = self.articles
        if tag not in VOID and not (attributes.endswith("/") and not VALUE_END.search(attributes)):
            self.push(Element(tag, beside, article, names))

    def end(self, tag: str) -> None:
        if not self.count[tag]:
            if tag not in INLINE:
                self.flush()
            return
        last = self.blocks[-1] if self.blocks else -1
        at = len(self.open) - 1
        while self.open[at].tag != tag:
            at -= 1
            if tag in INLINE and at <= last:
                return  # a stray end does not close blocks
        if tag in INLINE and at > 0 and (self.open[at].beside, self.open[at].named) == (self.open[at - 1].beside, self.open[at - 1].named):
            self.drop(at)
        else:
            self.pop(at)

    def resolved(self) -> list[Line]:
        """The lines, those in named elements beside unless the name misleads."""
        size, total = [0] * len(self.parent), 0
        for x in self.lines:
            if not x.beside:
                total += len(x.text)
                size[x.named] += len(x.text)
        for i in range(len(size) - 1, 0, -1):  # what is inside an element is later than it
            size[self.parent[i]] += size[i]
        misled = [False] + [n == total if r else 2 * n > total for n, r in zip(size[1:], self.readers[1:], strict=True)]
        seen, mains, articles = [False] * len(size), self.holders["main"], self.holders["article"]
        for i in mains if mains else articles if all(articles) else ():
            while i and not seen[i]:
                seen[i] = True
                misled[i] |= not self.readers[i]
                i = self.parent[i]
        misled[0] = True
        for i in range(1, len(size)):
            misled[i] &= misled[self.parent[i]]
        for x in self.lines:
            x.beside |= not misled[x.named]
        return self.lines


def is_beside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds something beside the text. An article's own header is part of it."""
    if tag in SILENT or tag in BESIDE and not (inside and tag == "header"):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes)))


def told_by_name(attributes: str) -> set[str]:
    """The words of NAMES in class and id."""
    out = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in "".join(values).split():
                words = [p.lower() for p in PARTS.findall(token)]
                for before, word in zip(["", *words], words):
                    if word in NAMES and before not in LAYOUT and not (word == "header" and before in OWN_HEADER):
                        out.add(word)
    return out


def lines_of(page: str) -> list[Line]:
    reader, at = Reader(), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            reader.write(page[at:])
            break
        reader.write(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            reader.end(tag)
            continue
        reader.start(tag, m[3])
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = close.start() if close else len(page)
    reader.flush()
    return reader.resolved()


def main_text(page: str | None) -> str:
    """The blocks of the main text, in page order, joined by an empty line."""
    lines = lines_of(page or "")
    length = [0 if x.beside or m else len(x.text) for x, m in zip(lines, menus(lines), strict=True)]
    stretches = surges(length)
    if not stretches:
        return ""
    best = max(stretches, key=lambda s: sum(length[s[0] : s[1]]))
    home = {lines[i].article for i in range(*best) if length[i]} - {0}
    if home:  # an article's text may be cut by adverts longer than a window
        kept = [i for i, x in enumerate(lines) if x.article in home]
    else:  # what stands apart from most of the text belongs to it if it holds a sentence or heading
        told = (s for s in stretches if s == best or any(length[i] and (lines[i].heading or SENTENCE.search(lines[i].text)) for i in range(*s)))
        kept = [i for s in told for i in range(*s)]
    return "\n\n".join(lines[i].text for i in kept if length[i])


def menus(lines: list[Line]) -> list[bool]:
    """Flags of the lines in windows of nothing but links: a run of such lines, headings aside, is a
    menu whatever its element or name. A line alone that is a link belongs to what is around it, and
    so does any run that holds most of the page's text."""
    bare = [x.linked and not x.heading and not x.beside for x in lines]
    out = [x and (i > 0 and bare[i - 1] or i + 1 < len(bare) and bare[i + 1]) for i, x in enumerate(bare)]
    text = sum(len(x.text) for x in lines if not x.beside)
    return [False] * len(lines) if 2 * sum(len(x.text) for x, m in zip(lines, out, strict=True) if m) > text else out


def surges(length: list[int]) -> list[tuple[int, int]]:
    """Stretches of lines from where the sum over a window surges from 0 to where it dives to 0.

    The sum at line i is that of lines i to i + BLOCK - 1, so gaps shorter than a window are bridged.
    """
    n = len(length)
    total = [sum(length[i : i + BLOCK]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if not length[i]:
            i += 1
            continue
        end = i
        while end < n and total[end]:
            end += 1
        while not length[end - 1]:
            end -= 1
        out.append((i, end))
        i = end
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages (page_id, url, html).

    A null html counts as empty; a page without text has an empty one. White space inside a block is
    one space, also where a line break stands. Broken and unclosed markup is read as browsers do
    where blocks follow each other; pages of any length and depth are read whole, in time that grows with
    their length. Every row gives one row, repeated ones too; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
