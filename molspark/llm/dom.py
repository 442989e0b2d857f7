"""A page as a tree: elements in page order with their parents, and text runs between them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple

# Element names of HTML by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head title script style noscript template svg iframe object canvas audio video textarea select option button".split()
)
BOILER = frozenset("nav header footer aside form menu dialog fieldset label legend".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl dt dd".split())
TABLES = frozenset("table thead tbody tfoot tr td th caption".split())
PROSE = frozenset("p blockquote pre figure figcaption address hgroup".split())
BLOCKS = BOILER | HEADING | LISTS | TABLES | PROSE | frozenset("html body div section article main center details summary hr search".split())
#: Words of class, id and role that mark what is not the article.
BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    sidebar menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager footer foot header masthead topbar
    comment comments commentlist reply replies respond disqus share sharing social recommended recommendations newsletter
    subscribe subscription signup login popup modal overlay widget hidden skip copyright contentinfo complementary toc tags
    outbrain taboola paywall""".split()
)
#: Words that mark boilerplate on some pages and parts of the article on others.
DOUBTFUL_WORDS = frozenset("notice notices notification alert warning disclaimer side related responses discussion search form legal".split())
#: A class such as ``has-sidebar`` tells what else the page has, not what the element is.
LAYOUT_WORDS = frozenset("has with without no".split())
#: Elements that hold the whole page, whatever their attributes speak of.
FRAMES = frozenset("html body main".split())
CONTENT_WORDS = frozenset("article articlebody post postbody entry story content maincontent".split())
#: An open element of the key's kind ends where one of these begins, up to the bounds given.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Marks(NamedTuple):
    """Whether the attributes speak of boilerplate, of content, of the main part, and of what may
    be boilerplate."""

    boiler: bool = False
    content: bool = False
    main: bool = False
    doubtful: bool = False


@dataclass
class Page:
    """Node 0 is the root. ``runs`` holds (node, text) in page order; node -1 is a border
    between blocks."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    marks: list[Marks] = field(default_factory=lambda: [Marks()])
    runs: list[tuple[int, str]] = field(default_factory=list)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.open = Page(), [0]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        page = self.page
        if tag in ("html", "body") and tag in page.tags:
            return
        if tag in BLOCKS:
            self._end("p", {"p"}, {"table", "td", "th", "button", "object"})
            page.runs.append((-1, ""))
        if tag in _ENDS:
            self._end(tag, *_ENDS[tag])
        if tag == "body":
            self._end("head", {"head"}, set())
        if tag in VOID:
            if tag in ("br", "hr"):
                page.runs.append((-1, ""))
            return
        page.tags.append(tag)
        page.parents.append(self.open[-1])
        page.marks.append(_marks(tag, attrs))
        self.open.append(len(page.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.page.runs.append((-1, ""))
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.page.tags[self.open[depth]]
            if name == tag:
                del self.open[depth:]
                return
            if name in BLOCKS and tag not in BLOCKS and tag not in HIDDEN:
                return

    def handle_data(self, data: str) -> None:
        self.page.runs.append((self.open[-1], data))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A declaration such as ``<![if IE]>`` is a comment up to the next ``>``, or to the end."""
        end = self.parse_bogus_comment(i)
        return len(self.rawdata) if end < 0 else end

    def _end(self, _: str, names: set[str], bounds: set[str]) -> None:
        last = 0
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.page.tags[self.open[depth]]
            if name in names:
                last = depth
            elif name in bounds or (name in BLOCKS and name not in PROSE and not last and name not in names):
                break
        if last:
            del self.open[last:]


def _marks(tag: str, attrs: list[tuple[str, str | None]]) -> Marks:
    boiler = content = main = doubtful = False
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
            for part in value.split():
                words = [w.lower() for w in _WORD.findall(part)]
                if not words or words[0] in LAYOUT_WORDS:
                    continue
                boiler |= not BOILER_WORDS.isdisjoint(words)
                doubtful |= not DOUBTFUL_WORDS.isdisjoint(words)
                content |= not CONTENT_WORDS.isdisjoint([*words, "".join(words)])
            main |= (name == "role" and value.strip().lower() in ("main", "article")) or (name == "itemprop" and value.strip().lower() == "articlebody")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            boiler = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            boiler = True
    if tag in FRAMES:
        boiler = doubtful = False
    return Marks(boiler, content, main, doubtful and not boiler)


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.page
