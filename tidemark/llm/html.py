"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks with their words and link density. Blocks in elements that never are an article's text (nav,
footer, button, ...) go. Of the others a decision tree looks at words and link density of the block and of the blocks before and after
it, at the share of the page's text in its container and at its tag path, and keeps it or not. The tree is grown from the
hand-labelled pages below.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What HTML elements are, and words in class or id that mark parts of a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
GONE = frozenset("head svg object audio video canvas map select option datalist".split())
APART = frozenset("nav footer aside header button dialog menu".split())
FORMS = frozenset("form fieldset".split())
#: Elements that may hold an article's text as a whole.
HOLDERS = frozenset("body div section article main form center".split())
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("body div section article main aside header footer nav form td th table blockquote figure ul ol dl details fieldset dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar widget related recommended cookie cookies consent notice alert popup modal gdpr newsletter "
    "subscribe subscription signup login comment comments disqus respond reply replies share sharing social toolbar pagination".split()
)

# Of MARKS: what people write below an article, which may itself be in article elements.
REMARKS = frozenset("comment comments disqus respond reply replies".split())
# A class or id names a part of a page if all of its words are MARKS or these; others ("ad-free", "has-sidebar") say something else.
GENERIC = frozenset(
    "area bar block body bottom box col column container content-box div form group inner item items left link links list main module outer "
    "page panel post posts primary region right row secondary section site slot small thread title top unit wrap wrapper".split()
)
_LEGAL = re.compile(r"©|\(c\) ?\d|\bcopyright\b|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits r[ée]serv[ée]s\b|\btodos los derechos reservados\b", re.I)

# A quote opens a value only directly after '='; elsewhere, or if it is never closed, it is a character like others.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_TAG = re.compile(rf"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+)>""")
_ATTRIBUTE = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
_TOKEN = re.compile(r"[a-z0-9]+")
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "share", "article", "marked", "heading", "item", "legal")


#: Elements around a block that are looked at for its share of the text; share of a page's text that makes a marked element its layout.
DEPTH, LAYOUT_SHARE = 64, 0.75


@dataclass
class Block:
    text: str
    words: int
    linked: int
    apart: bool  # in a menu, header, footer, sidebar, button or notice by its tag or role
    main: bool  # in an article or main element
    heading: bool
    item: bool
    holders: tuple[int, ...]  # the elements around it that may hold an article, the nearest last
    marks: tuple[int, ...]  # the elements around it whose name, class or id marks a form, an advert, comments and the like


@dataclass
class Mark:
    """An element marked as a part of the page. It is its layout if an article or nearly all of the page's text is inside it."""

    remarks: bool
    in_main: bool
    words: int = 0
    layout: bool = False


class Page:
    """One pass over a page's markup. Unclosed and misnested elements are closed where their parent ends."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.holders: list[int] = []
        self.marks: list[int] = []
        self.marked: list[Mark] = []
        self.seen = 0
        self.open: Counter[str] = Counter()  # open elements by name, and how many give each trait
        self.parts: list[str] = []
        self.links: list[str] = []
        self._read(source)
        self._flush()
        most = sum(b.words - b.linked for b in self.blocks if not b.apart) * LAYOUT_SHARE
        for mark in self.marked:
            mark.layout |= mark.words > most and not mark.remarks and not mark.in_main

    def _read(self, source: str) -> None:
        at, tag_at = 0, _TAG.match
        while True:
            lt = source.find("<", at)
            self._text(source[at : lt if lt >= 0 else len(source)])
            if lt < 0:
                return
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = len(source) if end < 0 else end + 3
            elif source.startswith(("<!", "<?"), lt):
                end = source.find(">", lt)
                at = len(source) if end < 0 else end + 1
            elif tag := tag_at(source, lt):
                at = tag.end()
                name = tag[2].lower()
                if tag[1]:
                    self._close(name)
                elif name in RAW:
                    end = _RAW_END[name].search(source, at)
                    at = len(source) if end is None else end.start()
                else:
                    self._start(name, tag[3])
            elif re.match(r"</?[A-Za-z]", source[lt : lt + 3]):
                if tag_at == _PLAIN.match or source.find(">", lt) < 0:
                    at = len(source)  # a tag that never ends
                else:  # its end stands only in a value: from here on tags end at their first >
                    at, tag_at = lt, _PLAIN.match
            else:
                at = lt + 1
                if at < len(source):  # else a tag that never ends
                    self._text("<")

    def _text(self, text: str) -> None:
        if text and not self.open["+gone"]:
            self.parts.append(text)
            if self.open["a"]:
                self.links.append(text)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text(" ")
        if name not in INLINE:
            self._flush()
            for closes, own in (("p", True), ("li", name == "li")):
                if own and self.open[closes]:
                    self._close_within(closes)
        if name in VOID or attributes.endswith("/"):
            return
        traits = self._traits(name, attributes)
        if "+main" in traits and not self.open["+main"]:
            for k in self.marks:  # what holds an article is its layout, whatever its class or id
                self.marked[k].layout |= not self.marked[k].remarks
        if "+marked" in traits or "+remarks" in traits:
            self.marks.append(len(self.marked))
            self.marked.append(Mark("+remarks" in traits, self.open["+main"] > 0))
        if name in HOLDERS:
            self.holders.append(self.seen)
            self.seen += 1
        self.stack.append((name, traits))
        self.open[name] += 1
        self.open.update(traits)

    def _traits(self, name: str, attributes: str) -> tuple[str, ...]:
        found = {"+gone"} if name in GONE else set()
        if name in APART:
            found.add("+apart")
        if name in FORMS:
            found.add("+marked")
        if name in MAIN:
            found.add("+main")
        if attributes:
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                    found.add("+gone")
                elif key == "role" and value in ROLES:
                    found.add("+apart")
                elif key in ("class", "id") and name not in ("body", "html", "article", "main"):
                    for words in map(_TOKEN.findall, value.split()):
                        marks = MARKS.intersection(words)
                        if marks and all(w in MARKS or w in GENERIC or w.isdigit() for w in words):
                            found.add("+remarks" if marks & REMARKS else "+marked")
        return tuple(found)

    def _close_within(self, name: str) -> None:
        """Close the last such element, unless a container that was opened inside it is still open."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self._pop(k)
                return
            if self.stack[k][0] in CONTAINERS:
                return

    def _close(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        if self.open[name]:
            k = len(self.stack) - 1
            while self.stack[k][0] != name:
                k -= 1
            self._pop(k)

    def _pop(self, k: int) -> None:
        for name, traits in self.stack[k:]:
            self.open[name] -= 1
            self.open.subtract(traits)
            if name in HOLDERS:
                self.holders.pop()
            if "+marked" in traits or "+remarks" in traits:
                self.marks.pop()
        del self.stack[k:]

    def _flush(self) -> None:
        if not self.parts:
            return
        words = references.unescape("".join(self.parts)).split()
        linked = len(references.unescape(" ".join(self.links)).split())
        self.parts, self.links = [], []
        if words:
            o = self.open
            linked = min(linked, len(words))
            if not o["+apart"]:
                for k in self.marks:
                    self.marked[k].words += len(words) - linked
            place = o["+apart"] > 0, o["+main"] > 0, any(o[h] for h in HEADINGS), o["li"] > 0
            self.blocks.append(Block(" ".join(words), len(words), linked, *place, tuple(self.holders[-DEPTH:]), tuple(self.marks)))


def shares(blocks: list[Block], parts: list[bool]) -> list[float]:
    """For each block the largest share of the page's unlinked words that stand directly in one of the elements around it.

    An element with a single block is a paragraph of the element around it. Blocks of marked parts count for nothing.
    """
    held = Counter(b.holders[-1] for b in blocks if b.holders)
    places = [b.holders[:-1] if b.holders and held[b.holders[-1]] == 1 else b.holders for b in blocks]
    direct, total = Counter(), 0
    for b, place, part in zip(blocks, places, parts, strict=True):
        if not b.apart and not part:
            direct[place[-1] if place else -1] += b.words - b.linked
            total += b.words - b.linked
    return [max([direct[h] for h in place] or [direct[-1]]) / max(total, 1) for place in places]


def features(page: Page) -> np.ndarray:
    """[blocks, FEATURES]. article: 1 inside one, -1 outside one on a page that has it, 0 on a page without."""
    blocks = page.blocks
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    has = any(b.main and not b.apart for b in blocks)
    parts = [not all(page.marked[k].layout for k in b.marks) for b in blocks]
    place = [
        [share, 1 if b.main else -has, part, b.heading, b.item, _LEGAL.search(b.text) is not None]
        for b, share, part in zip(blocks, shares(blocks, parts), parts, strict=True)
    ]
    near = [words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]]
    return np.column_stack([*near, np.array(place, float).reshape(-1, 6)])


# --- labelled pages: each block in order, kept (1) or not (0) -----------------------------------

_PAPER = "The council met on Monday evening to hear the plans for the old harbour and to vote on the money that the repairs will take."
_PLAN = "Engineers told the meeting that the sea wall had lost a third of its stones since the storms of the last two winters."
_MID = "Work could begin in spring, the engineers said."
_SHORT = "No vote was taken."
_LEGAL_LINE = "Copyright 2024 The Harbour Paper and its partners, all rights reserved, no part of this page may be used without leave in writing."
_HINT = "We use cookies to make this page better for you and for all of our partners and their friends."
_MENU = "<div><a href=/>Start</a> | <a href=/x>Sport</a> | <a href=/y>Weather</a></div>"
_TWELVE = "<div>" + " ".join(f"<a href=/{k}>More news today</a>" for k in range(12)) + "</div>"
_LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Story number {k}</a></li>" for k in range(4)) + "</ul>"
_POEM = "<p>The wall is low</p><p>The tide is high</p><p>The gulls all know</p><p>The reason why</p>"
_REPLY = "I have lived by the water for thirty years and nobody ever asked us about any of this before now."
LABELLED = (
    # Pages with an article or main element.
    (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>Harbour plans</h1><p>{_PAPER}</p><p>{_SHORT}</p><p>Agreed.</p></article><footer>&copy; The Paper</footer>", "00" "1111" "0"),
    (f"<header><h1>The Paper</h1><p>All the news of the coast, every day of the week</p></header><main><h2>Harbour</h2><p>{_PLAN}</p><ul><li>Stones</li><li>Sand and clay</li></ul><p>{_PAPER}</p></main><aside><p>{_PLAN}</p></aside>", "00" "11111" "0"),
    (f"<article><p>{_PAPER}</p><p>Two.</p><p>See <a href=/w>the plan of the wall</a></p><p>{_PLAN}</p><h3>Costs</h3><p>Ten</p></article><section id=comments><h3>Comments</h3><p>{_PLAN} I think so too.</p></section><div class=ad>{_SHORT} Buy stones now.</div>", "111111" "00" "0"),
    (f"<div class='cookie-notice'><p>{_HINT}</p><button>Accept</button></div><article><h1>One</h1><p>Word</p></article><form><label>Search</label><input></form>", "00" "11" "0"),
    (f"<div class=ad><p>{_PLAN}</p></div><article><header><p>By a writer</p></header><p>{_PLAN}</p><div class='related'><a href=/o>Other news of the day</a></div><p>{_PAPER}</p></article><p>{_PAPER}</p>", "0" "0101" "0"),
    (f"<article><p>Yes.</p></article><div>{_PAPER}</div><div>{_PLAN}</div>", "1" "00"),
    (f"<article><h1>Plans</h1><p>{_PAPER}</p></article>", "11"),
    ("<main><p>Seen.</p></main>", "1"),
    (f"<article><p>{_PLAN}</p><p><a href=/w>The plan of the wall</a></p><p>Ends</p></article>", "111"),
    (f"<div class=nav><a href=/>Start</a></div><article><p><a href=/w>The plan of the wall</a></p></article>", "01"),
    (f"<article><ul><li>Stones</li><li><a href=/s>Sand and clay from the bay</a></li></ul><h2>End</h2></article><footer><p>{_PAPER}</p></footer>", "111" "0"),
    (f"<div class='content-sidebar-wrap'><div class=nav><a href=/>Start</a></div><article><h1>Plans</h1><p>{_PAPER}</p><p>Agreed.</p></article><div class=sidebar><p>{_PLAN}</p></div></div>", "0" "111" "0"),
    (f"<form id=aspnetForm><div class=search-box>Search</div><article><h1>Plans</h1><p>{_PAPER}</p><p>{_SHORT}</p></article></form>", "0" "111"),
    (f"<article><h2>Prices</h2><div class=share-price-table><table><tr><td>Stones</td><td>4</td></tr></table></div><p>{_PLAN}</p><form><p>Your mail</p></form></article>", "1111" "0"),
    (f"<article>{_POEM}<p>From a book of the coast</p><div class='share links'><a href=/t>Tell a friend</a></div></article>{_TWELVE}", "11111" "00"),
    (f"<article><p>{_PAPER}</p><p>{_LEGAL_LINE}</p><p>{_MID}</p></article><p>{_LEGAL_LINE}</p><div>{_MID}</div>", "111" "00"),
    (f"<main><p>{_PAPER}</p><div class=ads>{_MID}</div><div class=newsletter><p>{_HINT}</p></div><p>{_PLAN}</p></main>{_LINKS}", "1001" "0000"),
    (f"<article><p>{_SHORT}</p></article><div class=comments><p>{_REPLY}</p><p>{_REPLY}</p><p>Me too.</p></div>", "1" "000"),
    (f"<article><p>{_PAPER}</p></article><section id=comments><article><p>{_REPLY}</p></article><article><h4>Ann</h4><p>{_MID}</p></article></section>", "1" "000"),
    # Pages without one.
    (f"<div class=menu><a href=/>Start</a> <a href=/a>About us</a></div><div id=content><p>{_PAPER}</p><p>{_PLAN}</p><p>{_SHORT}</p></div><div class=sidebar><p>{_PAPER}</p></div>", "0" "111" "0"),
    (f"{_MENU}<div><h1>Harbour plans</h1></div><div>{_PAPER}</div><div>{_PLAN}</div><div><a href=/1>Read more</a></div><div>All rights reserved</div>", "0" "111" "00"),
    ("<p><a href=/1>First link of the page</a></p><p><a href=/2>Second link of the page</a></p><p><a href=/3>Third</a></p>", "000"),
    (f"<h1>Harbour</h1><p>{_PAPER}</p><p>{_PLAN} {_PAPER}</p><p>{_SHORT}</p><p>{_PLAN}</p><p><a href=/s>Share</a></p><p><a href=/t>Top</a></p>", "11111" "00"),
    (f"<p>{_PAPER}</p><p>Agreed.</p><p>{_PLAN}</p>", "111"),
    (f"<p>{_PLAN}</p>", "1"),
    (f"<p>{_PAPER}</p><p>{_SHORT}</p><p>{_PLAN}</p>", "111"),
    (f"<p>{_PAPER}</p><p>{_PLAN}</p><p>{_SHORT}</p>", "111"),
    (f"<div><p>{_PAPER}</p></div><div><a href=/1>One</a> <a href=/2>Two</a></div>", "10"),
    (f"<div><p>{_PAPER}</p><p>{_PLAN}</p><p>{_SHORT}</p></div>{_TWELVE}<p>{_LEGAL_LINE}</p>", "111" "00"),
    (f"{_TWELVE}<div><h1>Harbour</h1><p>{_PAPER}</p><ul><li>Stones</li><li>Sand and clay</li><li>Ropes</li></ul><p>{_PLAN}</p></div>{_LINKS}", "0" "111111" "0000"),
    (f"<div>{_LINKS}</div><div><h1>Low wall</h1>{_POEM}</div><div><p>{_LEGAL_LINE}</p></div>", "0000" "11111" "0"),
    (f"{_MENU}<div>{_POEM}{_POEM}</div>", "0" "11111111"),
    (f"<form id=aspnetForm><div>{_MENU}</div><div><h1>Harbour plans</h1><p>{_PAPER}</p><p>{_PLAN}</p><p>{_SHORT}</p></div><div><a href=/i>Imprint</a> <a href=/c>Contact</a></div></form>", "0" "1111" "0"),
    (f"<form action=/find><p>Find a page</p><p>Sort by day</p></form><div><p>{_PAPER}</p><p>{_MID}</p></div>", "00" "11"),
    (f"<div><p>{_PAPER}</p><p>{_PLAN}</p></div><form class=signup><p>{_HINT}</p><p>Mail</p></form>", "11" "00"),
    (f"<div class='single comments-open'><h1>Plans</h1><p>{_PAPER}</p><p>{_SHORT}</p></div><div class=comments><p>{_REPLY}</p><p>{_REPLY}</p></div>", "111" "00"),
    (f"<div class='site has-sidebar'><div class='no-comments'><p>{_PAPER}</p><p>{_PLAN}</p></div><div class=widget><p>{_PAPER}</p></div></div>", "11" "0"),
    (f"<div class=ad-free><p>{_PAPER}</p><p>{_MID}</p></div><div class=ad><p>{_PLAN}</p></div>", "11" "0"),
    (f"<table><tr><td>{_MENU}</td><td><h1>Plans</h1><p>{_PAPER}</p><p>{_PLAN}</p><p>Agreed.</p></td></tr><tr><td>{_LEGAL_LINE}</td></tr></table>", "0" "1111" "0"),
    (f"<div id=page><div>{_MENU}{_LINKS}</div><div><h2>Costs</h2><p>{_PLAN} See <a href=/w>the plan</a> of it.</p><p>{_MID}</p><blockquote>{_SHORT}</blockquote></div><div><h3>Also read</h3>{_LINKS}</div></div>", "0" "0000" "1111" "0" "0000"),
    (f"<div><div>{_MENU}</div><div><p>{_PAPER}</p><div><p>{_MID}</p><p>{_SHORT}</p></div><p>{_PLAN}</p></div><div><p>Follow us</p><p>Write to us</p><p><a href=/m>Mail</a></p></div></div>", "0" "1111" "000"),
    (f"<div><h4>Most read</h4>{_LINKS}</div><div><p>{_PAPER}</p><p>{_PLAN}</p><h4>Costs</h4><p>{_MID}</p></div><div><h4>Topics</h4><p><a href=/a>Harbour</a></p><p><a href=/b>Money</a></p></div>", "00000" "1111" "000"),
    (f"<div><h4>Most read</h4>{_LINKS}<h4>Topics</h4>{_LINKS}</div><div><h1>Harbour</h1><p>{_PAPER}</p><p>{_SHORT}</p></div><div>{_LINKS}<h4>About us</h4><p>{_MID}</p></div>", "0000000000" "111" "000000"),
    (f"{_MENU}<div><p>{_PAPER}</p><p>Read <a href=/w>the plan of the wall</a> and what the engineers said of it.</p><p>{_MID}</p></div>", "0" "111"),
    (f"<div>{_LEGAL_LINE}</div><div><h1>Notes</h1><ol><li>{_MID}</li><li>Stones</li><li>{_PLAN}</li></ol><p>Ends</p></div>", "0" "11111"),
    (f"<div class=cookies><p>{_HINT}</p><p>{_HINT}</p></div><div><h1>Tide</h1><p>High.</p><p>{_PAPER}</p></div>", "00" "111"),
    (f"<div><p>{_PAPER} {_PLAN}</p><p>Tags: <a href=/a>harbour</a> <a href=/b>wall</a> <a href=/c>money</a></p></div><div>{_TWELVE}</div>", "10" "0"),
    (f"<p>Log in</p><p><a href=/p>Password</a></p><div><p>{_PAPER}</p><p>{_PLAN}</p></div><p>Imprint</p>", "00" "11" "0"),
)


# --- decision tree ------------------------------------------------------------------------------


@dataclass
class Tree:
    """Left where the feature is at most the threshold. A leaf has the share of kept blocks and no branches."""

    share: float
    feature: int = 0
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def keep(self, inputs: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(inputs), self.share > 0.5)
        below = inputs[:, self.feature] <= self.threshold
        out = np.empty(len(inputs), bool)
        out[below], out[~below] = self.left.keep(inputs[below]), self.right.keep(inputs[~below])
        return out


#: Features in the order in which equally good splits are preferred.
_PREFERENCE = [FEATURES.index(n) for n in ("density", "marked", "article", "share", "legal", "words", "density_before", "density_after", "heading", "item", "words_before", "words_after")]


def grow(inputs: np.ndarray, kept: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """Splits with the least Gini impurity, halfway between neighbouring values; ties by _PREFERENCE."""
    tree = Tree(float(kept.mean()))
    if depth == 0 or kept.all() or not kept.any():
        return tree
    best = None
    for feature in _PREFERENCE:
        values = np.unique(inputs[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            below = inputs[:, feature] <= threshold
            n = below.sum()
            if min(n, len(kept) - n) < least:
                continue
            impurity = sum(part.sum() * (1 - part.mean()) for part in (kept[below], kept[~below]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, float(threshold), below
    if best is None:
        return tree
    _, tree.feature, tree.threshold, below = best
    tree.left = grow(inputs[below], kept[below], depth - 1, least)
    tree.right = grow(inputs[~below], kept[~below], depth - 1, least)
    return tree


def trained(pages=LABELLED) -> Tree:
    inputs, kept = [], []
    for source, labels in pages:
        page = Page(source)
        if len(page.blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for the {len(page.blocks)} blocks of {source[:60]}")
        if any(b.apart and x == "1" for b, x in zip(page.blocks, labels, strict=True)):
            raise ValueError(f"a block of {source[:60]} is kept in an element that goes")
        seen = [not b.apart for b in page.blocks]
        inputs.append(features(page)[seen])
        kept += [x == "1" for x, own in zip(labels, seen, strict=True) if own]
    return grow(np.concatenate(inputs), np.array(kept))


def judged(page: Page, tree: Tree) -> list[bool]:
    """Which blocks of a page are kept."""
    if not page.blocks:
        return []
    return [bool(keep) and not b.apart for b, keep in zip(page.blocks, tree.keep(features(page)), strict=True)]


def main_text(source: str, tree: Tree) -> tuple[str, int, int]:
    """The kept blocks joined by line feeds, their number and the number of all blocks."""
    page = Page(source)
    kept = [b.text for b, keep in zip(page.blocks, judged(page, tree), strict=True) if keep]
    return "\n".join(kept), len(kept), len(page.blocks)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """[page_id, url, text, n_chars, n_kept, n_blocks], one row per page.

    text is empty where nothing is kept, and for null, empty and text-free pages. White space of all kinds inside a block is one space.
    Null ids and urls and repeated pages keep their rows; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h or "", shared.value) for h in batch.column(2).to_pylist()]
            texts, kept, blocks = zip(*found, strict=True) if found else ((), (), ())
            columns = [pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (list(map(len, texts)), kept, blocks))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
