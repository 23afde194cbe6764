"""A tolerant HTML reader: a tree of elements and the text each owns, in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from html import unescape

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe svg annotation annotation-xml".split())  # their content is never page text
MATH = set(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics".split()
)
FOREIGN = MATH | {"svg"}  # a closing slash ends them
NESTED = set("template svg".split())  # they hold their own kind; the others end at the first closing tag
ENDLESS = set("script style".split())  # without a closing tag they last to the end of the page
TITLE = set("title textarea".split())  # their content holds no elements
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
) | MATH  # a formula is part of the text around it
CLOSED_BY = {  # an open element of the first kind ends where one of the others starts
    "p": set(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul".split()
    ),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

CLOSERS = set().union(*CLOSED_BY.values())
ONCE = {"html", "head", "body"}  # a second one inside the first is passed over

# A comment, a declaration or what else is no tag; the start of a tag; text.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)|(?:[^<]+|<(?![a-zA-Z/!?]))+|<", re.S)
_NESTED = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style)\b.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>svg|template)(?=[\s/>])", re.S | re.I
)
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"([^\s/>][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
KEPT = {"class", "id", "role", "hidden", "style", "aria-hidden", "data-main"}


class _Tags:
    """Reads the rest of a tag as HTML does: a quote opens only behind an equals sign, any other is part of a name or value."""

    def __init__(self, text: str):
        self.text = text
        self.last = {quote: text.rfind(quote) for quote in "\"'"}  # a quote that nothing closes is not searched for again

    def rest(self, at: int) -> tuple[int, dict[str, str], bool]:
        """Behind a tag's name: the place behind its `>`, the attributes that are kept, and whether a slash ends it."""
        text, kept = self.text, {}
        if text.startswith(">", at):
            return at + 1, kept, False
        while True:
            at = _GAP.match(text, at).end()
            if at == len(text):
                return at, kept, False
            if text[at] == ">":
                return at + 1, kept, text[at - 1] == "/"
            name = _NAME.match(text, at)
            at, value = name.end(), ""
            if name[2]:
                quote = text[at : at + 1]
                if at < self.last.get(quote, -1):
                    end = text.index(quote, at + 1)
                    value, at = text[at + 1 : end], end + 1
                else:
                    found = _UNQUOTED.match(text, at)
                    value, at = found.group(), found.end()
            if (key := name[1].lower()) in KEPT:
                kept.setdefault(key, unescape(value))


class _Open:
    """The open elements, with the node that owns the text of each; where each tag stands is known without a search."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]  # places of elements that are not inline

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def ended_by(self, tag: str) -> int:
        """The place of the element that an opening tag ends, 0 if none.

        At most one element of each kind in CLOSED_BY is open above the first other one, so few are looked at.
        """
        for k in reversed(self.blocks if tag in CLOSERS else ()):
            name = self.stack[k][0]
            if tag in CLOSED_BY.get(name, ()):
                return k
            if name in HOLDS.get(tag, ()) or name not in CLOSED_BY:
                break
        return 0

    def closed_by(self, tag: str) -> int:
        """The place of the element that a closing tag ends, 0 if none; an inline one ends no block."""
        depth = (self.places.get(tag) or [0])[-1]
        return depth if tag not in INLINE or self.blocks[-1] <= depth else 0


def _nested_ends(text: str, at: int, tags: _Tags) -> dict[int, tuple[int, int]]:
    """Of nested raw elements from `at` on that are closed: end of the opening tag -> start and end of the closing one."""
    ends, opened = {}, {tag: [] for tag in NESTED}
    while m := _NESTED.search(text, at):
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            at, _, self_closed = tags.rest(at)
            if not m["close"]:
                if not (tag in FOREIGN and self_closed):
                    opened[tag].append(at)
            elif opened[tag]:
                ends[opened[tag].pop()] = (m.start(), at)
    return ends


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[int] = field(default_factory=list)
    words: int = 0
    link_words: int = 0
    sentences: int = 0


@dataclass
class Page:
    """Nodes in page order (0 is the root), and pieces of text as (node, block, text)."""

    nodes: list[Node]
    pieces: list[tuple[int, int, str]]


def parse(html: str | None) -> Page:
    """Read any text as a page; what is not closed is closed at the end.

    Plain inline elements are no nodes: their text belongs to the element around them.
    A block number changes wherever a block-level element starts or ends.
    """
    nodes, pieces, block = [Node("html", -1)], [], 0
    opened, at, text = _Open(), 0, html or ""
    tags = _Tags(text)
    open_ended: set[str] = set()  # raw elements that nothing closes from here on
    nested: dict[int, tuple[int, int]] | None = None
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        closing, tag = m.group(1, 2)
        if tag is None:
            if m.group().startswith("<") and len(m.group()) > 1:
                continue  # a comment or declaration
            own = unescape(m.group())
            node = opened.stack[-1][1]
            n = len(own.split())
            if n:
                nodes[node].words += n
                nodes[node].link_words += n if opened.places.get("a") else 0
                nodes[node].sentences += own.count(". ") + own.rstrip().endswith((".", "!", "?", "…"))
            pieces.append((node, block, own))
            continue
        tag = tag.lower()
        at, attributes, self_closed = tags.rest(at)
        if closing:
            if depth := opened.closed_by(tag):
                opened.cut(depth)
                block += tag not in INLINE
            continue
        if tag == "br":
            pieces.append((opened.stack[-1][1], block, " "))
            continue
        if depth := opened.ended_by(tag):
            opened.cut(depth)
        if tag in FOREIGN and self_closed:
            continue
        if tag in RAW or tag in TITLE:
            if tag in NESTED:
                nested = _nested_ends(text, m.start(), tags) if nested is None else nested
                end = nested.get(at)
            else:
                found = None if tag in open_ended else _closing(tag).search(text, at)
                end = found.span() if found else None
            if end is None and tag not in ENDLESS:
                open_ended.add(tag)
                block += 1
                continue  # read on
            inner = text[at : end[0]] if end else text[at:]
            at = end[1] if end else len(text)
            block += 1
            if tag in TITLE and inner.strip():
                nodes.append(Node(tag, opened.stack[-1][1], attributes, words=len(inner.split())))
                nodes[nodes[-1].parent].children.append(len(nodes) - 1)
            continue
        if tag in ONCE and opened.places.get(tag):
            if tag == "html":
                nodes[0].attributes = attributes | nodes[0].attributes
            continue
        inline = tag in INLINE
        block += not inline
        if tag in VOID:
            continue
        node = opened.stack[-1][1]
        if not inline or attributes:
            nodes.append(Node(tag, node, attributes))
            nodes[node].children.append(len(nodes) - 1)
            node = len(nodes) - 1
        opened.push(tag, node)
    return Page(nodes, pieces)


def blocks_of(page: Page, wanted: list[bool]) -> str:
    """Text of the wanted nodes: white space in a block becomes one space, blocks are joined by an empty line."""
    out, last, own = [], None, []
    for node, block, text in [*page.pieces, (0, -1, "")]:
        if block != last:
            joined = " ".join("".join(own).split())
            if joined:
                out.append(joined)
            last, own = block, []
        if block >= 0 and wanted[node]:
            own.append(text)
    return "\n\n".join(out)
