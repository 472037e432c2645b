"""Leaf blocks of HTML pages: the texts between block-level tags, with what their place and form tells about them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

# Fixed values of HTML: elements that begin and end a block of text, elements without content, elements whose content
# is no text of the page, and which open elements a start tag closes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset(
    "audio button canvas iframe noscript object script select style svg template textarea title video".split()
)
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("tr", "td", "th"), "tbody": ("tr", "td", "th"), "body": ("head",),
}
OUTERMOST_TAGS = ("html", "body")
_CONTAINERS = frozenset("article aside body div footer form header main nav section table td ul ol dl".split())

# Training pages mark the blocks that belong to the main text with this attribute; pages to extract from never need it.
MARK = "data-main"

_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile("[>\"']")
# Quoted values that a tag has at most before its first > ends it.
_MOST_QUOTED = 1000
_NAMED = re.compile(r"""(?i)\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}\b", re.I) for name in SKIPPED_TAGS}
# Elements that a start tag may close, as bits.
_CLOSABLE = {tag: 1 << place for place, tag in enumerate(("p", *sorted({tag for tags in CLOSED_BY.values() for tag in tags})))}

# Words that short texts around an article often have.
CUES = frozenset(
    "advertisement accept agree comment comments consent cookie cookies copyright login newsletter policy privacy "
    "read related replies reply reserved rights search share sign sponsored subscribe".split()
)


@dataclass
class Scope:
    """An open block-level element; ``features`` are its own, those of its ancestors are theirs."""

    tag: str
    parent: Scope | None
    features: list[str]
    marked: bool
    depth: int
    score: float | None = None
    # The nearest container, itself perhaps, and the closable elements that are open inside of it.
    inside: Scope | None = None
    closable: int = 0

    def __post_init__(self) -> None:
        inner = self.tag in _CONTAINERS or self.parent is None
        self.inside = self if inner else self.parent.inside
        closed = self.tag in _CONTAINERS and self.tag != "td" or self.parent is None
        self.closable = (0 if closed else self.parent.closable) | _CLOSABLE.get(self.tag, 0)

    def chain(self) -> Iterator[Scope]:
        scope = self
        while scope is not None:
            yield scope
            scope = scope.parent


@dataclass
class Block:
    """A text between block-level tags. ``container`` tells blocks of one surrounding element from others."""

    text: str
    scope: Scope
    container: int
    marked: bool
    link_share: float
    features: list[str] = field(default_factory=list)


def _scope_features(tag: str, attributes: str, parent: Scope | None) -> list[str]:
    """Features of an element. Every page has the outermost elements, written or not, so their tags say nothing."""
    above = parent.tag if parent and parent.tag not in OUTERMOST_TAGS else ""
    found = [] if tag in OUTERMOST_TAGS else [f"in:{tag}", f"under:{above}>{tag}"]
    for _, value in _NAMED.findall(attributes):
        for part in _NAME_PART.findall(value.strip("\"'")):
            found.append(f"name:{part.lower()}")
            found.append(f"stem:{part.lower()[:4]}")
    return found


@dataclass
class _Tag:
    """A tag or a comment; ``name`` is empty for what is none of a page's elements."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""


class _Tags:
    """The tags of a page, one after the other. What is not there any more is not looked for again, so the time is in
    proportion to the page."""

    def __init__(self, html: str):
        self.html = html
        self.none_left = False  # no > from here on
        self.gone: set[str] = set()

    def after(self, at: int) -> _Tag | None:
        """The next tag that begins at or after a place."""
        html = self.html
        while not self.none_left:
            start = html.find("<", at)
            if start < 0:
                return None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return _Tag(start, end + 3 if end >= 0 else len(html))
            if html[start + 1 : start + 2] in ("!", "?"):
                end = html.find(">", start + 2)
                if end < 0:
                    break
                return _Tag(start, end + 1)
            named = _TAG_NAME.match(html, start)
            if named is None:
                at = start + 1
                continue
            end = self._end(named.end())
            if end < 0:
                break
            return _Tag(start, end + 1, named[1].lower(), html[start + 1] == "/", html[named.end() : end])
        self.none_left = True
        return None

    def _end(self, at: int) -> int:
        """Where a tag ends: the first > outside of quotes, or the first of all if a quote stays open."""
        first = self.html.find(">", at)
        place, quoted = at, 0
        while first >= 0:
            stop = _TAG_STOP.search(self.html, place)
            if stop is None:
                return first
            if stop[0] == ">":
                return stop.start()
            close = -1 if stop[0] in self.gone else self.html.find(stop[0], stop.end())
            quoted += 1
            if close < 0 or quoted > _MOST_QUOTED:
                if close < 0 and self.html.rfind(stop[0]) == stop.start():
                    self.gone.add(stop[0])
                return first
            place = close + 1
        return -1

    def end_of(self, name: str, at: int) -> int:
        """Where the element's end tag ends, or -1."""
        found = None if f"</{name}" in self.gone else _ENDS[name].search(self.html, at)
        end = self.html.find(">", found.end()) if found else -1
        if end < 0:
            self.gone.add(f"</{name}")
        return end + 1 if end >= 0 else -1


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order, their text with references decoded and runs of white space made one space."""
    blocks: list[Block] = []
    scope = Scope("", None, [], False, 0)
    containers = {id(scope): 0}
    parts: list[str] = []
    linked, link_depth, at = 0, None, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                inside = scope.inside
                share = min(1.0, linked / len(text))
                blocks.append(Block(text, scope, containers.setdefault(id(inside), len(containers)), scope.marked, share))
                kept.append(inside)
            parts.clear()
        linked = 0

    kept: list[Scope] = []  # keeps scopes alive, so that their numbers stay their own
    open_tags: Counter[str] = Counter()
    tags = _Tags(html)
    while True:
        tag = tags.after(at)
        text = html[at : tag.start] if tag else html[at:]
        if text:
            parts.append(text)
            if link_depth is not None:
                linked += len(text)
        if not tag:
            break
        at = tag.end
        name, closing = tag.name, tag.closing
        if name in SKIPPED_TAGS:
            # An icon that ends in its own tag has no content.
            empty = name == "svg" and tag.attributes.endswith("/")
            end = -1 if closing or empty else tags.end_of(name, at)
            if end >= 0:
                at = end
            elif not closing and name in ("script", "style"):
                break
        elif name in BLOCK_TAGS:
            flush()
            if closing:
                if open_tags[name]:
                    while scope.tag != name:
                        open_tags[scope.tag] -= 1
                        scope = scope.parent
                    open_tags[name] -= 1
                    scope = scope.parent
            else:
                # A paragraph ends where a block begins, items and cells where the next one begins.
                ends = ("p", *CLOSED_BY.get(name, ()))
                if scope.closable & sum(_CLOSABLE[tag] for tag in set(ends)):
                    below = scope
                    for open_scope in scope.chain():
                        if open_scope.tag in ends:
                            below = open_scope.parent
                        elif open_scope.tag in _CONTAINERS and open_scope.tag not in ("td",):
                            break
                    while scope is not below:
                        open_tags[scope.tag] -= 1
                        scope = scope.parent
                if name not in VOID_TAGS:
                    attributes = tag.attributes
                    marked = MARK in attributes or (scope.marked and f'{MARK}="0"' not in attributes)
                    marked = marked and f'{MARK}="0"' not in attributes
                    features = _scope_features(name, attributes.replace(MARK, ""), scope)
                    scope = Scope(name, scope, features, marked, scope.depth + 1)
                    open_tags[name] += 1
            if link_depth is not None and scope.depth < link_depth:
                link_depth = None
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link_depth = None if closing else scope.depth
    flush()
    _form_features(blocks)
    return blocks


def _form_features(blocks: list[Block]) -> None:
    """Features of the text itself and of its place on the page."""
    headed = False
    for place, block in enumerate(blocks):
        text, features = block.text, block.features
        words = text.count(" ") + 1
        size = min(words.bit_length(), 7)
        link = 0 if block.link_share == 0 else 1 if block.link_share < 0.5 else 2
        sentence = text[-1] in ".!?…»\"”"
        features += (
            f"tag:{block.scope.tag}",
            f"size:{size}",
            f"link:{link}",
            f"form:{min(size, 4)}/{link}/{sentence}",
            f"tag:{block.scope.tag}/{link}",
            f"headed:{headed}",
        )
        if place == 0:
            features.append("first")
        if place == len(blocks) - 1:
            features.append("last")
        if "©" in text:
            features.append("sign:copyright")
        if words <= 24:
            features += {f"cue:{word}" for word in (w.strip(".,:!?").lower() for w in text.split()) if word in CUES}
        headed = headed or block.scope.tag == "h1"
