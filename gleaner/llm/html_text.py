"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas on to the elements above them, fewer with
each level; an element's points are discounted by the share of its text that is links. The
best container's ``article`` or ``main`` is kept, or else the container grown to the elements
above it while these hold no lists of links, with those of its siblings that are none.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut out of the tree before, by tag, role or the words of class and id. A single
word of a longer name (``market-share``) decides for containers outside an article only;
elsewhere the whole name must say so, or the element must be links for the most part.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm import words

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEVER = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe "
    "object svg canvas dialog audio video menu title".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "toolbar form".split()
)
_CLUTTER = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo "
    "promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead topbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended widget widgets toolbar pagination pager search skip copyright hidden".split()
)
#: Words of names that say that an element is a part of the article.
_CONTENT = frozenset("article body content entry lead post story text".split())
#: Elements of running text, which a single word of their name does not condemn.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody pre blockquote figcaption span em strong b i".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CUT_OFF_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
#: A start tag ends an open element of these kinds, up to the nearest limit.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_LEVELS = 5


class _Node:
    __slots__ = ("tag", "parent", "children", "cut", "length", "linked", "links", "points", "suspect")

    def __init__(self, tag: str, parent: _Node | None, cut: bool, suspect: bool = False) -> None:
        self.tag, self.parent, self.cut, self.suspect = tag, parent, cut, suspect
        self.children: list[_Node | str] = []
        self.length = self.linked = self.links = 0
        self.points = 0.0

    def link_density(self) -> float:
        return self.linked / self.length if self.length else 0.0


def _is_clutter(tag: str, attrs: dict[str, str | None], inside: set[str]) -> bool | None:
    """Whether an element is cut; None if its links decide, once its text is known."""
    if tag in _NEVER or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True
    names = {w.lower() for w in _WORD.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}
    if names & _COMMENTS:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if (attrs.get("role") or "").lower() in _ROLES or (tag == "header" and not inside & {"article", "main"}):
        return True
    if not names & _CLUTTER or {"has", "with", "no"} & names:
        return False
    tokens = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()
    whole = [{w.lower() for w in _WORD.findall(t)} for t in tokens]
    if any(t and t <= _CLUTTER for t in whole):
        return True
    return None if inside or tag in _PROSE or names & _CONTENT else True


class _Tree(HTMLParser):
    """Builds the tree, leaving out what is cut. Unclosed and stray tags are tolerated."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = _Node("html", None, False)
        self.open: dict[str, int] = {}

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs)
        inside = {t for t in ("article", "main") if self.open.get(t)}
        clutter = _is_clutter(tag, known, inside)
        cut = self.top.cut or clutter is True
        node = _Node(tag, self.top, cut, clutter is None)
        if not cut:
            self.top.children.append(node)
        self.top = node
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def _end(self, tags: set[str], limits: set[str]) -> None:
        """Closes the nearest open element of ``tags``, unless a limit comes first."""
        if not any(self.open.get(t) for t in tags):
            return
        node = self.top
        while node.parent is not None and node.tag not in tags:
            if node.tag in limits:
                return
            node = node.parent
        if node.parent is not None:
            while self.top is not node:
                self._pop()
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in _BLOCK:
            self._end({"p"}, {"button", "table", "blockquote", "article", "section", "div", "td"})
        if tag in _CLOSES:
            self._end(*_CLOSES[tag])
        if tag in _VOID:
            if not self.top.cut:
                self.top.children.append(" " if tag != "hr" else _Node("hr", self.top, False))
            return
        self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        limits = set() if tag in _BLOCK else _BLOCK
        self._end({tag}, limits)

    def handle_data(self, data: str) -> None:
        if not self.top.cut:
            self.top.children.append(data)


def _parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(_CUT_OFF_TAG.sub("", html))
    tree.close()
    return tree.root


def _in_order(root: _Node) -> list[_Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, _Node))
    return order


def _measure(order: list[_Node]) -> None:
    """Text and link lengths of every element, white space not counted."""
    for node in reversed(order):
        node.length = node.linked = node.links = 0
        for child in node.children:
            if isinstance(child, str):
                node.length += sum(map(len, child.split()))
            else:
                node.length += child.length
                node.linked += child.linked
                node.links += child.links
        if node.tag == "a":
            node.linked, node.links = node.length, node.links + 1


def _own_text(node: _Node) -> str:
    """The text of a block without the blocks inside it."""
    parts: list[str] = []
    todo: list[_Node | str] = list(reversed(node.children))
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            parts.append(one)
        elif one.tag not in _BLOCK:
            todo.extend(reversed(one.children))
    return " ".join("".join(parts).split())


def _score(order: list[_Node]) -> list[_Node]:
    """Gives every paragraph's points to the elements above it; returns those with points."""
    scored: dict[int, _Node] = {}
    for node in order:
        if node.tag not in _BLOCK or not node.length or node.tag in _HEADINGS:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = 1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3)
        points *= 1 - node.link_density()
        # A container with text of its own is its own paragraph.
        above = node.parent if node.tag in ("p", "pre", "td", "th", "li", "dd", "dt", "blockquote") else node
        for level in range(_LEVELS):
            while above is not None and above.tag not in _BLOCK:
                above = above.parent
            if above is None:
                break
            above.points += points / (1, 2, 6, 9, 12)[level]
            scored[id(above)] = above
            above = above.parent
    for node in scored.values():
        node.points *= 1 - node.link_density()
    return list(scored.values())


def _without_suspects(root: _Node) -> list[_Node]:
    """All elements in order, without those of a doubtful name that are links for the most part."""
    order = _in_order(root)
    _measure(order)
    gone = [n for n in order if n.suspect and n.links and n.link_density() >= 0.5]
    if not gone:
        return order
    for node in gone:
        node.parent.children = [c for c in node.parent.children if c is not node]
    order = _in_order(root)
    _measure(order)
    return order


def _fits(one: _Node | str) -> bool:
    """Whether something beside the best container may be a part of the same article."""
    return isinstance(one, str) or not one.length or one.link_density() < 0.5


def _article(top: _Node) -> list[_Node | str]:
    """The best container with what belongs to it."""
    for tag in ("article", "main"):
        above: _Node | None = top
        while above is not None and above.tag != tag:
            above = above.parent
        if above is not None:
            return [above]
    while top.parent is not None and all(_fits(c) for c in top.parent.children):
        top = top.parent
    return [top] if top.parent is None else [c for c in top.parent.children if c is top or _fits(c)]


def _is_link_list(node: _Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "table") and node.links >= 3 and node.link_density() > 0.75


def _blocks(roots: list[_Node]) -> list[str]:
    """The texts of all blocks in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    todo: list[_Node | str | None] = list(reversed(roots))
    while todo:
        one = todo.pop()
        if one is None:
            flush()
        elif isinstance(one, str):
            held.append(one)
        elif one.tag not in _BLOCK:
            todo.extend(reversed(one.children))
        elif not _is_link_list(one):
            flush()
            todo.append(None)
            todo.extend(reversed(one.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, one per line; empty if there is none.

    Character references are decoded and white space inside a block becomes one space. A
    page that is cut off or not well formed is read as far as it goes.
    """
    if not html:
        return ""
    root = _parse(html)
    candidates = _score(_without_suspects(root))
    if not candidates:
        return "\n".join(_blocks([root]))
    return "\n".join(_blocks(_article(max(candidates, key=lambda node: node.points))))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of the html.

    A null or empty html gives an empty text. Columns named ``text`` or ``n_chars`` are
    replaced; all others, null or not, are passed on.
    """

    def compute(column: pa.Array) -> list:
        texts = [main_text(h) for h in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    fields = {"text": "string", "n_chars": "long"}
    if html.lower() in fields:
        pages, html = pages.withColumnRenamed(html, "_html"), "_html"
    return words.with_columns(pages, html, fields, compute, keep=[c for c in pages.columns if c != html and c not in fields])
