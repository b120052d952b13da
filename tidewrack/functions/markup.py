"""A small tree over the standard library's HTML tokeniser, and what is read off it. Works on one document; operators apply it to batches."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import islice

from tidewrack.functions.urls import completed

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags an open paragraph or list item doesn't reach across.
_CLOSES = {"p": {"p"}, "li": {"li"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "div": {"p"}, "article": {"p"}, "ul": {"p"}, "section": {"p"}}
_HIDDEN = frozenset("script style noscript template nav header footer aside form button".split())
# --- Fixed values, which sites and results depend on.
#: Words in an address that mark an image as decoration, and the least length of an address worth keeping.
DECORATION, SHORTEST = ("logo", "icon", "avatar", "ads", "banner", "pixel"), 10
#: Declarations of a page's image, the one that counts first; attributes with an image's address, in order, and those with a set of candidates.
DECLARED = (("property", "og:image"), ("property", "og:image:secure_url"), ("name", "twitter:image"))
ADDRESS, SETS = ("src", "data-src", "data-lazy-src", "data-original", "srcset", "data-srcset"), ("srcset", "data-srcset")
#: Boxes that hold a heading and its link.
BOXES = ("div", "article", "li")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """This node's descendants in document order; no recursion, so depth is no limit."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.children))

    def all(self, *tags: str):
        return (x for x in self.walk() if isinstance(x, Node) and x.tag in tags)

    def first(self, *tags: str) -> Node | None:
        return next(self.all(*tags), None)

    def up(self, *tags: str) -> Node | None:
        x = self.parent
        while x is not None and x.tag not in tags:
            x = x.parent
        return x

    def text(self, without: frozenset[str] = frozenset()) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in without:
                stack.extend(reversed(x.children))
        return "".join(out)

    def matches(self, selector: str) -> bool:
        """``tag``, ``.class`` or ``tag.class``."""
        tag, _, name = selector.partition(".")
        return (not tag or self.tag == tag) and (not name or name in self.attrs.get("class", "").split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x.tag not in (tag, "#root"):
            x = x.parent
        if x.tag == tag:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except (AssertionError, ValueError):
        pass  # what was read before a broken declaration stands
    return b.root


def address_of(img: Node) -> str:
    """What the first attribute of ``ADDRESS`` that isn't empty says; of a set of candidates the first."""
    for name in ADDRESS:
        if value := img.attrs.get(name):
            return value if name not in SETS else (value.split(",")[0].split() or [""])[0]
    return ""


def pictures(root: Node):
    """A page's candidates for its image, best first: the declared one, then those in the text that are no decoration."""
    declared: dict[int, Node] = {}
    for x in root.all("meta"):
        for rank, (attribute, name) in enumerate(DECLARED):
            if x.attrs.get(attribute) == name:
                declared.setdefault(rank, x)
    if declared:
        yield declared[min(declared)].attrs.get("content", "")
    for src in map(address_of, root.all("img")):
        low = src.lower()
        if len(src) >= SHORTEST and not any(w in low for w in DECORATION):
            yield src


def hero_image(root: Node, base: str = "") -> str:
    """The first of a page's candidates that isn't empty, as a full address; '' without any."""
    return next((completed(src, base) for src in pictures(root) if src), "")


def anchors(node: Node):
    """Links near a node, nearest first: within it, around it, after it, in the box around it."""
    yield node.first("a")
    yield node.up("a")
    if node.parent is not None:
        beside = node.parent.children
        yield next((x for x in beside[beside.index(node) + 1 :] if isinstance(x, Node) and x.tag == "a"), None)
    box = node.up(*BOXES)
    yield box.first("a") if box is not None else None


def nearest_link(node: Node, base: str) -> str:
    """The address of the nearest link; root-relative ones are completed, other relative ones dropped."""
    a = next((x for x in anchors(node) if x is not None), None)
    href = a.attrs.get("href", "") if a is not None else ""
    return href if href.startswith("http") else base.rstrip("/") + href if href.startswith("/") else ""


def paragraphs(root: Node, selector: str) -> list[str]:
    """The paragraphs that aren't blank of the first container that a selector matches."""
    box = next((x for x in root.walk() if isinstance(x, Node) and x.matches(selector)), None)
    return [] if box is None else [t for t in (p.text().strip() for p in box.all("p")) if t]


def lead(root: Node, selectors: list[str], n: int = 3, limit: int = 400) -> str:
    """The first paragraphs of the first selector that has any."""
    found = next(filter(None, (paragraphs(root, s) for s in selectors)), [])
    return ". ".join(found[:n])[:limit]


def headings(root: Node, selector: str, base: str, limit: int = 10, after: bool = False, drop: frozenset[str] = frozenset(), plain: bool = False):
    """``(pos, title, link)`` of a listing's headings.

    The first ``limit`` headings count before blank and unwanted ones are left out, or after with ``after``; ``drop`` are titles in capitals, and
    ``plain`` leaves out headings with a class.
    """
    found = (x for x in root.walk() if isinstance(x, Node) and x.matches(selector))
    rows = ((pos, h.text().strip(), h) for pos, h in enumerate(found) if after or pos < limit)
    kept = ((pos, title, h) for pos, title, h in rows if title and title.upper() not in drop and not (plain and h.attrs.get("class")))
    for pos, title, h in islice(kept, limit if after else None):
        yield pos, title, nearest_link(h, base)


def main_text(root: Node) -> str:
    """The text of the container with most of it outside links, by paragraph; navigation, scripts and forms left out."""
    best, most = None, 0
    for box in root.all("article", "main", "section", "div", "body"):
        if box.tag in _HIDDEN or box.up(*_HIDDEN):
            continue
        own = [x for x in box.children if isinstance(x, Node) and x.tag in ("p", "h1", "h2", "h3", "ul", "ol", "blockquote", "pre")]
        size = sum(len(x.text(_HIDDEN).strip()) - sum(len(a.text()) for a in x.all("a")) for x in own)
        if size > most:
            best, most = own, size
    if best is None:
        return root.text(_HIDDEN | {"head"}).strip()
    return "\n\n".join(t for x in best if (t := " ".join(x.text(_HIDDEN).split())))
