"""Main text of HTML pages by tree scoring.

A page becomes a tree in which menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments hold no text. Every paragraph earns points
for its length and its commas and passes them to its ancestors, the whole to its parent,
half to the next and less to those above; an ancestor's sum is discounted by the share
of its text that is inside links. The best container is kept together with siblings
that score close to it or read like prose, and everything left in them is written block
by block in page order.

Spark splits the pages over tasks; a page is independent of all others and is parsed in
time linear in its length.

Nulls, ties and the rest: null and empty pages give empty text; a page without tags is
one block; of containers with equal scores the first wins; a page where nothing earns
points gives its first article or main element, else its body; pages that repeat repeat
in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd",
         "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
         "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main",
         "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li",
                    "dd", "dt"}
#: A start tag ends open elements of these kinds, up to an element of the second kind.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

# What holds no article text: by element, by ARIA role, by a word of class or id.
DROP_TAG = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg",
                  "canvas", "object", "template", "dialog", "menu", "fieldset", "label", "audio",
                  "video", "map"}
DROP_ROLE = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog",
             "alert", "alertdialog", "menu", "menubar", "toolbar", "tooltip"}
DROP_WORD = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox",
             "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
             "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead",
             "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
             "pagination", "paywall", "popup", "promo", "promotion", "related", "replies", "reply",
             "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
             "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets"}
#: Never dropped for a class or an id alone.
SAFE = {"html", "body", "article", "main"}
PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd"}
CONTAINER = {"div", "section", "article", "main", "body", "center", "figure", "details"}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "chars", "linked", "links", "commas", "score", "in_article")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.kids: list[Node | str] = []
        self.chars = self.linked = self.links = self.commas = 0
        self.score = 0.0
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROP_TAG or (tag == "header" and not in_article):
        return True
    if not attrs or attrs.isspace():
        return False
    a = {}
    for m in ATTR.finditer(attrs):
        a.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if tag in SAFE:
        return False
    if a.get("role", "").lower() in DROP_ROLE:
        return True
    words = {w.lower() for w in WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    return bool(words & DROP_WORD) or ("header" in words and not in_article)


def parse(html: str) -> list[Node]:
    """All nodes, parents before children; the first is the root."""
    root = Node("html", None, False)
    nodes, here, pos = [root], root, 0

    def text(lo: int, hi: int) -> None:
        if lo < hi and not here.drop:
            here.kids.append(unescape(html[lo:hi]))

    opened: Counter[str] = Counter()

    def leave(to: Node) -> Node:
        """Closes everything open below ``to``."""
        at = here
        while at is not to:
            opened[at.tag] -= 1
            at = at.parent
        return to

    def close(kinds: set[str], until: set[str], last: str) -> Node:
        """Closes the nearest open elements of ``kinds`` below ``until``, ``last`` the last."""
        if not any(opened[k] > 0 for k in kinds):
            return here
        at, found = here, here
        while at.parent is not None and at.tag not in until:
            if at.tag in kinds:
                found = at.parent
                if at.tag == last:
                    break
            at = at.parent
        return leave(found)

    last = html.rfind(">") + 1  # no tag ends behind it
    while m := TAG.search(html, pos, last):
        text(pos, m.start())
        pos = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            pos = len(html)  # a comment that never ends
            break
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ending = tag.lower(), (m[1] if m[2] else m[4]) == "/"
        if ending:
            if opened[tag] > 0:
                at = here
                while at.tag != tag:
                    at = at.parent
                here = leave(at.parent)
            elif tag == "p":
                here.kids.append(Node("p", here, True))  # a stray end still parts blocks
            continue
        if tag in ("html", "body") and here is root:
            if tag == "body" and not any(n.tag == "body" for n in nodes):
                here = Node("body", root, False)
                root.kids.append(here)
                nodes.append(here)
                opened["body"] += 1
            continue
        if tag in CLOSES_P:
            here = close({"p"}, {"table", "td", "th", "li", "blockquote", "div", "section", "article",
                                 "main", "aside", "nav", "form", "figure", "button", "object"}, "p")
        if tag in ENDS:
            here = close(*ENDS[tag], tag)
        attrs = m[3] if m[2] else m[6] or ""
        drop = here.drop or _unwanted(tag, attrs, here.in_article)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, pos)
            pos = end.start() if end else len(html)
            if end:
                pos = html.find(">", end.start()) + 1 or len(html)
            continue
        node = Node(tag, here, drop)
        here.kids.append(node)
        if tag in VOID:
            continue
        nodes.append(node)
        opened[tag] += 1
        here = node
    text(pos, len(html))
    return nodes


def _measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                t = len(" ".join(k.split()))
                n.chars += t
                n.commas += k.count(",") + k.count("、") + k.count("，") + k.count("،")
            elif not k.drop:
                n.chars += k.chars
                n.commas += k.commas
                n.linked += k.linked
                n.links += k.links
        if n.tag == "a":
            n.linked, n.links = n.chars, n.links + 1


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _pass_points(nodes: list[Node]) -> None:
    for n in nodes:
        if n.drop:
            continue
        own = n.tag in PARAGRAPH
        if n.tag in CONTAINER:  # text directly in a container counts like a paragraph
            own = sum(len(k.strip()) for k in n.kids if isinstance(k, str)) >= 25
        if not own or n.chars < 25:
            continue
        points = (1 + n.commas + min(n.chars / 100, 3)) * (1 - _density(n))
        at, level = (n if n.tag in CONTAINER else n.parent), 0
        while at is not None and level < 5:
            at.score += points / (1, 2, 6, 9, 12)[level]
            at, level = at.parent, level + 1


def _kept_roots(nodes: list[Node]) -> list[Node]:
    _measure(nodes)
    _pass_points(nodes)
    for n in nodes:
        n.score = n.score * (1 - _density(n)) + (25 if n.tag in ("article", "main") and n.chars else 0)
    best = max((n for n in nodes if not n.drop), key=lambda n: n.score)
    if best.score <= 0:
        best = next((n for n in nodes if n.tag == "body"), nodes[0])
    if best.parent is None:
        return [best]
    out, floor = [], max(10.0, best.score * 0.2)
    siblings = [k for k in best.parent.kids if isinstance(k, Node) and not k.drop]
    place = siblings.index(best)
    for i, s in enumerate(siblings):
        prose = s.tag in PARAGRAPH and s.chars > 80 and _density(s) < 0.25
        heading = s.tag in ("h1", "h2") and i < place and not s.links and s.chars
        if s is best or s.score >= floor or prose or heading:
            out.append(s)
    return out


def _menu(n: Node) -> bool:
    return n.tag in ("ul", "ol", "div", "table", "section") and n.links > 2 and _density(n) > 0.6


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by two line ends."""
    if not html:
        return ""
    nodes = parse(html)
    blocks: list[str] = []
    open_block: list[str] = []

    def end_block() -> None:
        line = " ".join("".join(open_block).split())
        if line:
            blocks.append(line)
        open_block.clear()

    for root in _kept_roots(nodes):
        stack: list[Node | str | None] = [root]
        while stack:
            k = stack.pop()
            if k is None:
                end_block()
            elif isinstance(k, str):
                open_block.append(k)
            elif k.tag == "br":
                open_block.append(" ")
            elif k.drop or (k is not root and _menu(k)):
                if k.tag in BLOCK:
                    end_block()
            elif k.tag in BLOCK:
                end_block()
                stack.append(None)
                stack += reversed(k.kids)
            else:
                stack += reversed(k.kids)
        end_block()
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url",
                            "cast(html as string) as html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
