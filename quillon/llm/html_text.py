"""Main text of web pages by tree scoring: paragraphs pass points to ancestors, and the best container and its kin are kept."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|"|')*(?:>|\Z)|</[^A-Za-z>][^>]*(?:>|\Z)""", re.DOTALL)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Their content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: They never hold article text.
DROPPED = RAW - {"xmp"} | {"head", "nav", "footer", "aside", "button", "select", "option", "datalist", "svg", "canvas", "object", "applet", "audio", "video", "dialog", "menu", "template", "map"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | DROPPED - {"button", "select", "option", "svg", "canvas", "object", "map", "audio", "video", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | {"p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "hgroup"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "html", "center", "form", "details", "fieldset"}
#: Words of a class, id or role that mark what is not the article.
UNLIKELY = {
    "ad", "ads", "adsense", "advert", "advertisement", "advertisements", "adverts", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "captcha", "comment", "comments", "complementary", "consent", "contentinfo",
    "cookie", "cookies", "copyright", "dialog", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "notifications",
    "outbrain", "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "recommendations", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signin", "signup", "skip",
    "skyscraper", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "teaser", "toolbar", "topbar", "tracking",
}
#: Of these, those that hold articles other than the page's own; and those that name an article element itself.
BESIDE = {"comment", "comments", "sidebar", "related", "footer", "recommended", "recommendations", "promo", "promoted", "teaser", "sponsored", "replies", "respond"}
NO_ARTICLE = BESIDE - {"comments", "replies", "respond"} | {"ad", "ads", "advert", "advertisement", "reply"}
#: A header of these is the article's.
OWN_HEADER = {"entry", "article", "post", "story"}
#: Start tags that end an open element of these names, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"})}
_ENDS |= {"thead": _ENDS["tbody"], "tfoot": _ENDS["tbody"]}
_COMMAS = re.compile("[,،、，;；]")


class Node:
    __slots__ = ("children", "classes", "commas", "hidden", "length", "linked", "links", "name", "parent", "score")

    def __init__(self, name: str, parent: Node | None, classes: frozenset = frozenset(), hidden: bool = False):
        self.name, self.parent, self.classes, self.hidden = name, parent, classes, hidden
        self.children: list[Node | str] = []
        self.score = 0.0


def _words(value: str) -> list[str]:
    return [w.lower() for w in _NAME_PART.findall(value)]


def _open(tag: str, name: str, parent: Node) -> Node:
    classes, hidden = set(), False
    for key, *values in _ATTRIBUTE.findall(tag, len(name) + 1):
        key, value = key.lower(), html.unescape("".join(values))
        if key in ("class", "id", "role"):
            classes.update(_words(value))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return Node(name, parent, frozenset(classes), hidden)


def parse(page: str) -> Node:
    """The tree of a page; open paragraphs, items and cells end where the next begins, and what is never closed at the page's end."""
    root = at = Node("html", None)
    done, size = 0, len(page)
    while done < size:
        found = _MARKUP.search(page, done)
        text = page[done : found.start() if found else size]
        if text:
            at.children.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        done, tag = found.end(), found[0]
        named = _NAME.match(tag)
        if not named or tag.startswith("<!"):
            if tag.startswith("<![CDATA["):
                at.children.append(tag[9:].removesuffix("]]>"))
            continue
        name = named[1].lower()
        if tag[1] == "/":
            up = at
            while up.parent and up.name != name and not (name not in BLOCKS and up.name in BLOCKS):
                up = up.parent
            if up.parent and up.name == name:
                at = up.parent
            continue
        if name in BLOCKS:
            up = at
            while up.parent and up.name != "p" and up.name not in BLOCKS:
                up = up.parent
            if up.name == "p" and up.parent:
                at = up.parent
        if name in _ENDS:
            ends, within = _ENDS[name]
            up, last = at, None
            while up.parent and up.name not in within:
                last = up if up.name in ends else last
                up = up.parent
            if last:
                at = last.parent
        if name in ("html", "body"):
            if name == "body":
                while at.parent and at.name == "head":
                    at = at.parent
            if name == "html" or any(isinstance(c, Node) and c.name == "body" for c in root.children):
                continue
        node = _open(tag, name, at) if " " in tag or "\n" in tag or "\t" in tag else Node(name, at)
        at.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, done)
            if name == "xmp":
                node.children.append(page[done : close.start()])
            done = close.end()
        elif name not in VOID and not (tag.endswith("/>") and name not in BLOCKS):
            at = node
    return root


def _holds(node: Node, names: set[str], titled: bool = False) -> bool:
    """Whether an element of these names is below node, one with a first heading of its own (or main) if titled."""
    open_ = [node]
    while open_:
        for child in open_.pop().children:
            if isinstance(child, Node):
                if child.name in names and not child.classes & NO_ARTICLE and (not titled or child.name == "main" or _holds(child, {"h1"})):
                    return True
                open_.append(child)
    return False


def _foreign(node: Node, inside: bool) -> bool:
    """Whether node is no part of an article; inside: it lies in one. What frames the article is none, whatever it is called."""
    if node.name in DROPPED or node.hidden:
        return True
    if node.name in ("html", "body", "main"):
        return False
    if node.name == "article":
        return bool(node.classes & NO_ARTICLE)
    if node.classes & UNLIKELY:
        return not _holds(node, {"article", "main"}, titled=bool(node.classes & BESIDE))
    if node.name == "header" or ("header" in node.classes and not node.classes & OWN_HEADER):
        return not inside and not _holds(node, {"article", "main"})
    if node.name == "form":
        return not _holds(node, {"article", "main"}) and not (_holds(node, {"p"}) and _holds(node, HEADINGS))
    return False


def _prune(node: Node) -> None:
    """Take out what is no part of an article."""
    stack = [(node, False)]
    while stack:
        up, inside = stack.pop()
        kept: list[Node | str] = []
        for child in up.children:
            if isinstance(child, Node):
                if _foreign(child, inside):
                    kept.append(" ")
                    continue
                stack.append((child, inside or child.name in ("article", "main")))
            kept.append(child)
        up.children = kept


def _measure(node: Node) -> None:
    """Letters, letters in links, commas and links below every node, children first."""
    order, stack = [], [node]
    while stack:
        up = stack.pop()
        order.append(up)
        stack.extend(c for c in up.children if isinstance(c, Node))
    for up in reversed(order):
        up.length = up.linked = up.commas = up.links = 0
        for child in up.children:
            if isinstance(child, Node):
                up.length, up.linked, up.commas, up.links = up.length + child.length, up.linked + child.linked, up.commas + child.commas, up.links + child.links
            else:
                up.length += len("".join(child.split()))
                up.commas += len(_COMMAS.findall(child))
        if up.name == "a":
            up.linked, up.links = up.length, 1


def _plain(node: Node) -> bool:
    """Whether the node has text of its own, not only that of blocks."""
    return any((not isinstance(c, Node) and not c.isspace()) or (isinstance(c, Node) and c.name not in BLOCKS and c.length) for c in node.children)


def _score(root: Node) -> Node | None:
    """Paragraphs pass points to their parent, half to the next and less to those above; the best by points less its share of links."""
    held, stack = {}, [root]
    while stack:
        up = stack.pop()
        stack.extend(c for c in up.children if isinstance(c, Node))
        paragraph = up.name in ("p", "pre", "td", "li", "dd", "blockquote") or up.name in CONTAINERS
        if not paragraph or not up.length or not _plain(up):
            continue
        points = (1 + up.commas + up.length / 100) * (1 - up.linked / up.length)
        parent, share = (up if up.name in CONTAINERS else up.parent), 1
        while parent and share < 6:
            if parent.name in CONTAINERS or parent.parent is None:
                parent.score += points / share
                held[id(parent)] = parent
                share += 1
            parent = parent.parent
    found = [n for n in held.values() if n.length]
    return max(found, key=lambda n: n.score * (1 - n.linked / n.length), default=None)


def _menu(node: Node) -> bool:
    """A list of links."""
    return node.name in CONTAINERS | {"ul", "ol", "dl", "table", "p"} and node.links >= 3 and node.linked > 0.8 * node.length and node.length < 60 * node.links


def _heading(node: Node) -> bool:
    """A heading, or a block with nothing but headings in it."""
    return node.name in HEADINGS or (node.name in CONTAINERS | {"header", "hgroup"} and all((not isinstance(c, Node) and c.isspace()) or (isinstance(c, Node) and (not c.length or _heading(c))) for c in node.children))


def _kept(root: Node) -> list[Node]:
    """The best container, the article around it if there is one, and those of its siblings that belong to it, in page order."""
    best = _score(root)
    if best is None:
        return [root] if root.length else []
    up = best
    while up:
        if up.name in ("article", "main"):
            best = up
            if up.name == "article":
                break
        up = up.parent
    if not best.parent:
        return [best]
    fair, kept = max(best.score * 0.2, 3), []
    for other in best.parent.children:
        if other is best:
            kept.append(best)
        elif isinstance(other, Node) and other.length:
            light = other.linked < 0.25 * other.length
            if (other.name in PROSE and light and best.name != "article") or (other.name in CONTAINERS and light and other.score >= fair) or _heading(other):
                kept.append(other)
    return kept


def _texts(node: Node, out: list[str]) -> None:
    """Text in page order; blocks and line breaks are set apart by a space."""
    stack: list = [node]
    while stack:
        now = stack.pop()
        if not isinstance(now, Node):
            out.append(now)
            continue
        if now is not node and now.links and _menu(now):
            out.append(" ")
            continue
        apart = now.name in BLOCKS or now.name in ("br", "hr")
        if apart:
            out.append(" ")
            stack.append(" ")
        stack.extend(reversed(now.children))


def main_text(page: str | None) -> str:
    """The article of a page, white space as single spaces."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    _measure(root)
    out: list[str] = []
    for node in _kept(root):
        _texts(node, out)
        out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of pages (page_id, url, html).

    The html becomes a tree. Menus, headers, footers, asides, forms, scripts, hidden parts and what classes or ids name as
    advert, notice, sidebar, comments and the like go, unless they frame an article or main element. Paragraphs pass
    points for their length and commas, less their share of linked letters, to the containers above; the container with
    the most points, widened to the article or main element it lies in, is kept with its headings and those siblings
    that have much the same points. Lists of links go. All other text stays, in page order.

    Rows are independent, so nothing is shuffled. Null and empty html, and pages without text, have an empty text. Text
    without markup is the text. Unclosed elements, comments and scripts end with the page. Repeated rows and ids give a
    row each; null ids and urls stay; an empty table gives an empty one; extra columns are not read.
    """
    bound_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            out = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
