"""Main text of HTML pages by tree scoring.

Paragraphs give points for length and commas to their parent and, halved, to its parent; a container's points
are discounted by the share of its text that stands in links. The best container, or the article or main element
around it, is kept with those siblings that score well; menus, forms, adverts and the like are cut beforehand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# The rest of a tag: a > inside a quoted value does not end it; a quote elsewhere is a sign like any other.
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RESUME = re.compile(r"<(?:p|div|article|section|main|h[1-6]|ul|ol|table|nav|footer|header|aside|body|/body|/head)\b", re.I)

# Element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_HIDDEN = frozenset("noscript template svg canvas audio video".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CUT = frozenset("nav header footer aside form menu dialog button select datalist fieldset head label".split())
_PARAGRAPH = frozenset("p pre blockquote td dd li".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT_BLOCKS = _HEADINGS | frozenset("p pre blockquote ul ol dl table figure hr".split())
_BYLINE = 120  # characters of a line between a heading and its text
_BETTER = {"article": 10.0, "main": 10.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "body": 0.0}
_GROUPS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
_UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
# Our own lists: names of page furniture, names that may also head a part of the article, and words that say nothing.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist disqus replies respond sidebar sidebars rail widget widgets menu navbar navigation nav breadcrumb breadcrumbs pagination pager footer header masthead topbar "
    "toolbar newsletter subscribe signup copyright".split()
)
_WEAK_NAMES = frozenset("share sharing social related recommended search skip side discussion login legal".split())
_PLAIN_WORDS = frozenset("box list area container wrapper wrap slot unit block bar links link buttons button items item inner outer left right top bottom content text form section main".split())
_LAYOUT = frozenset("no has with without not is show hide".split())


class Node:
    """An element: cut says it is left out, named that only its class or id says so, weak that its text has a say too."""

    __slots__ = ("tag", "parent", "parts", "cut", "named", "weak", "score", "size", "commas", "linked")

    def __init__(self, tag: str, parent: Node | None, unwanted: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        self.cut, self.named, self.weak = unwanted in ("kind", "name"), unwanted == "name", unwanted == "weak"
        self.score, self.size, self.commas, self.linked = None, 0, 0, 0


def _name_kind(value: str) -> str:
    """name or weak if a class or id value names page furniture, else nothing.

    Of a compound the last telling part counts: cookie-notice and ad-slot do, legal-analysis and has-sidebar do not.
    """
    kind = ""
    for token in value.split():
        parts = [x for x in re.split(r"[-_0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
        if not parts or parts[0] in _LAYOUT:
            continue
        while len(parts) > 1 and parts[-1] in _PLAIN_WORDS:
            parts.pop()
        if parts[-1] in _NAMES:
            return "name"
        if parts[-1] in _WEAK_NAMES:
            kind = "weak"
    return kind


def _unwanted(tag: str, attributes: str) -> str:
    """kind if an element is unwanted by its kind, role or hiding; name or weak if by its class or id."""
    if tag in _CUT:
        return "kind"
    if tag in ("html", "body", "article", "main") or not attributes:
        return ""
    said = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "role" and value.lower() in _UNWANTED_ROLES:
            return "kind"
        if name in ("class", "id") and said != "name":
            said = _name_kind(value) or said
    return said


class _Page:
    """The open element while a page is read, with the number of open elements of each tag."""

    def __init__(self):
        self.root = self.now = Node("html", None)
        self.open = {"html": 1}

    def enter(self, node: Node) -> None:
        self.now = node
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def leave(self, node: Node) -> None:
        """Close everything down to node's parent."""
        while self.now is not node.parent:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def end(self, tag: str) -> None:
        if not self.open.get(tag):
            if tag == "p":
                self.now.parts.append(Node("br", self.now))
            return
        node = self.now
        while node.tag != tag:
            if tag not in _BLOCK and node.tag in _BLOCK:
                return
            node = node.parent
        if node.parent is not None:
            self.leave(node)

    def supply_ends(self, tag: str) -> None:
        """Close an open paragraph before a block, and the last item of a list or cell before the next one."""
        if self.open.get("p"):
            node = self.now
            while node.tag not in _BLOCK:
                node = node.parent
            if node.tag == "p":
                self.leave(node)
        group = _GROUPS.get(tag, ())
        if any(self.open.get(t) for t in group):
            stop, node, found = _STOPS.get(tag, ("table",)), self.now, None
            while node is not None and node.tag not in stop:
                found = node if node.tag in group else found
                node = node.parent
            if found is not None:
                self.leave(found)


def _closing(page: str, tag: str, at: int, ends: dict[str, int]) -> tuple[int, int]:
    """(start, end) of the next end tag, (-1, -1) if there is none; ends remembers tags that have none left."""
    if ends.get(tag, len(page)) < at:
        return -1, -1
    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
    if close is None:
        ends[tag] = at - 1
        return -1, -1
    return close.start(), close.end()


def parse(page: str) -> Node:
    """A tree of nodes and texts; missing end tags are supplied where a block begins or an outer element ends.

    A script or the like without an end tag ends at the next block; the tag of any other hidden element without one
    is passed over. Every step goes forward in the page, so the time taken grows with its length.
    """
    tree, at, whole, ends = _Page(), 0, True, {}
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            begin = len(page)
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            stop = len(page) if stop < 0 else stop + 3
            tag = None
        elif page.startswith(("<!", "<?"), begin):
            stop = page.find(">", begin) + 1 or len(page)
            tag = None
        else:
            m = _OPENING.match(page, begin)
            rest = _REST.match(page, m.end()) if m and whole else None
            stop = rest.end() if rest else page.find(">", begin) + 1 if m else 0
            if m and whole and not rest:
                whole = False  # quotes are out of step from here on: read plain tags
            if not stop:  # a sign, not a tag
                begin = page.find("<", begin + 1) if begin < len(page) else begin
                begin = len(page) if begin < 0 else begin
                tree.now.parts.append(html.unescape(page[at:begin]))
                at = begin
                continue
            tag = m[2].lower()
        if begin > at:
            tree.now.parts.append(html.unescape(page[at:begin]))
        at = stop
        if tag is None:
            continue
        if m[1]:
            tree.end(tag)
            continue
        attributes = page[m.end() : stop - 1]
        closed = attributes.endswith("/")
        if tag in _RAW or tag in _HIDDEN and not closed:
            low, high = _closing(page, tag, at, ends)
            if high < 0 and tag in _RAW:
                again = _RESUME.search(page, at)
                at = again.start() if again else len(page)
            elif high >= 0 and (tag in _RAW or re.compile(rf"<{tag}\b", re.I).search(page, at, low) is None):
                at = high
            continue
        if tag in _BLOCK:
            tree.supply_ends(tag)
        child = Node(tag, tree.now, _unwanted(tag, attributes))
        tree.now.parts.append(child)
        if tag not in _VOID and (not closed or tag in ("p", "div", "a")):
            tree.enter(child)
    return tree.root


def _walk(node: Node) -> list[Node]:
    """All nodes that are not cut, outer before inner; an iterative walk, so deep pages do not matter."""
    out, left = [], [node]
    while left:
        one = left.pop()
        out.append(one)
        left += [p for p in reversed(one.parts) if isinstance(p, Node) and not p.cut]
    return out


def _open_wrappers(root: Node) -> None:
    """Take back cuts by class or id around the article: of a wrapper of an article or main where none is left
    outside, else of an element that holds most of the page's paragraph text."""
    order, left = [], [(root, False)]
    while left:
        one, below = left.pop()
        order.append((one, below))
        left += [(p, below or p.named) for p in reversed(one.parts) if isinstance(p, Node) and (p.named or not p.cut)]
    if not any(node.named for node, _ in order) or any(node.tag in ("article", "main") and not below for node, below in order):
        return
    said: dict[Node, int] = {}
    for node, _ in reversed(order):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        inner = [p for p in node.parts if isinstance(p, Node)]
        said[node] = sum(said.get(p, 0) for p in inner) + (own if node.tag in _PARAGRAPH else 0)
    wanted = [node for node, _ in order if node.tag in ("article", "main")]
    if wanted:
        node: Node | None = max(wanted, key=lambda n: said[n])
        while node is not None:
            if node.named:
                node.cut = node.named = False
            node = node.parent
        return
    for node, _ in order:
        if node.named and 2 * said[node] > said[root]:
            node.cut = node.named = False


def _measure(nodes: list[Node]) -> None:
    """Text length, commas and text in links of every node, from the inside out."""
    for node in reversed(nodes):
        node.size = node.commas = node.linked = 0
        for part in node.parts:
            if isinstance(part, str):
                node.size += len(part.strip())
                node.commas += part.count(",")
            elif not part.cut:
                node.size += part.size
                node.commas += part.commas
                node.linked += part.size if part.tag == "a" else part.linked


def _text(node: Node, out: list[str]) -> None:
    left: list = [node]
    while left:
        one = left.pop()
        if isinstance(one, str):
            out.append(one)
        elif not one.cut:
            edge = " " if one.tag in _BLOCK or one.tag == "br" else ""
            left.append(edge)
            left += one.parts[::-1]
            left.append(edge)


def main_text(page: str | None) -> str:
    """The article's text, blocks joined by one space; empty if there is none."""
    root = parse(page or "")
    _open_wrappers(root)
    nodes = _walk(root)
    _measure(nodes)
    inside: set[Node] = set()
    for node in nodes:
        if node.tag in ("article", "main") or node.parent in inside:
            inside.add(node)
        links = node.tag in ("ul", "ol") and (items := sum(isinstance(p, Node) for p in node.parts)) >= 3 and node.linked >= 0.9 * node.size > 0
        if links and node in inside:
            # Outside an article a list of links is a menu; inside one only if its entries are single words, else its sources.
            said: list[str] = []
            _text(node, said)
            links = len("".join(said).split()) < 2 * items
        # A part named share, related and so on belongs to the article if it has prose and few links.
        if links or node.weak and (node.size < 60 or node.linked > 0.25 * node.size):
            node.cut = True
    nodes = _walk(root)
    _measure(nodes)
    for node in nodes:
        own = [p for p in node.parts if isinstance(p, str) and p.strip()] if node.tag in ("div", "section", "article", "main", "body", "html") else []
        size, commas = (sum(len(p.strip()) for p in own), sum(p.count(",") for p in own)) if own else (node.size, node.commas)
        if not size or not own and node.tag not in _PARAGRAPH:
            continue
        points = 1 + commas + min(size / 100, 3)
        for share, up in ((1.0, node if own else node.parent), (0.5, node.parent if own else node.parent and node.parent.parent)):
            if up is not None:
                up.score = (_BETTER.get(up.tag, 0.0) if up.score is None else up.score) + share * points
    fair = lambda n: n.score * (1 - n.linked / n.size if n.size else 0)
    scored = [n for n in nodes if n.score is not None and n.tag not in ("a", "p")]
    kept = _kept(max(scored, key=fair), fair) if scored else [root]
    out: list[str] = []
    for part in kept:
        if isinstance(part, str):
            out.append(part)
        else:
            _text(part, out)
        out.append(" ")
    return " ".join("".join(out).split())


def _kept(best: Node, fair) -> list[Node | str]:
    """The best container, or the article or main around it, with those siblings that belong to it, in page order."""
    up: Node | None = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.parent is None:
        return [best]
    bar = max(10.0, 0.2 * fair(best)) if best.score is not None else 10.0
    beside, chosen = best.parent.parts, []
    for k, part in enumerate(beside):
        if part is best:
            chosen.append(k)
        elif isinstance(part, Node) and not part.cut and part.tag != "a":
            scores = part.score is not None and fair(part) >= bar
            if scores or part.tag == "p" and part.size > 80 and part.linked < 0.25 * part.size:
                chosen.append(k)
    first, last, picked = _headed(beside, chosen[0]), chosen[-1], set(chosen)
    # What is left out anyway does not end the text; a block that is mostly links or a new container does.
    for k in range(last + 1, len(beside)):
        part = beside[k]
        if isinstance(part, str) and part.strip() or isinstance(part, Node) and not part.cut and part.size:
            if isinstance(part, Node) and (part.tag in _BLOCK and part.tag not in _TEXT_BLOCKS or part.linked > 0.25 * part.size):
                break
            last = k
    # From the heading to the last block all that is not mostly links stays.
    return [part for k, part in enumerate(beside) if k in picked or first <= k <= last and (isinstance(part, str) or not part.cut and part.linked <= 0.25 * part.size)]


def _headed(beside: list[Node | str], first: int) -> int:
    """Where the text begins: at the headings before the first kept part, a by-line or a date between them included."""
    for k in range(first - 1, -1, -1):
        part = beside[k]
        if isinstance(part, Node) and not part.cut and part.tag in _HEADINGS:
            first = k
        elif isinstance(part, Node) and not part.cut and (part.size > _BYLINE or part.linked > 0.25 * part.size) or isinstance(part, str) and len(part.strip()) > _BYLINE:
            break
    return first


def _extracted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([main_text(p) for p in part], dtype="object")


def extract_main_text(pages: DataFrame, html_column: str = "html", to: str = "main_text") -> DataFrame:
    """pages with the main text of every row in the column `to` (replaced if it exists); nothing is capped.

    Null and empty pages give an empty text. Pages are read one by one and whole, in time that grows with their
    length: repeated rows come out alike. Of containers that score alike the first of the page is taken.
    """
    return pages.withColumn(to, F.pandas_udf(_extracted, "string")(F.col(html_column)))
