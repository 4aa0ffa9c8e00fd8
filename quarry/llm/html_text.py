"""Main text of HTML pages by tree scoring.

The page becomes a tree (comments, scripts and styles left out, end tags that HTML implies are supplied). Elements
that are never article text (navigation, page headers and footers, sidebars, forms and their controls, notices, adverts, reader comments) are
taken out by their tag or role, or by the words of their class and id. A name that says nothing else (``comments``, ``cookie-notice``) is enough; a word among others
(``related-work``, ``recipe cookies``), or the id of a section or paragraph, counts only where the element lies outside the page's articles and main element, is mostly links, or holds no
sentence. Elements around an article are not taken out by name. So is what a browser doesn't show as text (drawings, frames, media).

Each block with text of its own passes points to the block around it: a point for each comma, one for each 100 characters (three at
most), and one more, in proportion where it has under 25 characters. What a block has received it passes on by half, however deep the page. A block's
points and those of its tag and name count less the more of its text is inside links. The block with the most points is the best
container. Where it lies in an article or main element, that is kept whole; so are other articles of the page with at least a quarter of its points. Elsewhere the best container is
kept, and so are its siblings and, up to an element with a name of content or the whole page, those of its ancestors, but for those that are mostly links and neither sentences nor a list under a heading;
without a name of content, those of its ancestors need a fifth of the points of the best. All their text comes out in page order.

Defined results: a null or empty page, and a page without text, give an empty text; character references are decoded; white space
inside a block becomes one space; blocks are joined by one line feed; a page of any length or depth is read whole, in time that grows with
its length; markup that is broken off or never closed is read as far as it goes; repeated rows give the same text; an empty table gives an
empty one; other columns are kept, whatever their names, but the page and those with the names of the added ones.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh, with_fields

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "canvas", "audio", "video", "object"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|\Z", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose start ends an open one of their kind, and the elements that such a kind doesn't reach out of.
_CLOSES = {"li": ("li",), "dt": ("dd",), "dd": ("dd",), "tr": ("tr", "td"), "td": ("td",), "th": ("td",), "option": ("option",)}
_KIND = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_BARS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dd",), "table": ("tr", "td"), "select": ("option",)}
_TABLE = {"table", "tr", "tbody", "thead", "tfoot", "td", "th"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_DROP = {"nav", "footer", "aside", "form", "button", "select", "input", "menu", "dialog", "head", "map"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar", "status"}
_BAD = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox "
    "nav navbar navigation menu menus submenu toc breadcrumb breadcrumbs pager pagination sidebar sidebars aside widget widgets footer masthead topbar toolbar skip comment comments commentlist disqus reply replies respond "
    "share sharing social follow related recommended recommendations trending outbrain taboola newsletter subscribe subscription signup login register search paywall copyright reactions".split()
)
_GOOD = set("article body content entry main page post story text blog hentry column".split())
_TAG_POINTS = {"article": 10, "main": 8, "div": 5, "section": 3, "blockquote": 3, "pre": 3, "td": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5}
#: Words that say what an element is laid out as, not what it holds.
_NEUTRAL = _GOOD | set(
    "box block wrapper wrap container section area list item items link links button buttons bar top bottom left right inner outer header head title row column col unit slot group panel region "
    "site primary secondary first last odd even fixed sticky mobile desktop".split()
)
#: Names that are enough even beside others.
_SURE = set(
    "ad ads adv advert adverts advertisement advertising sponsored comment comments commentlist disqus sidebar sidebars masthead navbar breadcrumb breadcrumbs pagination newsletter outbrain taboola paywall cookie consent gdpr "
    "popup modal lightbox".split()
)
_NAME_WORDS = re.compile(r"[A-Za-z][a-z]*")
_SENTENCE = re.compile(r"[.!?;:,。！？،、](?:\s|$)|\w{2,}\W+\w{2,}\W+\w{2,}\W+\w{2,}\W+\w{2,}\W+\w{2,}\W+\w{2,}\W+\w{2,}")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "dropped", "received", "chars", "linked", "score", "prose", "sentence", "around")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.dropped = tag, attrs, parent, [], False
        self.received, self.chars, self.linked, self.score = 0.0, 0, 0, 0.0
        self.prose = 0.0  # points of all blocks inside
        self.sentence = self.around = False  # whether there is one outside links; whether it holds an article or main element


class _Tree:
    """A tree in the making: the chain of open elements, and for each tag and kind where in the chain it is open."""

    def __init__(self) -> None:
        self.root = Node("#root", "", None)
        self.chain: list[Node] = [self.root]
        self.blocks = [0]  # places of blocks in the chain
        self.places: dict[str, list[int]] = {}
        self.kinds: list[dict[str, int]] = [{}]  # of each place, where the kinds that it is inside are open
        self.seen: set[str] = set()

    def text(self, t: str) -> None:
        self.chain[-1].kids.append(html.unescape(t) if "&" in t else t)

    def cut(self, n: int) -> None:
        """Leaves the first n elements open."""
        while len(self.chain) > n:
            tag = self.chain.pop().tag
            self.kinds.pop()
            at = len(self.chain)
            if self.blocks[-1] == at:
                self.blocks.pop()
            if (held := self.places.get(tag)) and held[-1] == at:
                held.pop()

    def last(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else 0

    def end(self, tag: str) -> None:
        """An end tag closes its element and all inside; without one it is ignored. Tags other than a table's don't reach out of a cell."""
        at = self.last(tag)
        if not at or (tag not in _TABLE and tag not in ("html", "body") and at < max(self.last(t) for t in ("table", "td", "th"))):
            return
        if tag not in _BLOCK and self.blocks[-1] > at:  # blocks opened inside an unclosed inline element go on
            self.cut(self.blocks[-1] + 1)
            self.places[tag].pop()
        else:
            self.cut(at)

    def start(self, tag: str, attrs: str) -> Node | None:
        if tag in ("html", "body"):
            if tag in self.seen:
                return None
            self.seen.add(tag)
            if tag == "body" and self.last("head"):
                self.cut(self.last("head"))
        elif tag in _BLOCK:
            inner = self.chain[self.blocks[-1]].tag
            if inner == "p" or tag in _HEADINGS and inner in _HEADINGS:
                self.cut(self.blocks[-1])
        for kind in _CLOSES.get(tag, ()):
            if at := self.kinds[-1].get(kind):
                self.cut(at)
        node = Node(tag, attrs, self.chain[-1])
        self.chain[-1].kids.append(node)
        # a slash doesn't close an HTML block
        if tag in _RAW:
            node.dropped = True
        elif tag not in _VOID and (tag in _BLOCK or not attrs.endswith("/")):
            at = len(self.chain)
            kinds = self.kinds[-1]
            if (barred := _BARS.get(tag, ())) or tag in _KIND:
                kinds = {k: v for k, v in kinds.items() if k not in barred}
                if tag == "tr":
                    kinds.pop("td", None)
                if tag in _KIND:
                    kinds[_KIND[tag]] = at
            self.chain.append(node)
            self.kinds.append(kinds)
            self.places.setdefault(tag, []).append(at)
            if tag in _BLOCK:
                self.blocks.append(at)
        return node


def parse(page: str) -> Node:
    """The tree; text is held as strings among ``kids``, references decoded."""
    tree = _Tree()
    at, text_at, size = 0, 0, len(page)
    while at < size and (m := _TOKEN.search(page, at)) is not None:
        if m.start() > text_at:
            tree.text(page[text_at : m.start()])
        at = text_at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            tree.end(tag)
            continue
        attrs = (m[3] or m[6] or "").rstrip()
        tree.start(tag, attrs)
        if tag in _RAW and not attrs.endswith("/"):
            at = text_at = _RAW_END[tag].search(page, at).end()
    if text_at < size:
        tree.text(page[text_at:])
    return tree.root


def _names(attrs: str) -> tuple[list[str], dict[str, str]]:
    found = {}
    for k, a, b, c in _ATTR.findall(attrs):
        found.setdefault(k.lower(), a or b or c)
    words = [w.lower() for w in _NAME_WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")]
    return words, found


def _name_says(node: Node) -> str:
    """What the class and id say: ``sure`` (not article text), ``maybe`` or nothing."""
    _, found = _names(node.attrs)
    tokens = [(t, "class") for t in found.get("class", "").split()] + [(t, "id") for t in found.get("id", "").split()]
    said, other = "", False
    for token, kind in tokens:
        parts = [w.lower() for w in _NAME_WORDS.findall(token)]
        bad = [w for w in parts if w in _BAD]
        if not bad:
            other = other or not all(w in _NEUTRAL for w in parts)
        elif all(w in _BAD or w in _NEUTRAL for w in parts) and (kind == "class" or node.tag not in ("section", "p")):
            if any(w in _SURE for w in parts):
                return "sure"
            said = said or "alone"
        else:
            said = "maybe"
    return "sure" if said == "alone" and not other else "maybe" if said else ""


def _unwanted(node: Node, in_article: bool, landmarks: bool) -> bool:
    if node.tag in _DROP or (node.tag == "header" and not in_article):
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main") and "comment" not in node.attrs:
        return False
    _, found = _names(node.attrs)
    if found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if node.around or node.tag not in _BLOCK | {"span", "ins", "a"} or node.tag in _HEADINGS:
        return False
    says = _name_says(node)
    return says == "sure" or says == "maybe" and (landmarks and not in_article or _link_heavy(node) or not node.sentence)


def blocks(nodes: list[Node]) -> list[str]:
    """The text blocks below the nodes, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif not x.dropped:
            if x.tag == "br":
                held.append(" ")
            elif x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.kids)
    flush()
    return out


def _link_heavy(node: Node) -> bool:
    return node.linked * 2 >= node.chars > 0


def _landmark(node: Node) -> Node | None:
    """Of the elements around a node the nearest article; without one the nearest main element; without both the nearest with a name of content."""
    found: dict[str, Node] = {}
    while node is not None and node.tag not in ("body", "html", "#root"):
        if node.tag in ("article", "main"):
            found.setdefault(node.tag, node)
        elif "named" not in found and node.attrs and any(w in _GOOD for w in _names(node.attrs)[0]):
            found["named"] = node
        node = node.parent
    return found.get("article") or found.get("main") or found.get("named")


def _measure(root: Node) -> bool:
    """Sets chars, linked, sentence and around of all elements; returns whether the page has an article or main element with text."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if not isinstance(k, str) and not k.dropped]
    for x in reversed(order):
        kids = [k for k in x.kids if not isinstance(k, str) and not k.dropped]
        own = [k for k in x.kids if isinstance(k, str)]
        x.chars = sum(len(k.strip()) for k in own) + sum(k.chars for k in kids)
        x.linked = x.chars if x.tag == "a" else sum(k.linked for k in kids)
        x.sentence = any(k.sentence for k in kids) or x.tag != "a" and any(_SENTENCE.search(k) for k in own)
        x.around = any(k.around or k.tag in ("article", "main") for k in kids)
    return any(x.tag in ("article", "main") and x.chars > 0 for x in order)


def _kept(root: Node) -> list[Node]:
    """The elements that are not unwanted, in page order; the others are marked as dropped."""
    order: list[Node] = []
    landmarks = _measure(root)
    stack = [(root, False)]
    while stack:
        x, in_article = stack.pop()
        order.append(x)
        inside = in_article or x.tag in ("article", "main")
        for k in reversed(x.kids):
            if not isinstance(k, str) and not k.dropped:
                if _unwanted(k, inside, landmarks):
                    k.dropped = True
                else:
                    stack.append((k, inside))
    return order


def own_points(text: str) -> float:
    """The points that a block with this text of its own passes."""
    commas = sum(text.count(c) for c in ",、،")
    return commas + min(len(text) // 100, 3) + min(1.0, len(text) / 25) if text else 0.0


def score_tree(order: list[Node]) -> list[Node]:
    """Sets received, chars, linked and score of kept elements; returns the blocks that received points, in page order."""
    around: dict[int, Node] = {}
    for x in order:  # the block around each element
        for k in x.kids:
            if not isinstance(k, str):
                around[id(k)] = x if x.tag in _BLOCK or x.parent is None else around[id(x)]
    for x in reversed(order):  # what is inside comes first
        x.chars = sum(len(k.strip()) if isinstance(k, str) else 0 if k.dropped else k.chars for k in x.kids)
        x.linked = x.chars if x.tag == "a" else sum(k.linked for k in x.kids if not isinstance(k, str) and not k.dropped)
        if x.tag in _BLOCK and x.parent is not None:
            own = 0.0 if x.tag in _HEADINGS else own_points(" ".join(" ".join(_direct(x)).split()))
            around[id(x)].received += own + x.received / 2
            x.prose += own
            around[id(x)].prose += x.prose
    found = [x for x in order if x.received > 0 and x.parent is not None]
    for x in found:
        named = x.attrs and any(w in _GOOD for w in _names(x.attrs)[0])
        x.score = (x.received + _TAG_POINTS.get(x.tag, 0) + (15 if named else 0)) * (1 - x.linked / max(x.chars, 1))
    return found


def _menu_like(node: Node, before: Node | None) -> bool:
    """Mostly links, neither sentences nor a list under a heading."""
    listed = node.tag in ("ul", "ol", "dl") and before is not None and before.tag in _HEADINGS
    return _link_heavy(node) and not listed and not (node.tag in ("p", "blockquote", "pre", "li", "td", "dd") and node.sentence)


def _beside(node: Node, least: float | None) -> None:
    """Drops the siblings of a node that aren't kept with it; ``least``: the points that they need."""
    before = None
    for k in node.parent.kids:
        if isinstance(k, str) or k.dropped or k.tag not in _BLOCK:
            continue
        if k is not node and (_menu_like(k, before) or least is not None and k.prose < least and k.tag not in _HEADINGS):
            k.dropped = True
        else:
            before = k


def main_text(page: str | None) -> str:
    """The article's text, blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = _kept(root)
    scored = score_tree(order)
    best = max(scored, key=lambda x: x.score, default=None)  # of equals the first
    if best is None:  # text outside blocks only
        return "\n".join(blocks([next((x for x in order if x.tag in ("article", "main")), root)]))
    top = _landmark(best)
    if top is not None and top.tag in ("article", "main"):
        chosen = {id(top)}
        if top.tag == "article":
            chosen |= {id(x) for x in order if x.tag == "article" and x.prose >= top.prose / 4 and not _link_heavy(x)}
        return "\n".join(blocks([x for x in order if id(x) in chosen and not _inside(x, chosen)]))
    chosen_kids: list[Node | str] = [best]
    x, need = best, best.prose / 5
    while x.parent is not None and x.tag not in ("body", "html") and x is not top:
        _beside(x, None if x is best or top is not None else need)
        x = x.parent
        chosen_kids = x.kids
    return "\n".join(blocks(chosen_kids))


def _inside(node: Node, chosen: set[int]) -> bool:
    """Whether an element around the node is chosen."""
    while (node := node.parent) is not None:
        if id(node) in chosen:
            return True
    return False


def _direct(node: Node) -> list[str]:
    """A block's own text: that of its inline descendants too, but not of blocks inside it."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.kids))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped and x.tag not in _BLOCK:
            stack += reversed(x.kids)
    return out


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the page and one named as the text), the text, and n_chars, its code points."""
    names = keep if keep is not None else [c for c in df.columns if c not in (html_col, text_col, "n_chars")]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html_col}`").alias(*fresh(names, "page")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.num_columns - 1
            texts = [main_text(x.as_py()) for x in b.column(at)]
            fields = [b.schema.field(i) for i in range(at)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=pa.schema([*fields, pa.field(text_col, pa.string()), pa.field("n_chars", pa.int64())]))

    schema = with_fields(df.select(*[F.col(f"`{c}`") for c in names]), f"`{text_col}` string, n_chars long")
    return rows.mapInArrow(run, schema)
