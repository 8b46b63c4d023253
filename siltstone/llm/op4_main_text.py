"""Main text of web pages by composite text density.

Every DOM node that a page shows gets characters per tag, adjusted by its links; the node whose children's densities sum highest is the
content, and the lowest density on its path to the body is what a subtree beside it must reach to belong to it as well. An element whose class or id names it as something else, or a form, is not chosen unless it holds
most of the page's text; within the content it goes only if its links or its density speak against it, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|type)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption col colgroup option optgroup".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("tbody thead tfoot tr td th caption", ("table",)), "tfoot": ("tbody thead tfoot tr td th caption", ("table",)), "thead": ("tbody thead tfoot tr td th caption", ("table",)), "option": ("option", ("select",))}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in SIBLINGS.items()}
DROPPED = frozenset("head nav footer aside button select input dialog menu script style textarea title noscript template iframe noembed noframes xmp svg math object audio video canvas map datalist".split())
CONTAINERS = frozenset("html body form article main section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a whole page: what has one as a child is a frame of the page rather than its content.
FURNITURE = frozenset("nav header footer aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: What an element's own marks make of it: left out whatever it holds, or only if its text doesn't speak for it.
GONE, NAMED = 2, 1
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs masthead header footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations recommend teaser comment comments disqus reply replies respond discussion responses pagination pager toolbar skip".split()
)


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "chars", "tags", "links", "link_chars", "blocks", "density", "total", "sacred")

    def __init__(self, tag: str, parent: "Node | None", cut: int = 0):
        self.tag, self.parent, self.kids, self.cut, self.sacred = tag, parent, [], cut, False


def _named(tag: str, attrs: str) -> int:
    """Whether attributes hide an element or give it another role (GONE), or name it as something other than content (NAMED)."""
    named = 0
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return GONE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GONE
        if name == "role" and value.lower() in ROLES:
            return GONE
        if name == "role" and value.lower() == "form":
            named = NAMED
        if name in ("class", "id") and tag not in HEADINGS and any(t.lower() in NAMES for t in TOKENS.findall(value)):
            named = NAMED
    return named


def parse(html: str) -> Node:
    """The page as a tree; kids are nodes and decoded strings. Unclosed and misnested tags are closed as browsers do."""
    root = Node("html", None)
    top, at, end = root, 0, len(html)
    lower = None
    while at < end:
        lt = html.find("<", at)
        m = TOKEN.match(html, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a bare < is text
            lt = html.find("<", lt + 1)
            m = TOKEN.match(html, lt) if lt >= 0 else None
        text = html[at : lt if lt >= 0 else end]
        if text:
            top.kids.append(unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            node = top
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                top = node.parent
            continue
        if tag == "html" or tag == "body" and any(isinstance(k, Node) and k.tag == "body" for k in root.kids):
            continue
        if tag in CLOSES_P:
            node = top
            while node.parent is not None and node.tag != "p" and node.tag not in ("td", "th", "table", "button"):
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if tag == "body":
            top = root
        if tag in SIBLINGS:
            same, scope = SIBLINGS[tag]
            node = top
            last = None
            while node.parent is not None and node.tag not in scope:
                if node.tag in same:
                    last = node
                node = node.parent
            if last is not None and last.parent is not None:
                top = last.parent
        attrs = m[3]
        cut = GONE if tag in DROPPED else NAMED if tag == "form" else 0
        if cut != GONE and attrs.strip() and tag not in ("body", "main"):
            cut = max(cut, _named(tag, attrs))
        if tag == "header" and not cut:
            node = top
            while node is not None and node.tag not in ("article", "main"):
                node = node.parent
            cut = GONE if node is None else 0
        node = Node(tag, top, cut)
        top.kids.append(node)
        if tag in ("article", "main") and not cut:
            up = top
            while up is not None:
                up.sacred, up = True, up.parent
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == end else re.sub("[A-Z]", lambda x: x[0].lower(), html)
            stop = lower.find("</" + tag, at)
            at = stop if stop >= 0 else end
            if stop >= 0:
                close = html.find(">", stop)
                at = close + 1 if close >= 0 else end
            continue
        top = node
    return root


def _live(node: Node) -> bool:
    """A marked node counts as content after all if an article or main part stands in it."""
    return not node.cut or node.sacred and node.tag not in DROPPED


def _shown(node: Node) -> bool:
    """Live, or left out by its name only."""
    return node.cut != GONE or _live(node)


def _walk(root: Node, enter) -> list[Node]:
    """The nodes that are reached by entering those for which `enter` holds; parents come before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and enter(k)]
    return order


def _measure(root: Node) -> None:
    """Counts characters, tags, links, their characters and blocks with text of every shown node, and gives its density."""
    order = _walk(root, _shown)
    for node in reversed(order):
        node.chars = node.tags = node.links = node.link_chars = node.blocks = node.total = 0
        own = 0
        for k in node.kids:
            if isinstance(k, str):
                own += len("".join(k.split()))
            elif _shown(k):
                node.chars += k.chars
                node.tags += k.tags + 1
                node.links += k.links + (k.tag == "a")
                node.link_chars += k.chars if k.tag == "a" else k.link_chars
                node.blocks += k.blocks
                own += k.chars if k.tag not in BLOCK and not k.blocks else 0
        node.chars += sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        node.blocks += node.tag in BLOCK and own > 0
    share = root.link_chars / max(1, root.chars)
    for node in order:
        c, t = node.chars, max(1, node.tags)
        linked = c if node.tag == "a" else node.link_chars
        base = max(1.1, log(c / max(1, c - linked) * linked + share * c + e))
        x = c / max(1, linked) * t / max(1, node.links)
        node.density = c / t * max(0.0, log(x)) / log(base) if c else 0.0


def _linked(node: Node) -> bool:
    """Whether half of a node's text is links."""
    return node.link_chars * 2 >= node.chars


def _keep_largest(root: Node) -> None:
    """Takes the mark from what its name would leave out although it holds most of the page's text.

    It must have paragraphs, and no article or main part beside it may have them (so comments may outgrow their article),
    or there must be no other text.
    """
    large, node = [], root
    while node is not None:  # what holds most of the text lies on one path
        node = next((k for k in node.kids if isinstance(k, Node) and _shown(k) and k.chars * 2 > root.chars), None)
        if node is not None and not _live(node) and not _linked(node):
            large.append(node)
    if not large:
        return
    live = _walk(root, _live)
    text = any(isinstance(k, str) and k.strip() for n in live for k in n.kids)
    above = set()
    for node in large:
        while node is not None:
            above.add(id(node))
            node = node.parent
    rival = any(n.tag in ("article", "main") and n.blocks >= 2 and id(n) not in above for n in live)
    for node in large:
        if not text or node.blocks >= 2 and not rival:
            node.cut = 0


def _scope(best: Node) -> Node | None:
    """The part in which a name alone leaves nothing out: the article around the chosen subtree, or that itself unless it frames a page."""
    node = best
    while node is not None and node.tag != "article":
        node = node.parent
    if node is not None:
        return node
    framed = best.tag in ("html", "body", "form") or any(isinstance(k, Node) and k.tag in FURNITURE for k in best.kids)
    return None if framed else best


def _belongs(node: Node, low: float) -> bool:
    """Whether the text of a named node within the content speaks for it: not links, and a section, a paragraph or dense enough."""
    return node.cut == NAMED and node.tag != "form" and not (node.chars and _linked(node)) and (node.tag in ("section", "p") or node.density >= low)


def _menu(node: Node) -> bool:
    """A part that is little but links."""
    return node.tag in BLOCK and node.links >= 3 and node.link_chars >= 0.8 * node.chars


def main_text(html: str | None) -> str:
    """The text of the content subtree; blocks joined by one space, white space runs made one space."""
    if not html:
        return ""
    root = parse(html)
    _measure(root)
    _keep_largest(root)
    order = _walk(root, _live)
    for node in order:
        node.total = sum(k.density for k in node.kids if isinstance(k, Node) and _live(k))
    best = max(order, key=lambda n: (n.total, n.tag in ("article", "main")))  # the first in page order, if still tied
    if best.total <= 0:
        best = root
    while best.parent is not None and best.tag not in CONTAINERS:  # a paragraph's bold start may outweigh its siblings
        best = best.parent
    path, node = set(), best
    low = best.density
    while node is not None:
        path.add(id(node))
        low = min(low, node.density) if node.chars and node.tag != "html" else low
        node = node.parent
    scope = _scope(best)
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    todo: list = [(root, False, scope is root)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        if isinstance(item, str):
            line.append(item)
            continue
        node, inside, scoped = item
        inside, scoped = inside or node is best, scoped or node is scope
        if node.tag == "br":
            line.append(" ")
            continue
        if not inside and id(node) not in path and node.density < low and node.tag not in HEADINGS:
            continue
        inside = inside or id(node) not in path  # a subtree that reaches the threshold belongs as a whole
        if node is not root and _menu(node) and id(node) not in path:
            continue
        block = node.tag in BLOCK
        if block:
            flush()
            todo.append(None)
        for k in reversed(node.kids):
            if isinstance(k, str):
                todo.append(k)
            elif _live(k) or (scoped or inside and k.tag == "p") and _belongs(k, low):
                todo.append((k, inside, scoped))
            elif k.tag in BLOCK or k.tag in RAW:
                todo.append(None) if k.tag in BLOCK else None
    flush()
    return " ".join(out)


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds to each row the main text of a page, and its code points as n_chars; the html column is dropped.

    Null and empty pages, and pages without content, give an empty text. Broken and cut-off markup is read as browsers
    read it. Pages are handled one by one, so long ones cost memory in proportion and repeated rows give repeated results.
    Columns named like an output are replaced.
    """
    keep = [f for f in df.schema.fields if f.name not in (html, out, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, big.num_columns - 1):
                texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
                cols = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in keep), out, "n_chars"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` string", "n_chars long"])
    return lean(df).select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{html}`").cast("string").alias("__html")).mapInArrow(run, fields)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
