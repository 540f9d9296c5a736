"""Main text of HTML pages by composite text density.

A page is parsed into a tree (implied ends of p, li and the like; raw text of script and style
skipped). Elements that are never part of an article go first: by tag (nav, aside, form, ...), by
role, and by the words of class and id (ad, cookie, comments, sidebar, ...). On what is left each
node gets a density, its characters per tag, adjusted by how much of it is link text; the sum of
its children's densities says how much content it gathers. Where the greatest sum stands in an
article or main element, that element is taken whole. Elsewhere an article may be split over
several containers: of every block below the body that is at least as dense as the sparsest node on
the path from the greatest sum to the body, the block with the greatest sum in it and its own text
are taken, in page order, and the headings right before one, and the title, with it.

A null or empty page, and one without text, gives an empty text. Rows keep their number; further
columns of the input are not read. A page is worked on alone, in linear time, without recursion.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import table

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

# How HTML treats elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
CELL = set("br td th".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "option", "legend"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = set("ul ol dl table tbody thead tfoot select menu".split())
# Elements and words of class, id and role that mark what surrounds an article.
NEVER = set("head nav aside footer form script style noscript template iframe svg canvas object embed button select option textarea input label dialog menu audio video map".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar "
    "comment comments commentlist disqus respond replies reply discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login search pagination pager widget widgets skip hidden".split()
)
# On an article itself only these count.
NOT_ARTICLE = set("ad ads advert advertisement sponsored promo comment comments reply related recommended".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


class Node:
    __slots__ = ("density", "items", "kept", "links", "link_chars", "parent", "tag", "tags", "chars", "top", "total", "out")

    def __init__(self, tag: str, parent: Node | None, out: bool = False):
        self.tag, self.parent, self.items, self.out = tag, parent, [], out
        self.chars = self.tags = self.links = self.link_chars = 0
        self.density = self.total = 0.0
        self.top, self.kept = self, False


def _in_article(node: Node | None) -> bool:
    while node and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _surrounds(tag: str, attrs: str, inside: Node) -> bool:
    if tag in NEVER:
        return True
    if tag == "header" and not _in_article(inside):  # a heading group of the article itself stays
        return True
    if attrs and tag not in ("html", "body", "h1"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True
            if name == "role" and value.strip() in ROLES:
                return True
            if name in ("class", "id"):
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()))
                found = words & (NOT_ARTICLE if tag in ("article", "main") else MARKS)
                if found and not (found == {"header"} and _in_article(inside)):
                    return True
    return False


def parse(html: str) -> Node:
    """The tree, with `out` set on elements that surround an article; text stands in `items` between nodes."""
    root = node = Node("html", None)
    at, low, held = 0, None, 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            node.items.append(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = node
            while up.parent and up.tag != tag and not (tag not in BLOCK and up.tag in BLOCK):
                up = up.parent
            if up.tag == tag and up.parent:
                node = up.parent
            continue
        if tag in ("html", "body") and node is root:
            continue
        if tag in CLOSES_P:
            up = node
            while up and up.tag != "p" and up.tag not in BLOCK and up.tag not in ("td", "th"):
                up = up.parent
            if up and up.tag == "p":
                node = up.parent
        if tag in ENDS:
            up = node
            while up and up.tag not in ENDS[tag] and up.tag not in SCOPE - {tag}:
                up = up.parent
            while up and up.tag in ENDS[tag]:
                node = up.parent
                up = node if node.tag in ENDS[tag] else None
        new = Node(tag, node, _surrounds(tag, m[3], node))
        node.items.append(new)
        if tag in RAW:
            low = low or html.lower()
            end = low.find("</" + tag, at)
            end = len(html) if end < 0 else end
            at = html.find(">", end) + 1 or len(html)
            new.out = True
        elif tag not in VOID and not m[3].endswith("/"):
            node = new
    if at < len(html):
        node.items.append(html[at:])
    return root


def _ordered(root: Node) -> list[Node]:
    """Nodes that are not out, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(x for x in reversed(n.items) if isinstance(x, Node) and not x.out)
    return out


def main_nodes(root: Node) -> list[Node]:
    """The nodes whose texts are the article, in page order."""
    nodes = _ordered(root)
    for n in reversed(nodes):
        n.chars += sum(len("".join(x.split())) for x in n.items if isinstance(x, str))
        if n.tag == "a":
            n.link_chars, n.links = n.chars, n.links + 1
        if p := n.parent:
            p.chars += n.chars
            p.tags += n.tags + (n.tag not in ("br", "wbr"))
            p.link_chars += n.link_chars
            p.links += n.links
    share = root.link_chars / max(1, root.chars)
    for n in nodes:
        if n.chars:
            base = math.log(max(1.0, n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars) + math.e)
            adjust = math.log(max(1.0 + 1e-9, n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.links))) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else 1.0
            n.density = n.chars / max(1, n.tags) * max(adjust, 0.0)
            if n.parent:
                n.parent.total += n.density
    best = max(nodes, key=lambda n: n.total)
    up = best
    while up.parent and up.tag not in ("article", "main", "body"):
        up = up.parent
    if up.tag in ("article", "main"):
        return [up]
    if best is up:  # the body itself
        return [best]
    threshold, n = best.density, best
    while n is not up:
        n = n.parent
        threshold = min(threshold, n.density)
    for n in reversed(nodes):  # the block of greatest sum in each subtree; of equals the widest
        if n.parent and n.top.tag in BLOCK and n.top.total > n.parent.top.total:
            n.parent.top = n.top
    return _kept(up, threshold)


def _kept(body: Node, threshold: float) -> list[Node]:
    out, heads, title, stack = [], [], None, list(reversed(_parts(body)))
    while stack:
        n = stack.pop()
        if not n.kept and n.chars and n.tag in BLOCK and n.density >= threshold:
            n.top.kept = True
        if n.kept:
            out += ([title] if title and not out and title not in heads else []) + heads + [n]
            heads = []
        elif n.tag in HEADINGS:
            heads.append(n)
            title = n if n.tag == "h1" else title
        else:
            heads = heads if all(x.tag in BLOCK for x in _parts(n)) and not any(isinstance(x, str) and x.strip() for x in n.items) else []
            stack.extend(reversed(_pieces(n) if n.tag in BLOCK and n.chars and n.density >= threshold else _parts(n)))
    return out


def _pieces(node: Node) -> list[Node]:
    """The blocks in a dense one, and what text of its own stands between them, as blocks that are kept."""
    out: list[Node] = []
    for x in node.items:
        if isinstance(x, Node) and (x.out or x.tag in BLOCK):
            out += [] if x.out else [x]
            continue
        if not out or out[-1].parent:
            out.append(Node("div", None))
        out[-1].items.append(x)
        out[-1].kept |= bool(x.strip() if isinstance(x, str) else x.chars)
    return out


def _parts(node: Node) -> list[Node]:
    return [x for x in node.items if isinstance(x, Node) and not x.out]


def text_of(node: Node) -> str:
    """Blocks in order, one a line."""
    blocks, line = [], []

    def end() -> None:
        if s := " ".join(unescape("".join(line)).split()):
            blocks.append(s)
        line.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.out:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            elif x.tag in CELL:
                line.append(" ")
            stack.extend(reversed(x.items))
    end()
    return "\n".join(blocks)


def extract(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(filter(None, map(text_of, main_nodes(parse(html)))))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(K.tidy(_run), "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
