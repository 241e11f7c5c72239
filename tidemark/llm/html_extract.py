"""Operator 6: main text of web pages by site style trees.

The DOMs of a host's pages are merged into one style tree: a node is a path
of element labels (tag and class), and counts, over the pages that have it,
how often it holds which children (presentation) and which text (content).
A node's importance is the entropy of these two distributions, 1 where every
page differs and 0 where all pages say the same. Pages of one host with the
same content count once, so that copies lower no importance. Branches whose
importance is low over enough pages are site furniture and are removed from
each page, the least important first, but never ``html``, ``body``, what leads
to an article, or a branch that holds all the text that is left of a page.

Landmarks speak before statistics, for a menu may well differ on every page:
elements that are furniture by tag, role or class have importance 0. A class,
id or role counts as a whole (``has-sidebar`` says nothing) or as one of a few
compounds (``comment-list``, ``site-footer``); within a line only marks of
adverts and sharing count. Where a page marks its article (``article``,
``main``) that branch has importance 1 and is the main text, whatever its
paragraphs share with others; articles within marked elements (comments,
teasers) are it only where there is no other. Marks within an article remove
their elements, unless nothing would be left of it.

A page is parsed within its row's task, in one pass over its tags; as in
browsers, elements more than ``DEEPEST`` deep do not nest further. Paths are
64-bit hashes. A page's nodes are one row, made distinct with map-side combine;
the tree is an aggregation of their (host, path, hash), also with map-side
combine; it sends back, per host, the paths to remove: a staged table that is
broadcast when it is counted to be small, and else joins with its skewed hosts
split.

Defined results: null html gives the empty text; white space is Unicode white
space; an unclosed comment, script or tag runs to the end of the page; pages
without a host (null or odd url) only follow landmarks; hosts with fewer than
``MIN_PAGES`` distinct pages at a node keep it; repeated rows are treated alike.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Collection, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.operators.joins import broadcast_if_small
from tidemark.session import stage_table

#: Distinct pages a node must have before it can be judged; importance under which it
#: goes; weight of presentation against content.
MIN_PAGES, LOW, PRESENTATION = 5, 0.2, 0.1
#: Elements around a block, at most.
DEEPEST = 512

#: Elements that never hold main text, and those that mark it.
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg canvas object menu dialog".split())
ARTICLE = frozenset(("article", "main"))
#: Classes, ids or roles that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer comment comments reply replies disqus share sharing social related newsletter "
    "subscribe widget pager pagination contentinfo complementary search dialog hidden".split())
#: Marks that count on elements within a line.
INLINE_MARKS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo share sharing social hidden".split())
#: Second parts of compounds that begin with a mark, and first parts of those that end with one.
PARTS = frozenset("area bar block box container list panel section slot unit wrap wrapper".split())
PLACES = frozenset("article bottom entry global left main page post primary right secondary site top".split())
#: Further marks that count only outside an article.
OUTER = frozenset(("header", "masthead"))
#: Elements inside a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that a start tag closes, and those that the search does not leave.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body table td th div section article main aside nav header footer ul ol li blockquote form button".split())

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)


class Block(NamedTuple):
    """A block of text, the labels of the elements around it, how many of them
    lead to its article (0 without one), and whether that article stands in a
    marked element."""
    path: tuple[str, ...]
    text: str
    article: int
    doubtful: bool


class _Element(NamedTuple):
    tag: str
    label: str
    furniture: bool
    outer: bool  # is or is in a marked element outside all articles
    inner: bool  # is or is in a marked element of an article
    article: bool
    nested: bool  # is or is in an ``article``


def _marked(word: str, inside: bool) -> bool:
    """Whether a class, id or role marks furniture."""
    if word in MARKS or word in OUTER and not inside:
        return True
    first, _, second = word.replace("_", "-").partition("-")
    return first in MARKS and (second in PARTS or second in MARKS) or first in PLACES and second in MARKS


def _element(tag: str, attributes: str, parent: _Element | None) -> _Element:
    inside, nested = bool(parent and parent.article), bool(parent and parent.nested)
    furniture = bool(parent and parent.furniture) or tag in FURNITURE or (tag in OUTER and not inside)
    outer, inner = bool(parent and parent.outer), bool(parent and parent.inner)
    label = tag
    if attributes and not furniture:
        words: set[str] = set()
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "class" and value:
                label += "." + ".".join(value.split())
            if name in ("class", "id", "role"):
                words.update(value.split())
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                furniture = furniture or tag not in ("html", "body")
        if tag not in ("html", "body") and (nested or tag not in ARTICLE) and any(
                w in INLINE_MARKS if tag in INLINE else _marked(w, inside) for w in words):
            outer, inner = outer or not inside, inner or inside
    return _Element(tag, label, furniture, outer, inner, inside or tag in ARTICLE, nested or tag == "article")


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without furniture."""
    stack: list[_Element] = []
    out: list[tuple[tuple[str, ...], int, bool, list[tuple[str, bool]]]] = []
    line: list[tuple[str, bool]] = []  # pieces of text, and whether an article's mark removes them

    def close_block() -> None:
        if line:
            around = [e for e in stack if e.tag not in INLINE]
            # the outermost <article>, or else the innermost <main>
            article = max((i for i, e in enumerate(around, 1) if e.tag in ARTICLE and not (i > 1 and around[i - 2].nested)), default=0)
            doubtful = any(e.outer for e in around)
            if article or not (doubtful or any(e.outer for e in stack)):
                out.append((tuple(e.label for e in around), article, doubtful, line.copy()))
            line.clear()

    def pop_to(at: int) -> None:
        if any(e.tag not in INLINE for e in stack[at:]):
            close_block()
        del stack[at:]

    at, size = 0, len(page)
    while at < size:
        mark = _OPEN.search(page, at)
        end = mark.start() if mark else size
        if end > at and not (stack and stack[-1].furniture):
            top = stack[-1] if stack else None
            if not (top and top.outer and top.tag in INLINE and not top.article):
                line.append((entities.unescape(page[at:end]), bool(top and top.inner)))
        if not mark:
            break
        at = end
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = size if stop < 0 else stop + 3
            continue
        found = _TAG.match(page, at)
        if not found:
            stop = page.find(">", at) if page[at + 1] in "!?/" else -1
            at = size if stop < 0 else stop + 1
            continue
        at, tag = found.end(), found[1].lower()
        if page[found.start() + 1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
            continue
        if tag == "br":
            line.append(("\n", False))
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in SCOPE:
                    break
            if tag in CLOSES:
                ends, until = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in until:
                        break
                    if stack[i].tag in ends:
                        pop_to(i)
            close_block()
        if tag in VOID or found[2].endswith("/") and tag not in RAW and tag in INLINE:
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = stop.start() if stop else size
            stop = page.find(">", at)
            at = size if stop < 0 else stop + 1
            continue
        if len(stack) < DEEPEST:
            stack.append(_element(tag, found[2], stack[-1] if stack else None))
    close_block()
    say = lambda pieces: " ".join("".join(pieces).split())
    kept = [Block(path, say(t for t, removed in pieces if not removed), article, doubtful) for path, article, doubtful, pieces in out]
    if not any(b.text for b in kept if b.article):  # marks never empty an article
        kept = [Block(path, say(t for t, _ in pieces), article, doubtful) if article else b
                for b, (path, article, doubtful, pieces) in zip(kept, out, strict=True)]
    sure = any(b.text and b.article and not b.doubtful for b in kept)
    return [b for b in kept if b.text and not (sure and b.doubtful)]


def main_text(page: str, low: Collection[int]) -> str:
    """The main text of a page, given the keys of its host's low paths, the
    lowest first."""
    found = blocks(page)
    if any(b.article for b in found):
        found = [b for b in found if b.article]
    if low:
        found = _without(found, low)
    return " ".join(b.text for b in found)


class _Paths:
    """Numbers of the paths of a page, with 64-bit keys that agree between pages."""

    def __init__(self):
        self.keys: list[int] = []
        self.number: dict[tuple[int, str], int] = {}

    def walk(self, path: tuple[str, ...]) -> list[int]:
        """The numbers of a path and its beginnings."""
        at, out = -1, []
        for label in path:
            child = self.number.get((at, label))
            if child is None:
                child = self.number[at, label] = len(self.keys)
                self.keys.append(_hash(self.keys[at] if at >= 0 else 0, label))
            at = child
            out.append(at)
        return out


def _hash(seed: int, text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text, seed & ((1 << 64) - 1)) - (1 << 63)


def path_key(path: str) -> int:
    """The key of a path whose labels are joined by slashes."""
    paths = _Paths()
    return paths.keys[paths.walk(tuple(path.split("/")))[-1]]


def _without(found: list[Block], low: Collection[int]) -> list[Block]:
    """The blocks that are left when the low branches go, one by one."""
    paths, wanted, branches = _Paths(), set(low), {}
    for at, block in enumerate(found):
        for i, n in enumerate(paths.walk(block.path)):
            if paths.keys[n] in wanted and i >= block.article and block.path[i].split(".")[0] not in ("html", "body"):
                branches.setdefault(paths.keys[n], set()).add(at)
    left = set(range(len(found)))
    for key in low:
        if not left <= branches.get(key, set()):
            left -= branches.get(key, set())
    return [b for at, b in enumerate(found) if at in left]


def _nodes(page: str) -> Iterator[tuple[int, int, int]]:
    """(path, presentation, content) of a page's nodes without furniture;
    running hashes, so that a block costs one step for each element around it."""
    paths, content, children = _Paths(), [], []
    for block in blocks(page):
        text = _hash(0, block.text)
        walked = paths.walk(block.path)
        grow = len(paths.keys) - len(content)
        content += [0] * grow
        children += [0] * grow
        for n, child in zip(walked, [*walked[1:], -1], strict=True):
            content[n] = hash((content[n], text))
            if child >= 0:
                children[n] = hash((children[n], paths.keys[child]))
    yield from zip(paths.keys, children, content, strict=True)


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            pages = [list(_nodes(page)) for page in part.column("html").to_pylist()]
            columns = list(zip(*(node for nodes in pages for node in nodes), strict=True)) or [[]] * 3
            nodes = pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3, strict=True)], ["path", "presentation", "content"])
            ends = pa.array([0, *accumulate(map(len, pages))], pa.int32())
            yield pa.record_batch([part.column("host"), pa.ListArray.from_arrays(ends, nodes)], ["host", "nodes"])


def _entropy(rows: DataFrame, name: str) -> DataFrame:
    """(host, path, pages, entropy of ``name`` relative to the most possible)."""
    counts = rows.groupBy("host", "path", name).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nln"))
    spread = (F.log("pages") - F.col("nln") / F.col("pages")) / F.log("pages")
    return total.select("host", "path", "pages", F.when(F.col("pages") > 1, spread).otherwise(1.0).alias(name))


def host_of(url: Column) -> Column:
    """The host of a url, lower case; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def style_tree(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) as (host, path, pages, importance), over the
    distinct contents of a host's pages."""
    once = stage_table(pages.where("host is not null").select("host", "html")
                       .mapInArrow(_tree_rows, "host string, nodes array<struct<path: long, presentation: long, content: long>>")
                       .distinct(), "nodes")
    rows = once.select("host", F.inline("nodes"))
    both = _entropy(rows, "content").join(_entropy(rows, "presentation").drop("pages"), ["host", "path"])
    importance = PRESENTATION * F.col("presentation") + (1 - PRESENTATION) * F.col("content")
    return both.select("host", "path", "pages", importance.alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            texts = [main_text(page, low or ()) for page, low in
                     zip(part.column("html").to_pylist(), part.column("low").to_pylist(), strict=True)]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text: one row each."""
    rows = pages.select("page_id", "url", text_of("html").alias("html"), host_of(F.col("url")).alias("host"))
    low = (style_tree(rows).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW))
           .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("importance", "path")))["path"].alias("low")))
    return rows.join(broadcast_if_small(stage_table(low, "low")), "host", "left").select("page_id", "url", "html", "low").mapInArrow(
        _extract, "page_id long, url string, text string")
