"""Operator 6: main text of pages by a site style tree.

The pages of a host are merged: elements with the same path of presentation (tag, class, id) are one node of the host's style
tree. A node's content importance is one minus the mean entropy of the blocks of its branch over the pages that have it (a block on
all of them has entropy 1, one on a single page 0); its presentation importance is the entropy of the layouts of its branch (0 if all pages have
the same). So both are inherited from what is below a node, and its importance is their mean. A node that ``LEAST_PAGES`` different pages
have and whose importance is under ``LEAST_IMPORTANCE`` is boilerplate: its branch is removed from each page, unless it holds the page's main
element. Below a main element only what nearly all pages share goes (``LEAST_INSIDE``), and the tree never takes the whole text of a page.

A host with few pages teaches little, so what HTML itself marks as not being the article supports the tree: elements and roles (menus, footers, sidebars,
forms, scripts, hidden parts), a header outside the article, and class or id words of elements that are outside the main element and don't hold it. Inside
it, words count only as a whole class name of a container, such as <div class="comments">; ids, headings and paragraphs are never judged by words there.

Pass one counts (host, node, block) over all pages, pass two extracts; both parse a page once. What a page needs is the list of its host's
removed branches. Hosts with over 1/``HOT_HOSTS`` of all pages, of which there are ``HOT_HOSTS`` at most, get theirs by broadcast if the list has
``MOST_NODES`` entries or fewer, so their pages, however many, stay where they are; only pages of other hosts are joined by host.

Defined cases: a null or empty html gives the empty text; an unclosed element ends with the page; a null url, or one without a host, has no
style tree; equal pages of a host count once; null and repeated ids are kept as they are; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Different pages that must have a node before its importance counts, and the importance it needs to stay, outside and inside a main element.
LEAST_PAGES, LEAST_IMPORTANCE, LEAST_INSIDE = 8, 0.4, 0.1
#: Hosts, and nodes of each, that are broadcast at most: 20 MB.
HOT_HOSTS, MOST_NODES = 10_000, 256

# HTML's elements without content, without text, and with a block of their own.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
_BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - {"button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "body", "html"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = set("ul ol dl table select article section div body html main nav aside footer header form".split())
_NEVER = set("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea input dialog menu noembed noframes xmp title".split())
_NEVER_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_NEVER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended comment comments commentlist respond reply replies disqus widget widgets toolbar pagination pager skip print hidden".split()
)

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attribute = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


#: Elements that hold others and are judged by class name inside a main element.
_CONTAINERS = set("div section ul ol aside article figure table".split())
_NEVER_INSIDE = _NEVER_WORDS - set("side skip print hidden notice notices notification banner masthead footer topbar widget widgets respond reply toolbar menu login".split())


#: Elements nested deeper count as part of the one at this depth, as in browsers.
DEEPEST = 512


class Element:
    __slots__ = ("above", "children", "depth", "gone", "inside", "layout", "marked", "never", "path", "role_main", "style", "tag", "token")

    def __init__(self, tag: str, style: str, above: Element | None, never: bool = False, marked: bool = False, token: bool = False, role_main: bool = False) -> None:
        self.tag, self.style, self.above = tag, style, above
        self.depth = above.depth + 1 if above is not None else 0
        #: Hash of the styles from the root to this element.
        self.path = _hash(f"{above.path} {style}") if 0 < self.depth <= DEEPEST else above.path if above is not None else 0
        #: What HTML says: never text; marked by class or id words; by a whole class name; a main element.
        self.never, self.marked, self.token, self.role_main = never, marked, token, role_main
        #: Found when the page is known: whether it is within a main element, whether it is removed, and the hash of its branch's styles.
        self.inside = self.gone = False
        self.layout = 0
        self.children: list[Element] = []


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _settle(elements: list[Element]) -> None:
    """Which elements are within a main element, which are removed, and their layouts. Elements come before what they hold."""
    for e in reversed(elements):
        e.layout = _hash(f"{e.style}({' '.join([str(c.layout or c.style) for c in e.children])})")
    under: dict[int, bool] = {}  # by word marks, of itself or above
    never: dict[int, bool] = {}
    for e in elements:
        above = e.above
        never[id(e)] = e.never or never.get(id(above), False)
        under[id(e)] = e.marked or under.get(id(above), False)
    mains = [e for e in elements if e.role_main and not never[id(e)]]
    # A main element within something marked counts only if there is no other, and then the marks above it don't.
    free = [e for e in mains if not under[id(e)]] or [e for e in mains if e.tag != "article"] or [e for e in mains if not e.marked]
    roots, holds = {id(e) for e in free}, set()
    for e in free:
        up = e.above
        while up is not None and id(up) not in holds:
            holds.add(id(up))
            up = up.above
    for e in elements:
        above = e.above
        e.inside = above.inside or id(e) in roots
        within = above.inside
        words = e.token if within else e.marked and id(e) not in holds and id(e) not in roots
        e.gone = above.gone or e.never or words or (e.tag == "header" and not within and id(e) not in holds)


def parse(page: str | None) -> tuple[list[tuple[Element, str]], list[Element]]:
    """The blocks of a page in order, each with the element that holds it, and all elements."""
    root = Element("", "", None)
    here, elements, blocks, text, opened = root, [], [], [], Counter()
    holder = root
    page = page or ""

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            if block:
                blocks.append((holder, block))
            text.clear()

    def add(raw: str) -> None:
        nonlocal holder
        if raw:
            if not text:
                holder = here
            text.append(html_lib.unescape(raw))

    def leave(tag: str) -> None:
        """Close the innermost element of the tag, and what is open in it."""
        nonlocal here
        while True:
            closed, here = here, here.above
            opened[closed.tag] -= 1
            if closed.tag == tag:
                return

    at = 0
    while True:
        found = _token.search(page, at)
        add(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if not opened[tag]:
                continue
            if tag in _BLOCKS:
                flush()
            leave(tag)
            continue
        if tag in _BLOCKS:
            flush()
        if tag == "br":
            add(" ")
        if tag in _CLOSES_P or tag in _CLOSED_BY:
            ends = _CLOSED_BY.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
            up = here if any(opened[t] for t in ends) else root
            while up is not root and up.tag not in ends and up.tag not in _SCOPES:
                up = up.above
            if up is not root and up.tag in ends:
                leave(up.tag)
                if tag == "tr" and here.tag in ends:
                    leave(here.tag)
        names = {k.lower(): html_lib.unescape(a or b or c) for k, a, b, c in _attribute.findall(found[3])} if found[3] else {}
        style = tag + "".join(f".{c}" for c in sorted(names.get("class", "").split())) + (f"#{re.sub('[0-9]+', '0', names['id'])}" if names.get("id") else "")
        classes = names.get("class", "").lower().split()
        words = {w.lower() for w in _name_words(f"{names.get('class', '')} {names.get('id', '')}")}
        role = names.get("role", "").lower()
        hides = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
        marked = tag not in ("body", "html", "article", "main") and not words.isdisjoint(_NEVER_WORDS) or (tag == "article" and not words.isdisjoint(("comment", "comments", "reply", "related")))
        token = marked and tag in _CONTAINERS and not _NEVER_INSIDE.isdisjoint(classes)
        element = Element(tag, style, here, tag in _NEVER or hides or role in _NEVER_ROLES, marked, token, tag in ("article", "main") or role == "main")
        here.children.append(element)
        if tag in _VOID:
            continue
        elements.append(element)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        here = element
        opened[tag] += 1
    flush()
    _settle(elements)
    return blocks, elements


def main_paths(elements: list[Element]) -> set[int]:
    """The paths of main elements and of what is above them; of html and body in any case."""
    out = {0}
    for e in elements:
        if (e.inside and not e.above.inside) or e.tag in ("html", "body"):
            while e is not None and e.path not in out:
                out.add(e.path)
                e = e.above
    return out


#: Kinds of features: a block of the branch, a layout of the branch, the node itself outside and inside a main element (with the node above it).
BLOCK, LAYOUT, OUTSIDE, INSIDE = range(4)


def style_features(page: str | None) -> set[tuple[int, int, int]]:
    """(node, kind, feature) of a page, for what isn't removed anyway and isn't a main element or above one."""
    blocks, elements = parse(page)
    safe = main_paths(elements)
    out = set()
    for holder, block in blocks:
        h = _hash(block)
        while holder.depth > DEEPEST:
            holder = holder.above
        while holder.path not in safe:
            out.add((holder.path, BLOCK, h))
            holder = holder.above
    for e in elements:
        if e.path not in safe and e.depth <= DEEPEST:
            out.add((e.path, LAYOUT, e.layout))
            out.add((e.path, INSIDE if e.inside else OUTSIDE, e.above.path))
    return out


def main_text(page: str | None, unimportant: frozenset[int] | set[int] = frozenset(), marks: bool = True) -> str:
    """The blocks that stay, joined by one line end. Without ``marks`` only the style tree decides, besides what is never text."""
    blocks, elements = parse(page)
    if marks:
        has_main = any(e.inside for e in elements)
        blocks = [(e, block) for e, block in blocks if not e.gone and (e.inside or not has_main)]
    if unimportant:
        safe = main_paths(elements) if marks else {0}
        lost: set[int] = set()
        for e in elements:
            if id(e.above) in lost or (e.path not in safe and e.path in unimportant):
                lost.add(id(e))
        blocks = [(e, block) for e, block in blocks if id(e) not in lost] or blocks
    return "\n".join(block for _, block in blocks)


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def importance(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` to each node of each host's style tree: host, node, above, inside, pages, content, layout, importance."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for host, page in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    out += [(host, _hash(page or ""), *f) for f in style_features(page)]
                columns = zip(*out, strict=True) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names=["host", "page", "node", "kind", "feature"])

    rows = pages.select("host", "html").where("host <> ''").mapInArrow(features, "host string, page long, node long, kind int, feature long").distinct()
    counted = rows.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    of = lambda value, *kinds: F.sum(F.when(F.col("kind").isin(*kinds), value))
    entropy = F.col("c") * F.log("c")
    per_node = counted.groupBy("host", "node").agg(
        of(F.col("c"), OUTSIDE, INSIDE).alias("pages"),
        F.max(F.when(F.col("kind").isin(OUTSIDE, INSIDE), F.col("feature"))).alias("above"),
        (F.max("kind") == INSIDE).alias("inside"),
        of(F.col("c"), BLOCK).alias("blocks"),
        of(entropy, BLOCK).alias("block_sum"),
        of(F.col("c"), LAYOUT).alias("layouts"),
        of(entropy, LAYOUT).alias("layout_sum"),
    )
    # Mean of log(c) / log(pages) over blocks; entropy of layouts, log n - sum(c log c) / n, over log n.
    several = per_node.where("pages > 1")
    content = F.lit(1.0) - F.coalesce(F.col("block_sum") / F.col("blocks"), F.lit(0.0)) / F.log("pages")
    layout = F.lit(1.0) - F.col("layout_sum") / F.col("layouts") / F.log("layouts")
    found = several.where("blocks IS NOT NULL").select("host", "node", "above", "inside", "pages", content.alias("content"), layout.alias("layout"))
    return found.withColumn("importance", (F.col("content") + F.col("layout")) / 2)


def unimportant_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE, inside: float = LEAST_INSIDE) -> DataFrame:
    """(host, node, above) of each host's style tree whose importance is too low."""
    return importance(pages).where((F.col("pages") >= least_pages) & (F.col("importance") < F.when(F.col("inside"), inside).otherwise(least))).select("host", "node", "above")


def extract_pages(pages: DataFrame, marks: bool = True) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    low = materialize(unimportant_nodes(rows), "nodes")
    # A branch within a removed branch needn't be named.
    top = low.df.join(low.df.select("host", F.col("node").alias("above")), ["host", "above"], "left_anti")
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    per_host = materialize(top.groupBy("host").agg(F.collect_list("node").alias("nodes")).join(sizes, "host"), "hosts").df
    low.drop()
    is_hot = (F.col("size") * HOT_HOSTS > rows.count()) & (F.size("nodes") <= MOST_NODES)
    hot = F.broadcast(per_host.where(is_hot).select("host", "nodes"))
    with_nodes = rows.join(hot, "host").unionByName(rows.join(F.broadcast(hot.select("host")), "host", "left_anti").join(per_host.where(~is_hot).select("host", "nodes"), "host", "left"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py(), frozenset(n.as_py() or ()), marks) for h, n in zip(batch.column("html"), batch.column("nodes"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return with_nodes.select("page_id", "url", "html", "nodes").mapInArrow(texts, "page_id long, url string, text string")
