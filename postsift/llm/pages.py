"""Main text of web pages by wrappers inferred for each host.

A page is read as a tree of block elements; every node's children are a sequence of
labelled tokens and text slots. For each host all pages are aligned, one after the other,
into one wrapper, a regular expression without unions: children that match are merged,
equal neighbours become a repeated group, children that only one side has become optional,
and texts become text slots. Pages of a host meet as distinct folded shapes, most of which
are equal, and are merged in rounds of bounded groups, so a host of any size is a few short
rows by the time it is aligned.

The wrapper names the slot of every text. A slot outside the article whose text never
changes over ``TEMPLATE_PAGES`` or more different pages of the host belongs to the template.
The main text is that of the article element (or main, or the body where there is none)
without template slots and without elements that are navigation, headers, footers,
sidebars, notices, adverts, forms, scripts or comments, by name or by class, id or role.
A class, id or role counts as a whole, but for a number at its end: one of ``SKIPPED_WORDS``
or of the compounds in ``SKIPPED_NAMES``. It never takes out html, body or a heading, and
where nothing would be left of a page, names are not looked at.
Headings inside an article's own header stay.

Character references are decoded once, white space in a block becomes one space, blocks
are joined by line feeds in page order. Null or empty html gives an empty text. Pages
without a host form one group. Malformed pages are read as far as they go: an end tag
without a start is ignored, open elements end with the page. Elements nested deeper than
``MAX_DEPTH`` are kept as siblings at that depth, with all their texts.
"""

from __future__ import annotations

import json
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import packed
from postsift.session import broadcast_if_small, cut_lineage, ship_package

TEMPLATE_PAGES = 8
MERGE_GROUP = 64
LONGEST_PERIOD = 3
MAX_DEPTH = 100

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small "
                   "span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
SKIPPED = frozenset("head nav footer aside form button select option input label dialog menu object "
                    "canvas audio video header".split()) | RAW
SKIPPED_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising banner "
    "promo promotion sponsor sponsored cookie cookies consent notice notices alert newsletter subscribe signup "
    "share sharing social related recommended comment comments disqus replies breadcrumb breadcrumbs popup modal "
    "overlay login search form contentinfo complementary masthead toolbar".split())
SKIPPED_NAMES = frozenset(
    "site-header site-footer site-nav site-navigation page-header page-footer main-nav main-navigation main-menu "
    "nav-bar nav-menu top-bar ad-slot ad-banner ad-container ad-wrapper ad-unit cookie-notice cookie-banner "
    "cookie-consent cookie-bar share-buttons share-bar share-links social-links social-share social-media "
    "social-buttons related-posts related-articles related-links related-content recommended-posts "
    "comment-list comment-form comments-area comments-section comments-list newsletter-signup newsletter-form "
    "signup-form login-form search-form search-box search-bar left-sidebar right-sidebar sidebar-left "
    "sidebar-right breadcrumb-nav promo-box alert-banner notice-banner modal-dialog disqus-thread".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_BY_NAME = HEADINGS | {"html", "body"}
# A new element of the first kind ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("name", "label", "skip", "items")

    def __init__(self, name: str, label: str, skip: bool):
        self.name, self.label, self.skip, self.items = name, label, skip, []


def _told(name: str, words: list[str]) -> bool:
    """Whether an element is to be skipped by its classes, id or role."""
    if name in NEVER_BY_NAME:
        return False
    wholes = (re.sub(r"[-_]*\d+$", "", w).replace("_", "-") for w in words)
    return any(w in SKIPPED_WORDS or w in SKIPPED_NAMES for w in wholes)


def read(html: str, names: bool = True) -> Node:
    """Tree of block elements; ``items`` are nodes and strings of (undecoded) text.

    Without ``names`` no element is skipped by class, id or role.
    """
    root = Node("#page", "#page", False)
    path, at = [root], 0
    while (m := _TOKEN.search(html, at)) is not None:
        at = m.end()
        closing, name, attributes, text = m.groups()
        if text is not None:
            path[-1].items.append(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                path[-1].items.append(" ")
            continue
        if closing:
            for k in range(len(path) - 1, 0, -1):
                if path[k].name == name:
                    del path[k:]
                    break
            continue
        ended = CLOSES.get(name, ())
        while len(path) > 1 and (path[-1].name == "p" or path[-1].name in HEADINGS or path[-1].name in ended):
            path.pop()
        words = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower().split()
        skip = name in SKIPPED or names and _told(name, words) or bool(
            re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))
        node = Node(name, ".".join([name, *(re.sub(r"\d+", "0", w) for w in words[:2])]), skip)
        path[-1].items.append(node)
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif len(path) < MAX_DEPTH and name not in VOID and not (attributes.rstrip().endswith("/") and name not in ("p", "div", "article")):
            path.append(node)
    return root


# A wrapper is a list of items [label, optional, repeated, inner wrapper]; a text slot has
# the label "#" and no inner wrapper, a repeated group of several the label "(a b)".

def shape(node: Node) -> list:
    """Folded wrapper of one page's node."""
    items = []
    for item in node.items:
        if isinstance(item, str):
            if item.strip() and not (items and items[-1][0] == "#"):
                items.append(["#", False, False, []])
        else:
            items.append([item.label, False, False, [] if item.name in RAW else shape(item)])
    return fold(items)


def fold(items: list) -> list:
    """Neighbouring repeats of up to LONGEST_PERIOD items become repeated groups."""
    for period in range(1, LONGEST_PERIOD + 1):
        out, i = [], 0
        while i < len(items):
            labels = [x[0] for x in items[i:i + period]]
            j, group = i + period, items[i:i + period]
            while len(labels) == period and [x[0] for x in items[j:j + period]] == labels:
                group = [merge_item(a, b) for a, b in zip(group, items[j:j + period])]
                j += period
            if j > i + period:
                if period == 1:
                    out.append([group[0][0], group[0][1], True, group[0][3]])
                else:
                    out.append(["(" + " ".join(labels) + ")", False, True, group])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merge_item(a: list, b: list) -> list:
    return [a[0], a[1] or b[1], a[2] or b[2], merge(a[3], b[3])]


def merge(a: list, b: list) -> list:
    """Aligns two wrappers by a longest common subsequence of labels."""
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merge_item(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], True, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2], b[j][3]])
            j += 1
    return fold(out)


def blocks(root: Node, wrapper: list) -> list[tuple[str, str, bool]]:
    """(slot, text, inside an article or main) of all texts that no skipped element holds."""
    articles, mains = [], []

    def find(node: Node, skipped: bool):
        for item in node.items:
            if isinstance(item, Node):
                if item.name in ("article", "main") and not item.skip:
                    (articles if item.name == "article" else mains).append((item, skipped))
                    if item.name == "article":
                        continue
                find(item, skipped or item.skip)

    find(root, False)
    chosen = [x for x, skipped in articles if not skipped] or [x for x, skipped in mains if not skipped] or [
        x for x, _ in articles] or [x for x, _ in mains]
    found = []

    def walk(node: Node, items: list, path: str, inside: bool, header: bool):
        inside = inside or any(node is x for x in chosen)
        held, slot = [], path

        def close():
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text and not (header and node.name not in HEADINGS):
                found.append((slot, text, inside))

        at = 0
        for item in node.items:
            label = "#" if isinstance(item, str) else item.label
            at, step, inner = _slot(items, label, at)
            if isinstance(item, str):
                if not held:
                    slot = f"{path}/{step}"
                held.append(item)
                continue
            close()
            own = item.name == "header" and inside
            if not item.skip or own or any(item is x for x in chosen):
                walk(item, inner, f"{path}/{step}", inside, header or own)
            elif chosen and not inside:
                walk_to(item, inner, f"{path}/{step}")
        close()

    def walk_to(node: Node, items: list, path: str):
        """Chosen articles inside skipped elements."""
        for item in node.items:
            if isinstance(item, Node):
                if any(item is x for x in chosen):
                    walk(item, [], path, True, False)
                else:
                    walk_to(item, [], path)

    walk(root, wrapper, "", False, False)
    return found


def _slot(items: list, label: str, at: int) -> tuple[int, str, list]:
    """Place of the wrapper item that a child of this label takes, looking on from ``at``."""
    size = len(items)
    for k in (*range(at, size), *range(at)):
        item = items[k]
        if item[0] == label:
            return k, f"{k}", item[3]
        if item[0][:1] == "(":
            for g, inner in enumerate(item[3]):
                if inner[0] == label:
                    return k, f"{k}.{g}", inner[3]
    return at, label, []


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#]*)", 1))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper, as JSON, for every host."""
    ship_package(pages.sparkSession)

    @F.arrow_udf("string")
    def shape_of(htmls):
        import pyarrow as pa
        return pa.array([json.dumps(shape(read(h.as_py() or ""))) for h in htmls], pa.string())

    def aligned(frame):
        import pandas as pd
        merged = None
        for text in sorted(frame["wrapper"]):
            one = json.loads(text)
            merged = one if merged is None else merge(merged, one)
        return pd.DataFrame({"host": frame["host"].iloc[:1], "wrapper": [json.dumps(merged)]})

    shapes = cut_lineage(pages.select(_host(F.col(url)).alias("host"), shape_of(F.col(html)).alias("wrapper"))
                         .distinct())
    while True:
        sizes = shapes.groupBy("host").agg(F.count("*").alias("n"))
        groups = F.ceil(F.col("n") / MERGE_GROUP)
        many = sizes.agg(F.max("n")).first()[0] or 0
        if many <= 1:
            return shapes
        salted = shapes.join(sizes, "host").withColumn(
            "part", F.pmod(F.xxhash64("wrapper"), groups))
        shapes = cut_lineage(salted.groupBy("host", "part").applyInPandas(
            aligned, "host string, wrapper string").distinct())


def _templates(pages: DataFrame, known: DataFrame, url: str, html: str) -> DataFrame:
    """(host, slots): slots of a host whose text is the same on many different pages."""

    def slots(batches):
        import pyarrow as pa
        cache: dict[str, list] = {}
        names = ["host", "page", "slot", "text"]
        for batch in batches:
            out = {n: [] for n in names}
            for host, wrapper, body in zip(*(batch.column(n).to_pylist() for n in ("host", "wrapper", "html"))):
                if wrapper not in cache:
                    cache.clear() if len(cache) > 1000 else None
                    cache[wrapper] = json.loads(wrapper)
                for slot, text, inside in blocks(read(body or ""), cache[wrapper]):
                    if not inside:
                        out["host"].append(host)
                        out["page"].append(body)
                        out["slot"].append(slot)
                        out["text"].append(text)
            out["page"] = [hash_of(p) for p in out["page"]]
            out["text"] = [hash_of(t) for t in out["text"]]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("host", pa.string()), ("page", pa.int64()), ("slot", pa.string()), ("text", pa.int64())]))

    def hash_of(text: str) -> int:
        from xxhash import xxh64_intdigest
        return xxh64_intdigest(text) - (1 << 63)

    seen = _with_wrapper(pages, known, url, html).select("host", "wrapper", "html").mapInArrow(
        slots, "host string, page long, slot string, text long")
    counted = seen.groupBy("host", "slot").agg(
        F.min("text").alias("low"), F.max("text").alias("high"),
        F.approx_count_distinct("page").alias("pages"))
    return counted.where((F.col("low") == F.col("high")) & (F.col("pages") >= TEMPLATE_PAGES)).groupBy(
        "host").agg(F.array_sort(F.collect_set("slot")).alias("slots"))


def _with_wrapper(pages: DataFrame, known: DataFrame, url: str, html: str) -> DataFrame:
    return pages.select(packed(pages).alias("row"), _host(F.col(url)).alias("host"),
                        F.col(html).alias("html")).join(broadcast_if_small(known), "host")


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``row`` and the main ``text`` of every page."""
    known = wrappers(pages, url, html)
    templates = _templates(pages, known, url, html)
    known = cut_lineage(known.join(templates, "host", "left").select("host", "wrapper", F.coalesce(
        "slots", F.array().cast("array<string>")).alias("slots")))

    @F.arrow_udf("string")
    def text_of(htmls, shapes, dropped):
        import pyarrow as pa
        cache: dict[str, list] = {}
        out = []
        for h, w, d in zip(htmls, shapes, dropped):
            w, gone = w.as_py(), set(d.as_py())
            if w not in cache:
                cache.clear() if len(cache) > 1000 else None
                cache[w] = json.loads(w)
            for names in (True, False):
                found = blocks(read(h.as_py() or "", names), cache[w])
                main = any(inside for _, _, inside in found)
                text = "\n".join(t for s, t, inside in found if (inside or not main) and s not in gone)
                if text:
                    break
            out.append(text)
        return pa.array(out, pa.string())

    return _with_wrapper(pages, known, url, html).select(
        "row", text_of(F.col("html"), F.col("wrapper"), F.col("slots")).alias("text"))
