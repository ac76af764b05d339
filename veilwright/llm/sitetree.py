"""Main text of web pages by site style trees.

The DOMs of one host's pages are merged into a style tree: elements with the same path of tags and attributes are one node.
A node is important if it differs from page to page. Presentation: the entropy of the sequences of children that the node
has in the host's pages. Content, for nodes with text of their own: one less the mean entropy of its text blocks over the
pages (a block on one page has entropy 0, one that is on all pages has 1). A branch's composite importance is the weighted
mean over its nodes, and branches below `THRESHOLD` are removed from each page, the outermost first.

Elements that markup itself names as navigation, header, footer, sidebar, notice, advert, form or comments have an importance
that no entropy can lift over the threshold, so they go before anything is merged. If a page has an article (or else a main)
element with text, what lies beside it goes too, and inside it only elements with an own class or id are judged: paragraphs
of articles that a host shows twice are no boilerplate. A branch that holds over half of a page's text stays, and its
inner branches are judged; a node is judged once `PAGES` different pages of the host have it.

Only hashes travel: page by page the nodes of a tree, merged by aggregates with a map-side combine, so a host with a third
of all pages is spread over all tasks. A page's noisy branches meet it by a join on its hash.

Nulls and odd cases: null or empty html has an empty text. A url that is null or has no host belongs to no site; only markup
decides there. Equal pages of a host are merged once and come back as often as they occur; null and repeated page_ids are
kept. Elements below `DEPTH` levels count as part of their ancestor there, texts of any length are treated whole. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from veilwright.sources.scratch import written

#: Composite importance below which a branch is removed; different pages that a judged node must be on; levels of a tree.
THRESHOLD, PAGES, DEPTH = 0.3, 3, 64
#: Share of presentation in a node's weight by its number of styles: 1 - DECAY ** styles.
DECAY = 0.9

# Names of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var").split())
CLOSES_P = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul").split())
#: An element that ends an open one of the given names, up to the nearest of the last names.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("html table td th caption button object template".split())

#: Elements that are no article text, by their tag, role, or a word of their class or id.
CHROME_TAGS = frozenset((
    "nav header footer aside form menu dialog search script style noscript template iframe svg canvas audio video object select "
    "button textarea fieldset datalist head title noembed noframes map").split())
CHROME_ROLES = frozenset((
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status").split())
CHROME_WORDS = frozenset((
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer bottombar copyright "
    "sidebar aside rail notice notices notification cookie cookies consent gdpr alert banner disclaimer ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored sponsors promo promotion promotions promoted form search login signup signin "
    "subscribe subscription newsletter comment comments respond reply replies disqus discussion share sharing social related "
    "recommended recommendations popup modal overlay lightbox widget widgets toolbar pagination pager skip").split())
#: Words that say that a header belongs to the text, and that a name is only about a part.
OWN_HEADER, ABOUT = frozenset("article entry post content story title text".split()), frozenset("no has with without".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def hash64(text: str) -> int:
    """A signed 64-bit hash."""
    value = xxh64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


@dataclass
class Node:
    """A node of a page's style tree: all its elements with one path of tags and attributes."""

    key: int
    ancestors: tuple[int, ...]
    named: bool
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """A text block, the nodes around it from the outside, and whether it is in an article or main element."""

    text: str
    path: tuple[int, ...]
    within: tuple[bool, bool]


@dataclass
class _Open:
    """An open element; `node` is its own or the nearest one around it."""

    tag: str
    chrome: bool
    node: Node | None
    within: tuple[bool, bool]


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def named_as_chrome(tag: str, own: dict[str, str], in_article: bool) -> bool:
    """Does markup say that the element is no article text?"""
    if tag in ("html", "body"):
        return False
    if tag in CHROME_TAGS and not (tag == "header" and in_article):
        return True
    if own.get("role", "").strip().lower() in CHROME_ROLES or own.get("aria-hidden", "").lower() == "true" or "hidden" in own:
        return True
    if _HIDDEN.search(own.get("style", "")):
        return True
    for name in f"{own.get('class', '')} {own.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        found = CHROME_WORDS.intersection(words)
        if not found or ABOUT.intersection(words):
            continue
        if found <= {"header"} and (in_article or OWN_HEADER.intersection(words)):
            continue
        return True
    return False


class Page:
    """A page's blocks and its part of the style tree, without what markup names as no article text."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.nodes: dict[int, Node] = {}
        self._pending: list[str] = []
        self._stack: list[_Open] = []
        self._open_tags: Counter[str] = Counter()
        self._read(html)
        for place in (0, 1):  # the article, or else the main element
            if any(b.within[place] for b in self.blocks):
                self.blocks = [b for b in self.blocks if b.within[place]]
                self.in_article = True
                return
        self.in_article = False

    def _read(self, html: str) -> None:
        at = 0
        while found := _TAG.search(html, at):
            if found.start() > at:
                self._text(html[at:found.start()])
            at = found.end()
            closing, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if found[0].startswith("<![CDATA["):
                self._text(found[0][9:].removesuffix("]]>"), False)
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
                self._open(tag, rest)
            else:
                self._open(tag, rest)
                if rest.endswith("/") and self._stack and tag in ("svg", "path", "use"):
                    self._close(tag)
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _text(self, text: str, escaped: bool = True) -> None:
        if not (self._stack and self._stack[-1].chrome):
            self._pending.append(unescape(text) if escaped and "&" in text else text)

    def _flush(self) -> None:
        if self._pending:
            text = " ".join("".join(self._pending).split())
            self._pending = []
            if text:
                top = self._stack[-1] if self._stack else None
                path = (*top.node.ancestors, top.node.key) if top and top.node else ()
                self.blocks.append(Block(text, path, top.within if top else (False, False)))

    def _open(self, tag: str, rest: str) -> None:
        inline = tag in INLINE
        if tag in VOID:
            if tag == "br":
                self._pending.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if not inline:
            self._flush()
            if tag in CLOSES_P:
                self._end({"p"}, SCOPE)
            if tag in CLOSES:
                self._end(*CLOSES[tag])
        top = self._stack[-1] if self._stack else _Open("", False, None, (False, False))
        self._open_tags[tag] += 1
        if top.chrome:
            self._stack.append(_Open(tag, True, None, top.within))
            return
        own = attributes(rest) if rest.strip(" /") else {}
        if named_as_chrome(tag, own, any(top.within)):
            self._stack.append(_Open(tag, True, None, top.within))
            return
        article = tag == "article" or own.get("itemprop") == "articleBody" or own.get("role") == "article"
        within = (top.within[0] or article, top.within[1] or tag == "main" or own.get("role") == "main")
        node = above = top.node
        if not inline and (above is None or len(above.ancestors) < DEPTH):
            label = f"{tag}.{' '.join(sorted(own.get('class', '').split()))}#{own.get('id', '')}"
            label = _DIGITS.sub("0", label)
            if above:
                above.children.append(label)
            key = hash64(f"{above.key if above else ''}/{label}")
            node = self.nodes.get(key)
            if node is None:
                ancestors = (*above.ancestors, above.key) if above else ()
                node = self.nodes[key] = Node(key, ancestors, "class" in own or "id" in own)
        self._stack.append(_Open(tag, False, node, within))

    def _cut(self, place: int) -> None:
        """Close the elements from `place` on."""
        for closed in self._stack[place:]:
            self._open_tags[closed.tag] -= 1
        del self._stack[place:]

    def _end(self, names: set[str], border: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of these names that has none of `border` inside it."""
        if not any(self._open_tags[name] for name in names):
            return
        for place in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[place].tag
            if tag in names:
                self._cut(place)
                return
            if tag in border:
                return

    def _close(self, tag: str) -> None:
        inline = tag in INLINE
        if not self._open_tags[tag]:
            if tag in CLOSES_P:
                self._flush()
            return
        for place in range(len(self._stack) - 1, -1, -1):
            here = self._stack[place].tag
            if here == tag:
                if not inline:
                    self._flush()
                self._cut(place)
                return
            if inline and here not in INLINE or here == "table" and tag not in ("body", "html"):
                return

    def judged(self) -> list[Node]:
        """The nodes that the site's tree decides about."""
        around: set[int] = {k for b in self.blocks for k in b.path}
        return [n for n in self.nodes.values() if n.key in around and (n.named or not self.in_article)]

    def text_without(self, noisy: set[int]) -> str:
        """The blocks that are in no noisy branch; a branch with over half of the text is no noise, but its parts may be."""
        if noisy and self.blocks:
            size = Counter()
            total = 0
            for b in self.blocks:
                total += len(b.text)
                for key in set(b.path):
                    size[key] += len(b.text)
            noisy = {k for k in noisy if 2 * size[k] <= total}
            return "\n".join(b.text for b in self.blocks if noisy.isdisjoint(b.path))
        return "\n".join(b.text for b in self.blocks)


def host_of(url: Column) -> Column:
    """The host in lower case; null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def _identified(pages: DataFrame, *columns: Column) -> DataFrame:
    html = F.col("html").cast("string")
    return pages.select(*columns, host_of(F.col("url").cast("string")).alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))


_TREE = "host string, page long, nodes array<struct<key: long, ancestors: array<long>, style: long, blocks: array<struct<block: long, n: long>>>>"


def page_trees(pages: DataFrame) -> DataFrame:
    """host, page (hash of the html) and the judged nodes of every different page of a host."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("host", pa.string()), ("page", pa.int64()), ("nodes", pa.list_(pa.struct([
                ("key", pa.int64()), ("ancestors", pa.list_(pa.int64())), ("style", pa.int64()),
                ("blocks", pa.list_(pa.struct([("block", pa.int64()), ("n", pa.int64())])))])))])
        for batch in batches:
            rows = []
            for host, page, html in zip(*[batch.column(k) for k in range(3)], strict=True):
                parsed = Page(html.as_py())
                nodes = parsed.judged()
                if nodes:
                    texts: dict[int, Counter] = {}
                    for b in parsed.blocks:
                        if b.path:
                            texts.setdefault(b.path[-1], Counter())[hash64(b.text)] += 1
                    rows.append({"host": host.as_py(), "page": page.as_py(), "nodes": [
                        {"key": n.key, "ancestors": [*n.ancestors, n.key], "style": hash64("\n".join(n.children)),
                         "blocks": [{"block": t, "n": c} for t, c in texts.get(n.key, {}).items()]} for n in nodes]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    own = _identified(pages).where("host is not null and html is not null and html <> ''")
    return own.mapInArrow(over, _TREE).dropDuplicates(["host", "page"])


def noisy_nodes(trees: DataFrame, threshold: float = THRESHOLD, pages: int = PAGES) -> DataFrame:
    """(host, key) of the nodes whose branches have a composite importance below `threshold`."""
    nodes = trees.select("host", F.explode("nodes").alias("node")).select("host", "node.*")
    # Presentation: entropy of the sequences of children over the host's pages, in the unit in which all different is 1.
    styles = nodes.groupBy("host", "key", "style").agg(F.count("*").alias("c"), F.min("ancestors").alias("ancestors"))
    shown = styles.groupBy("host", "key").agg(
        F.sum("c").alias("m"), F.count("*").alias("styles"), F.sum(F.col("c") * F.log("c")).alias("clogc"),
        F.min("ancestors").alias("ancestors"))
    presentation = F.when(F.col("m") > 1, (F.log("m") - F.col("clogc") / F.col("m")) / F.log("m")).otherwise(1.0)
    # Content: a block's entropy over the pages that have it.
    blocks = nodes.select("host", "key", F.explode("blocks").alias("b")).select("host", "key", "b.*")
    spread = blocks.groupBy("host", "key", "block").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    spread = spread.groupBy("host", "key").agg(F.avg(F.log("c") - F.col("nlogn") / F.col("c")).alias("entropy"))
    importance = F.when(F.col("entropy").isNull() | (F.col("m") <= 1), presentation).otherwise(
        1 - F.least(F.lit(1.0), F.col("entropy") / F.log("m")))
    weight = F.when(F.col("entropy").isNull(), F.col("m") * (1 - F.pow(F.lit(DECAY), "styles"))).otherwise(F.col("m"))
    judged = shown.join(spread, ["host", "key"], "left").select(
        "host", "key", "m", importance.alias("importance"), weight.alias("weight"), "ancestors")
    judged = written(judged, "site_nodes")
    # A branch's composite importance, from all nodes below it.
    branch = judged.select("host", "importance", "weight", F.explode("ancestors").alias("key")).groupBy("host", "key").agg(
        (F.sum(F.col("importance") * F.col("weight")) / F.sum("weight")).alias("composite"))
    low = judged.where(F.col("m") >= pages).select("host", "key").join(branch.where(F.col("composite") < threshold), ["host", "key"])
    return low.select("host", "key")


def main_text(pages: DataFrame, threshold: float = THRESHOLD, least: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html)."""
    trees = written(page_trees(pages), "trees")
    noisy = written(noisy_nodes(trees, threshold, least), "noisy")
    keys = trees.select("host", "page", F.explode("nodes.key").alias("key"))
    found = keys.join(noisy, ["host", "key"]).groupBy("host", "page").agg(F.collect_list("key").alias("noisy"))
    # Stored, so its size is known: few enough rows are sent to the pages, else the pages are shuffled by their hash.
    found = written(found, "branches")
    own = _identified(pages, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    joined = own.join(found, ["host", "page"], "left").select("page_id", "url", "html", "noisy")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html.as_py() or "").text_without(set(noisy.as_py() or ()))
                     for html, noisy in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = joined.mapInArrow(over, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
