"""Operator 5: main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree.  An *element node* is a path of elements (tag, class, id) from the root; its
*style nodes* are the different sequences of children that its pages show below it; text that stands in an element itself is a
*content node*.  With m pages that hold an element (copies of a page count once)

* a content that k pages share has entropy ``log k / log (m + PRIOR)``, and the content's importance is 1 less the mean entropy;
* presentation has the entropy of the style nodes' shares, to the base ``m + PRIOR``, or 1 for a single page;
* an element's composite importance is ``(1 - GAMMA**l) * presentation + GAMMA**l * below`` with l style nodes, where ``below`` is the
  mean, by the styles' shares, of the importance of their children (elements and own text alike); without children it is its content's.

A branch is cut where its element and all elements below it are under ``LEAST``.  ``PRIOR`` keeps a host's few first pages from telling too much.
Composites are made level by level, from the deepest up, by joins and sums over (host, element, child), so no host's tree or pages
are gathered; only what is to be cut goes back to the pages, as the paths of each page.

Markup that says by itself what it is needs no tree: elements for menus, forms, adverts and so on, hidden ones, roles, and elements
one of whose class or id values *is* such a name (ids of headings and sections, which are anchors, don't count within an article).
A name that only *holds* such a word (``has-sidebar``) is a hint, which is followed unless the branch holds a main
container, a first heading, or half of the page's text; none is followed inside a main container.  Where a page marks its article (article, main,
role=main), text outside it is not important; text inside is weighed by the tree like that of other pages.  Plain headings of an article
stay, and an article of which less than a tenth would be left (its pages are alike) stays whole.

Cases: null html counts as empty and gives an empty text; broken markup (unclosed or stray tags, cut-off pages) is read as far as
it goes; very long pages are taken whole; ties don't arise (blocks keep their order); repeated rows give repeated results; a null
url belongs to one host ""; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.common import stored, table

LEAST, GAMMA, PRIOR = 0.35, 0.9, 3
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title|iframe|select|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "strike", "big", "acronym", "nobr", "button"}
NOISE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "noscript", "template"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
NOISE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adbox", "banner", "sponsor", "sponsored", "promo", "promoted",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "header", "masthead", "topbar", "footer", "foot", "copyright",
    "sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations", "popular", "trending", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer",
    "form", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "feedback", "skip", "hidden",
}
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ANCHORED = HEADINGS | {"section"}
#: Blocks in whose sentences a button is a word.
SENTENCES = HEADINGS | {"p", "li", "td", "dd", "blockquote"}
#: Share of an article's text that has to be left where branches are cut: less means that pages are copies, not that they share an ornament.
LEFT = 0.1
#: page: digest of a page's blocks.  Paths, contents and styles are digests; text is null outside a marked article, and ``stays``
#: marks plain headings of an article.
PARSED = "row long, page_id long, url string, host string, marked boolean, page long, blocks array<struct<path: long, content: long, stays: boolean, text: string>>, nodes array<struct<path: long, depth: int, style: long, children: array<long>>>"
TEXT = 0  # the child that stands for an element's own text


def _noise(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, str]:
    """Whether an element is noise (``inside`` a main container or not), whether its names hint at it, whether it is a main
    container, and its mark in paths."""
    noise, hint, main, mark = tag in NOISE_TAGS and not (inside and tag == "header"), False, tag in MAIN_TAGS, tag
    whole = tag not in {"html", "body"} | MAIN_TAGS
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, own = m[1].lower(), m[2] or m[3] or m[4] or ""
            value = own.lower()
            if name in ("class", "id"):
                mark += "." + ".".join(value.split()) if name == "class" else "#" + re.sub(r"\d+", "0", value)
                noise |= whole and not (inside and name == "id" and tag in ANCHORED) and any(w in NOISE_WORDS for w in value.split())
                hint |= whole and not inside and any(w in NOISE_WORDS for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", own).lower()))
            elif name == "role":
                noise |= value in NOISE_ROLES
                main |= value in MAIN_ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                noise = True
    return noise, hint, main, mark


class Page:
    """Blocks in page order, each (path, inside a main container, text), and elements (path, depth, children), without noise."""

    def __init__(self, html: str) -> None:
        self.found: list[tuple[str, bool, bool, tuple[int, ...], str]] = []  # path, main, noise, hints about it, text
        self.elements: list[tuple[str, int, list[str], bool, tuple[int, ...]]] = []  # path, depth, marks below, noise, hints
        self.holds_main: dict[int, bool] = {}  # of the elements with hints
        # tag, noise, main, path, hints, and the element's number (that of the block around it for inline elements).
        self.stack: list[tuple[str, bool, bool, str, tuple[int, ...], int]] = []
        self.parts: list[str] = []
        self._read(html)
        size = [len(x[4]) for x in self.found]
        total, held = sum(n for n, x in zip(size, self.found, strict=True) if not x[2]), dict.fromkeys(self.holds_main, 0)
        for n, x in zip(size, self.found, strict=True):
            for k in x[3]:
                held[k] += n * (not x[2])
        out = {k for k, main in self.holds_main.items() if not main and 2 * held[k] < total}
        self.blocks = [(path, main, text) for path, main, noise, hints, text in self.found if not noise and not out.intersection(hints)]
        self.nodes = [(path, depth, below) for path, depth, below, noise, hints in self.elements if not noise and not out.intersection(hints)]

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        self.parts.clear()
        if text:
            _, noise, main, path, hints, number = self.stack[-1] if self.stack else ("", False, False, "", (), -1)
            self.found.append((path, main, noise, hints, text))
            if number >= 0 and (not self.elements[number][2] or self.elements[number][2][-1] != ""):
                self.elements[number][2].append("")

    def _read(self, html: str) -> None:
        stack, parts, at = self.stack, self.parts, 0
        known: dict[tuple[str, str, bool], tuple[bool, bool, bool, str]] = {}
        for m in TOKEN.finditer(html):
            if m.start() > at:
                parts.append(html[at : m.start()])
            at = m.end()
            if (tag := m[3]) is None:
                continue
            tag = tag.lower()
            if tag == "br":
                parts.append(" ")
                continue
            inline = tag in INLINE
            if not inline:
                self._flush()
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if inline and any(x[0] not in INLINE for x in stack[k:]):
                            break  # a stray end of an inline element doesn't close the blocks since
                        if inline and k and stack[k][1:5] != stack[k - 1][1:5]:
                            self._flush()
                        del stack[k:]
                        break
                continue
            if tag in VOID or m[4].endswith("/") and tag not in NOISE_TAGS | MAIN_TAGS:
                continue
            inside = bool(stack) and stack[-1][2]
            if (tag, m[4], inside) not in known:
                known[tag, m[4], inside] = _noise(tag, m[4], inside)
            noise, hint, main, mark = known[tag, m[4], inside]
            if tag == "button":
                noise |= not any(x[0] in SENTENCES for x in stack[-3:])
            if not inline and stack:
                # A block ends an open paragraph; an item ends the item before it.
                closes = {"p"} if tag not in ("li", "dt", "dd", "td", "th", "tr", "option") else {"p", tag} | ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th", "tr") else set())
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            _, n, a, path, hints, number = stack[-1] if stack else ("", False, False, "", (), -1)
            if main or tag == "h1":
                for k in hints:
                    self.holds_main[k] = True
            if inline and (noise or hint) and not n:
                self._flush()
            if inline and not noise and not hint:
                stack.append((tag, n, a or main, path, hints, number))
                continue
            own = len(self.elements)
            if hint and not noise:
                self.holds_main[own] = main
                hints = (*hints, own)
            if number >= 0 and not noise:
                self.elements[number][2].append(mark)
            self.elements.append((f"{path}/{mark}", len(stack), [], n or noise, hints))
            stack.append((tag, n or noise, a or main, f"{path}/{mark}", hints, own))
        if at < len(html):
            parts.append(html[at:])
        self._flush()


def _stays(path: str, main: bool) -> bool:
    """Whether a path is that of a plain heading of an article, its headers included."""
    *above, last = path.split("/")
    while above and above[-1] == "header":
        above.pop()
    return main and last in HEADINGS and bool(above) and re.split("[.#]", above[-1])[0] in MAIN_TAGS


def parse(pages: DataFrame) -> DataFrame:
    """PARSED: of every page the blocks that aren't noise."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))))
    block = pa.struct([("path", pa.int64()), ("content", pa.int64()), ("stays", pa.bool_()), ("text", pa.string())])
    node = pa.struct([("path", pa.int64()), ("depth", pa.int32()), ("style", pa.int64()), ("children", pa.list_(pa.int64()))])

    def run(batches):
        digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63) or 1
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                marks, whole, kept, nodes = [], [], [], []
                for html in part.column("html").to_pylist():
                    page = Page(html or "")
                    marked = any(main for _, main, *_ in page.found)
                    path_of = {p: digest(p) for p in {x[0] for x in page.blocks} | {x[0] for x in page.nodes}}
                    marks.append(marked)
                    whole.append(digest("\0".join(x for path, _, text in page.blocks for x in (path, text))))
                    kept.append([{"path": path_of[path], "content": digest(text), "stays": _stays(path, main), "text": text if main or not marked else None} for path, main, text in page.blocks])
                    shown = {(path, depth, tuple(below)) for path, depth, below in page.nodes}
                    nodes.append([{"path": path_of[path], "depth": path.count("/"), "style": digest("|".join(below)), "children": sorted({TEXT if x == "" else digest(f"{path}/{x}") for x in below})} for path, _, below in shown])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "page_id", "url", "host")), pa.array(marks, pa.bool_()), pa.array(whole, pa.int64()), pa.array(kept, pa.list_(block)), pa.array(nodes, pa.list_(node))], ["row", "page_id", "url", "host", "marked", "page", "blocks", "nodes"])

    return rows.mapInArrow(run, PARSED)


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, path, importance, low: the composite importance of every element of the hosts' trees, and whether it and all below it are
    under LEAST."""
    # Pages that are copies of each other count once: their rows are equal, and grouping by page makes them one.
    held = parsed.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.path", "n.depth", "n.style", "n.children").groupBy("host", "page", "path", "style").agg(F.min("depth").alias("depth"), F.first("children").alias("children"))
    styles = held.groupBy("host", "path", "style").agg(F.count("*").alias("k"), F.min("depth").alias("depth"), F.first("children").alias("children"))
    pages = held.groupBy("host", "path", "page").agg(F.lit(1).alias("one")).groupBy("host", "path").agg(F.count("*").alias("m"))
    # The styles of an element are as many as its pages at most; their children go with their share of the element.
    shares = styles.groupBy("host", "path").agg(F.sum("k").alias("all"), F.count("*").alias("l"), F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("kl"), F.min("depth").alias("depth"))
    entropy = lambda k, m: F.log(k.cast("double")) / F.log(m + F.lit(float(PRIOR)))
    # How many contents are held by k pages: all that entropies need, and few rows for an element however many pages hold it.
    texts = parsed.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.path", "b.content").distinct().groupBy("host", "path", "content").agg(F.count("*").alias("k")).groupBy("host", "path", "k").agg(F.count("*").alias("n"))
    texts = texts.join(pages, ["host", "path"]).groupBy("host", "path").agg((1 - F.sum(F.col("n") * F.least(F.lit(1.0), entropy(F.col("k"), F.col("m")))) / F.sum("n")).alias("content"))
    of_styles = F.when(F.col("m") == 1, 1.0).otherwise(F.least(F.lit(1.0), (F.log(F.col("all").cast("double")) - F.col("kl") / F.col("all")) / F.log(F.col("m") + F.lit(float(PRIOR)))))
    nodes = stored(shares.join(pages, ["host", "path"]).join(texts, ["host", "path"], "left").select("host", "path", "depth", "l", "all", of_styles.alias("presentation"), F.coalesce("content", F.lit(0.0)).alias("content")), "html-nodes")
    below = styles.select("host", "path", F.explode("children").alias("child"), (F.col("k") / F.size("children")).alias("part")).groupBy("host", "path", "child").agg(F.sum("part").alias("part"))
    below = stored(below.join(nodes, ["host", "path"]).select("host", "path", "depth", "child", (F.col("part") / F.col("all")).alias("share")), "html-children")
    done, level = None, nodes.agg(F.max("depth")).first()[0]
    under = None
    while level is not None and level >= 0:
        here = nodes.where(F.col("depth") == level)
        parts = below.where((F.col("depth") == level) & (F.col("child") != TEXT))
        if under is None:
            parts = parts.select("host", "path", F.lit(0.0).alias("value"), F.lit(True).alias("low"), "share")
        else:
            parts = parts.join(under.select("host", F.col("path").alias("child"), "importance", F.col("low").alias("_low")), ["host", "child"], "left").select("host", "path", (F.col("share") * F.coalesce("importance", F.lit(0.0))).alias("value"), F.coalesce("_low", F.lit(True)).alias("low"), "share")
        sums = parts.groupBy("host", "path").agg(F.sum("value").alias("value"), F.min("low").alias("below_low"))
        own = below.where((F.col("depth") == level) & (F.col("child") == TEXT)).select("host", "path", F.col("share").alias("text_share"))
        rows = here.join(sums, ["host", "path"], "left").join(own, ["host", "path"], "left")
        weight = F.pow(F.lit(GAMMA), F.col("l"))
        composite = (1 - weight) * F.col("presentation") + weight * (F.col("value") + F.coalesce("text_share", F.lit(0.0)) * F.col("content"))
        rows = rows.withColumn("importance", F.when(F.col("value").isNull(), F.col("content")).otherwise(composite))
        under = stored(rows.select("host", "path", "importance", ((F.col("importance") < LEAST) & F.coalesce("below_low", F.lit(True))).alias("low")), "html-level")
        done, level = under if done is None else done.union(under), level - 1
    return done if done is not None else nodes.select("host", "path", F.lit(0.0).alias("importance"), F.lit(True).alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per page.  See the module's text."""
    parsed = stored(parse(pages), "html-blocks")
    low = stored(style_tree(parsed).where("low").select(F.col("host").alias("_host"), F.col("path").alias("_path")), "html-tree")
    rows = parsed.withColumn("cut", F.array().cast("array<bigint>"))
    if not low.isEmpty():
        paths = parsed.select("row", "host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["path"]))).alias("path"))
        cut = paths.join(low, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))).groupBy(F.col("row").alias("_row")).agg(F.collect_list("path").alias("cut"))
        rows = parsed.join(cut, F.col("row") == F.col("_row"), "left")
    joined = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["text"]), " ")
    rows = rows.withColumn("all", joined(F.col("blocks")))  # blocks outside an article have no text
    rows = rows.withColumn("text", F.when(F.coalesce(F.size("cut"), F.lit(0)) <= 0, F.col("all")).otherwise(joined(F.filter("blocks", lambda b: b["stays"] | ~F.array_contains("cut", b["path"])))))
    whole = F.col("marked") & (F.length("text") < LEFT * F.length("all"))
    return rows.select("page_id", "url", F.when(whole, F.col("all")).otherwise(F.col("text")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
