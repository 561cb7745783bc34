"""HTML extraction with a site style tree.

Every page is parsed into elements, each named by the path of tags and classes that leads to it. Merging the pages of
a host by path gives its style tree. An element's presentation is the sequence of its children's names, its content the
text that stands in it outside of children. Over the m pages of the host that have the element, its presentation
importance is the entropy of the presentations to the base m. The content importance is one minus the mean of log_m(c)
over the distinct contents, with m the pages that have any and c the number of them that share one: 0 if all pages read
alike, 1 if each reads differently. With l children the composite importance is (1 - g^l) presentation + g^l below, where
below is the mean composite importance of the children, own text counting as a child of its content importance. An
element is low if it and all elements and texts under it are judged and of low importance; low branches are removed from each page.
An element that holds an article is never low.

The tree judges what LEAST_PAGES pages or more of a host have, inside articles too: there only headings, paragraphs and
the like without a class of their own are left alone, since pages may copy each other's text. Where boilerplate differs from page
to page, or a host has few pages, importance can't tell it from content. For these cases elements that menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments are written as are removed too, and where a
page marks its article the text comes from it; ``hints=False`` leaves all to the tree.

The first scan emits a few numbers for each path of a page; a hot host is pre-aggregated by path and content before
the shuffle, and importance rises by levels of the tree in joins on host and path. The low branches of all hosts are broadcast if they are few, or else joined to the pages by host.

Defined cases: null or empty html gives an empty text; a page without a host is a host of its own kind; unclosed,
misnested or cut markup closes with the page; rows that repeat are extracted each; an empty table gives no rows. Time
is linear in the page, whatever its tags: elements below TREE_DEPTH count as content of the one above them.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of, slices
from loomwork.llm.url_filters import host_and_path
from loomwork.session import checkpointed, ship

#: Pages of a host that must have an element before it can be judged; importance below which its branch is removed.
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.5
#: How much less presentation counts with each further child.
DECAY = 0.9
#: Elements nested deeper than this count as content of their ancestors; importance rises level by level.
TREE_DEPTH = 24
#: Low branches up to which they are broadcast (8 bytes each).
BROADCAST_BRANCHES = 1_000_000

#: Fixed values of the markup language: elements by how they are written and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEXT = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr br".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES_ITS_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table select article section div body html".split())
#: What boilerplate is written as: elements, roles, and words in classes or ids.
BOILERPLATE = frozenset("nav footer aside form menu dialog button select object svg math canvas audio video map".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments disqus reply replies respond pagination pager toolbar widget skip".split()
)

#: Quantifiers never give back, so that each character is looked at once; an attribute that is cut off ends with the page.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")


class Element:
    __slots__ = ("article", "children", "dropped", "label", "main", "own", "path", "tag")

    def __init__(self, tag: str, label: str, path: int, own: list[str], dropped: bool, article: bool, main: bool):
        self.tag, self.label, self.path, self.own = tag, label, path, own
        self.dropped, self.article, self.main = dropped, article, main
        self.children: list[str] = []


class Node:
    """What one page says of a path: hashes of presentation and of own text, children, occurrences, and if it is an article."""

    __slots__ = ("article", "children", "content", "depth", "parent", "presentation", "times")

    def __init__(self, parent: int, depth: int):
        self.parent, self.depth = parent, depth
        self.presentation = self.content = self.children = self.times = 0
        self.article = False


class Page:
    """One parsed page: pieces of text with where they stand, and the elements of the style tree."""

    def __init__(self, markup: str, low: frozenset[int] = frozenset(), tree: bool = False, hints: bool = True):
        self.low, self.tree, self.hints = low, tree, hints
        #: Text pieces and, beside them, 0 for dropped text, 1 for other text, 2 in a main element, 3 in an article.
        self.pieces: list[str] = []
        self.places: list[int] = []
        self.has_article = self.has_main = False
        self.elements: dict[int, Node] = {}
        self.stack = [Element("", "", 0, [], False, False, False)]
        #: Places in the stack of the open elements of each tag, and of the containers that end a search for one.
        self.open: dict[str, list[int]] = {}
        self.boundaries = [0]
        self.parse(markup)
        while len(self.stack) > 1:
            self.close()

    def text(self) -> str:
        """The kept text: of the articles, or else of the main element, or else of all that is left."""
        least = 3 if self.has_article else 2 if self.has_main else 1
        return " ".join("".join(p for p, at in zip(self.pieces, self.places, strict=True) if at >= least).split())

    def add(self, piece: str) -> None:
        top = self.stack[-1]
        self.pieces.append(piece)
        if self.tree:
            top.own.append(piece)
        self.places.append(0 if top.dropped else 3 if top.article else 2 if top.main else 1)

    def parse(self, markup: str) -> None:
        at, end = 0, len(markup)
        while at < end:
            found = TAG.search(markup, at)
            if found is None:
                self.add(html_module.unescape(markup[at:]))
                return
            if found.start() > at:
                self.add(html_module.unescape(markup[at : found.start()]))
            at = found.end()
            name = found[2]
            if not name:
                continue
            tag = name.lower()
            if found[1]:
                self.end(tag)
            else:
                at = self.begin(tag, found[3], markup, at)

    def begin(self, tag: str, attributes: str, markup: str, at: int) -> int:
        if tag in VOID:
            if tag not in INLINE:
                self.add(" ")
            return at
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(markup, at)
            return close.end() if close else len(markup)
        if tag in CLOSES_PARAGRAPH:
            self.close_open({"p"})
        if tag in CLOSES_ITS_KIND:
            self.close_open(CLOSES_ITS_KIND[tag])
        if tag not in INLINE:
            self.add(" ")
        parent = self.stack[-1]
        classes, role, hidden, words = "", "", False, set()
        if attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), html_module.unescape("".join(values))
                if name == "role":
                    role = value.strip().lower()
                elif name == "hidden":
                    hidden = True
                else:
                    words.update(w.lower() for w in NAME_WORD.findall(value))
                    if name == "class":
                        classes = ".".join(sorted(value.split()))
        label = f"{tag}.{classes}" if classes else tag
        path = path_key(parent.path, label) if len(self.stack) <= TREE_DEPTH else parent.path
        article = parent.article or (self.hints and tag == "article")
        main = parent.main or (self.hints and (tag == "main" or role == "main"))
        boilerplate = tag in BOILERPLATE or hidden or role in BOILERPLATE_ROLES or (tag == "header" and not parent.article)
        if tag not in ("html", "body", "main") and not (tag == "article" and not parent.article and "comment" not in words and "comments" not in words):
            boilerplate = boilerplate or not BOILERPLATE_WORDS.isdisjoint(words)
        dropped = parent.dropped
        if not dropped and self.low and path != parent.path and not (article and (tag == "article" or (tag in TEXT and not classes))):
            dropped = path in self.low
        dropped = dropped or (self.hints and boilerplate)
        if not dropped:
            self.has_article |= article and tag == "article"
            self.has_main |= main and not parent.main
        deeper = path == parent.path
        if not deeper:
            parent.children.append(label)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BOUNDARY:
            self.boundaries.append(len(self.stack))
        self.stack.append(Element(tag, label, path, parent.own if deeper else [], dropped, article, main))
        return at

    def close_open(self, tags: set[str]) -> None:
        """Close an open element of these tags, if it stands inside the nearest container."""
        depth = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if depth > self.boundaries[-1]:
            self.close_from(depth)

    def close_from(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.close()

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.add(" ")
        if self.open.get(tag):
            self.close_from(self.open[tag][-1])

    def close(self) -> None:
        element = self.stack.pop()
        self.open[element.tag].pop()
        if element.tag in BOUNDARY:
            self.boundaries.pop()
        parent = self.stack[-1].path
        if self.tree and element.path != parent:
            text = " ".join("".join(element.own).split())
            mine = self.elements.get(element.path) or self.elements.setdefault(element.path, Node(parent, len(self.stack)))
            mine.presentation = xxhash.xxh3_64_intdigest(",".join(element.children), seed=mine.presentation)
            if text:
                mine.content = xxhash.xxh3_64_intdigest(text, seed=mine.content)
            mine.children += len(element.children)
            mine.times += 1
            mine.article |= element.tag == "article" and not element.dropped


def path_key(parent: int, label: str) -> int:
    """The name of an element by that of the one above it and its tag and classes."""
    return xxhash.xxh3_64_intdigest(label, seed=parent & ((1 << 64) - 1)) - (1 << 63)


ELEMENT = "host string, path bigint, parent bigint, depth int, presentation bigint, content bigint, children bigint, share double, own_share double, article boolean"
ELEMENT_TYPES = {"host": pa.string(), "depth": pa.int32(), "share": pa.float64(), "own_share": pa.float64(), "article": pa.bool_()}


def emit_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's paths with hashes of presentation and content (null without text of its own, if there are children),
    the number of children, and the shares of the element in its parent and of its own text in itself."""
    names = [column.split()[0] for column in ELEMENT.split(", ")]
    for batch in slices(batches, "html"):
        rows: dict[str, list] = {k: [] for k in names}
        for host, markup in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            elements = Page(markup or "", tree=True).elements
            for path, node in elements.items():
                own = node.content != 0 or node.children == 0
                above = elements.get(node.parent)
                values = (
                    host,
                    path,
                    node.parent,
                    node.depth,
                    node.presentation - (1 << 63),
                    node.content - (1 << 63) if own else None,
                    node.children,
                    node.times / (above.children + (above.content != 0)) if above else 1.0,
                    1 / (node.children + 1) if own else 0.0,
                    node.article,
                )
                for name, value in zip(names, values, strict=True):
                    rows[name].append(value)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, ELEMENT_TYPES.get(k, pa.int64())) for k, v in rows.items()})


def emit_texts(hints: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            low: dict[tuple, frozenset[int]] = {}
            texts = []
            for markup, branches in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
                known = low.setdefault(tuple(branches or ()), frozenset(branches or ()))
                texts.append(Page(markup, known, hints=hints).text() if markup else "")
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": counts})

    return emit


def element_importance(elements: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, pages, importance, highest) of the style tree's elements, from the pages' paths: the composite
    importance, and the highest one of the element and all under it, null where one of them can't be low."""

    def shares(*columns: str) -> DataFrame:
        sums = (F.sum(c).alias(c) for c in ("children", "share", "own_share"))
        return elements.groupBy("host", "path", *columns).agg(F.count("*").alias("c"), *sums, F.max("article").alias("article"), F.first("parent").alias("parent"), F.first("depth").alias("depth"))

    base = F.log(F.sum("c"))
    looks = shares("presentation").groupBy("host", "path").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.sum("c").alias("pages"),
        *(F.sum(c).alias(c) for c in ("children", "share", "own_share")),
        F.max("article").alias("article"),
        F.when(F.sum("c") > 1, (F.sum("c") * base - F.sum(F.col("c") * F.log("c"))) / (F.sum("c") * base)).otherwise(1.0).alias("presentation"),
    )
    texts = elements.filter("content is not null").groupBy("host", "path", "content").agg(F.count("*").alias("c"))
    contents = texts.groupBy("host", "path").agg(F.sum("c").alias("texts"), F.when(F.sum("c") > 1, 1 - F.avg(F.log("c")) / base).otherwise(1.0).alias("content"))
    nodes = checkpointed(looks.join(contents, ["host", "path"], "left"))

    # From the deepest level up: children pass their importance, weighted by their share, to the parent.
    weight = F.pow(F.lit(DECAY), F.col("children") / F.col("pages"))
    below = (F.coalesce("passed", F.lit(0.0)) + F.col("own_share") * F.coalesce("content", F.lit(0.0))) / F.col("pages")
    kept = F.col("article") | (F.col("pages") < least_pages) | F.coalesce(F.col("texts") < least_pages, F.lit(False)) | F.coalesce("kept_below", F.lit(False))
    judged = passed = None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 1, 0, -1):
        level = nodes.filter(F.col("depth") == depth)
        if passed is None:
            level = level.withColumns({"passed": F.lit(0.0), "high_below": F.lit(0.0), "kept_below": F.lit(False)})
        else:
            level = level.join(passed, ["host", "path"], "left")
        level = level.withColumn("importance", (1 - weight) * F.col("presentation") + weight * below)
        level = checkpointed(level.select("host", "path", "parent", "pages", "share", "importance", F.greatest("importance", "content", "high_below").alias("high"), kept.alias("kept")))
        passed = level.groupBy("host", F.col("parent").alias("path")).agg(F.sum(F.col("share") * F.col("importance")).alias("passed"), F.max("high").alias("high_below"), F.max("kept").alias("kept_below"))
        found = level.select("host", "path", "pages", "importance", F.when(~F.col("kept"), F.col("high")).alias("highest"))
        judged = found if judged is None else judged.unionByName(found)
    return judged


def extract_texts(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    hints: bool = True,
    least_pages: int = LEAST_PAGES,
    least_importance: float = LEAST_IMPORTANCE,
) -> DataFrame:
    """Per row: its id, url, text and n_chars (code points). Without ``hints`` only the style tree removes elements."""
    ship(pages.sparkSession)
    rows = columns_of(pages, id=id_column, url=url_column, html=html_column).withColumn("host", host_and_path(F.col("url"))[0])
    elements = rows.select("host", "html").mapInArrow(emit_elements, ELEMENT)
    judged = element_importance(checkpointed(elements), least_pages)
    low = judged.filter(F.col("highest") < least_importance)
    low = checkpointed(low.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("low")))
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_BRANCHES:
        low = F.broadcast(low)
    joined = rows.join(low, "host", "left").select("id", "url", "html", "low")
    texts = joined.mapInArrow(emit_texts(hints), f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
    return texts.withColumnsRenamed({"id": id_column, "url": url_column})
