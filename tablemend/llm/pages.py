"""Main text of web pages, with site templates removed by counting element subtrees per host.

A first pass hashes the block elements of every page from the leaves up. Spark counts in how many different contents of a host each
subtree occurs; those that recur across many are the site's template. A second pass writes the text of what is left.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from tablemend.llm.common import extended, stored, text_slices, with_fields
from tablemend.llm.urls import host_of
from tablemend.operators.joins import join_per_key

TAG = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*)|[!?][^>]*(?:>|$)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)?)?)*+)(?P<close>>|$))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))?)?""")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img nobr picture source".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Elements and names that are never part of an article.
DROPPED = frozenset(
    "head title script style noscript template iframe object embed svg canvas audio video nav footer aside button select textarea input "
    "dialog menu search map noembed noframes datalist".split()
)
NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside breadcrumb breadcrumbs cookie cookies consent gdpr notice notices banner "
    "alert popup modal overlay newsletter subscribe subscription signup promo promotion ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored sponsors share sharing social related recommended recommendations comment comments disqus replies respond form login "
    "search searchbox pagination pager widget widgets toolbar skiplink".split()
)
COMMENTS = frozenset("comment comments disqus replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_NAMES = frozenset(("articlebody", "article-body", "entry-content", "post-content", "post-body", "article-content", "main-content"))
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    dropped: bool  # by its kind or its very name, or within such an element
    main: bool
    header: bool = False  # within a header, and in none of its headings
    doubt: Element | None = None  # the innermost element here or above that a part of a name, or being a form, speaks against
    block: Element | None = None  # itself, or the block element that holds it
    parts: list[str] = field(default_factory=list)  # of the subtree's content, for its hash
    hash: int = 0
    size: int = 0  # characters within, of an element in doubt
    landmark: bool = False  # holds the page's main part
    cut: bool = False
    seen: bool = False


@dataclass
class Block:
    text: str
    element: Element  # the innermost block element that holds it


def _attributes(rest: str) -> dict[str, str]:
    return {n.lower(): markup.unescape(a or b or c) for n, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /\n\t\r") else {}


def _unwanted(tag: str, attributes: dict[str, str], in_main: bool) -> str:
    """``no`` if an element goes whatever it holds, ``doubt`` if it goes unless it holds most of the page, else empty."""
    if tag in DROPPED or tag == "header" and not in_main:
        return "no"
    doubt = "doubt" if tag == "form" else ""
    if not attributes or tag in ("html", "body", "main") or tag in HEADINGS:
        return "no" if "hidden" in attributes and tag not in ("html", "body") else doubt
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "no"
    if attributes.get("role", "").lower() in ROLES:
        return doubt if tag == "form" else "no"
    for name in (*attributes.get("class", "").split(), *attributes.get("id", "").split()):
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        if name.lower() in NAMES or parts & COMMENTS or tag in INLINE and parts & NAMES:
            return "no"
        if parts & NAMES:
            doubt = "doubt"
    return doubt


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page in order, without what is dropped by kind or name, and its block elements with hashes."""
    root = Element("", None, False, False)
    root.block = root
    stack, blocks, elements, runs = [root], [], [], []
    doubts: list[Element] = []  # outer ones first
    opened: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join("".join(runs).split())
        runs.clear()
        if text:
            own = stack[-1].block
            own.parts.append(text)
            if not stack[-1].dropped:
                blocks.append(Block(text, own))

    def pop() -> None:
        element = stack[-1]
        if element.tag not in INLINE:
            flush()
            element.hash = xxhash.xxh64_intdigest("\0".join([element.tag, *element.parts]), 7) - 2**63
            element.parts = []
            stack[-2].parts.append(f"\1{element.hash}")
            elements.append(element)
        opened[element.tag] -= 1
        stack.pop()

    def text(run: str) -> None:
        if run and not stack[-1].dropped:
            runs.append(markup.unescape(run) if "&" in run else run)

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            text(page[at:] if (cut := page.find("<", at)) < 0 else page[at:cut] if re.match(r"<[/!?A-Za-z]", page[cut:]) and ">" not in page[cut:] else page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag or not m["close"]:
            continue
        if m["end"]:
            if not opened[tag]:
                continue
            while stack[-1].tag != tag:
                pop()
            pop()
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES[tag]:
                    break
                if stack[i].tag in CLOSES[tag]:
                    while len(stack) > i:
                        pop()
                    break
        if tag in VOID:
            if tag in ("br", "wbr", "hr") and not stack[-1].dropped:
                runs.append("" if tag == "wbr" else " ")
            if tag == "hr":
                flush()
            continue
        attributes = _attributes(m["rest"])
        parent = stack[-1]
        if tag not in INLINE:
            flush()
        names = {n.lower() for n in attributes.get("class", "").split()} | {attributes.get("id", "").lower(), attributes.get("itemprop", "").lower()}
        landmark = tag == "main" or attributes.get("role", "").lower() == "main" or bool(names & MAIN_NAMES)
        main = parent.main or landmark or tag == "article" or attributes.get("role", "").lower() == "article"
        unwanted = "no" if parent.dropped else _unwanted(tag, attributes, parent.main)
        header = tag == "header" or parent.header and tag not in HEADINGS
        element = Element(tag, parent, unwanted == "no", main, header, parent.doubt)
        element.block = parent.block if tag in INLINE else element
        if unwanted == "doubt":
            element.doubt = element
            doubts.append(element)
        if landmark and not element.dropped:
            held = element.doubt
            while held is not None and not held.landmark:
                held.landmark, held = True, held.parent.doubt
        stack.append(element)
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            pop()
    while len(stack) > 1:
        pop()
    flush()
    # What only a part of a name speaks against goes if it holds less than half of the page's text, and not its main part.
    for b in blocks:
        if b.element.doubt is not None:
            b.element.doubt.size += len(b.text)
    total = sum(len(b.text) for b in blocks)
    for e in reversed(doubts):
        if (outer := e.parent.doubt) is not None:
            outer.size += e.size
    for e in doubts:
        outer = e.parent.doubt
        e.cut = outer is not None and outer.cut or not e.landmark and 2 * e.size < total
    # A header within an article keeps its headings only.
    return [b for b in blocks if not b.element.header and not (b.element.doubt and b.element.doubt.cut)], elements


def chosen(blocks: list[Block]) -> list[Block]:
    """The blocks of the article, where the page marks one; else all."""
    return [b for b in blocks if b.element.main] or blocks


def holders(blocks: list[Block]) -> list[Element]:
    """All elements that hold one of the blocks, each once."""
    out = []
    for b in blocks:
        element = b.element
        while element.parent is not None and not element.seen:
            element.seen = True
            out.append(element)
            element = element.parent
    return out


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page, host, html): its content, whether it marks an article, and the hashes of the
    subtrees that hold its text."""
    new = [StructField("content", LongType()), StructField("marked", BooleanType()), StructField("hashes", ArrayType(LongType()))]
    schema = StructType([pages.schema["page"], pages.schema["host"], *new])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "html"):
            contents, marked, hashes = [], [], []
            for t in texts:
                blocks = chosen(parse(t or "")[0])
                contents.append(xxhash.xxh64_intdigest("\n".join(b.text for b in blocks), 8) - 2**63)
                marked.append(bool(blocks) and blocks[0].element.main)
                hashes.append(sorted({e.hash for e in holders(blocks) if e.tag not in INLINE}))
            yield extended(batch, arrow, {"content": pa.array(contents), "marked": pa.array(marked), "hashes": pa.array(hashes, arrow.field("hashes").type)})

    return pages.mapInArrow(run, schema)


def templates(
    trees: DataFrame, least_pages: int = 4, least_share: float = 0.3, least_pages_marked: int = 10, least_share_marked: float = 0.8
) -> DataFrame:
    """(subtree, anywhere, outside) of subtrees that recur in many different contents of a host.

    Copies of a content count once, so a widely copied article is no template. Within a marked article a subtree must recur in nearly all of the
    host's contents; ``anywhere`` says that it does, ``outside`` that it counts outside marked articles.
    """
    own = trees.where("host <> ''")
    seen = own.select("content", F.explode("hashes").alias("hash"), "host").select(_subtree(), F.xxhash64("host").alias("site"), "content").distinct()
    seen = seen.groupBy("subtree").agg(F.count("*").alias("n"), F.min("site").alias("site"))
    seen = seen.where(F.col("n") >= min(least_pages, least_pages_marked))
    totals = own.select(F.xxhash64("host").alias("site"), "content").distinct().groupBy("site").agg(F.count("*").alias("total"))
    seen = join_per_key(seen, totals, ["site"], "inner")
    everywhere = (F.col("n") >= least_pages_marked) & (F.col("n") >= least_share_marked * F.col("total"))
    outside = (F.col("n") >= least_pages) & (F.col("n") >= least_share * F.col("total"))
    return seen.select("subtree", everywhere.alias("anywhere"), outside.alias("outside")).where("anywhere OR outside")


def _subtree() -> Column:
    """A subtree of a host as one number: the keys of its counts are most of what this operator shuffles beside the pages."""
    return F.xxhash64("host", "hash").alias("subtree")


def packed(pages: DataFrame) -> DataFrame:
    """``pages`` with their markup compressed, for the way through the shuffle."""
    schema = with_fields(pages, [StructField("html", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "html"):
            yield extended(batch, arrow, {"html": pa.array([None if t is None else zlib.compress(t.encode(), 1) for t in texts], pa.binary())})

    return pages.mapInArrow(run, schema)


def remaining(page: str, template: set[int]) -> list[str]:
    """Texts of the article's blocks that are in no template subtree.

    If the template would take more than half of a marked article's characters, it is an article that the site shows often, and stays.
    """
    blocks, elements = parse(page)
    blocks = kept = chosen(blocks)
    if template:
        for e in reversed(elements):  # parents come before what they hold
            e.cut = e.hash in template or e.parent.block.cut
        kept = [b for b in blocks if not b.element.cut]
    if kept != blocks and blocks[0].element.main and 2 * sum(len(b.text) for b in kept) < sum(len(b.text) for b in blocks):
        kept = blocks
    return [b.text for b in kept]


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    The text is the page's article: blocks joined by two line breaks, white space within a block made one space, character
    references decoded. Null or empty markup has an empty text; a page without a host has no template. Broken or cut markup is
    read as far as it goes. Repeated rows are all kept; other columns are dropped, so none can clash.

    A name that says menu, notice, comments and the like removes its element; a name of which that is only a part (``has-sidebar``) or a
    form removes it unless it holds half of the page's text or its main part. Very long and deeply nested pages are read in linear time.

    Markup is shuffled once, compressed, by page, to meet the page's own template subtrees; a hot host is never in one task, as
    subtrees are counted by host and hash after map-side combination.
    """
    rows = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("html")).withColumn("host", host_of(F.col("_url")))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    trees = stored(subtree_hashes(rows.select("page", "host", "html")), "subtrees")
    found = templates(trees)
    # Only subtrees of a page that are a template somewhere on its host; one row per page that has any.
    mine = trees.select("page", "host", "marked", F.explode("hashes").alias("hash")).select("page", "marked", "hash", _subtree())
    mine = join_per_key(mine, found, ["subtree"], "inner").where("anywhere OR (outside AND NOT marked)")
    mine = mine.groupBy("page").agg(F.collect_set("hash").alias("template"))
    joined = join_per_key(packed(rows.select("_id", "_url", "page", "html")), mine, ["page"])
    schema = StructType([rows.schema["_id"], rows.schema["_url"], StructField("text", StringType(), False), StructField("n_chars", LongType(), False)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (None if x is None else zlib.decompress(x).decode() for x in batch.column(batch.schema.get_field_index("html")).to_pylist())
            sets = batch.column(batch.schema.get_field_index("template")).to_pylist()
            out = ["\n\n".join(remaining(t or "", set(s or ()))) for t, s in zip(texts, sets)]
            yield extended(batch, arrow, {"text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())})

    return joined.mapInArrow(run, schema).select(F.col("_id").alias(id), F.col("_url").alias(url), "text", "n_chars")
