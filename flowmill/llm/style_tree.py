"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element is a node named by its path of tags,
classes and ids, and at each node that holds text the tree keeps how many pages have it,
how often it occurs in each (its presentation) and which texts it held in how many pages (its content).

Importance by entropy, with m the number of pages that have the node:

- content: 1 minus the mean over its texts of log k / log m, k being the pages that hold the text. What
  stands on every page has importance 0, what stands on one has 1.
- presentation: the entropy to base m of how often the node occurs in a page. A menu always has its
  places, an article has as many paragraphs as it needs.
- both: 1 - (1 - content) * (1 - presentation); then the smaller of the host's tree and the tree of
  all hosts, which knows templates shared between hosts of few pages. A node of one page has importance 1.

Branches below ``least`` are removed from each page. Names are priors: what HTML or a class calls navigation,
advert, form, comment and the like (NOISE_TAGS, NOISE_NAMES) is never important, what is an ``article``
or ``main`` element outside of these always is, so that copied articles stay. The trees decide
on everything else.

How it holds at scale: pages are parsed where they lie; only (host, node, text hash) and counts are shuffled, combined
before the shuffle, and exact copies of a page count once. A host with a third of all pages is
spread by node and text. A page's nodes meet the removed ones in a join salted by page, and a
page's text moves at most once, to meet its own list of removed nodes.

Defined cases: null html gives empty text; null url, or one without ``://``, is the empty host; repeated rows
each keep their row; an empty table gives no rows. Text outside elements belongs to the root.
White space is what Python's str.split takes for it, the no-break space included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.session import save_and_reload

LEAST_IMPORTANCE = 0.8
SALTS = 32

# Elements and names.
NOISE_TAGS = frozenset("nav aside footer form dialog menu button select textarea".split())
DROPPED_TAGS = frozenset("script style noscript template iframe object svg canvas head title".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets related recommended share sharing social "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search "
    "form comment comments commentlist disqus respond replies copyright legal toolbar pagination pager complementary contentinfo".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies".split())
ARTICLE_NAMES = frozenset("article post entry content main story body text".split())
ARTICLE_TAGS = frozenset(["article", "main"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split())
#: A start tag that ends an open element of these, up to the given containers.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
IN_PARAGRAPH = frozenset(["td", "th", "li", "div", "section", "article", "table", "body", "blockquote", "button"])

TREE, NOISE, ARTICLE = 0, 1, 2
_FIRM, _COMMENT = 3, 4  # noise that an article element inside does not end

NODE = pa.struct([("node", pa.int64()), ("role", pa.int8()), ("text", pa.string())])
COUNT = pa.struct([("node", pa.int64()), ("times", pa.int32())])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Element:
    __slots__ = ("tag", "node", "role")

    def __init__(self, tag: str, node: int, role: int):
        self.tag, self.node, self.role = tag, node, role


class PageTree(HTMLParser):
    """Text blocks of a page in page order: (node, role, text).

    A block is the text between two starts or ends of elements that are not inline, white space in it
    made one space. Its node is a hash of the path of named elements above it.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", _hash(""), TREE)]
        self.blocks: list[tuple[int, int, str]] = []
        self.parts: list[str] = []
        self.dropped: list[str] = []  # open elements whose text is no text
        self.labels: dict[tuple, int] = {}
        self.feed(html)
        self.close()
        self._end_block()

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                top = self.stack[-1]
                role = NOISE if top.role in (_FIRM, _COMMENT) else top.role
                self.blocks.append((top.node, role, text))

    def _role(self, tag: str, attrs: dict[str, str], above: int) -> int:
        if above in (_FIRM, _COMMENT):
            return above
        names = set(re.findall("[a-z]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
        kind = attrs.get("role", "").lower()
        if names & COMMENT_NAMES and tag not in ("html", "body"):
            return _COMMENT
        if tag in NOISE_TAGS or kind in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
            return _FIRM
        if tag in ARTICLE_TAGS or kind in ("main", "article"):
            return ARTICLE
        if tag == "header" and above != ARTICLE:
            return NOISE
        if tag not in ("html", "body") and names & NOISE_NAMES and not names & ARTICLE_NAMES:
            return _FIRM if above == ARTICLE else NOISE
        return above

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dropped:
            if tag in DROPPED_TAGS and tag not in VOID_TAGS:
                self.dropped.append(tag)
            elif tag == "body":
                self.dropped.clear()
            if self.dropped or tag == "body":
                return
        if tag in DROPPED_TAGS:
            self.dropped.append(tag)
            self.parts.append(" ")
            return
        if tag in VOID_TAGS:
            if tag in INLINE_TAGS:
                self.parts.append(" " if tag == "br" else "")
            else:
                self._end_block()
            return
        if tag not in INLINE_TAGS:
            self._end_block()
            self._close_implied(tag)
        given = {k: v or "" for k, v in attrs}
        top = self.stack[-1]
        role = self._role(tag, given, top.role)
        if tag in INLINE_TAGS and role == top.role:
            return  # formatting is no node of the tree
        if tag in INLINE_TAGS:
            self._end_block()
        key = (top.node, tag, given.get("class", ""), re.sub("[0-9]+", "#", given.get("id", "")))
        node = self.labels.get(key)
        if node is None:
            node = self.labels[key] = _hash("\x00".join(map(str, key)))
        self.stack.append(_Element(tag, node, role))

    def _close_implied(self, tag: str) -> None:
        ends, within = CLOSES.get(tag, (frozenset(["p"]), IN_PARAGRAPH))
        for at in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[at].tag
            if open_tag in ends:
                del self.stack[at:]
                return
            if open_tag in within:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
            return
        if tag in INLINE_TAGS:
            if self.stack[-1].tag == tag:
                self._end_block()
                self.stack.pop()
            return
        self._end_block()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                del self.stack[at:]
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)


def host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, lower-cased."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), F.lit("")))


def page_blocks(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(kept columns, _uid, _host, _blocks, _nodes), a stored table of parsed pages, one row a page."""
    rows = pages.select(*keep, F.monotonically_increasing_id().alias("_uid"), host(F.col(url_col)).alias("_host"),
                        F.col(html_col).alias("_html"))
    schema = rows.drop("_html").schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.schema.get_field_index("_html")
            held = [c for i, c in enumerate(batch.columns) if i != plain]
            names = [n for i, n in enumerate(batch.schema.names) if i != plain]
            blocks, nodes = [], []
            for html in batch.column(plain):
                found = PageTree(html.as_py() or "").blocks
                blocks.append(found)
                nodes.append(list(Counter(b[0] for b in found).items()))
            as_dicts = [[{"node": n, "role": r, "text": t} for n, r, t in page] for page in blocks]
            counted = [[{"node": n, "times": t} for n, t in page] for page in nodes]
            yield pa.record_batch([*held, pa.array(as_dicts, pa.list_(NODE)), pa.array(counted, pa.list_(COUNT))],
                                  names=[*names, "_blocks", "_nodes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return save_and_reload(rows.mapInArrow(
        parse, f"{kinds}, _blocks array<struct<node:bigint,role:tinyint,text:string>>, "
               "_nodes array<struct<node:bigint,times:int>>"), "pages")


def _entropies(content: DataFrame, presentation: DataFrame, by: list[str]) -> DataFrame:
    """(by, m, importance) of nodes from (by, text, k) and (by, times, pages)."""
    shown = presentation.groupBy(*by).agg(F.sum("pages").alias("m"), F.sum(F.col("pages") * F.ln("pages")).alias("s"))
    held = content.groupBy(*by).agg(F.avg(F.ln("k")).alias("mean_log"))
    wide = F.ln(F.col("m"))
    both = shown.join(held, by)
    dull = F.least(F.lit(1.0), F.col("mean_log") / wide)  # 1 - content
    varied = (wide - F.col("s") / F.col("m")) / wide
    importance = F.when(F.col("m") > 1, 1 - dull * (1 - varied)).otherwise(F.lit(1.0))
    return both.select(*by, "m", importance.alias("importance"))


def node_importance(blocks: DataFrame) -> DataFrame:
    """(_host, node, importance, site_importance, m): the nodes of every host's tree."""
    texts = F.array_distinct(F.transform("_blocks", lambda b: F.struct(
        b["node"].alias("node"), F.xxhash64(F.regexp_replace(F.lower(b["text"]), "[0-9]+", "#")).alias("text"))))
    pages = blocks.select("_host", F.xxhash64(F.col("_blocks")).alias("_digest"), texts.alias("_texts"), "_nodes")
    # Exact copies are one page; the copies' arrays are the same.
    pages = save_and_reload(pages.groupBy("_host", "_digest").agg(
        F.first("_texts").alias("_texts"), F.first("_nodes").alias("_nodes")), "trees")
    content = pages.select("_host", F.explode("_texts").alias("x")).groupBy("_host", "x.node", "x.text").agg(F.count(F.lit(1)).alias("k"))
    content = save_and_reload(content, "content")
    presentation = save_and_reload(pages.select("_host", F.explode("_nodes").alias("x")).groupBy(
        "_host", "x.node", "x.times").agg(F.count(F.lit(1)).alias("pages")), "presentation")
    sites = _entropies(content, presentation, ["_host", "node"])
    everywhere = _entropies(content.groupBy("node", "text").agg(F.sum("k").alias("k")),
                            presentation.groupBy("node", "times").agg(F.sum("pages").alias("pages")), ["node"])
    everywhere = everywhere.select("node", F.col("importance").alias("all_importance"))
    return sites.withColumnRenamed("importance", "site_importance").join(everywhere, "node").select(
        "_host", "node", F.least("site_importance", "all_importance").alias("importance"), "site_importance", "m")


def main_text(blocks: DataFrame, importance: DataFrame, least: float = LEAST_IMPORTANCE, named: bool = True) -> DataFrame:
    """``blocks`` with ``text``: what is left of each page without branches of low importance.

    Without ``named`` the trees alone decide.
    """
    open_roles = [TREE] if named else [TREE, NOISE, ARTICLE]
    low = importance.filter(F.col("importance") < least).select("_host", "node")
    low = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = F.array_distinct(F.transform(F.filter("_blocks", lambda b: b["role"].isin(open_roles)), lambda b: b["node"]))
    asked = blocks.select("_uid", "_host", F.explode(mine).alias("node"))
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int"))
    removed = asked.join(low, ["_host", "node", "_salt"]).groupBy("_uid").agg(F.collect_list("node").alias("_removed"))
    removed = save_and_reload(removed, "removed")  # of known size: the texts stay where they are if it is small
    joined = blocks.join(removed, "_uid", "left").withColumn("_removed", F.coalesce("_removed", F.array().cast("array<bigint>")))
    if named:
        kept = F.filter("_blocks", lambda b: (b["role"] == ARTICLE) | (
            (b["role"] == TREE) & ~F.array_contains(F.col("_removed"), b["node"])))
    else:
        kept = F.filter("_blocks", lambda b: ~F.array_contains(F.col("_removed"), b["node"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.withColumn("text", text).drop("_blocks", "_nodes", "_removed", "_uid", "_host")


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), least: float = LEAST_IMPORTANCE) -> DataFrame:
    """The kept columns and ``text``, the main text of every page (columns url and html)."""
    blocks = page_blocks(pages, keep=keep)
    return main_text(blocks, node_importance(blocks), least)
