"""Main text of web pages, with site template removal.

A page is parsed once, by one pass over its tags, into blocks of text and the subtrees of block elements, each with a hash built
from its children's and the range of blocks that it holds. Subtrees are counted by host in Spark, and those that recur on many
different pages of a host are the site's template; copies of one page count once. Their blocks are deleted. What never is main
text by its element, or by a class, id or role that names its purpose, is left out from the start. If the page marks its article
(article, main, role=main) and the marks hold at least half of the text that is not left out, the text is what is left inside.
Otherwise marks are ignored until the template is gone; if they hold half of the rest then, the text is what is inside, else all of it.

A name counts as a purpose only as a whole (`sidebar`, `ad-slot`, but not `no-sidebar` or `share-price`), never on a paragraph
or heading, never on what holds the marked article, and, but for comments, never on what holds most of the page's text. An
article named as a comment is one, and marks nothing. A label stays where it stands in a line of other text.

Quotes in a tag count only after an equals sign, and only if a space, a slash, a quote or the tag's end follows the second one;
any other quote is a character, so that a tag ends at the first `>` after it.

Inside a marked article only containers (div, section, aside, lists, tables) can be template, never its headings and
paragraphs, so a sentence that many pages quote stays.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, materialize, table

#: A subtree is template from so many different pages of a host on, if it is on at least this share of them, or on ENOUGH pages.
MIN_PAGES, MIN_SHARE, ENOUGH = 5, 0.2, 500
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas video audio".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("aside details div dl fieldset figure footer form header menu nav ol section table ul".split())
NEVER = frozenset("head nav header footer aside form button select dialog menu label input".split()) | RAW
#: What closes an open paragraph, and which open elements an element of the same family closes.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words that, as a whole class, id or role, name something other than the main text.
PURPOSE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup comment comments disqus replies respond share sharing "
    "social related recommended recommendations widget widgets footer header masthead copyright complementary contentinfo search toolbar".split()
)
#: Words that may stand beside those in a name; and beside comments, links to other texts and adverts alone.
BESIDE = frozenset(
    "site page top bottom left right list box block area container wrapper wrap inner outer section bar link links item items slot primary secondary global main "
    "form panel group row col column holder module region unit zone label button buttons icon icons".split()
)
BESIDE_SOFT = frozenset("post posts article articles entry story stories content user reader reader's".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
SOFT = COMMENTS | frozenset("ad ads advert adverts sponsored related recommended share sharing social newsletter".split())
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/"'>]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PLAIN = frozenset("html body main p h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*"(?=[\s/>"']|\Z)|=\s*+'[^']*'(?=[\s/>"']|\Z)|[^>])*+)(?:>|\Z)""", re.S)


def names(attrs: str) -> list[tuple[str, str]]:
    """(attribute, name) of each name in class, id and role."""
    return [(kind.lower(), name) for kind, value in ATTRIBUTE.findall(attrs) if kind.lower() in ("class", "id", "role") for name in value.strip("\"'").split()]


def purpose(tag: str, given: list[tuple[str, str]]) -> str | None:
    """'comments', 'other', or None: what the names of an element say that it is. An article can only be comments."""
    if not given or tag in PLAIN:
        return None
    found = None
    for _, token in given:
        words = {w.lower() for w in WORDS.findall(token)}
        named = words & PURPOSE
        rest = {w for w in words - PURPOSE if not w.isdigit()}
        if named and rest <= (BESIDE | BESIDE_SOFT if named & SOFT else BESIDE):
            if named & COMMENTS:
                return "comments"
            found = None if tag == "article" else "other"
    return found


class Node:
    """An element: parts are its texts and children's hashes in order, size the characters of text that it holds, line those that
    stand in it without a block or label of their own, block the element that counts them."""

    __slots__ = ("tag", "attrs", "parent", "parts", "size", "line", "block", "named", "heading", "role", "mains", "hash", "inside", "gone", "first", "stop", "articles")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[str] = []
        self.size, self.line, self.hash, self.articles = 0, 0, 0, 0
        self.block = self if parent is None or tag in BLOCK or tag == "label" else parent.block
        given = names(attrs) if attrs else []
        self.named = purpose(tag, given)
        self.heading = any(name.lower() == "header" for _, name in given)
        self.role = any(kind == "role" and name.lower() == "main" for kind, name in given)
        main = (tag in ("article", "main") or self.role) and self.named != "comments"
        self.mains = int(main)
        self.inside = main or (parent is not None and parent.inside)
        self.gone = False
        self.first = self.stop = -1

    def end(self) -> None:
        self.hash = _hash("\x02".join((self.tag, " ".join(self.attrs.split()), *self.parts)))
        self.parts = []
        if self.parent is not None:
            self.parent.parts.append(f"\x03{self.hash:x}")
            self.parent.mains += self.mains
            if self.tag not in NEVER or self.tag in ("form", "header"):
                self.parent.size += self.size


OPEN, CLOSE, BREAK = "open", "close", "break"


def parse(source: str) -> tuple[list[Node], list[tuple[str, Node, str | None]]]:
    """Elements in page order, and what happens in page order: (text, element, None), or ("", element, OPEN, CLOSE or BREAK)."""
    root = Node("#root", "", None)
    nodes, events, stack = [root], [], [root]
    open_tags: Counter[str] = Counter()
    at, n = 0, len(source)

    def say(text: str) -> None:
        events.append((text, stack[-1], None))
        if folded := " ".join(text.split()):
            stack[-1].parts.append(folded)
            stack[-1].size += len(folded)
            stack[-1].block.line += len(folded)

    def close(k: int) -> None:
        for node in reversed(stack[k:]):
            node.end()
            open_tags[node.tag] -= 1
            if node.tag in BLOCK:
                events.append(("", node, CLOSE))
        del stack[k:]

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            elif tag == "p":
                events.append(("", stack[-1], BREAK))
            continue
        if tag in SIBLINGS:
            if any(open_tags[t] for t in SIBLINGS[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in LIMITS[tag]:
                        break
                    if stack[k].tag in SIBLINGS[tag]:
                        close(k)
                        break
        elif tag in BLOCK and open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        node = Node(tag, m[3], stack[-1])
        nodes.append(node)
        if tag in BLOCK:
            events.append(("", node, OPEN))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            node.end()
            if tag in BLOCK:
                events.append(("", node, CLOSE))
            if tag == "br":
                events.append((" ", stack[-1], None))
            continue
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            node.parts.append(" ".join(source[at : end.start() if end else n].split()))
            node.end()
            at = end.end() if end else n
            continue
        stack.append(node)
        open_tags[tag] += 1
    close(1)
    root.end()
    return nodes, events


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def leave_out(nodes: list[Node]) -> None:
    """Marks what is never main text; parents come first."""
    half = nodes[0].size / 2
    for node in nodes[1:]:
        up = node.parent
        named = node.named
        if named and (node.mains or named != "comments" and node.size > half):
            named = None
        if named and up.inside and not up.gone and node.heading and named != "comments":
            named = None  # an article's own heading
        never = node.tag in NEVER
        if node.tag == "form" and (node.mains or node.size > half):
            never = False  # the page's wrapper
        if node.tag == "header" and up.inside and not named:
            never = False  # an article's own heading
        if node.tag == "label" and up.block.line:
            never = False  # a part of a sentence
        node.gone = up.gone or never or named is not None


def can_be_template(node: Node, marked: bool) -> bool:
    if marked and node.inside:
        return node.tag in CONTAINERS and not (node.tag == "div" and node.role)
    return node.tag in BLOCK and node.tag not in ("html", "body")


def most(inside: list[bool], sizes: list[int]) -> bool:
    """Whether what is inside holds at least half of all."""
    held = sum(n for i, n in zip(inside, sizes) if i)
    return held > 0 and 2 * held >= sum(sizes)


def page(source: str) -> tuple[list[str], list[tuple[int, int, int, int]], list[bool]]:
    """The blocks of text of a page that could be main text, character references resolved and white space folded; (hash,
    first block, block after the last, marked articles) of each subtree that could be template, parents first; and for each block
    whether it is inside a marked article. If marks hold most of the text, only what is inside is given."""
    nodes, events = parse(source)
    leave_out(nodes)
    texts = [(node.inside, len(" ".join(text.split()))) for text, node, what in events if what is None and not node.gone]
    marked = most([i for i, _ in texts], [n for _, n in texts])
    blocks: list[str] = []
    inside: list[bool] = []
    now: list[str] = []
    held = False
    for text, node, what in [*events, ("", nodes[0], BREAK)]:
        if what is None:
            if not node.gone and (node.inside or not marked):
                now.append(text)
                held = held or node.inside
            continue
        if now:
            if block := " ".join(html_lib.unescape("".join(now)).split()):
                blocks.append(block)
                inside.append(held)
            now, held = [], False
        if what == OPEN:
            node.first = len(blocks)
        elif what == CLOSE:
            node.stop = len(blocks)
    for node in nodes[1:] if marked else ():
        if node.inside and not node.parent.inside and not node.gone and node.first < node.stop:
            up: Node | None = node
            while up is not None:
                up.articles += 1
                up = up.parent
    subtrees = [(_signed(n.hash), n.first, n.stop, n.articles) for n in nodes[1:] if not n.gone and 0 <= n.first < n.stop and can_be_template(n, marked)]
    return blocks, subtrees, inside


def strip(blocks: list[str], subtrees: list[tuple[int, int, int, int]], inside: list[bool], template: set[int] | frozenset[int]) -> str:
    """The text without the blocks of subtrees that are template; the page's last marked article never goes with what is around
    it or is it. If marks hold most of what is left, it is what they hold."""
    left = kept(subtrees, len(blocks), template)
    if most([inside[k] for k in left], [len(blocks[k]) for k in left]):
        left = [k for k in left if inside[k]]
    return "\n".join(blocks[k] for k in left)


def kept(subtrees: list[tuple[int, int, int, int]], n: int, template: set[int] | frozenset[int]) -> list[int]:
    """The numbers of the n blocks that no template holds."""
    if not template:
        return list(range(n))
    left = 0
    until = 0
    for _, first, stop, articles in subtrees:  # outermost ones
        if first >= until:
            left, until = left + articles, stop
    out, at, until = [], 0, 0
    for h, first, stop, articles in subtrees:
        if first < until or h not in template:
            continue
        if 0 < articles == left:
            continue
        left -= articles
        out += range(at, first)
        at = until = stop
    return [*out, *range(at, n)]


_SUBTREE = pa.struct([("h", pa.int64()), ("first", pa.int32()), ("stop", pa.int32()), ("articles", pa.int32())])
_PARSED = "blocks array<string>, texts array<long>, subtrees array<struct<h: long, first: int, stop: int, articles: int>>, inside array<boolean>"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, k1, k2, html) to what page() finds, with the blocks' hashes."""
    for batch in batches:
        blocks, texts, subtrees, marks = [], [], [], []
        for source in batch.column(4):
            b, trees, inside = page(source.as_py() or "")
            blocks.append(b)
            marks.append(inside)
            texts.append([_signed(_hash(t)) for t in b])
            subtrees.append([dict(zip(("h", "first", "stop", "articles"), t)) for t in trees])
        cols = [pa.array(blocks, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.int64())), pa.array(subtrees, pa.list_(_SUBTREE)), pa.array(marks, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], ["page_id", "url", "k1", "k2", "blocks", "texts", "subtrees", "inside"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, subtrees, inside, hashes = (batch.column(c).to_pylist() for c in (2, 3, 4, 5))
        got = [strip(b, [tuple(t.values()) for t in trees] if h else [], i, set(h or ())) for b, trees, i, h in zip(blocks, subtrees, inside, hashes)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], ["page_id", "url", "text"])


def host(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def often(rows: DataFrame, page: str, min_pages: int, min_share: float, enough: int) -> DataFrame:
    """(k1, h): what recurs, from distinct (k1, page, h) of all pages, h null where a page has none."""
    sites = rows.select("k1", page).distinct().groupBy("k1").agg(F.count(F.lit(1)).alias("pages"))
    counts = rows.filter("h is not null").groupBy("k1", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(sites, "k1").filter((F.col("n") >= enough) | (F.col("n") >= min_share * F.col("pages"))).select("k1", "h")


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH) -> DataFrame:
    """(k1, k2, hashes): for each page, named by hashes of host and url and of the html, its subtrees that are the site's template.

    Copies of a page count once: what recurs on pages with different html is template only if it also does on pages that
    differ in what doesn't recur. So an article under several urls, or in print and mobile variants, is no template of its own.
    """
    found = materialize(parsed.select("k1", "k2", "texts", "subtrees").dropDuplicates(["k1", "k2"]), "subtrees")
    each = found.select("k1", "k2", F.explode_outer(F.array_distinct("subtrees.h")).alias("h"))
    recurring = materialize(each.join(often(each, "k2", min_pages, min_share, enough), ["k1", "h"]).groupBy("k1", "k2").agg(F.collect_set("h").alias("hashes")), "recurring")
    kept = found.join(recurring, ["k1", "k2"], "left")
    shared = F.filter("subtrees", lambda s: F.array_contains("hashes", s["h"]))
    rest = F.filter("texts", lambda t, i: ~F.exists(shared, lambda s: (i >= s["first"]) & (i < s["stop"])))
    rest = F.when(F.col("hashes").isNull(), F.col("texts")).otherwise(rest)
    # a page without text is told from others by its html
    own = F.when(F.size("texts") == 0, F.col("k2")).otherwise(F.xxhash64(F.array_sort(F.array_distinct(rest))))
    kept = materialize(kept.select("k1", own.alias("own"), F.explode_outer("hashes").alias("h")).distinct(), "own")
    return recurring.select("k1", "k2", F.explode("hashes").alias("h")).join(often(kept, "own", min_pages, min_share, enough), ["k1", "h"]).groupBy("k1", "k2").agg(F.collect_set("h").alias("hashes"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH) -> DataFrame:
    """page_id, url and text of each row of pages (page_id, url, html).

    Null and empty html give an empty text; pages without a url share the empty host. Copies of a page on a host count once,
    and so do pages that differ only in what recurs. Variants of one page that each have a text of their own (a time of
    printing, say) count as different pages. Broken markup never fails: what is not closed ends with what contains it. Repeated
    rows stay; columns other than the three are not read. Empty tables give no rows.

    min_pages, min_share, enough: see templates(); a min_pages of 2 finds the template of the smallest hosts too.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    named = pages.select("page_id", "url", F.xxhash64(host(F.col("url"))).alias("k1"), F.xxhash64("html").alias("k2"), "html")
    parsed = materialize(named.mapInArrow(_pages, f"page_id {kinds['page_id']}, url {kinds['url']}, k1 long, k2 long, {_PARSED}"), "pages")
    found = materialize(templates(parsed, min_pages, min_share, enough), "templates")
    out = join_hot(parsed, found, ["k1", "k2"]).select("page_id", "url", "blocks", "subtrees", "inside", "hashes")
    return out.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_html_extraction": op10_html_extraction}
