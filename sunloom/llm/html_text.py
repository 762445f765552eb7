"""HTML main-text extraction with site template removal.

Every page is scanned into a small tree, and each element subtree is hashed.
Spark counts, for each host, on how many different pages a subtree stands;
subtrees that recur are deleted as the site's template, wherever they stand.
Menus, adverts and lists of links are templates from a small share of the host's
pages on, other blocks only on half of them, since articles quote each other.
Pages count as different by their two longest blocks, so near copies of an
article don't make its paragraphs a template.

Only what templates left goes through the fallback: elements dropped for their
role or name (a host with few pages, an advert that changes on every page), and
what stands beside an article that holds most of the remaining text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import nlargest
from html import unescape
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sunloom.llm.common import cut

#: A template stands on at least so many different pages of its host, and on this share of them:
#: menus, adverts and lists of links beside the article, and all other blocks.
SIDE_PAGES, SIDE_SHARE = 3, 0.01
BODY_PAGES, BODY_SHARE = 10, 0.5
#: Remaining characters beside an article that are never taken for the page's main text.
BESIDE_CHARS = 200
#: Lanes over which a host's templates are spread when they are joined.
LANES = 32
#: Templates that are broadcast at most (8 bytes each); more are joined to their pages by a shuffle.
BROADCAST_TEMPLATES = 1 << 20

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "head title script style noscript template textarea iframe noembed noframes xmp svg math object embed canvas audio video "
    "nav footer aside form button select option datalist dialog menu map".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt td th".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
COUNTED = BLOCK - {"html", "body", "br", "hr"}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
# Words of class names and ids that name what isn't the article, and words that may stand beside them.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments disqus reply replies respond share sharing social related recommended recommendations "
    "popup modal overlay widget toolbar pagination pager masthead skiplink hidden".split()
)
BESIDE = frozenset(
    "a all area articles bar block body bottom box button buttons card cards col column container content desktop first footer form global group header "
    "icon icons inner item items last left line link links list main middle mobile module nav outer page panel post posts primary right row secondary section "
    "site slot sticky text thread title top unit web wide wrap wrapper x".split()
)
NAMED_ALIKE = frozenset("html body main".split())
NOT_ARTICLES = frozenset("comment comments reply replies related ad ads advert sponsored promo".split())
CONTENT_HEADER = re.compile(r"(?:^|\s)(?:entry|post|article|content|story|page)[-_]?header(?:\s|$)", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WHITE = re.compile(r"[\x20\x09-\x0D ]+")
_NAME_PART = re.compile(r"[a-z]+")


def names_boilerplate(names: str) -> bool:
    """Whether one class name or id, taken whole, names something beside the article."""
    for token in names.lower().split():
        parts = set(_NAME_PART.findall(token))
        if parts & NAMES and not parts - NAMES - BESIDE:
            return True
        if "header" in parts and not parts - BESIDE and not CONTENT_HEADER.search(token):
            return True
    return False


class Element:
    __slots__ = ("at", "boiler", "children", "hash", "linked", "named", "names", "own", "root", "size", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = tag
        self.children: list[Element | str] = []
        #: Position in the page; hash; characters below, of these within links, and of these in no block further down.
        self.at = self.hash = self.size = self.linked = self.own = 0
        self.names = ""
        #: Dropped for its role or, where it isn't prose within an article, for its name.
        self.boiler, self.named = tag in DROPPED, False
        self.root = tag in ("article", "main")
        if attributes.strip(" /"):
            self._read({m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)})

    def _read(self, given: dict[str, str]) -> None:
        role, classes, own_id = given.get("role", "").lower(), given.get("class", ""), given.get("id", "")
        self.names = f"{classes} {own_id}".strip()
        self.root |= role == "main" or given.get("itemprop", "").lower() == "articlebody"
        unseen = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", "").lower())
        if self.tag not in ("html", "body") and (role in ROLES or unseen):
            self.boiler = True
        if self.tag == "article":
            self.boiler |= bool(set(_NAME_PART.findall(self.names.lower())) & NOT_ARTICLES)
        elif self.tag in PROSE:
            # An anchor's id names no more than its own text.
            self.named = names_boilerplate(classes)
        elif self.tag not in NAMED_ALIKE and names_boilerplate(self.names):
            self.boiler = True
        if self.boiler or self.named:
            self.root = False


def parse(html: str) -> Element:
    """The page's tree. Elements that are not closed end with their parent; a tag that is cut off is dropped.

    Open elements are counted by name and open blocks kept on a stack of their
    own, so that no closing tag searches the stack in vain: linear in the page.
    """
    top = Element("#page")
    stack, at, n = [top], 0, len(html)
    opened: Counter[str] = Counter()
    blocks: list[int] = []

    def close(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].children.append(html[at:])
            break
        if lt > at:
            stack[-1].children.append(html[at:lt])
        token = _TOKEN.match(html, lt)
        if not token:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag or not token[4]:
            continue
        if token[1]:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack[-1].tag in (("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)):
            close(len(stack) - 1)
        element = Element(tag, token[3])
        stack[-1].children.append(element)
        if tag in VOID or token[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        opened[tag] += 1
        if tag in CLOSES_P:
            blocks.append(len(stack))
        stack.append(element)
    return top


def plain(text: str) -> str:
    return _WHITE.sub(" ", text).strip(" ")


class Page:
    """A page's elements with their hashes, parents first, and where each one stands."""

    def __init__(self, html: str) -> None:
        self.top = parse(html)
        #: Elements and their parents' positions.
        self.order: list[tuple[Element, int]] = [(self.top, -1)]
        for i, (e, _) in enumerate(self.order):
            e.at = i
            for c in e.children:
                if c.__class__ is Element:
                    self.order.append((c, i))
        self._measure()
        self._place()

    def _measure(self) -> None:
        """Each element's hash, of its tag, class, id and all below it, and its sizes."""
        for e, _ in reversed(self.order):
            digest = xxhash.xxh64(f"{e.tag}\x00{e.names}\x00".encode("utf-8", "surrogatepass"))
            size = linked = own = 0
            for c in e.children:
                if isinstance(c, str):
                    text = plain(c)
                    size += len(text)
                    own += len(text)
                    digest.update(text.encode("utf-8", "surrogatepass"))
                else:
                    size += c.size
                    linked += c.linked
                    if c.tag not in BLOCK:
                        own += c.own
                    digest.update(c.hash.to_bytes(8, "little"))
                digest.update(b"\x01")
            e.hash, e.size, e.own, e.linked = digest.intdigest(), size, own, size if e.tag == "a" else linked

    def _place(self) -> None:
        """``rooted``: within an outermost article or main element. ``gone``: within something dropped for its role or name."""
        n = len(self.order)
        self.rooted, self.gone = [False] * n, [False] * n
        for i, (e, parent) in enumerate(self.order):
            inside = parent >= 0 and self.rooted[parent]
            shut = parent >= 0 and (self.gone[parent] or self.order[parent][0].boiler)
            if e.named and not inside:
                e.boiler = True
            self.gone[i] = shut
            self.rooted[i] = inside or (e.root and not shut and not e.boiler)

    def blocks(self) -> list[tuple[int, bool]]:
        """Position of every block that is counted, and whether it is a menu, an advert or a list of links beside the article, or a part of one."""
        return [
            (i, e.boiler or self.gone[i] or (not self.rooted[i] and 2 * e.linked > e.size))
            for i, (e, _) in enumerate(self.order) if e.tag in COUNTED and e.size
        ]

    def look(self) -> int:
        """Hash of the page's two longest blocks, by which pages are told apart; 0 without text."""
        longest = nlargest(2, [(e.own, e.hash) for i, (e, _) in enumerate(self.order) if e.own and e.tag in BLOCK and not e.boiler and not self.gone[i]])
        if not longest:
            return xxhash.xxh64_intdigest(plain("".join(c for c in self.top.children if isinstance(c, str))).encode("utf-8", "surrogatepass"))
        return xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little") for _, h in longest))

    @staticmethod
    def _known_below(top: Element, templates: set[int] | frozenset[int]) -> int:
        """Characters below an element that stand in templates."""
        known, stack = 0, [top] if templates else []
        while stack:
            for c in stack.pop().children:
                if c.__class__ is Element:
                    if c.at in templates:
                        known += c.size
                    else:
                        stack.append(c)
        return known

    def text(self, templates: set[int] | frozenset[int] = frozenset()) -> tuple[str, int, int]:
        """The main text, and how many characters went by templates (positions) and by the fallback."""
        out: list[tuple[str, bool]] = []
        by_template = by_role = 0
        stack: list[tuple[Element | str, bool, bool]] = [(self.top, False, False)]
        while stack:
            node, header, rooted = stack.pop()
            if isinstance(node, str):
                if header:
                    by_role += len(plain(node))
                else:
                    out.append((unescape(node) if "&" in node else node, rooted))
                continue
            i = node.at
            if i in templates:
                by_template += node.size
                continue
            if node.boiler or node.tag == "header" and not rooted:
                known = self._known_below(node, templates)
                by_template += known
                by_role += node.size - known
                continue
            rooted = self.rooted[i]
            if node.tag == "header":
                header = True
            elif node.tag in HEADINGS:
                header = False
            edge = (" ", rooted) if node.tag in BLOCK else None
            if edge:
                stack.append((edge[0], False, rooted))
                out.append(edge)
            stack.extend((c, header, rooted) for c in reversed(node.children))
        inside = plain("".join(t for t, r in out if r))
        if not inside:
            return plain("".join(t for t, _ in out)), by_template, by_role
        beside = plain("".join(t if not r else " " for t, r in out))
        if len(beside) <= max(len(inside), BESIDE_CHARS):
            return inside, by_template, by_role + len(beside)
        return plain("".join(t for t, _ in out)), by_template, by_role


def page_places(page: Page, host: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a page's counted subtrees, the keys under which the host's subtrees are counted, and which are beside the article."""
    found = page.blocks()
    at, side = np.array([i for i, _ in found], np.int64), np.array([s for _, s in found], bool)
    keys = np.array([page.order[i][0].hash for i, _ in found], np.uint64)
    keys = (keys ^ np.uint64(host & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.where(side, np.uint64(0xD1B54A32D192ED03), np.uint64(0))
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return at, keys ^ (keys >> np.uint64(32)), side


def main_text(html: str, templates: np.ndarray, host: int = 0) -> tuple[str, int, int]:
    """Main text, characters deleted by templates and by the fallback. ``templates``: their sorted keys."""
    page = Page(html)
    if not len(templates):
        return page.text()
    at, keys, _ = page_places(page, host)
    where = np.minimum(np.searchsorted(templates, keys), len(templates) - 1)
    return page.text(set(at[templates[where] == keys].tolist()))


def host_of(url: str) -> Column:
    """The url's host without user, port and leading www., lower case; null or without host: empty."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def site_templates(pages: DataFrame) -> DataFrame:
    """The keys (place) of subtrees that recur. ``pages``: host, look, side and body (arrays of keys).

    A busy host's templates would all meet its page count in one task, so hosts'
    counts go to every lane and templates to one each.
    """
    tagged = F.concat(
        F.transform("side", lambda p: F.struct(p.alias("place"), F.lit(True).alias("side"))), F.transform("body", lambda p: F.struct(p.alias("place"), F.lit(False).alias("side")))
    )
    each = pages.select("host", "look", F.explode(tagged).alias("t")).select("host", "look", "t.place", "t.side")
    different = each.groupBy("place", "look").agg(F.first("host").alias("host"), F.first("side").alias("side"))
    counted = different.groupBy("place").agg(F.first("host").alias("host"), F.first("side").alias("side"), F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= F.when(F.col("side"), F.lit(SIDE_PAGES)).otherwise(F.lit(BODY_PAGES))).withColumn("lane", F.pmod("place", F.lit(LANES)))
    sizes = pages.select("host", "look").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    sizes = sizes.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    share = F.when(F.col("side"), F.lit(SIDE_SHARE)).otherwise(F.lit(BODY_SHARE))
    return often.join(sizes, ["host", "lane"]).where(F.col("n") >= share * F.col("pages")).select("place")


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars, template_chars and role_chars of every row of ``pages``.

    ``template_chars`` and ``role_chars`` are the characters that went with
    recurring subtrees and with the fallback. Null html counts as empty and
    gives an empty text. Pages without a url are one host of their own. Repeated
    rows give repeated results, and count as one page when templates are counted.
    Other columns are not read. No pages give no rows.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.xxhash64(host_of("url")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, looks, places = batch.column("host").to_pylist(), [], ([], [])
            for h, host in zip(batch.column("html").to_pylist(), hosts, strict=True):
                page = Page(h)
                looks.append(page.look())
                _, keys, side = page_places(page, host)
                for out, chosen in zip(places, (side, ~side), strict=True):
                    out.append(np.unique(keys[chosen]).view(np.int64))
            kept = [batch.column(c) for c in batch.schema.names if c not in ("html", "host")]
            yield pa.RecordBatch.from_arrays([*kept, batch.column("host"), pa.array(np.array(looks, np.uint64).view(np.int64)), *(pa.array(p, pa.list_(pa.int64())) for p in places)], names=[*(c for c in batch.schema.names if c not in ("html", "host")), "host", "look", "side", "body"])

    counted = "host long, look long, side array<long>, body array<long>"
    templates = cut(site_templates(cut(rows.select("host", "html").mapInArrow(scan, counted))))
    if templates.limit(broadcast_templates + 1).count() <= broadcast_templates:
        found = np.array([r[0] for r in templates.collect()], np.int64).view(np.uint64)
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(found))
        return _extracted(rows, lambda batch: repeat(shared.value, batch.num_rows))
    marked = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))
    scanned = cut(marked.select("row", "host", "html").mapInArrow(scan, f"row long, {counted}"))
    own = scanned.select("row", F.explode(F.concat("side", "body")).alias("place"))
    # A template of a third of all pages is one key: pages are dealt to lanes, and templates go to each.
    spread = templates.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    deleted = own.withColumn("lane", F.pmod("row", F.lit(LANES))).join(spread, ["place", "lane"], "left_semi").groupBy("row").agg(F.collect_set("place").alias("deleted"))
    joined = marked.join(deleted, "row", "left").select("page_id", "url", "html", "host", "deleted")
    return _extracted(joined, lambda batch: (np.sort(np.array(d or [], np.int64).view(np.uint64)) for d in batch.column("deleted").to_pylist()))


def _extracted(rows: DataFrame, deleted_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> DataFrame:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, d, host) for h, host, d in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), deleted_of(batch), strict=True)]
            numbers = [pa.array([len(t[0]) for t in found], pa.int64()), *(pa.array([t[i] for t in found], pa.int64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t[0] for t in found], pa.string()), *numbers], ["page_id", "url", "text", "n_chars", "template_chars", "role_chars"])

    added = [StructField("text", StringType()), *(StructField(c, LongType()) for c in ("n_chars", "template_chars", "role_chars"))]
    return rows.mapInArrow(extract, StructType([rows.schema["page_id"], rows.schema["url"], *added]))
