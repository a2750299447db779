"""Main text of pages, with templates deduced from pages of the same host.

Each page is read by a tolerant tokeniser into elements and blocks (runs of text in an element).

Equivalence classes. A page's tokens are its element paths (names and classes from the root; long numbers
in class names don't count) and its blocks as path and text. Tokens of a host that occur equally
often in the same pages have equal occurrence vectors; a vector is kept as a sum of page hashes times
counts, so tokens are counted with partial sums and no host's pages meet in one task. A class is a set
of tokens with the same vector; it is valid with two element paths on two pages or more.

Template. Valid classes are nested by their elements: a class lies in a slot of the class that holds
its element's parent. Element paths that occur once on each of their pages frame slots; of each the
host's pages tell how much text outside links it holds, how much its pages hold, and whether it
varies. A slot that varies and holds ``SHARE`` of the text of its pages is a content slot.

Extraction. Of a page, the innermost content slot is the main text, with the headings and paragraphs
that stand beside it in the elements around it, below ``body``. A slot within an article element
stands for all of that element. Block tokens of valid classes that at least ``TEXT_PAGES``
pages and ``SUPPORT`` of the host's hold are the template's own words and go; what an article element
holds never counts as such. Near copies on a host (``COPIES`` percent of their shingles) count once
here: what copies of one text share is that text and not a template.

Fallback. A page without a content slot (the only page of its host, say, or of its layout) gives the
blocks of its article or main element, or else all blocks but lists of links: those outside the
element with most text that are links for the most part and no headings. So does a page whose
article elements hold more text than the slot.

In either, menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by their elements, roles and classes (whole names) too. A form, header
or layout class that wraps an article, or most of the text, leaves nothing out. Where removing the
template's words would leave nothing, they stay.

Edge cases: null or empty html and pages without text give an empty text; a null url has no host and
no template; ids and urls are handed on as they are; repeated rows each get a row and count as a
page each; of slots equally deep the first counts; pages of any length and depth are read in time and
memory linear in them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import neardup, scratch
from inkwell.llm.batches import slices, texts

#: Text of a slot that its pages have there, for it to be a content slot.
SHARE = 0.6
#: Pages of a host that a content slot's layout has to have, so that a host has few of them.
LAYOUT = 0.05
#: Different pages, and their share of the host's, that show a text to be the template's.
TEXT_PAGES = 10
SUPPORT = 0.5
#: Shared shingles of near copies, in percent.
COPIES = 80
FLUSH = 200_000
#: Template tokens that may be sent to every task; beyond, they are joined by host, dealt SALTS ways.
BROADCAST_TOKENS = 1_000_000
SALTS = 16

# HTML's element kinds.
RAW = frozenset("script style template noscript textarea title svg iframe audio video select xmp noembed noframes".split())
BLOCK = frozenset("html head body div section article main aside nav header footer form fieldset ul ol li dl dt dd table caption thead tbody tfoot tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog hgroup menu search center legend button label".split())
BREAK = frozenset({"br", "hr"})
#: Elements that end an open paragraph when they begin.
ENDS_P = BLOCK - {"button", "label"}
#: An element that begins ends these, up to the container that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
VOID = frozenset("area base col embed hr img input link meta source track wbr br param".split())
# What isn't main text, by element, role, and words of ids and classes.
DROPPED = frozenset("head nav aside footer form menu dialog button search fieldset label".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset("cookie-banner cookie-notice cookie-consent cookie-bar nav-bar main-nav site-nav top-nav nav-menu main-menu side-nav site-header page-header site-footer page-footer ad-banner ad-container ad-slot ad-unit ad-wrapper social-share share-buttons social-links related-posts related-articles comments-area comment-section newsletter-signup ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar side-bar aside nav navbar navigation menu menus breadcrumb breadcrumbs toolbar footer foot header masthead topbar comment comments commentlist comment-list disqus respond reply replies reactions newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget widgets skip-link disclaimer".split())
#: Of these, what may wrap a whole page or article: it counts only where it holds less than half of the text.
WRAPPERS = frozenset("form fieldset header".split())
WRAPPER_ROLES = frozenset("form banner search".split())
WRAPPER_WORDS = frozenset("header masthead topbar banner site-header page-header widget widgets modal overlay".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a text, rather than a page's parts.
LEAVES = HEADINGS | frozenset("p li dt dd pre address figcaption summary legend caption".split())
#: Numbers at the end of a class or id.
NUMBERED = re.compile(r"[-_]?\d+$")
DIGITS = re.compile(r"\d{3,}")
MAIN_ROLES = frozenset({"main", "article"})
ARTICLE_MARKS = frozenset({"article", "articlebody"})

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
WORDS = re.compile(r"[\s]+")


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _path(parent: int, name: str, classes: tuple[str, ...]) -> int:
    """A hash of a path of elements, so that deep pages don't hold long ones. Long numbers in class names don't count."""
    return _hash(str(parent), name, *(DIGITS.sub("#", c) for c in classes))


class Element:
    __slots__ = ("article", "depth", "dropped", "main", "name", "parent", "path", "place", "wrapped")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None, place: int = 0) -> None:
        classes = WORDS.split(attributes.get("class", "").strip().lower())
        words = {w for c in [*classes, attributes.get("id", "").strip().lower()] for w in (c, NUMBERED.sub("", c)) if w}
        role = attributes.get("role", "").lower()
        inside = bool(parent and parent.main)
        self.name, self.parent, self.place, self.depth = name, parent, place, parent.depth + 1 if parent else 0
        self.path = _path(parent.path if parent else 0, name, tuple(c for c in classes if c))
        self.main = inside or name in ("article", "main") or role in MAIN_ROLES or attributes.get("itemprop", "").lower() == "articlebody"
        self.article = bool(parent and parent.article) or bool({name, role, attributes.get("itemprop", "").lower()} & ARTICLE_MARKS)
        gone = words & DROPPED_WORDS
        dropped = name in DROPPED - WRAPPERS or role in DROPPED_ROLES - WRAPPER_ROLES or bool(gone - WRAPPER_WORDS) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        # An article may have a header of its own, with its title; a page's isn't main text.
        wrapped = name in WRAPPERS and not (name == "header" and inside) or role in WRAPPER_ROLES or bool(gone & WRAPPER_WORDS)
        if name in ("html", "body", "main", "article") and not words & {"comment", "comments", "reply", "related", "ad", "advert", "sponsored"}:
            dropped = wrapped = False
        self.dropped = dropped or bool(parent and parent.dropped)
        # A wrapper around an article says nothing about the article.
        begins = self.main and not inside
        self.wrapped = wrapped or bool(parent and parent.wrapped and not begins)


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, linked


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page and its elements, both in order; an element's place is its index."""
    root = Element("#", {}, None)
    stack, out, elements = [root], [], [root]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, anchor, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1], text, linked))
            parts.clear()
        linked = 0

    def pop(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in until:
                return
            if stack[i].name in names:
                opened.subtract(e.name for e in stack[i:])
                del stack[i:]
                return

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (anchor > 0)
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        if not m[4]:
            break  # the page ends within a tag
        name, end = m[2].lower(), bool(m[1])
        if name in RAW and not end:
            if name == "noscript" or m[3].rstrip().endswith("/") and name in ("svg", "math"):
                continue
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name == "a":
            anchor = 0 if end else 1
        elif name in BREAK:
            flush()
        elif name in BLOCK:
            flush()
            if end:
                while opened[name]:
                    ended = stack.pop().name
                    opened[ended] -= 1
                    if ended == name:
                        break
            else:
                if name in ENDS_P:
                    pop({"p"}, BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"})
                if name in ENDS:
                    pop(*ENDS[name])
                given = {a[0].lower() if a[0] else a[4].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(m[3])}
                stack.append(Element(name, given, stack[-1], len(elements)))
                elements.append(stack[-1])
                opened[name] += 1
    flush()
    return out, elements


def _wrap(n: int) -> int:
    return ((n + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def _weight(found: list[Block]) -> int:
    """Characters outside links."""
    return sum(max(0, len(b.text) - b.linked) for b in found)


def inside(found: list[Block], elements: list[Element]) -> tuple[list[int], list[int]]:
    """Of each element, by its place: characters outside links, and a hash of the text."""
    mass, text = [0] * len(elements), [0] * len(elements)
    for b in found:
        mass[b.element.place] += _weight([b])
        text[b.element.place] = zlib.crc32(b.text.encode("utf-8", "surrogatepass"), text[b.element.place])
    for e in reversed(elements):
        if e.parent:
            mass[e.parent.place] += mass[e.place]
            text[e.parent.place] = zlib.crc32(text[e.place].to_bytes(4, "little"), text[e.parent.place])
    return mass, text


#: Sums over pages by host and element path: pages, those with the path once, the occurrence vector,
#: characters outside links within it and on its pages, and the least and largest hash of its text.
ELEMENTS = "host string, token bigint, parent bigint, slot boolean, pages bigint, once bigint, vector bigint, mass bigint, total bigint, low bigint, high bigint"
#: The same of blocks.
TEXTS = "host string, token bigint, pages bigint, vector bigint"


def _summed(columns: str, of_page, add):
    """A mapInArrow function that hands on sums by (host, token) of what of_page(page) gives as token: values."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names)

        for b in slices(batches):
            for host, page in zip(b["host"].to_pylist(), texts(b["html"]), strict=True):
                for token, values in of_page(page).items():
                    have = sums.get((host, token))
                    sums[host, token] = values if have is None else add(have, values)
            if len(sums) > FLUSH:
                yield out()
        if sums:
            yield out()

    return run


def page_elements(page: str) -> dict[int, list]:
    """The values of ELEMENTS of a page, by element path."""
    found, elements = blocks(page)
    mass, text = inside([b for b in found if not b.element.dropped], elements)
    own, out = _hash("page", page), {}
    counts = Counter(e.path for e in elements)
    for e in elements:
        n = counts[e.path]
        if e.path in out:
            out[e.path][5] += mass[e.place]
        else:
            slot = e.name not in LEAVES and e.name not in ("#", "html", "body") and not e.dropped
            out[e.path] = [e.parent.path if e.parent else 0, slot, 1, int(n == 1), _wrap(own * n), mass[e.place], mass[0], text[e.place], text[e.place]]
    return out


def _add_elements(a: list, b: list) -> list:
    return [a[0], a[1] and b[1], a[2] + b[2], a[3] + b[3], _wrap(a[4] + b[4]), a[5] + b[5], a[6] + b[6], min(a[7], b[7]), max(a[8], b[8])]


def page_texts(page: str) -> dict[int, list]:
    """The values of TEXTS of a page, by block."""
    own = _hash("page", page)
    counts = Counter(_hash("text", str(x.element.path), x.text) for x in blocks(page)[0])
    return {token: [1, _wrap(own * n)] for token, n in counts.items()}


def _add_texts(a: list, b: list) -> list:
    return [a[0] + b[0], _wrap(a[1] + b[1])]


def _vector() -> Column:
    """Partial sums wrap around at 64 bits, so they are summed as decimals and compared modulo a divisor of that."""
    wrap = F.lit(1 << 62).cast("decimal(38,0)")
    return ((F.sum(F.col("vector").cast("decimal(38,0)")) % wrap + wrap) % wrap).cast("bigint").alias("vector")


def classes(pages: DataFrame) -> DataFrame:
    """(host, token, vector, pages, ...): the element paths of valid classes, each with its parent's; pages has host and html."""
    held = pages.where("host is not null and host != ''").select("host", "html")
    counted = held.mapInArrow(_summed(ELEMENTS, page_elements, _add_elements), ELEMENTS)
    sums = [F.sum(c).alias(c) for c in ("pages", "once", "mass", "total")]
    summed = counted.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.min("slot").alias("slot"), *sums, _vector(), F.min("low").alias("low"), F.max("high").alias("high"))
    summed = scratch.save(summed.where("pages > 1"), "elements")
    valid = summed.groupBy("host", "vector", "pages").agg(F.count("*").alias("paths")).where("paths > 1").select("host", "vector", "pages")
    return summed.join(valid, ["host", "vector", "pages"], "left_semi")


def content_slots(template: DataFrame) -> DataFrame:
    """(host, token): the element paths that frame content slots, each nested in a valid class.

    A layout has a chain of them at most, and a host has 1 / LAYOUT layouts at most, so a host's are few.
    """
    total = template.groupBy("host").agg(F.max("pages").alias("of_host"))
    held = template.select("host", F.col("token").alias("parent"))
    slots = template.where(F.col("slot") & (F.col("once") == F.col("pages")) & (F.col("low") != F.col("high")) & (F.col("mass") >= SHARE * F.col("total")) & (F.col("mass") > 0))
    return slots.join(held, ["host", "parent"], "left_semi").join(total, "host").where(F.col("pages") >= LAYOUT * F.col("of_host")).select("host", "token")


def own_words(pages: DataFrame, template: DataFrame) -> DataFrame:
    """(host, token): the block tokens of valid classes that TEXT_PAGES pages and SUPPORT of the host's hold.

    Each is on half of the host's pages, so a host has at most twice as many as a page has blocks.
    """
    counted = pages.mapInArrow(_summed(TEXTS, page_texts, _add_texts), TEXTS).groupBy("host", "token").agg(F.sum("pages").alias("pages"), _vector()).where(F.col("pages") >= TEXT_PAGES)
    frame = template.groupBy("host", "vector", "pages").agg(F.count("*").alias("paths"))
    total = template.groupBy("host").agg(F.max("pages").alias("of_host"))
    return counted.join(frame, ["host", "vector", "pages"]).join(total, "host").where(F.col("pages") >= SUPPORT * F.col("of_host")).select("host", "token")


def _flow(found: list[Block], elements: list[Element], slot: Element) -> list[Block]:
    """The blocks of a slot, and the headings and paragraphs beside it in the elements around it, below body."""
    around, e = set(), slot.parent
    while e and e.name not in ("#", "html", "body"):
        around.add(e.place)
        e = e.parent
    within = [False] * len(elements)
    for e in elements:
        within[e.place] = e is slot or bool(e.parent and within[e.parent.place])
    return [b for b in found if within[b.element.place] or b.element.name in LEAVES and b.element.parent and b.element.parent.place in around]


def main_blocks(page: str, slots: frozenset[int] | set[int] = frozenset()) -> tuple[list[Block], bool]:
    """The blocks of a page's main text, and whether a content slot gave them."""
    all_found, elements = blocks(page)
    found = [b for b in all_found if not b.element.dropped]
    named = [b for b in found if b.element.main]
    framed = [e for e in elements if e.path in slots and not e.dropped] if slots else []
    slot = max(framed, key=lambda e: e.depth, default=None)
    while slot and slot.parent and slot.parent.article:
        slot = slot.parent
    pool = _flow(found, elements, slot) if slot else []
    by_slot = bool(pool) and _weight(pool) >= _weight([b for b in named if b.element.article] if slot and not slot.article else [])
    if not by_slot:
        pool = named or found
    free = [b for b in pool if not b.element.wrapped]
    kept = free if 2 * _weight(free) >= _weight(pool) else pool
    if by_slot or named:
        return kept, by_slot
    # The smallest element that holds most of the text outside links.
    mass, _ = inside(kept, elements)
    best = max((e for e in elements if e.name not in LEAVES and mass[e.place] >= SHARE * mass[0]), key=lambda e: e.depth, default=None)
    within = [False] * len(elements)
    for e in elements:
        within[e.place] = e is best or bool(e.parent and within[e.parent.place])
    return [b for b in kept if 2 * b.linked <= len(b.text) or b.element.name in HEADINGS or within[b.element.place]] or kept, False


def _text(page: str, template: frozenset[int] | set[int], slots: frozenset[int] | set[int]) -> tuple[str, bool]:
    kept, by_slot = main_blocks(page, slots)
    if template:
        values = [b for b in kept if b.element.article or _hash("text", str(b.element.path), b.text) not in template]
        kept = values or kept
    return "\n".join(b.text for b in kept), by_slot


def main_text(page: str, template: frozenset[int] | set[int] = frozenset(), slots: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page: its blocks, joined by newlines."""
    return _text(page, template, slots)[0]


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key and main text of the pages whose main text isn't all in articles."""
    for b in slices(batches):
        rows = []
        for host, key, page, slots in zip(b["host"].to_pylist(), b["key"].to_pylist(), texts(b["html"]), b["slots"].to_pylist(), strict=True):
            kept, _ = main_blocks(page, frozenset(slots or ()))
            if not all(x.element.article for x in kept):
                rows.append((host, key, "\n".join(x.text for x in kept)))
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["host", "key", "text"])


def with_tokens(pages: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
    """pages with the tokens of their host as an array ``name``; a host has a bounded number of them."""
    by_host = tokens.groupBy("host").agg(F.collect_set("token").alias(name))
    if tokens.count() <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(by_host), "host", "left")
    # A host may have a third of all pages, so its pages are dealt in several parts.
    by_host = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pages.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    return dealt.join(by_host, ["host", "_salt"], "left").drop("_salt")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host and html of the pages whose words may be a template's, one of each group of near copies on a host; pages has host, html and slots."""
    keyed = pages.where("host is not null and host != ''").select("host", "html", "slots", F.xxhash64("host", "html").alias("key"))
    loose = scratch.save(keyed.mapInArrow(_loose, "host string, key bigint, text string").dropDuplicates(["key"]), "loose-pages")
    keyed = keyed.select("host", "html", "key")
    if loose.isEmpty():
        return keyed.limit(0).select("host", "html")
    groups = neardup.near_duplicates(loose.select(F.col("key").alias("doc_id"), "text"), COPIES).select(F.col("doc_id").alias("key"), "component_id")
    one = loose.select("host", "key").join(groups, "key").groupBy("host", "component_id").agg(F.min("key").alias("key")).select("key")
    return keyed.join(scratch.save(one, "distinct-pages"), "key", "left_semi").dropDuplicates(["key"]).select("host", "html")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_slot (whether the host's template gave the text): a row for each row of pages."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    given = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host"))
    slots = scratch.save(content_slots(classes(given)), "slots")
    given = with_tokens(given, slots, "slots")
    loose = distinct_pages(given)
    if loose.isEmpty():
        given = given.withColumn("words", F.array().cast("array<bigint>"))
    else:
        given = with_tokens(given, scratch.save(own_words(loose, classes(loose)), "words"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, by_slot = [], []
            for page, slots, words in zip(texts(b["html"]), b["slots"].to_pylist(), b["words"].to_pylist(), strict=True):
                text, decided = _text(page, set(words or ()), frozenset(slots or ()))
                out.append(text)
                by_slot.append(decided)
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array(by_slot, pa.bool_())], ["page_id", "url", "text", "n_chars", "by_slot"])

    return given.select("page_id", "url", "html", "slots", "words").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, by_slot boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
