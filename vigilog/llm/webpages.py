"""Operator 4: main text of web pages from markup and a suffix array per host.

A page is cut into blocks. Inside an article (or main) element, blocks are text of the page, unless
an element in it is marked as something else (navigation, notices, comments ...). Blocks in no
such element are judged by what the host's pages share: the token streams of the host's pages are
put one behind the other and the suffixes are sorted; neighbours in that order that agree for
`LONG` tokens or more and come from distinct pages mark boilerplate. A block outside an article
stays if its unique runs make up the larger part of it; one of fewer than `LONG` tokens, if no
other page of the host has it.

Menus differ from page to page as often as they repeat, and articles are copied, so for the blocks
that markup decides the array has no say; its tokens decide the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import small_batches
from vigilog.llm.repeats import refine
from vigilog.session import materialize

#: Tokens that a passage shared by distinct pages of a host has at least.
LONG = 8
#: Tokens of one suffix array.
ARRAY_TOKENS = 1 << 20
#: Parts that a host's pages are dealt to; what the parts find is added up.
PARTS = 64

#: Element names of HTML by their part in a page.
_RAW = frozenset("script style noscript template textarea title iframe svg math select".split())
_AROUND = frozenset("nav footer aside form button dialog menu head".split())
_MAIN = frozenset("article main".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class, id and role by which pages mark what isn't their text. A name
#: counts as a whole: has-sidebar, entry-header and related-work mark nothing.
_MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie "
    "cookies disqus footer header login masthead menu modal nav navbar navigation newsletter "
    "notice notices popup promo promoted related replies search share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget "
    # Compounds; an underscore counts as a hyphen.
    "site-nav site-navigation site-menu site-header site-footer site-notice main-nav "
    "main-navigation main-menu main-header main-footer top-nav top-menu top-bar bottom-nav "
    "global-nav global-header global-footer primary-nav primary-menu secondary-nav "
    "secondary-menu page-footer footer-nav footer-menu footer-links footer-widgets header-nav "
    "header-menu nav-bar nav-menu nav-links menu-bar dropdown-menu side-bar breadcrumb-nav "
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad sidebar-ad "
    "google-ad comment-list comments-list comments-area comment-section comments-section "
    "comment-form comment-respond disqus-thread cookie-banner cookie-bar cookie-consent "
    "cookie-notice related-posts related-articles related-stories related-links related-content "
    "share-bar share-buttons share-links sharing-buttons social-share social-links social-icons "
    "social-media social-buttons newsletter-signup newsletter-form subscribe-form subscribe-box "
    "search-form search-box search-bar login-form login-box promo-box promo-banner "
    "sponsored-content sponsored-links widget-area".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

MAIN, OPEN = 1, 0


def _marked(attributes: str) -> bool:
    """Whether class, id or role has a name of _MARKS."""
    return any(name in _MARKS for found in _ATTRIBUTE.findall(attributes)
               for name in "".join(found).lower().replace("_", "-").split())


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(MAIN or OPEN, text) of the page's blocks in order, without what markup excludes.

    An excluded element ends with its own end tag, or with that of an element around it; one that
    is never closed reaches to the end of the page. Outside an article no class, id or role
    excludes an article or main element or what holds one; inside an article, articles are
    comments or teasers and excluded as other elements are.
    """
    out, wraps = _read(page or "", frozenset())
    return _read(page or "", frozenset(wraps))[0] if wraps else out


def _read(page: str, wraps: frozenset[int]) -> tuple[list[tuple[int, str]], set[int]]:
    """The blocks, and the places of marked elements not in `wraps` that hold an article."""
    out: list[tuple[int, str]] = []
    # Name; what held around: excluded for good, in a main, in an article, marked elements.
    stack: list[tuple[str, bool, bool, bool, tuple | None]] = []
    text: list[str] = []
    holding: set[int] = set()
    hard = main = article = excluded = False
    marks: tuple | None = None                      # place of the innermost, and those around it

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((MAIN if main else OPEN, joined))

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            if not excluded:
                text.append(page[at:])
            break
        if not excluded and tag.start() > at:
            text.append(page[at:tag.start()])
        at = tag.end()
        if tag[3] is None:
            if tag[1] and not excluded:
                text.append(entities.escape(tag[1], quote=False))
            continue
        closing, name, rest = bool(tag[2]), tag[3].lower(), tag[4]
        if name in _BLOCKS and not excluded:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, hard, main, article, marks = stack[k]
                    excluded = hard or marks is not None
                    del stack[k:]
                    break
            continue
        if name in _VOID or rest.endswith("/"):
            continue
        if name in _RAW:
            close = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "p":                             # a paragraph ends where the next one begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    _, hard, main, article, marks = stack[k]
                    excluded = hard or marks is not None
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCKS:
                    break
        stack.append((name, hard, main, article, marks))
        if not hard:
            if name in _MAIN and not article:
                main, article = True, name == "article"
                around = marks
                while around and around[0] not in holding:
                    holding.add(around[0])
                    around = around[1]
            elif name in _AROUND or name == "header" and not main:
                hard = True
            elif name not in ("html", "body") and rest and _marked(rest):
                if article:
                    hard = True
                elif tag.start() not in wraps:
                    marks = tag.start(), marks
            excluded = hard or marks is not None
    if not excluded:
        flush()
    return out, holding


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


_PARSED = ("row bigint, page_id bigint, url string, host string,"
           " blocks array<struct<main:int,text:string>>")


def parse(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
          ) -> DataFrame:
    """(page_id, url, host, blocks) of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("main", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            blocks = [[{"main": m, "text": t} for m, t in blocks_of(h)]
                      for h in batch.column(2).to_pylist()]
            hosts = [host_of(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(hosts, pa.string()), pa.array(blocks, kind)],
                ["page_id", "url", "host", "blocks"])

    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        F.col(html).alias("html"))
    return rows.mapInArrow(run, _PARSED.removeprefix("row bigint, "))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct passage of LONG tokens, and per shorter block, of a host's part: its
    digest, its least and greatest page. Rows come sorted by host; a suffix array holds whole
    pages."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    def solve(host: str, pages: list[tuple[int, list[str]]],
              blocks: dict[bytes, tuple[int, int]]) -> pa.RecordBatch:
        digests, low, high = solve_long(pages) if pages else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array([host] * (len(digests) + len(blocks)), pa.string()),
             pa.array([*digests, *blocks], pa.binary()),
             pa.array([*low, *(b[0] for b in blocks.values())], pa.int64()),
             pa.array([*high, *(b[1] for b in blocks.values())], pa.int64())],
            ["host", "passage", "low", "high"])

    def solve_long(pages: list[tuple[int, list[str]]]) -> tuple[list, np.ndarray, np.ndarray]:
        tokens = [t for _, p in pages for t in p]
        ends = np.repeat(np.cumsum([len(p) for _, p in pages]), [len(p) for _, p in pages])
        page = np.repeat(np.array([i for i, _ in pages], np.int64), [len(p) for _, p in pages])
        codes = np.array([xxh3_64_intdigest(t.encode("utf-8", "replace")) for t in tokens],
                         np.uint64)
        # Suffixes sorted to depth LONG: equal nodes stand together, whatever follows.
        node = refine(codes, ends, LONG)
        array = np.argsort(node, kind="stable")
        array = array[node[array] >= 0]
        first = np.nonzero(np.diff(node[array], prepend=-1))[0]
        low, high = (np.minimum.reduceat(page[array], first), np.maximum.reduceat(
            page[array], first)) if len(first) else (page[:0], page[:0])
        passages = [xxh3_128_digest("\0".join(tokens[i:i + LONG])) for i in array[first].tolist()]
        return passages, low, high

    host, pages, blocks, size = None, [], {}, 0
    for batch in batches:
        for h, row, texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (pages or blocks) and (h != host or size >= ARRAY_TOKENS):
                yield solve(host, pages, blocks)
                pages, blocks, size = [], {}, 0
            host = h
            stream = " ".join(texts).split(" ")
            if len(stream) >= LONG:
                pages.append((row, stream))
            for _, digest in _short_blocks(texts):
                low, high = blocks.get(digest, (row, row))
                blocks[digest] = min(low, row), max(high, row)
            size += len(stream)
    if pages or blocks:
        yield solve(host, pages, blocks)


def _short_blocks(texts: list[str]) -> Iterator[tuple[int, bytes]]:
    """(number, digest) of the open blocks that have fewer than LONG tokens; no passage's digest
    is as long."""
    from xxhash import xxh3_128_digest

    for k, text in enumerate(texts):
        if text.count(" ") + 1 < LONG:
            yield k, xxh3_128_digest(text) + b"b"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages and short blocks of each page again, as (host, passage, row, place); the place
    of block k is -1 - k."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        for h, row, texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            stream = " ".join(texts).split(" ")
            found = [(i, xxh3_128_digest("\0".join(stream[i:i + LONG])))
                     for i in range(len(stream) - LONG + 1)]
            found += [(-1 - k, digest) for k, digest in _short_blocks(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h] * len(found), pa.string()),
                 pa.array([digest for _, digest in found], pa.binary()),
                 pa.array([row] * len(found), pa.int64()),
                 pa.array([place for place, _ in found], pa.int32())],
                ["host", "passage", "row", "place"])


def boilerplate(parsed: DataFrame) -> DataFrame:
    """(row, places): token places of open blocks that begin a passage of distinct pages, and
    -1 - k for every short open block k of distinct pages.

    `parsed` has row (a hash of page and content), host and texts (the open blocks). A host's pages
    are dealt to PARTS parts, so no task holds a large host; what a part's arrays find is merged by
    passage.
    """
    streams = parsed.select("host", "row", "texts")
    dealt = (streams.repartition("host", F.pmod(F.col("row"), F.lit(PARTS)))
             .sortWithinPartitions("host"))
    found = (dealt.mapInArrow(_arrays, "host string, passage binary, low bigint, high bigint")
             .groupBy("host", "passage").agg(F.min("low").alias("low"), F.max("high").alias("high"))
             .where("low < high").select("host", "passage"))
    return (streams.mapInArrow(_passages, "host string, passage binary, row bigint, place int")
            .join(found, ["host", "passage"])
            .groupBy("row").agg(F.collect_set("place").alias("places")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            ) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; `text` is the main blocks joined by \\n.

    Null and empty pages have an empty text. Pages that are repeated, also under the same id, are
    one page for the array, so copies don't become boilerplate of one another. Other columns are
    left out; no row is.
    """
    parsed = materialize(parse(pages, key, url, html).withColumn(
        "row", F.xxhash64("page_id", "host", "blocks")), "pages", compression="zstd")
    mixed = F.exists("blocks", lambda b: b["main"] == OPEN)
    texts = F.transform(F.filter("blocks", lambda b: b["main"] == OPEN), lambda b: b["text"])
    # Copies of a page, articles included, count once, under the least row. No text has a \n.
    same = F.sha2(F.array_join(F.transform("blocks", lambda b: F.concat(
        b["main"].cast("string"), b["text"])), "\n"), 256)
    streams = (parsed.where(mixed).select("host", texts.alias("texts"), same.alias("same"), "row")
               .groupBy("host", "same")
               .agg(F.min_by("texts", "row").alias("texts"), F.min("row").alias("row")))
    shared = materialize(boilerplate(streams), "boilerplate")
    stream_of = materialize(streams.select("host", "same", "row"), "streams").join(shared, "row")
    opened = parsed.where(mixed).withColumn("same", same).join(
        stream_of.select("host", "same", "places"), ["host", "same"], "left")
    closed = parsed.where(~mixed)
    main = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    text = closed.select("page_id", "url", main.alias("text")).unionByName(
        opened.select("page_id", "url", "blocks", "places").mapInArrow(
            _unique, "page_id bigint, url string, text string"))
    return text.withColumn("n_chars", F.length("text").cast("bigint"))


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages with open blocks, without those that shared passages cover by half."""
    for batch in batches:
        texts = []
        for blocks, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(),
                                  strict=True):
            sizes = [b["text"].count(" ") + 1 if b["main"] == OPEN else 0 for b in blocks]
            covered = np.zeros(sum(sizes) + LONG, bool)
            starts = np.cumsum([0, *(n for n in sizes if n)])
            for p in places or ():
                if p < 0:
                    covered[starts[-1 - p]:starts[-p]] = True
                else:
                    covered[p:p + LONG] = True
            kept, at = [], 0
            for b, n in zip(blocks, sizes, strict=True):
                if b["main"] == MAIN or 2 * covered[at:at + n].sum() < n:
                    kept.append(b["text"])
                at += n
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])
