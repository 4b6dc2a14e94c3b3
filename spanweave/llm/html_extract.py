"""Main text of web pages by host suffix arrays (operator 1).

A page is read into blocks of text, each with the zone of the page it lies in.
The token streams of all pages of a host are concatenated (page ends between
them), a suffix array of the stream is built, and long substrings that occur in
several distinct pages are found from neighbours in suffix order.  Blocks
covered by such substrings are boilerplate and go; unique runs are kept, and a
block of which less than half is covered is kept whole.

Where a page marks its article, the marks come first: what lies outside the
article, or in a menu, header, footer, sidebar, notice, advert, form, script,
style or comment list, is dropped even if it is unique; and what lies in the
article is dropped only if it stands on most pages of its host, as copied
articles also repeat.  Pages without such marks depend on the repeats alone.

A host's pages go to segments of bounded size, by the hash of the page id, and
each segment is a task; small hosts are one segment.  The suffix arrays of a
host's segments are merged: each names its classes of suffixes by a 64-bit hash
of their tokens and counts their pages, and the counts of classes that several
segments have are added up.  So the result doesn't depend on the segments.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Elements whose text is no page text, and those that are page furniture.
DROPPED = frozenset("script style noscript template svg math head title iframe object select option textarea button datalist audio video canvas map".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class, id or role that mark furniture.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|side-bar|aside|widget|advert\w*|ads?|"
    r"sponsor\w*|promo\w*|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|"
    r"comments?|commentlist|disqus|replies|reply|respond|toolbar|pagination|pager|complementary|contentinfo|"
    r"hidden|sr-only)(?=$|[\s_-])",
    re.I,
)
#: The same where no article is open: inside one they also name its title or its own words.
MARKED_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?=$|[\s_-])", re.I)
#: And on elements that hold other blocks.
MARKED_BOXES = re.compile(r"(?:^|[\s_-])(?:related|recommended)(?=$|[\s_-])", re.I)
#: Elements whose text runs to the end of the page if they aren't closed.
RAW = frozenset("script style title textarea iframe template svg math".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
MAIN, OUTSIDE, CLUTTER = "m", "o", "c"


def page_blocks(page: str | None) -> list[tuple[str, str]]:
    """Blocks of a page in order, as (zone, text).

    Zones: in the article, outside it, or in page furniture.  Text in dropped
    elements is left out.  References are decoded; white space is one space.
    """
    if not page:
        return []
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements that matter: name, zone inside
    parts: list[str] = []
    at, n = 0, len(page)

    def zone() -> str:
        return stack[-1][1] if stack else OUTSIDE

    def end_block() -> None:
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append((zone(), text))
            parts.clear()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in DROPPED:
            if m[1] or m[3].endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if close is None and name not in RAW:
                continue
            end_block() if name not in ("svg", "math", "button") else None
            at = close.end() if close else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            end_block()
        elif name in VOID:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in BLOCKS and stack[i][1] == CLUTTER:
                        end_block()
                    del stack[i:]
                    break
            continue
        if stack and ((name in BLOCKS and stack[-1][0] == "p") or name == stack[-1][0] == "li"):
            stack.pop()  # ends where the next one begins
        if m[3].endswith("/") or name in ("p", "li", "hr"):
            if name == "hr" or not m[3] or not _is_clutter(m[3], name, zone()):
                continue
        within = zone()
        if within != CLUTTER:
            if (name in FURNITURE and not (name == "header" and within == MAIN)) or (m[3] and name not in ("body", "html", "article", "main") and _is_clutter(m[3], name, within)):
                if name not in BLOCKS:
                    end_block()
                within = CLUTTER
            elif name in ("article", "main") or (m[3] and re.search(r"role\s*=\s*[\"']?(?:main|article)", m[3], re.I)):
                within = MAIN
        if name in BLOCKS or within != zone():
            stack.append((name, within))
    end_block()
    return out


def _is_clutter(attrs: str, name: str, within: str) -> bool:
    kinds = [MARKED]
    if within != MAIN:
        kinds.append(MARKED_OUTSIDE)
    if name in ("div", "section", "ul", "ol", "table", "dl"):
        kinds.append(MARKED_BOXES)
    return any(k.search(m[1].strip("\"'")) for m in NAMES.finditer(attrs) for k in kinds) or bool(HIDDEN.search(attrs))


def suffix_classes(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``length`` tokens, and each suffix's class.

    By prefix doubling: ranks of twice the length come from pairs of ranks; the
    last step overlaps so that exactly ``length`` tokens count.  Suffixes with
    one class agree in ``length`` tokens; they lie side by side in the order.
    """
    n = len(tokens)
    rank, size = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while size < length:
        step = min(size, length - size)
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + nxt
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        size += step
    return np.argsort(rank, kind="stable"), rank


def suffix_pages(tokens: np.ndarray, pages: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, on how many pages its first ``length`` tokens stand, and its class; 0 where it is shorter.

    ``pages`` has each token's page; page ends are tokens of their own, none
    equal to another, so no substring reaches over them.
    """
    n = len(tokens)
    if n < length:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, rank = suffix_classes(tokens, length)
    cls, page = rank[order], pages[order]
    by = np.lexsort((page, cls))
    c, p = cls[by], page[by]
    first = np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
    per_class = np.bincount(c[first], minlength=int(c.max()) + 1)
    start = per_class[rank]
    start[n - length + 1 :] = 0
    return start, rank


def covering(start: np.ndarray, length: int) -> np.ndarray:
    """A window covers its tokens: the largest of the last ``length`` window values."""
    support = np.zeros(len(start), np.int64)
    for shift in range(min(length, len(start))):
        np.maximum(support[shift:], start[: len(start) - shift], out=support[shift:])
    return support


def repeated(tokens: np.ndarray, pages: np.ndarray, length: int) -> np.ndarray:
    """For each token, on how many pages the best repeated substring over it stands."""
    return covering(suffix_pages(tokens, pages, length)[0], length)


def window_names(words: list[str], length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on, the same in every process; the last places have 0."""
    out = np.zeros(len(words), np.uint64)
    n = len(words) - length + 1
    if n > 0:
        h = pd.util.hash_array(np.array(words, dtype=object))
        for i in range(length):
            out[:n] = (out[:n] ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out[:n] ^= out[:n] >> np.uint64(29)
    return out.view(np.int64)


def _stream(frame: pd.DataFrame) -> tuple[list, list[str], np.ndarray, list]:
    """A segment's pages as blocks, the words of all pages with page ends between them, each word's page, and the blocks' spans."""
    pages = [[b.split("\x1f", 1) for b in s.split("\x1e")] if s else [] for s in frame["blocks"]]
    words, page_of, spans = [], [], []
    for k, blocks in enumerate(pages):
        own = []
        for _, text in blocks:
            w = text.split(" ")
            own.append((len(words), len(words) + len(w)))
            words += w
            page_of += [k] * len(w)
        words.append(f"\x1d{k}")
        page_of.append(k)
        spans.append(own)
    return pages, words, np.array(page_of, np.int64), spans


def _suffixes(words: list[str], page_of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    tokens = pd.factorize(np.array(words, dtype=object))[0] if words else np.array([], np.int64)
    return suffix_pages(tokens, page_of, length)


def _classes(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """The named suffix classes of a segment with their numbers of pages."""
    _, words, page_of, _ = _stream(frame)
    start, rank = _suffixes(words, page_of, length)
    ends = np.cumsum(np.fromiter((w[:1] == "\x1d" for w in words), np.int64, len(words)))
    n = max(len(words) - length + 1, 0)
    within = np.flatnonzero(ends[length - 1 :][:n] == np.concatenate([[0], ends])[:n])  # no page end inside
    at = within[np.unique(rank[within], return_index=True)[1]]
    return pd.DataFrame({"host": frame["host"].iloc[0], "segment": frame["segment"].iloc[0], "name": window_names(words, length)[at], "n": start[at]})


def _segment(frame: pd.DataFrame, length: int, most: float, least_pages: int, shared: pd.DataFrame | None = None) -> pd.DataFrame:
    """Main texts of a segment's pages; ``shared`` has the pages of classes (``name, total``) that other segments of the host have too."""
    pages, words, page_of, spans = _stream(frame)
    start, _ = _suffixes(words, page_of, length)
    n_pages = len(pages)
    if shared is not None:
        n_pages = int(frame["host_pages"].iloc[0])
        known = shared.sort_values("name")
        names, totals = known["name"].to_numpy(np.int64), known["total"].to_numpy(np.int64)
        if len(names):
            own = window_names(words, length)[: max(len(words) - length + 1, 0)]
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            start[: len(own)] = np.where(names[at] == own, totals[at], start[: len(own)])
    support = covering(start, length)
    many = max(least_pages, most * n_pages)
    out = []
    for blocks, own in zip(pages, spans):
        marked = any(z == MAIN for z, _ in blocks)
        kept = []
        covered = 0
        for (z, text), (a, b) in zip(blocks, own):
            s = support[a:b]
            covered += int((s >= 2).sum())
            if z == CLUTTER or (marked and z != MAIN):
                continue
            gone = s >= (many if marked else 2)
            if 2 * gone.sum() < len(gone):  # a repeat that only reaches into a block leaves it whole
                kept.append(text)
            elif not gone.all():
                kept.append(" ".join(w for w, g in zip(text.split(" "), gone) if not g))
        out.append(("\n\n".join(kept), covered))
    text, n = zip(*out) if out else ((), ())
    return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": list(text), "n_repeated": list(n)})


def main_text(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    length: int = 12,
    most: float = 0.6,
    least_pages: int = 30,
    segment_chars: int = 6_000_000,
) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated`` for every page.

    A substring of ``length`` tokens is boilerplate if it stands on two pages of
    the host, and inside a marked article on ``most`` of them and on
    ``least_pages`` at least.  ``n_repeated`` counts the page's tokens in
    substrings that another page repeats.  Null and empty pages have an empty
    text.  The host is the URL's, lower-cased; pages without one are a host
    together.  Rows with equal ids are pages of their own.  Nothing is cut.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    id_type = pages.schema[page_id].dataType
    # as text, since a null among integers would make floating point of them in a task
    base = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    sizes = base.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("chars"), F.count(F.lit(1)).alias("host_pages"))
    # only hosts of several segments; a written table, so that its size decides how it is joined
    large = materialize(sizes.select("host", F.ceil(F.col("chars") / segment_chars).alias("n"), "host_pages").where("n > 1"))

    @F.pandas_udf("string")
    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(["\x1e".join(f"{z}\x1f{t}" for z, t in page_blocks(_plain(p))) for p in batch], dtype=object)

    own = F.xxhash64("page_id", "url", "html")
    met = base.join(large, "host", "left")
    segment = F.xxhash64("host", F.pmod(F.xxhash64(own), F.coalesce("n", F.lit(1)))).alias("segment")
    held = lambda df, *more: df.select("page_id", "url", blocks("html").alias("blocks"), segment, *more)
    schema = "page_id string, url string, text string, n_repeated long"
    done = held(met.where("n is null")).groupBy("segment").applyInPandas(lambda frame: _segment(frame, length, most, least_pages), schema)
    if large.limit(1).count():
        parts = materialize(held(met.where("n is not null"), F.xxhash64("host").alias("host"), "host_pages"))
        named = parts.groupBy("segment").applyInPandas(lambda frame: _classes(frame, length), "host long, segment long, name long, n long")
        line = Window.partitionBy("host", "name")  # a row for each segment of a host at most
        shared = named.select("segment", "name", F.sum("n").over(line).alias("total"), F.count(F.lit(1)).over(line).alias("_in"))
        shared = shared.where("_in > 1").drop("_in")
        merged = parts.groupBy("segment").cogroup(shared.groupBy("segment"))
        done = done.unionByName(merged.applyInPandas(lambda frame, more: _segment(frame, length, most, least_pages, more), schema))
    return done.select(F.col("page_id").cast(id_type).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def _plain(page: str | None) -> str | None:
    """Without the characters that separate blocks here; white space in HTML."""
    if page and ("\x1e" in page or "\x1f" in page or "\x1d" in page):
        return page.replace("\x1e", " ").replace("\x1f", " ").replace("\x1d", " ")
    return page
