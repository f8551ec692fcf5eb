"""Main text of web pages by differencing neighbours in URL order.

Pages of a host are put in the order of their URL paths; each is aligned with the two pages before and the two after it
by a longest common subsequence of text lines, and the lines it shares with two of them (with one, where there is one
only) are deleted: menus, notices and other furniture repeat from page to page, the text of a copy does not. Copies that
follow each other count as one page and none is its own neighbour. Markup says more where it is clear: what a page declares as navigation, form, advert,
comment and the like goes even if no neighbour repeats it, and paragraphs inside its declared article stay even if a
copy of the article stands next to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, work_table
from .url_filter import host_of, path_of

#: Deletions of up to this number of pages (a key and a few line numbers each) are broadcast, more are joined by a shuffle.
BROADCAST_PAGES = 50_000
#: Matching pairs of lines up to which an alignment looks at each of them.
PAIRS = 200_000
#: Neighbours on each side, and how many of them must have a line that is deleted.
NEAR, AGREE = 2, 2
PLAIN, ARTICLE, FURNITURE = 0, 1, 2

# HTML element names and the words by which sites name the furniture of a page.
_RAW = {"script", "style", "template", "textarea", "title", "iframe", "noscript", "svg", "math", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "fieldset", "object", "video", "audio", "canvas", "map"}
_FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
_FURNITURE_WORDS = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "ad", "ads", "advert", "adverts", "advertisement", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "comment", "comments", "commentlist", "respond", "replies", "discussion", "disqus", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "newsletter", "subscribe", "signup", "login", "search", "skip", "toolbar", "widget", "copyright", "masthead", "topbar", "hidden"}
_BOX_WORDS = {"site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "list", "item", "items", "links", "link", "box", "block", "bar", "area", "section", "container", "wrapper", "wrap", "inner", "outer", "row", "col", "column", "panel", "region", "zone", "slot", "unit", "form", "field", "post", "posts", "article", "articles", "stories", "media", "button", "buttons", "icons", "text", "js", "el"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    """Names of attributes (lower case) and their values, the first of each name."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _names_furniture(name: str, words: set[str]) -> bool:
    """Whether a class or id is the word, or joins it with words that only say where or what kind of box it is."""
    parts = [x for x in _SPLIT.split(name) if x]
    return any(x in words for x in parts) and all(x in words or x in _BOX_WORDS or x.isdigit() for x in parts)


def _declared(attributes: dict[str, str], inside: bool) -> bool:
    """Whether class, id, role or style name the element as furniture, or it isn't shown."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _NOT_SHOWN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").strip().lower() in _FURNITURE_ROLES:
        return True
    words = _FURNITURE_WORDS if inside else _FURNITURE_WORDS | {"header"}
    return any(_names_furniture(x, words) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def blocks(html: str | None) -> list[tuple[str, int]]:
    """The page's text blocks in order, each PLAIN, in its ARTICLE, or FURNITURE. Broken markup is read as far as it goes."""
    page = html or ""
    out: list[tuple[str, int]] = []
    stack: list[list] = []  # name, furniture by its element, furniture by its names, article
    held: list[str] = []
    at = 0

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, FURNITURE if any(e[1] or e[2] for e in stack) else ARTICLE if any(e[3] for e in stack) else PLAIN))

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes, ending = m[3] or m[6] or "", bool(m[1] or m[4])
        if tag in _RAW and not ending:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in _INLINE:
            close()
        elif tag == "br":
            held.append(" ")
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(e[1] or e[2] or e[3] for e in stack[k:]):
                        close()
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE and stack:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _INLINE and any(e[0] == "p" for e in stack)):
                stack.pop()
            if stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
        if tag == "body":
            stack = [e for e in stack if e[0] != "head"]
        names = _attributes(attributes) if attributes else {}
        article = tag in ("article", "main") or names.get("role", "").strip().lower() == "main"
        inside = any(e[3] for e in stack)
        if article:
            for e in stack:  # a frame around the article is no furniture, whatever its names say
                e[2] = False
        by_tag = tag in _FURNITURE_TAGS or tag == "header" and not inside
        named = bool(names) and tag not in ("html", "body") and not article and _declared(names, inside)
        if named and held:
            close()
        if not attributes.endswith("/"):
            stack.append([tag, by_tag, named, article])
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b.

    Where few pairs of lines match, by these pairs (patience piles). Lines that repeat in both make the pairs many: then
    b is divided where the halves of a have most in common with its parts, which takes the lengths of the common
    subsequences with all beginnings and all ends of b; these come out of one pass over a with the bits of a long
    integer for b's lines.
    """
    first, second = Counter(a), Counter(b)
    if len(a) < 2 or sum(n * second[x] for x, n in first.items()) <= PAIRS:
        return _by_pairs(a, b)
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = list(range(low)), list(range(len(a) - high, len(a)))
    if low or high:
        return ends[0] + [low + i for i in common_lines(a[low : len(a) - high], b[low : len(b) - high])] + ends[1]
    half = len(a) // 2
    before, after = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int(np.argmax(before + after))
    return common_lines(a[:half], b[:cut]) + [half + i for i in common_lines(a[half:], b[cut:])]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each beginning of b (of 0 to all lines)."""
    places: dict[int, int] = {}
    wanted = set(a)
    for j, x in enumerate(b):
        if x in wanted:
            places[x] = places.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        both = row & places.get(x, 0)
        row = ((row + both) | (row - both)) & every
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _by_pairs(a: list[int], b: list[int]) -> list[int]:
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tops: list[int] = []  # the least place in b at which a common sequence of so many lines can end
    ends: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tops, j)
            node = (i, ends[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                ends.append(node)
            else:
                tops[k], ends[k] = j, node
    found, node = [], ends[-1] if ends else None
    while node:
        found.append(node[0])
        node = node[1]
    return found[::-1]


def _shared(own: list[int], kinds: list[int], near: list[list[int] | None]) -> set[int]:
    """Undeclared lines that AGREE neighbours have too, or the only one has; copies are no neighbours. A page without
    a line that its only neighbour lacks tells nothing of which lines are furniture, and loses none."""
    others = [x for x in near if x and x != own]
    plain = {i for i, k in enumerate(kinds) if k == PLAIN}
    if not others or not plain:
        return set()
    times = Counter(i for x in others for i in common_lines(own, x))
    gone = {i for i in plain if times[i] >= min(AGREE, len(others))}
    return set() if len(others) == 1 and gone == plain else gone


def _key() -> Column:
    """128 bits of (url, html), so that no two pages of any table share them by chance."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("+"), F.col("url")), F.lit("-")), F.lit("\n"), F.coalesce(F.col("html"), F.lit(""))).cast("binary"))


def _lines(pages: DataFrame) -> DataFrame:
    """(key, host, path, lines, kinds): hashes and kinds of every page's text lines."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, kinds = [], []
            for html in batch.column(3):
                found = blocks(html.as_py())
                lines.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in found])
                kinds.append([k for _, k in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8()))], ["key", "host", "path", "lines", "kinds"])

    return pages.select(_key().alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").mapInArrow(
        each, "key string, host string, path string, lines array<long>, kinds array<byte>")


def _in_url_order(lines: DataFrame) -> DataFrame:
    """Adds the place of every page in the order of (host, path, key), without gathering a host in one task. Pages of
    a host that follow each other and have equal lines share a place."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, part, last = -1, TaskContext.get().partitionId(), None
        for batch in batches:
            nth, digests = [], []
            for host, own in zip(batch.column("host"), batch.column("lines"), strict=True):
                digest = xxhash.xxh3_128_hexdigest(repr((host.as_py(), own.as_py())))
                n, last = n + (digest != last), digest
                nth.append(n)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(nth, pa.int64()), pa.array(digests, pa.string())],
                [*batch.schema.names, "part", "nth", "digest"])

    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema) + ", part int, nth long, digest string"
    placed = work_table(lines.repartitionByRange(n, "host", "path", "key").sortWithinPartitions("host", "path", "key").mapInArrow(number, fields), "order")
    starts, before, last = [], 0, None
    ends = placed.groupBy("part").agg(F.max("nth").alias("n"), F.min_by("digest", "nth").alias("first"), F.max_by("digest", "nth").alias("last"))
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        before -= r["first"] == last  # the copies of a page can lie on both sides of a cut
        starts.append((r["part"], before))
        before, last = before + r["n"] + 1, r["last"]
    first = F.broadcast(spark.createDataFrame(starts, "part int, before long"))  # one number for each partition
    return placed.join(first, "part").withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before", "digest")


def deletions(pages: DataFrame) -> DataFrame:
    """(key, gone): for the pages (url, html) that lose undeclared lines to their neighbours, the numbers of these lines."""
    ordered = work_table(_in_url_order(work_table(_lines(pages).where(F.size("lines") > 0).dropDuplicates(["key"]), "lines")), "placed")
    steps = [k for k in range(-NEAR, NEAR + 1) if k]
    seen = ordered.select("place", "host", "lines").dropDuplicates(["place"])
    sent = seen.select("host", "lines", F.explode(F.array(*[F.struct((F.col("place") - k).alias("place"), F.lit(k).alias("step")) for k in steps])).alias("x"))
    near = sent.groupBy("x.place", "host").agg(*[F.first(F.when(F.col("x.step") == k, F.col("lines")), ignorenulls=True).alias(f"n{i}") for i, k in enumerate(steps)])
    both = ordered.where(F.array_contains("kinds", F.lit(PLAIN).cast("byte"))).withColumn("host", F.coalesce("host", F.lit("")))
    both = both.join(near.withColumn("host", F.coalesce("host", F.lit(""))), ["place", "host"]).select("key", "lines", "kinds", F.array(*[f"n{i}" for i in range(len(steps))]).alias("near"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone = [], []
            for key, own, kinds, near in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if found := _shared(own, kinds, near):
                    keys.append(key)
                    gone.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return work_table(both.mapInArrow(each, "key string, gone array<int>"), "gone")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text.

    text is the main text: blocks in page order joined by an empty line, white space within a block as one space,
    character references decoded; empty if none (null or empty html). Null URLs share one empty host. Repeated rows
    get the same text; other columns are ignored. Where a page declares an article, its text is that article's;
    otherwise all blocks that neither markup nor a neighbour marks as furniture.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    gone = deletions(rows.select("url", "html"))
    few = gone.count() <= BROADCAST_PAGES
    found = rows.withColumn("key", _key()).join(F.broadcast(gone) if few else gone, "key", "left").select("page_id", "url", "html", "gone")
    kind = found.schema["page_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, gone in zip(batch.column(2), batch.column(3), strict=True):
                lines, lost = blocks(html.as_py()), set(gone.as_py() or ())
                kept = [(t, k) for i, (t, k) in enumerate(lines) if k != FURNITURE and i not in lost]
                article = [t for t, k in kept if k == ARTICLE]
                texts.append("\n\n".join(article or [t for t, _ in kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return found.mapInArrow(each, f"page_id {kind}, url string, text string")
