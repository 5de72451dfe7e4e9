"""Main text of web pages: markup, and differences from the page with the nearest URL."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import partitions, ship

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

# Element names of HTML by what they mean for the text.
RAW = {"script", "style", "template", "textarea", "title", "iframe"}
FOREIGN = {"svg", "math"}
#: Elements of FOREIGN that are never shown.
UNSEEN = {"desc", "metadata", "annotation", "annotation-xml"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
MAIN = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Parts of class, id or role names that mark what is no article.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "contentinfo", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "promoted", "recommended", "related",
    "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}


def lines(page: str) -> list[tuple[str, str]]:
    """(where, text) of every block of text; where: main (in an article or main element), rest, or dropped."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    open_: list[tuple[str, int, bool]] = []  # name, dropped, main
    dropped = main = 0
    foreign: list[str] = []  # open svg, math and foreignobject elements

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(("dropped" if dropped else "main" if main else "rest", text))

    def close(to: int) -> None:
        nonlocal dropped, main
        while len(open_) > to:
            _, d, m = open_.pop()
            dropped -= d
            main -= m

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        if tag is None:
            held.append(html.unescape(page[at:]))
            break
        if tag.start() > at:
            held.append(html.unescape(page[at : tag.start()]))
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        if tag["close"] or tag["close2"]:
            if name in BLOCKS:
                flush()
            if name in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(name) :]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close(k)
                    break
            continue
        empty = (tag["attrs"] or "").endswith("/")
        within = bool(foreign) and foreign[-1] in FOREIGN
        if name in RAW or (within and name in UNSEEN):
            if within and empty:
                continue
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else at if name in UNSEEN else len(page)
            continue
        if (name in FOREIGN or (within and name == "foreignobject")) and not empty:
            foreign.append(name)
        elif within and name in BLOCKS:  # HTML ends an open svg or math
            foreign.clear()
        if name == "br" or (within and name == "text"):
            held.append(" ")
        if name in BLOCKS:
            flush()
            if open_ and open_[-1][0] == "p":  # a block ends an open paragraph
                close(len(open_) - 1)
        if name in VOID or empty:
            continue
        marks = {w for m in _MARK.findall(tag["attrs"] or tag["attrs2"] or "") for w in re.split(r"[^a-z0-9]+", m.lower())}
        away = int(name in DROPPED or (name == "header" and not main) or (name not in ("html", "body") and bool(marks & MARKS)))
        article = name in MAIN and not away
        if article and not main:  # marks of what surrounds the article say nothing about it
            away = -sum(d for n, d, _ in open_ if d > 0 and n not in DROPPED and n != "header")
        if name in BLOCKS or away:
            open_.append((name, away, article))
            dropped += away
            main += article
    flush()
    return out


def shared(one: list[str], two: list[str]) -> list[bool]:
    """Which lines of one are in a longest common subsequence with two, by bit-parallel rows."""
    where: dict[str, int] = {}
    for j, line in enumerate(two):
        where[line] = where.get(line, 0) | (1 << j)
    full = (1 << len(two)) - 1
    rows = [full]
    for line in one:
        v = rows[-1]
        u = v & where.get(line, 0)
        rows.append(((v + u) | (v - u)) & full)
    found, i, j = [False] * len(one), len(one), len(two)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        elif not rows[i - 1] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found[i] = True
    return found


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def main_text(mine: list[tuple[str, str]], other: list[tuple[str, str]]) -> tuple[str, int]:
    """(text, shared lines deleted) of a page's lines, given those of the nearest page."""
    common = shared([t for _, t in mine], [t for _, t in other])
    article = any(w == "main" for w, _ in mine)
    gone = [w != "main" and c for (w, _), c in zip(mine, common)]
    kept = [t for (w, t), g in zip(mine, gone) if not g and w == ("main" if article else "rest")]
    return "\n\n".join(kept), sum(gone)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, host, path, html, own) in the order of all pages, three held at a time; only own pages give a row."""
    before = current = None
    out: list[tuple] = []

    def done(page: tuple, last: tuple | None, following: tuple | None) -> None:
        if not page[5]:
            return
        near: tuple | None = None
        for other in (last, following):
            if other is not None and other[2] == page[2] and (near is None or _common(page[3], other[3]) > _common(page[3], near[3])):
                near = other
        text, n = main_text(page[6], near[6] if near else [])
        out.append((page[0], page[1], text, len(text), n, near[0] if near else None))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 6
        out.clear()
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "text", "n_chars", "n_shared", "near_id"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            page = (*row, lines(row[4] or ""))
            if current is not None:
                done(current, before, page)
            before, current = current, page
            if len(out) >= 500:
                yield batch_of()
    if current is not None:
        done(current, before, None)
    yield batch_of()


_ORDER = ("host", "path", "page_id", "url", "tie")


def _key(host: str, path: str, page_id: int | None, url: str | None, tie: int) -> tuple:
    """Orders pages as Spark orders the columns of _ORDER: NULL first."""
    return host, path, page_id is not None, page_id or 0, url is not None, url or "", tie


def _deal(first: list[tuple], last: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds range and own to rows (*_ORDER, html): every page goes to its range, and the first and last page of
    a range also to the range before or after it, not as its own. first, last: keys of the ranges, in order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()  # equal pages are lent once a task
        for batch in batches:
            rows, ranges, own = [], [], []
            for i, key in enumerate(map(_key, *(batch.column(k).to_pylist() for k in range(5)))):
                k = max(bisect_right(first, key) - 1, 0)
                to = [k]
                if key not in sent and (key == first[k] or key == last[k]):
                    sent.add(key)
                    to += [k - 1] * (key == first[k] and k > 0) + [k + 1] * (key == last[k] and k + 1 < len(first))
                rows += [i] * len(to)
                ranges += to
                own += [True] + [False] * (len(to) - 1)
            dealt = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*dealt.columns, pa.array(ranges, pa.int32()), pa.array(own, pa.bool_())], names=[*_ORDER, "html", "range", "own"])

    return deal


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points), n_shared, near_id.

    Pages of a host are put in the order of their URL paths, and each is paired with the neighbour whose path has
    the longer common beginning (near_id). The text lines (blocks) of both are aligned by a longest common
    subsequence; shared lines outside the article are deleted (n_shared). Of the other lines, those of menus,
    headers, footers, sidebars, forms, adverts, notices and comments go by their markup; if the page has an
    article or main element, only its lines are left. Blocks are joined by two line feeds.

    Shared lines inside an article element stay: pages with equal or similar articles would lose them.

    All pages are in one order (host, path, page_id, url, hash of html), cut into ranges of about equal size, so
    no task gets a host whole; only rows that agree in all of these share a range. The first and last page of a
    range are lent to the ranges beside it, so the pairs do not depend on where ranges are cut. The driver gets
    these two keys of every range.

    NULL html is an empty page (empty text); a NULL or odd URL belongs to the host '' . Rows that repeat an
    identifier are separate pages. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("tie", F.xxhash64("html")).select(*_ORDER, "html")
    key = F.struct(*_ORDER)
    cuts = rows.select(*_ORDER).repartitionByRange(partitions(spark), *_ORDER).groupBy(F.spark_partition_id().alias("k")).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    first, last = (sorted(_key(*r[c]) for r in cuts) for c in ("first", "last"))
    dealt = rows.mapInArrow(_deal(first or [()], last or [()]), "host string, path string, page_id long, url string, tie long, html string, range int, own boolean")
    placed = dealt.repartitionById(max(len(cuts), 1), F.col("range")).sortWithinPartitions("range", *_ORDER)
    return placed.select("page_id", "url", "host", "path", "html", "own").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long, n_shared long, near_id long")
