"""HTML extraction by differencing each page with the one of nearest URL on its host."""

from __future__ import annotations

import bz2
import hashlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Pages of a host-and-path order that one group holds, and neighbours on either side that a page is compared with.
GROUP, BESIDE = 64, 3
#: A neighbour that shares more of a page's article is a reprint of it; one that shares more of all its lines, a copy.
REPRINT, COPY = 0.5, 0.9
#: Neighbours, reprints aside, that there have to be, and all share a line at an end of an article, before it counts as the template's.
AGREE = 3
#: Cells of one table of an alignment; longer pages are split until their tables are as small.
CELLS = 1 << 20

# Fixed values of HTML: elements whose text is no content, elements that begin a new line, and elements without an end.
_DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "fieldset", "iframe", "svg", "canvas", "object", "embed", "audio", "video", "dialog", "menu", "datalist"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "toolbar"}
#: Class names and ids, whole ones, that mark what surrounds an article.
_MARKS = regex.compile(r"(?i)(?:^|\s)(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|notice|notices|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|comment|comments|disqus|reply|replies|respond|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations|pagination|pager|skip|search|widget|toc|alert|disclaimer|copyright)(?:$|\s)")
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: A quote opens a value only after "="; elsewhere it is part of a name, as browsers have it.
_TOKEN = regex.compile(r"<!--(?:>|->|.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|))*+)(?:>|\Z)", regex.S)
_ATTRIBUTE = regex.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_CLOSES_P = _BLOCKS - {"br", "body", "html", "caption", "dd", "dt", "li", "legend", "optgroup", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}


class Line:
    """A line of a page's text: within the article proper, within what is never content, or neither."""

    __slots__ = ("text", "inside", "outside")

    def __init__(self, text: str, inside: bool, outside: bool):
        self.text, self.inside, self.outside = text, inside, outside


def page_lines(html: str) -> list[Line]:
    """The page's text, a line for each block, with character references decoded and white space made single."""
    lines: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are dropped
    marked: set[int] = set()  # depths of those that only a class or id drops
    dropped = articles = 0
    met = False  # an article so far

    def flush() -> None:
        text = " ".join("".join(map(unescape, held)).split())
        if text:
            lines.append(Line(text, articles > 0, dropped > 0))
        held.clear()

    def close(upto: int) -> None:
        nonlocal dropped, articles
        while len(stack) > upto:
            tag, bad = stack.pop()
            marked.discard(len(stack))
            dropped -= bad
            articles -= tag in ("article", "main")

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        held.append(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                held.append(m.group()[9:-3])
            continue
        tag, ends = m.group(2).lower(), bool(m.group(1))
        if tag in _RAW and not ends:
            flush_needed = tag in _DROPPED
            end = regex.compile(rf"(?i)</{tag}\s*>").search(html, at)
            at = end.end() if end else n
            if flush_needed:
                continue
        if tag in _BLOCKS:
            flush()
        if ends:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if where is not None:
                close(where)
            continue
        if tag in _CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            own = "p" if tag in _CLOSES_P else tag
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == own), None)
            limit = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("article", "main", "section", "div", "ul", "ol", "dl", "table", "td", "body") and stack[i][0] != own), -1)
            if where is not None and where > limit:
                close(where)
        if tag in _VOID or m.group(3).rstrip().endswith("/") and tag not in _BLOCKS:
            continue
        bad = tag in _DROPPED or (tag == "header" and not articles)
        if not bad and m.group(3).strip():
            got = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(m.group(3))}
            bad = got.get("role", "").lower() in _ROLES or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
            if not bad and tag not in ("article", "main", "body", "html") and not (articles and tag in _TEXT):
                names = ("class",) if articles or tag in _TEXT else ("class", "id")
                if bad := any(_MARKS.search(got.get(k, "")) for k in names):
                    marked.add(len(stack))
        if tag == "main" or (tag == "article" and not met):  # what holds the article is no sidebar or notice
            for k in marked:
                stack[k] = (stack[k][0], False)
                dropped -= 1
            marked.clear()
        met = met or tag in ("article", "main")
        stack.append((tag, bad))
        dropped += bad
        articles += tag in ("article", "main")
    flush()
    return lines


def common_lines(a: list, b: list) -> list[int]:
    """Positions in a of a longest common subsequence of a and b. Equal ends are matched first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [*range(head), *range(len(a) - tail, len(a))]
    there = set(b[head : len(b) - tail])
    own = [i for i in range(head, len(a) - tail) if a[i] in there]
    here = {a[i] for i in own}
    other = [x for x in b[head : len(b) - tail] if x in here]
    if not own or not other:
        return sorted(found)
    codes = {x: k for k, x in enumerate(here)}
    x, y = np.array([codes[a[i]] for i in own]), np.array([codes[v] for v in other])
    return sorted(found + [own[i] for i in _longest(x, y)])


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _longest(x: np.ndarray, y: np.ndarray, start: int = 0) -> list[int]:
    """Positions in x (plus start) of a longest common subsequence, split in halves until a table is small."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        return [start] if (y == x[0]).any() else []
    if len(x) * len(y) > CELLS:
        half = len(x) // 2
        cut = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
        return _longest(x[:half], y[:cut], start) + _longest(x[half:], y[cut:], start + half)
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(y == x[i], table[i, :-1] + 1, 0)))
    i, j, found = len(x), len(y), []
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            found.append(start + i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def _address(url: str) -> tuple[str, str]:
    try:
        parts = urlsplit(url.strip())
        return (parts.netloc.rpartition("@")[2].lower(), parts.path.rstrip("/") or "/")
    except ValueError:
        return ("", url)


def _nearness(a: str, b: str) -> int:
    """Leading path segments in common."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def parsed_pages(pages: DataFrame, html: str = "html", url: str = "url", id_: str = "page_id") -> DataFrame:
    """(key, page_id, url, host, path, digests, may, body): lines as packed digests, each with whether it is the article's, and the texts of those that may stay compressed.

    key is a hash of host and lines; may has a bit a line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "page_id", "url", "host", "path", "digests", "may", "body"]
        for batch in slices(batches, "html", 1 << 20):
            out: list[tuple] = []
            for id_, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                lines = page_lines(html or "")
                host, path = _address(url or "")
                digests = b"".join(_digest(x.text) + (b"\1" if x.inside and not x.outside else b"\0") for x in lines)
                key = hashlib.blake2b(host.encode("utf-8", "replace") + b"\0" + digests, digest_size=16).digest()
                may = may_stay([[x.text, x.inside, x.outside] for x in lines])
                body = "\n".join(x.text for x, m in zip(lines, may) if m).encode("utf-8", "replace")
                out.append((key, id_, url, host, path, digests, np.packbits(np.array(may, bool)).tobytes(), bz2.compress(body, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=names)

    rows = pages.select(F.col(id_).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "key binary, page_id long, url string, host string, path string, digests binary, may binary, body binary")


_LINE = 13


def _alike(a: list, b: list) -> int:
    """How many elements from the beginning on are the same."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def template_lines(own: list[bytes], near: list[list[bytes]]) -> list[int]:
    """Positions of a page's lines that are the template's, from its neighbours' lines, the nearest first.

    A page that shares nearly all lines is a copy and tells nothing unless there are only such. Of the others, the nearest one's common subsequence
    with the page is the template. Within an article, where a line may be a quotation, more is asked: that all neighbours that are
    no reprints, AGREE at least, share the line and those between it and the article's beginning or end.
    """
    if not near:
        return []
    article = [i for i, x in enumerate(own) if x[-1]]
    place = {i: k for k, i in enumerate(article)}
    text, found, votes, asked = [x[:-1] for x in own], None, np.zeros(len(own), int), 0
    for other in near:
        common = common_lines(text, [x[:-1] for x in other])
        if len(common) <= COPY * len(own) and found is None:
            found = common
        if not article or sum(i in place for i in common) > REPRINT * len(article):
            continue
        asked += 1
        theirs = [x[:-1] for x in other if x[-1]]
        mine = [text[i] for i in article]
        top, low = _alike(mine, theirs), _alike(mine[::-1], theirs[::-1])
        for i in common:
            if i in place and (place[i] < top or place[i] >= len(article) - low):
                votes[i] += 1
    found = common_lines(text, [x[:-1] for x in near[0]]) if found is None else found
    return sorted({i for i in found if i not in place} | {i for i in article if votes[i] == asked >= AGREE})


def shared_lines(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, shared): positions of a page's lines that template_lines() finds from its nearest pages by URL path on the host.

    Pages of the same lines on a host are one, under the first of their paths: a copy tells nothing about the template. They are
    numbered in order of host, path and URL: by range, then by the ranges' counts. 64 in turn and BESIDE neighbours at
    either end make a group, so a host of any size is spread. Lines join the numbered pages last, so that they are shuffled twice only. Of its neighbours a page takes those with more
    leading path segments in common first, then the closer ones, then the earlier.
    """
    spark = rows.sparkSession
    light = rows.groupBy("key").agg(F.min(F.struct("host", "path", "url", "page_id")).alias("at")).select("key", "at.*")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(np.arange(n, n + batch.num_rows))], names=[*batch.schema.names, "part", "nth"])
            n += batch.num_rows

    ordered = light.repartitionByRange("host", "path", "url", "page_id", "key").sortWithinPartitions("host", "path", "url", "page_id", "key").select("key", "host", "path")
    ordered = scratch.write(ordered.mapInArrow(number, "key binary, host string, path string, part long, nth long"), "ordered")
    scratch.drop()
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a range
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])])[:-1].tolist() if counts else []
    offsets = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(counts, before)] or [(0, 0)], "part long, before long")
    placed = ordered.join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("nth"))
    placed = placed.join(rows.groupBy("key").agg(F.min("digests").alias("digests")), "key")
    group = (F.col("at") / GROUP).cast("long")
    beside = [((F.col("at") + k) / GROUP).cast("long") for k in range(1, BESIDE + 1)] + [F.floor((F.col("at") - k) / GROUP) for k in range(1, BESIDE + 1)]
    placed = placed.withColumn("group", F.explode(F.array_distinct(F.array(group, *beside)))).where("group >= 0")

    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        own = [[d[i : i + _LINE] for i in range(0, len(d), _LINE)] for d in map(bytes, pdf["digests"])]
        hosts, paths, ats, groups = (pdf[c].tolist() for c in ("host", "path", "at", "group"))
        keys, out = pdf["key"].tolist(), []
        for i, at in enumerate(ats):
            if at // GROUP != groups[i]:
                continue
            near = [j for j in range(i - BESIDE, i + BESIDE + 1) if j != i and 0 <= j < len(ats) and abs(ats[j] - at) <= BESIDE and hosts[j] == hosts[i]]
            near.sort(key=lambda j: (-_nearness(paths[i], paths[j]), abs(j - i), j))
            out.append((keys[i], template_lines(own[i], [own[j] for j in near])))
        return pd.DataFrame(out, columns=["key", "shared"])

    return placed.groupBy("group").applyInPandas(difference, "key binary, shared array<int>")


def may_stay(lines: list[list]) -> list[bool]:
    """Whether a line is left without what markup says is no content and, if the page has an article, without what is beside it."""
    article = any(inside and not outside for _, inside, outside in lines)
    return [not outside and (inside or not article) for _, inside, outside in lines]


def main_text(lines: list[list], shared: set[int]) -> str:
    """The lines that may stay, without the template's."""
    return "\n".join(t for i, ((t, _, _), may) in enumerate(zip(lines, may_stay(lines))) if may and i not in shared)


def stored_text(may: bytes, body: bytes, shared: set[int]) -> str:
    """main_text() of a page as parsed_pages() holds it."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(may, np.uint8))).tolist()
    return "\n".join(t for i, t in zip(at, bz2.decompress(body).decode().split("\n")) if i not in shared)


def extract(pages: DataFrame, html: str = "html", url: str = "url", id_: str = "page_id") -> DataFrame:
    """One row per row of pages: page_id, url, text (lines joined by one line end; empty if none), n_chars, n_shared (lines that the differencing found to be the template's).

    Null html is empty; a null or odd URL is a host of its own spelling; a page alone on its host has no neighbour and loses
    only what markup marks. Repeated rows are one page in the order and each get its text. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rows = scratch.write(parsed_pages(pages, html, url, id_), "parsed")
    shared = scratch.write(shared_lines(rows.drop("may", "body"), scratch), "shared")
    scratch.drop("ordered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 1 << 20):
            found = [stored_text(m, b, set(s or ())) for m, b, s in zip(*(batch.column(c).to_pylist() for c in ("may", "body", "shared")))]
            n = [len(s or ()) for s in batch.column("shared").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()), pa.array(n, pa.int32())], names=["page_id", "url", "text", "n_chars", "n_shared"])

    joined = rows.select("key", "page_id", "url", "may", "body").join(shared, "key", "left").select("page_id", "url", "may", "body", "shared")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
