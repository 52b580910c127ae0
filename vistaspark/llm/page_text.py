"""HTML extraction by nearest-URL page differencing.

A page is read into text lines, one per block, frame and article alike. Each page is paired
with its neighbours in the order of URL paths within its host, the pages' lines are aligned
by longest common subsequence, and the lines that they share, the frame of the site, go.

Then the markup is held against that, as an exact check. A shared line that stands in the
element that names the article stays: a copied article or a licence line is no frame. A line
that is not shared but stands in a menu, form, advert, comment or the like, or outside the
article that the page names, goes: a frame can have words of its own on each page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.llm.chaining import common
from vistaspark.llm.common import materialise, small_side, tidy

# Names of HTML elements and the usual names of page parts.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("aside button canvas datalist dialog footer form head iframe menu nav noscript object search select svg template textarea title".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or id that mark a part of the frame.
MARKS = set(
    "ad ads adbox advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs byline captcha comment comments "
    "consent cookie cookies copyright disclaimer disqus flyout footer gdpr header login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification pagination pager paywall popup promo promos promotion recommended related replies reply respond share sharing "
    "sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)

#: Words in a class that mark the frame of a site, but the heading of an article within it.
HEADINGS = {"header"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _part(tag: str, attrs: str, in_article: bool) -> str:
    """'article', 'frame' or '' for an element."""
    for name, value in _ATTR.findall(attrs) if attrs.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "frame"
        if name == "role" and value in ROLES:
            return "frame"
        if name in ("class", "id") and tag not in ("html", "body") and (MARKS - HEADINGS if in_article else MARKS) & set(re.split(r"[^a-z]+", value)):
            return "frame" if tag not in ("article", "main") or "comment" in value else "article"
    if tag in DROPPED or tag == "header" and not in_article:
        return "frame"
    return "article" if tag in ("article", "main") else ""


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether an end tag, tag or '', attributes) in page order, in one forward scan.

    Comments, declarations and the content of scripts and the like are left out. Once a quote
    in a tag is found to have no end, quotes no longer hold tags together.
    """
    at, form, strict = 0, _TAG, True
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield page[at:lt], False, "", ""
            at = end + 3 if end >= 0 else len(page)
            continue
        kind = page[lt + 1 : lt + 3]
        if kind[:1] in ("!", "?"):
            end = page.find(">", lt)
            if end < 0:
                break
            yield page[at:lt], False, "", ""
            at = end + 1
            continue
        if not (kind[:1].isascii() and kind[:1].isalpha() or kind[:1] == "/" and kind[1:].isascii() and kind[1:].isalpha()):
            yield page[at : lt + 1], False, "", ""
            at = lt + 1
            continue
        m = form.match(page, lt)
        if m is None and strict:
            form, strict = _LOOSE_TAG, False
            m = form.match(page, lt)
        if m is None:  # no ">" is left
            break
        tag = m[2].lower()
        yield page[at:lt], m[1] == "/", tag, m[3]
        at = m.end()
        if tag in RAW and not m[1]:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
    yield page[at:], False, "", ""


#: What the markup says of a line: in the article that the page names; in the frame, or
#: outside that article; neither.
ARTICLE, FRAME, OPEN = 1, 2, 0


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The lines of a page in order, and what the markup says of each."""
    lines, kinds, pieces = [], [], []
    stack: list[tuple[str, str]] = []  # open elements that name a part, or whose end must be told from theirs
    named: dict[str, int] = {}  # of them, those that name a part, by tag
    parts = {"frame": 0, "article": 0, "": 0}
    found = False

    def close() -> None:
        line = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if line:
            lines.append(line)
            kinds.append(FRAME if parts["frame"] else ARTICLE if parts["article"] else OPEN)

    for text, is_end, tag, attrs in tokens(page):
        pieces.append(text)
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            close()
        if is_end:
            # of elements that name no part only those are on the stack that stand in one of the same tag
            if named.get(tag):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                if any(part for _, part in stack[k:]) and tag not in BLOCKS:
                    close()
                for t, part in stack[k:]:
                    parts[part] -= 1
                    named[t] -= part != ""
                del stack[k:]
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            part = _part(tag, attrs, parts["article"] > 0)
            if part or named.get(tag):
                if part and tag not in BLOCKS:
                    close()
                stack.append((tag, part))
                parts[part] += 1
                named[tag] = named.get(tag, 0) + (part != "")
                found = found or part == "article" and not parts["frame"]
    close()
    return lines, [FRAME if found and kind == OPEN else kind for kind in kinds]


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    return set(common(np.asarray(a), np.asarray(b))[0].tolist())


def shared_lines(lines: list, lengths: list[int], *others: list | None) -> list[bool]:
    """For each line, whether it is on a common subsequence with a neighbour.

    A neighbour that shares more than nine tenths of the page's characters is a copy of the
    article, not only of the frame: it tells nothing and is left out.
    """
    shared, whole = np.zeros(len(lines), bool), sum(lengths)
    for other in others:
        places = list(common_lines(lines, other)) if other is not None and len(other) and len(lines) else []
        if 10 * sum(lengths[i] for i in places) <= 9 * whole:
            shared[places] = True
    return shared.tolist()


def _digest(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "big", signed=True)


#: What is kept of a page: of each line a hash, its length and what the markup says; the lines outside the frame.
READ = {"hashes": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "kinds": pa.list_(pa.int8()), "lines": pa.list_(pa.string())}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [[], [], [], []]
        for value in batch.column(1):
            own, said = lines_of(value.as_py())
            for column, x in zip(columns, ([_digest(x) for x in own], [len(x) for x in own], said, [x for x, kind in zip(own, said, strict=True) if kind != FRAME]), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x, t) for x, t in zip(columns, READ.values(), strict=True)]], ["page_id", "url", *READ])


def _neighbours(pages: DataFrame) -> DataFrame:
    """row, before, after: the rows next to each in the order of host and path, within the host.

    The order is Spark's range partitioning; only the rows at the ends of partitions, two for
    each, look across.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    keys = pages.select("row", host.alias("host"), path.alias("path"))
    dealt = materialise(keys.repartitionByRange("host", "path", "row").withColumn("part", F.spark_partition_id()), "page-order")
    key = F.struct("host", "path", "row")
    ends = dealt.groupBy("part").agg(F.min(key).alias("head"), F.max(key).alias("tail"))
    parts = Window.orderBy("part")
    ends = ends.select("part", F.lag("tail").over(parts).alias("tail_before"), F.lead("head").over(parts).alias("head_after"))
    inside = Window.partitionBy("part").orderBy("host", "path", "row")
    near = dealt.select("row", "host", "part", F.lag(key).over(inside).alias("b"), F.lead(key).over(inside).alias("a"))
    # one row a partition
    near = near.join(F.broadcast(ends), "part").withColumn("b", F.coalesce("b", "tail_before")).withColumn("a", F.coalesce("a", "head_after"))
    same = lambda x: F.when(F.col(f"{x}.host") == F.col("host"), F.col(f"{x}.row"))
    return near.select("row", same("b").alias("before"), same("a").alias("after"))


def page_text(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared for every row of ``df`` (page_id, url, html).

    ``n_lines``: all text lines of the page, ``n_shared``: those that its neighbours share.
    Null and empty html give an empty text, a null url a page of an empty host; broken and
    very long html is read to its end in one scan. Of copies of a page, each gets its text,
    and repeated page_ids are rows of their own. An empty table gives an empty result. Other
    columns are not read.
    """
    source = df.select("page_id", F.coalesce("html", F.lit("")).alias("html"), "url")
    kinds = dict(df.dtypes)
    read = source.mapInArrow(tidy(_read), f"page_id {kinds['page_id']}, url string, hashes array<long>, lengths array<int>, kinds array<tinyint>, lines array<string>")
    read = materialise(read.withColumn("row", F.monotonically_increasing_id()), "page-lines")
    # lines are aligned by their hashes: what moves between tasks is some bytes a line
    narrow = read.select("row", "url", "hashes", "lengths")
    near = _neighbours(narrow)

    @F.pandas_udf("array<boolean>")
    def shared(own: pd.Series, lengths: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([shared_lines(a, n.tolist(), b, c) for a, n, b, c in zip(own, lengths, before, after, strict=True)], dtype=object)

    of = lambda side: narrow.select(F.col("row").alias(side), F.col("hashes").alias(f"hashes_{side}"))
    paired = narrow.join(near, "row").join(of("before"), "before", "left").join(of("after"), "after", "left")
    aligned = paired.select("row", shared("hashes", "lengths", "hashes_before", "hashes_after").alias("shared"))
    aligned = materialise(aligned, "page-shared")
    size = aligned.agg(F.count(F.lit(1)), F.sum(F.size("shared"))).first()
    whole = read.join(small_side(aligned, max(size[0], (size[1] or 0) // 32)), "row")
    outside = F.filter(F.arrays_zip("kinds", "shared"), lambda x: x["kinds"] != FRAME)
    stays = F.filter(F.arrays_zip("lines", outside.alias("said")), lambda x: (x["said"]["kinds"] == ARTICLE) | ~x["said"]["shared"])
    whole = whole.withColumn("text", F.array_join(F.transform(stays, lambda x: x["lines"]), "\n\n"))
    return whole.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("kinds").alias("n_lines"), F.size(F.filter("shared", lambda x: x)).alias("n_shared"))
