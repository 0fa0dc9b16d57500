"""Main text of web pages by differencing with the nearest page, corrected by structure.

A page is cut into lines, one for each block of text. It is paired with the page of the same host whose URL
is nearest, the two pages' lines are aligned by their longest common subsequence, and shared lines, the
template, are deleted. Structure corrects this where it knows better:

* elements that the text never has (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
  reader comments) go even where the nearest page has other ones;
* inside a marked article (``article``, ``main`` or that role) shared lines are given back, since passages
  that articles share are content, and lines outside it go;
* inside a marked article an element whose class, id or role only hints at something else (sharing, related
  pages, widgets, an article's own ``header``) goes where differencing finds its lines shared, else stays.

Nearest is the page with the longest common start of URL keys. In the order of URL keys that is always the
one before or the one after, so the search is exact.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common
from kgraph.llm.warc import url_key

CHUNK_ROWS = 256
PART_ROWS = 25_000
TABLE_CELLS = 1 << 20

# Element and class names of HTML.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SKIPPED = frozenset("nav footer aside form button select menu dialog fieldset datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msubsup msup mtext object q ruby rb rp rt s samp small "
    "span strike strong sub sup svg time tt u var wbr".split()
)
#: Menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup comment comments replies respond disqus login contentinfo complementary".split()
)
#: May be something else than the article.
HINTS = frozenset("alert popup modal overlay share sharing social related recommended reply widget toolbar pagination pager search skip".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass(slots=True)
class Block:
    text: str
    marked: bool  # inside a marked article
    out: bool  # in an element that is never article text
    doubt: bool  # inside a marked article, in an element whose name hints at something else


def _named(attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Do class, id or role name something to leave out? Do they hint at it? Is the role that of the main
    text? Inside an article only a whole name counts (``ad``, not ``ad-hoc``), and its parts hint."""
    whole: set[str] = set()
    for m in NAMES.finditer(attributes):
        whole |= set(html.unescape(m[1] or m[2] or m[3] or "").lower().split())
    parts = {p for w in whole for p in re.split(r"[_-]+", w)}
    main = "main" in whole and "role" in attributes.lower()
    if not in_article:
        return bool(parts & SKIPPED_NAMES or parts & HINTS), False, main
    return bool(whole & SKIPPED_NAMES), bool(parts & SKIPPED_NAMES or parts & HINTS), main


def blocks(page: str | None) -> list[Block]:
    """Blocks of text in page order, with white space made single; null and empty pages have none. An
    element to leave out that is never closed ends where an article starts or, if nothing else would be
    left, is read as if it were an ordinary one."""
    page = page or ""
    out = _blocks(page, True)
    return out if any(not b.out for b in out) else _blocks(page, False)


def _blocks(page: str, strict: bool) -> list[Block]:
    out: list[Block] = []
    text: list[str] = []
    skip: list[str] = []  # open elements of the same name as the one left out
    doubt: list[str] = []  # the same for one in doubt
    article: list[str] = []
    at, end = 0, len(page)
    marked = False

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, marked, bool(skip), bool(doubt)))
            text.clear()

    def closes_later(name: str) -> bool:
        return bool(re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at))

    while at < end:
        m = TAG.search(page, at)
        chunk = page[at : m.start() if m else end]
        if chunk:
            text.append(html.unescape(chunk))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif strict:
                    at = end
            continue
        if name in ("article", "main"):
            if closing:
                if article and name in article:
                    flush()
                    while article.pop() != name:
                        pass
                    marked = bool(article)
                    skip.clear()
                    doubt.clear()
            elif name == "main" or not skip or not article:
                flush()
                skip.clear()
                doubt.clear()
                article.append(name)
                marked = True
            continue
        if name not in INLINE:
            flush()
        inside = skip or doubt
        if inside and name == inside[0]:
            if closing:
                flush()
                inside.pop()
            elif name not in VOID and not attributes.endswith("/"):
                inside.append(name)
            continue
        if skip or closing or name in VOID or attributes.endswith("/"):
            continue
        named, hinted, main_role = _named(attributes, bool(article)) if "=" in attributes else (False, False, False)
        if main_role and name != "body":
            flush()
            marked = True
            article.append("role")
        elif name in SKIPPED and (strict or name != "form") or name == "header" and not article or named and name not in ("html", "body"):
            if strict or closes_later(name):
                flush()
                doubt.clear()
                skip.append(name)
        elif article and not doubt and (hinted or name == "header"):
            flush()
            doubt.append(name)
    flush()
    return out


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _row_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each start of y, bit-parallel: one number of
    len(y) bits is the whole row of the table, and a zero bit is a step up."""
    at: dict[int, int] = {}
    for j, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << j
    every = row = (1 << len(y)) - 1
    for v in x:
        hit = row & at.get(v, 0)
        row = (row + hit | row - hit) & every
    bits = np.unpackbits(np.frombuffer((row ^ every).to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(bits[: len(y)], dtype=np.int64)))


def _common_places(x: list[int], y: list[int], offset: int, found: list[int]) -> None:
    """Appends the places in x, plus offset, of a longest common subsequence with y. Large tables are never
    built: x is halved, and y is cut where the two halves' rows add up to the most."""
    if not x or not y:
        return
    if len(x) * len(y) <= TABLE_CELLS:
        other = np.array(y, np.int64)
        table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for i in range(len(x) - 1, -1, -1):
            here = np.maximum(table[i + 1, :-1], np.where(other == x[i], table[i + 1, 1:] + 1, 0))
            table[i, :-1] = np.maximum.accumulate(here[::-1])[::-1]
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j] and table[i, j] == table[i + 1, j + 1] + 1:
                found.append(offset + i)
                i, j = i + 1, j + 1
            elif table[i + 1, j] >= table[i, j + 1]:
                i += 1
            else:
                j += 1
        return
    if len(x) == 1:
        if x[0] in y:
            found.append(offset)
        return
    half = len(x) // 2
    cut = int((_row_lengths(x[:half], y) + _row_lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
    _common_places(x[:half], y[:cut], offset, found)
    _common_places(x[half:], y[cut:], offset + half, found)


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b, in memory linear in the lines. Common ends are
    taken off first, then lines that only one has."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(x) & set(y)
    at = [i for i, v in enumerate(x) if v in both]
    found: list[int] = []
    _common_places([x[i] for i in at], [v for v in y if v in both], 0, found)
    return [*range(head), *(head + at[i] for i in found), *range(len(a) - tail, len(a))]


def common_start(a: str, b: str) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def nearest(before: str | None, own: str, after: str | None) -> int:
    """-1 or 1: which neighbour in the order of URL keys has the longer common start with own; 0 if none
    is of the same host. Ties go to the one before."""
    host = own.partition(")")[0]
    starts = [-1 if u is None or u.partition(")")[0] != host else common_start(u, own) for u in (before, after)]
    return 0 if max(starts) < 0 else -1 if starts[0] >= starts[1] else 1


def _templates(lined: DataFrame) -> DataFrame:
    """(file, row, gone): the lines of each page that the nearest page shares.

    Pages of a host with all lines equal are copies and stand in the order of URL keys once, at their
    smallest key, so that copies never hide other pages. Hashes of lines are range-sorted, never texts, and
    a host with very many pages spreads over parts. Each part gets the last page before it and the first
    after it from a table of one row for each part."""
    host = F.when(F.instr("urlkey", ")") > 0, F.substring_index("urlkey", ")", 1)).otherwise(F.col("urlkey"))
    keyed = lined.filter(F.size("lines") > 0).withColumns({"host": host, "list": F.xxhash64("lines"), "more": F.xxhash64(F.reverse("lines"))})
    lists = keyed.groupBy("host", "list", "more").agg(F.min("urlkey").alias("urlkey"), F.first("lines").alias("lines"), F.count("*").alias("n"))
    lists = common.save(lists, "page-lists")
    order = ["urlkey", "list", "more"]
    n, pages = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = lists.repartitionByRange(common.bucket_count(n, PART_ROWS), *order).withColumn("part", F.spark_partition_id())
    parts = common.save(parts.withColumn("edge", F.lit(0)), "page-parts")
    page = F.struct(*order, *(c for c in parts.columns if c not in order and c != "part"))
    ends = parts.groupBy("part").agg(F.min(page).alias("low"), F.max(page).alias("high"))
    w = Window.orderBy("part")  # numbers of parts alone
    steps = ends.select("part").withColumns({"before": F.lag("part").over(w), "after": F.lead("part").over(w)})
    ends = ends.join(steps, "part")
    sides = [ends.filter(F.col(to).isNotNull()).select(F.col(to).alias("part"), f"{e}.*").withColumn("edge", F.lit(k)) for e, to, k in (("high", "after", -1), ("low", "before", 1))]
    around = parts.unionByName(sides[0]).unionByName(sides[1])

    def match(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("edge", *order, "host", "lines", "n"))))
        rows.sort(key=lambda r: r[:4])
        found = []
        for i, (edge, url, a, b, host, lines, n) in enumerate(rows):
            if edge:
                continue
            near = [rows[k] if 0 <= k < len(rows) else None for k in (i - 1, i + 1)]
            side = nearest(near[0] and near[0][1], url, near[1] and near[1][1])
            gone = shared_lines(lines, near[side > 0][5]) if side else []
            if gone:
                found.append((host, a, b, gone, n))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        cols = list(zip(*found)) or [[] for _ in kinds]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host", "list", "more", "gone", "n"])

    gone = common.save(around.groupBy("part").applyInArrow(match, "host string, list long, more long, gone array<long>, n long"), "page-gone")
    places = keyed.select("file", "row", "host", "list", "more")
    return common.join_hot(places, gone, ["host", "list", "more"], "n", pages).select("file", "row", "gone")


def main_text(own: list[Block], template: set[int]) -> tuple[list[str], int]:
    """Blocks of the text, and how many differencing alone took out: they are shared with the nearest page
    and nothing in the structure says that they go."""
    marked = any(b.marked and not b.out for b in own)
    kept, decided = [], 0
    for i, b in enumerate(own):
        if b.out or marked and not b.marked:
            continue
        if i in template and (b.doubt or not b.marked):
            decided += 1
        else:
            kept.append(b.text)
    return kept, decided


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id_col, url_col, text (empty if none), n_chars (code points), n_shared
    (lines that the nearest page shares, wherever they stand) and n_decided (those of them that went
    because they are shared, and for no other reason).

    Character references are decoded, white space inside a block becomes one space, and blocks are joined
    by one space in page order. Null html gives an empty text. Null or broken urls are a host of their
    own. Pages of a host with all lines equal are copies and delete nothing from each other; a page that is
    alone in its host has no template. Of two equally near pages the earlier in the order of URL keys
    counts. Repeated rows give repeated results. An empty table gives no rows; other columns are left out.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    columns = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")]
    rows = common.scan_rows(pages, columns)

    def hash_lines(batches):
        for batch in common.slices(batches, CHUNK_ROWS):
            found = []
            for file, row, url, page in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "url", "html"))):
                found.append((url_key(url), file, row, [line_hash(b.text) for b in blocks(page)]))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["urlkey", "file", "row", "lines"])

    lined = common.save(rows.select("file", "row", "url", "html").mapInArrow(hash_lines, "urlkey string, file string, row long, lines array<long>"), "page-lines")
    gone = _templates(lined).withColumn("chunk", F.floor(F.col("row") / CHUNK_ROWS).cast("long"))
    side = common.SideFiles(gone, "file", ["chunk", "row"], "page-templates")

    def extract(batches):
        answers = side.reader()
        for batch in common.slices(batches, CHUNK_ROWS):
            texts, shared, decided = [], [], []
            at, found = None, {}
            for file, row, page in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "html"))):
                if at != (file, row // CHUNK_ROWS):
                    at = (file, row // CHUNK_ROWS)
                    found = dict(answers.rows(file, row // CHUNK_ROWS, ["row", "gone"]))
                template = set(found.get(row, ()))
                kept, n = main_text(blocks(page), template)
                texts.append(" ".join(kept))
                shared.append(len(template))
                decided.append(n)
            counts = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], shared, decided)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), *counts], names=schema.names)

    fields = [("id", kind), ("url", T.StringType()), ("text", T.StringType()), ("n_chars", T.LongType()), ("n_shared", T.LongType()), ("n_decided", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    out = rows.mapInArrow(extract, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_shared", "n_decided")
