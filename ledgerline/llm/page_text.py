"""Main text of HTML pages: nearest-URL page differencing of all pages, checked by their markup.

A page is cut into blocks, its lines, without what its markup calls boilerplate (menus, headers, footers,
sidebars, forms, scripts, adverts, notices, comments: by element, or by a name in class, id or role).
The lines of every page are compared with those of the pages whose URL paths are next, before and
after, within the host: they are aligned by longest common subsequence, and shared lines are deleted.

An exact check by markup follows, since articles of a host repeat passages and nothing of them may go:
lines of an article (of a main element, if it has no article) are restored if they were deleted, and
lines outside of these elements go, on pages that have them. Where markup is silent, the differencing
stands: on pages without such an element, and inside a main element beside its articles. A line that
is in the article of the other page is a passage, no template, and stays too. Pages with silent lines are
compared with each other, and so are those without: they are built alike.

Pages are sorted by host, path and content over ranges, so a host with any share of the pages is
cut where it must be. The first and last pages of each range wait for those of the adjacent ranges,
so the result does not depend on where ranges are cut. Pages next to each other
whose lines are all equal are copies: they are compared once, with the nearest page on each side that
differs, and all get the result. Pages of one host, path and html are one page (by 128 bits). Only digests of lines
(64 bits) are sorted and compared; what is shared goes back to the pages, which are parsed a second time rather than kept.

Defined results: a null or empty page has an empty text; a null URL is of host and path ''; equal
rows give equal texts; an empty table gives no rows; a very long page is parsed whole; extra columns
are ignored, whatever their names. Memory is that of a batch of pages, three
pages' digests, and the keys of the copies next to each other in a range; one task reads the digests of two pages at each edge of the ranges.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import islice
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, stored
from .url_filter import url_parts

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: Attributes up to the end of their tag, quoted ``>`` included; looked for over so many characters, else the tag ends at the first ``>``.
ATTRIBUTES, WITHIN = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*"""), 4096
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
words = lambda s: frozenset(s.split())
#: HTML elements by what they do to blocks.
RAW = words("script style textarea title xmp")
VOID = words("area base br col embed hr img input link meta param source track wbr")
BLOCK = words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
)
DROPPED = words("aside audio button canvas dialog footer form head iframe menu nav noscript object script select style svg template textarea video")
CLOSED_BY_SAME = words("dd dt li option p td th tr")
#: Names that mark a block as no part of the text; the last two only outside an article.
NAMES = words(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
)
OUTSIDE_NAMES = words("header masthead")
#: In a name of several parts, what may stand beside one of ``NAMES`` that comes first, and
#: what takes its meaning away where it comes last.
PARTS = words(
    "area bar block body bottom box button buttons card cell center col collapse column container content cta dialog footer form grid group head header heading icon icons image images inline inner item items label left link links list main modal outer overlay panel post posts primary right row secondary section slot small story strip text title toggle top unit widget wrap wrapper"
)
DENIED = words("has hide is no non not off on show with without")
#: Runs of copies that a range begins with, ends with, or is made of; an ordinal.
FIRST, LAST, WHOLE = 0, 1, 2
#: What markup says of a line: beside the text, nothing, of the text.
OUTSIDE, SILENT, SURE = 0, 1, 2
#: By the innermost element that a page has (none, main, article): what a line in none, in main, in article is.
KINDS = ((SILENT,), (OUTSIDE, SURE), (OUTSIDE, SILENT, SURE))
#: Bytes of a line's digest.
WIDE = 8
#: Pairs of equal lines for each line of two pages from which they are aligned by bits.
DENSE = 32


def marks_boilerplate(names: str, listed: frozenset[str]) -> bool:
    """Whether one of the names of an attribute says that the block is no part of the text.

    A name counts whole (``ad``, ``social-share``); of several parts the last one counts (``site-nav``, ``cookie-banner``), but not
    after a word such as "no" or "has" (``no-sidebar``), and the first one before words of layout (``comment-list``).
    """
    for name in names.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if not parts or DENIED.intersection(parts[:-1]):
            continue
        if parts[-1] in listed or parts[0] in listed and all(x in PARTS or x in listed or x.isdigit() for x in parts[1:]):
            return True
    return False


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of each tag, comment (no name) and declaration (no name), in one walk."""
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            end = close + 3 if close >= 0 else len(page)
            yield at, end, False, "", ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end or len(page), False, "", ""
            if not end:
                return
        elif found := NAME.match(page, at + 1):
            name = found.group().lower()
            end = ATTRIBUTES.match(page, found.end(), found.end() + WITHIN).end()
            if page[end : end + 1] != ">":
                end = page.find(">", found.end())
                if end < 0:  # no tag ends from here on: the page breaks off in this one
                    yield at, len(page), False, "", ""
                    return
            yield at, end + 1, name[0] == "/", name.lstrip("/"), page[found.end() : end]
            end += 1
            if name in RAW and page[end - 2] != "/":  # its content is no markup
                close = re.compile(rf"</{name}(?![a-z0-9])", re.I).search(page, end)
                stop = page.find(">", close.end()) + 1 if close else 0
                yield end, stop or len(page), False, "", ""
                end = stop or len(page)
        else:
            end = at + 1
        at = page.find("<", end)


def lines_of(page: str) -> list[tuple[str, int]]:
    """(block, level) of a page, in order: 2 in an article, 1 in a main element, else 0; time grows with its length alone, whatever its markup."""
    out, text = [], []
    stack: list[tuple[str, bool, int]] = []  # element, dropped, level
    held: dict[str, int] = {}  # how many of each element are open
    at = 0
    state = lambda: (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def flush() -> None:
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if block:
                out.append((block, state()[1]))

    def pop() -> str:
        tag = stack.pop()[0]
        held[tag] -= 1
        return tag

    for begin, end, closing, tag, attributes in tags_of(page):
        if begin > at and not state()[0]:
            text.append(page[at:begin])
        at = end
        if not tag:
            continue
        if closing:
            if tag in BLOCK and not state()[0]:
                flush()
            if held.get(tag):
                # a line ends with a block that began outside of what is dropped; not with an element within a line
                last = len(stack) - 1
                while True:
                    if stack[last][0] in BLOCK and not (last and stack[last - 1][1]):
                        flush()
                    if stack[last][0] == tag:
                        break
                    last -= 1
                while pop() != tag:
                    pass
            continue
        if tag == "br":
            if not state()[0]:
                text.append(" ")
            continue
        if tag in BLOCK:
            if not state()[0]:
                flush()
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in CLOSED_BY_SAME):
                pop()
        if tag in RAW or tag in VOID:
            continue
        names = " ".join(x.group(1) or x.group(2) or x.group(3) or "" for x in NAMED.finditer(attributes)) if attributes else ""
        heart = tag in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I) is not None
        if tag == "body" or heart and not state()[1]:
            while stack and stack[-1][0] in ("head", "header", "nav"):  # never closed
                pop()
        dropped, inside = state()
        if tag not in ("html", "body"):
            named = not heart and (marks_boilerplate(names, NAMES) or not inside and marks_boilerplate(names, OUTSIDE_NAMES))  # an article keeps its text, however it is laid out
            dropped |= tag in DROPPED or named or not inside and tag == "header"
        if tag in BLOCK or dropped or heart:
            if (tag in BLOCK or heart) and not state()[0]:
                flush()
            stack.append((tag, dropped, max(inside, (2 if tag == "article" else 1) if heart and not dropped else 0)))
            held[tag] = held.get(tag, 0) + 1
    if at < len(page) and not state()[0]:
        text.append(page[at:])
    flush()
    return out


def blocks_of(page: str) -> tuple[list[str], list[str]]:
    """(main, open) blocks of a page, in order."""
    lines = lines_of(page)
    return [x for x, level in lines if level], [x for x, level in lines if not level]


def aligned_by_bits(a: list, b: list) -> list[tuple[int, int]]:
    """The same as ``aligned`` by Hyyrö's bit vectors: time by pairs of lines over the bits of a word.

    Rows are kept at every root of their number and computed anew between, from the last to the first.
    """
    masks: dict = {}
    for j, x in enumerate(b):
        masks.setdefault(x, bytearray(len(b) // 8 + 1))[j >> 3] |= 1 << (j & 7)
    masks = {x: int.from_bytes(m, "little") for x, m in masks.items()}
    full = (1 << len(b)) - 1

    def rows(v: int, begin: int, end: int) -> Iterator[int]:
        for x in a[begin:end]:
            hit = v & masks.get(x, 0)
            v = ((v + hit) | (v - hit)) & full
            yield v

    step = isqrt(len(a)) + 1
    kept = [full]
    for i in range(0, len(a), step):
        for v in rows(kept[-1], i, i + step):
            pass
        kept.append(v)
    out, j = [], len(b)
    for part in range((len(a) - 1) // step, -1, -1):
        held = [kept[part], *rows(kept[part], part * step, (part + 1) * step)]
        i = len(held) - 1
        while i and j:
            if held[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if held[i] >> (j - 1) & 1:
                    j -= 1
                    out.append((part * step + i, j))
    return out


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Positions in ``a`` and in ``b`` of a longest common subsequence, the last first (Hunt and Szymanski)."""
    place: dict = {}
    for k, x in enumerate(b):
        place.setdefault(x, []).append(k)
    if sum(len(place.get(x, ())) for x in a) > DENSE * (len(a) + len(b)):
        return aligned_by_bits(a, b)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple | None] = []
    for k, x in enumerate(a):
        for j in reversed(place.get(x, ())):
            at = bisect_left(ends, j)
            link = (k, j, links[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[at], links[at] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    return {k for k, _ in aligned(a, b)}


def without_shared(lines: list[str], *others: list[str] | None) -> str:
    """``lines`` but those shared with any of ``others``."""
    gone = set().union(*(shared_lines(lines, x) for x in others if x))
    return "\n".join(x for k, x in enumerate(lines) if k not in gone)


def kinds_of(levels: list[int]) -> bytes:
    """The kind of each line of a page."""
    of = KINDS[max(levels, default=0)]
    return bytes(of[x] for x in levels)


def checked(page: tuple[bytes, bytes], *others: tuple[bytes, bytes] | None) -> tuple[list[bool] | None, int, int]:
    """(whether each line that is not ``OUTSIDE`` stays, null if all do; lines shared with any of ``others``; shared ones that stay).

    A page is given as the digests and the kinds of its lines.
    """
    cut = lambda x: [x[k : k + WIDE] for k in range(0, len(x), WIDE)]
    lines, kinds = cut(page[0]), page[1]
    shared, template = set(), set()
    for digests, theirs in (x for x in others if x):
        for k, j in aligned(lines, cut(digests)):
            shared.add(k)
            if kinds[k] == OUTSIDE or kinds[k] == SILENT and theirs[j] != SURE:
                template.add(k)
    stays = [k not in template for k, kind in enumerate(kinds) if kind != OUTSIDE]
    return None if all(stays) else stays, len(shared), len(shared - template)


def differenced(pages: Iterator[tuple[tuple, list[str]]], result: Callable = without_shared) -> Iterator[tuple]:
    """Pages of a range (key of which the first is the host, lines), each with ``result`` of its lines and its neighbours'.

    Copies that are next to each other are a run, compared as one with the nearest pages that differ.
    Yields (key, text, null, null, null) for a page whose neighbours are in the range, and for one of
    a run at the range's edge (key, null, edge, null, null); edge is FIRST, LAST or WHOLE. Then
    ((host, null, null), null, edge, lines, lines of the next page within) for each such run.
    """
    before: list[str] | None = None
    keys: list[tuple] = []
    here: list[str] = []
    first = True

    def settled(after: list[str] | None, last: bool) -> Iterator[tuple]:
        if first or last:
            edge = WHOLE if first and last else FIRST if first else LAST
            yield from ((k, None, edge, None, None) for k in keys)
            yield (keys[0][0], None, None), None, edge, here, after if first else before
        else:
            text = result(here, before, after)
            yield from ((k, text, None, None, None) for k in keys)

    for key, lines in pages:
        same = bool(keys) and key[0] == keys[0][0]
        if same and lines == here:
            keys.append(key)
            continue
        if keys:
            yield from settled(lines if same else None, False)
            first = False
        before, keys, here = here if same else None, [key], lines
    if keys:
        yield from settled(None, True)


def edge_texts(runs: Iterator[tuple[int, int, str, list[str], list[str] | None]], result: Callable = without_shared) -> Iterator[tuple[int, int, str]]:
    """(range, edge, text) of runs (range, edge, host, lines, lines of the next page within), in order.

    Runs of several ranges that are equal and next to each other are one. Three pages' lines are held.
    """
    waiting: list[tuple[int, int]] = []  # of the run that lacks its right neighbour
    host, lines, left = "", [], None

    def settled(right: list[str] | None) -> Iterator[tuple[int, int, str]]:
        if waiting:
            text = result(lines, left, right)
            yield from ((*k, text) for k in waiting)

    for part, edge, its_host, its_lines, within in runs:
        if edge == LAST:
            waiting, host, lines, left = [(part, edge)], its_host, its_lines, within
            continue
        same = bool(waiting) and its_host == host
        if same and its_lines == lines:
            waiting.append((part, edge))
        else:
            yield from settled(its_lines if same else None)
            waiting, host, lines, left = [(part, edge)], its_host, its_lines, lines if same else None
        if edge == FIRST:
            yield from settled(within)
            waiting = []
    yield from settled(None)


def page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars, n_shared (lines that the next pages have too), n_restored (those of them that stay)."""
    shipped(pages.sparkSession)
    host, path = url_parts(F.col(url_col))
    html = F.coalesce(F.col(html_col), F.lit(""))
    # a host has no / and ?, a path no ?
    key = F.unhex(F.md5(F.concat(host, path, F.lit("?"), html).cast("binary")))
    source = pages.select(key.alias("_key"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), path.alias("_path"), html.alias("_html"))

    def parsed(b: pa.RecordBatch) -> Iterator[tuple[list[str], bytes]]:
        """The lines of pages and their kinds."""
        for h in b.column("_html").to_pylist():
            found = lines_of(h)
            yield [x for x, _ in found], kinds_of([level for _, level in found])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "_host", "_path"]
        for b in batches:
            digests, kinds = [], []
            for lines, of in parsed(b):
                digests.append(b"".join(hashlib.blake2b(x.encode(), digest_size=WIDE).digest() for x in lines))
                kinds.append(of)
            made = [pa.array([SILENT in k for k in kinds], pa.bool_()), pa.array(digests, pa.binary()), pa.array(kinds, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, "_silent", "digests", "kinds"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "_id", "_url"]
        for b in batches:
            text = ["\n".join(x for x, kind in zip(lines, kinds) if kind != OUTSIDE) for lines, kinds in parsed(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(text, pa.string())], names=[*names, "_text"])

    def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        while out := list(islice(rows, 2000)):
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out)))), schema=schema)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def rows() -> Iterator[tuple]:
            nonlocal part
            for b in batches:
                part = b.column("_part")[0].as_py() if b.num_rows else part
                yield from ((((h, s), k), (d, of)) for h, s, k, d, of in zip(*(b.column(c).to_pylist() for c in ("_host", "_silent", "_key", "digests", "kinds"))))

        none = (None, None, None)
        return batched(((key[1], *(found or none), part if edge is not None else None, edge, *key[0], *(page or none[:2]), *(within or none[:2])) for key, found, edge, page, within in differenced(rows(), checked)), first)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_part", "_edge", "_host", "_silent", "digests", "kinds", "digests_within", "kinds_within"))))
        made = edge_texts(((part, edge, (h, s), (d, k), None if x is None else (x, y)) for part, edge, h, s, d, k, x, y in runs), checked)
        return batched(((part, edge, *found) for part, edge, found in made), second)

    verdict = [("stays", pa.list_(pa.bool_())), ("n_shared", pa.int64()), ("n_restored", pa.int64())]
    second = pa.schema([("_part", pa.int32()), ("_edge", pa.int32()), *verdict])
    first = pa.schema([("_key", pa.binary()), *verdict, ("_part", pa.int32()), ("_edge", pa.int32()), ("_host", pa.string()), ("_silent", pa.bool_()), ("digests", pa.binary()), ("kinds", pa.binary()), ("digests_within", pa.binary()), ("kinds_within", pa.binary())])
    stays = "stays array<boolean>, n_shared long, n_restored long"
    lines = source.select("_key", "_host", "_path", "_html").mapInArrow(digested, "_key binary, _host string, _path string, _silent boolean, digests binary, kinds binary")
    # stored, since two jobs read it: the sample and the cut of the ranges
    every = stored(lines.dropDuplicates(["_key"]))
    order = ["_host", "_silent", "_path", "_key"]
    ranges = every.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_host", "_silent", "digests", "kinds", F.spark_partition_id().alias("_part"))
    # stored, since ranges are sampled and cut anew each time they are computed
    found = stored(ranges.mapInArrow(compared, f"_key binary, {stays}, _part int, _edge int, _host string, _silent boolean, digests binary, kinds binary, digests_within binary, kinds_within binary"))
    edges = found.where("digests is not null").select("_part", "_edge", "_host", "_silent", "digests", "kinds", "digests_within", "kinds_within").repartition(1).sortWithinPartitions("_part", "_edge")
    verdicts = edges.mapInArrow(across, f"_part int, _edge int, {stays}")
    of = ["_key", "stays", "n_shared", "n_restored"]
    inner = found.where("_edge is null").select(*of)
    outer = found.where("_edge is not null and digests is null").select("_key", "_part", "_edge").join(verdicts, ["_part", "_edge"]).select(*of)
    # the verdicts are the small side, so that texts need no sort; a page without one shares nothing
    shared = inner.unionByName(outer).where("n_shared > 0").hint("shuffle_hash")
    kind = pages.schema[id_col].dataType.simpleString()
    whole = source.select("_key", "_id", "_url", "_html").mapInArrow(texts, f"_key binary, _id {kind}, _url string, _text string")
    left = F.array_join(F.filter(F.split("_text", "\n"), lambda _, k: F.get("stays", k)), "\n")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_shared", "n_restored")]
    done = whole.join(shared, "_key", "left").select("_id", "_url", F.when(F.col("stays").isNull(), F.col("_text")).otherwise(left).alias("_text"), *counts)
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"), "n_shared", "n_restored")
