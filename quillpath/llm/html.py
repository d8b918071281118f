"""Main text of web pages: structure, and differencing against the page with the nearest URL."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpath.llm.common import map_arrow, written

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
# Elements by what becomes of them, and the words that name page furniture.
RAW = frozenset("script style title textarea noscript template iframe svg object canvas audio video xmp noembed noframes annotation annotation-xml".split())
#: Of these, those whose text ends with the page where no end tag follows; others are then empty.
ENDLESS = frozenset("script style title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics mstyle".split())
DROPPED = frozenset("head nav footer aside form menu button select dialog fieldset datalist".split())
NAMED = frozenset("div section ul ol dl p span table aside header article details figure center".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist respond disqus share sharing social related recommended newsletter subscribe "
    "subscription signup popup modal overlay widget toolbar pagination pager skip".split()
)
#: Words beside those in names of furniture. A name that has other words too, as share-price, only suggests furniture.
NEUTRAL = frozenset("box bar main top bottom left right wrapper wrap container list item items block area link links button buttons inner outer section content global site page post posts article articles stories icon icons form widget widgets js".split())
#: Words of names for what a page is about. An element that has one of them as a name is furniture by others only perhaps, and a header of it is none.
CONTENT = frozenset("content main article post entry story body page text".split())
#: Words of readers' comments, which may well be most of a page.
COMMENTS = frozenset("comment comments commentlist respond disqus".split())
#: Share of a page's text from which on an element is not removed by what it is called.
BULK = 0.75
#: Elements that hold lines together inside an article or main element.
BOXES = frozenset("div section ul ol dl table aside details figure center article".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-cased name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'").lower())
    return out


def _furniture(tag: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """How surely an element is page furniture by its name or by its class, id or role: 2 if it is, 1 if it may be
    and differencing decides, 0 if nothing says so. And whether it is out whatever it holds: navigation, what is hidden, and readers' comments."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return 2, tag not in ("form", "aside", "header", "fieldset", "dialog")
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return 0, False
    found = _attributes(attributes)
    if "hidden" in found or (found.get("aria-hidden") == "true" and tag not in INLINE) or re.search(r"display\s*:\s*none", found.get("style", "")):
        return 2, True
    if found.get("role") in ROLES:
        return 2, found["role"] == "navigation"
    sure, comments = 0, False
    if tag in NAMED:
        names = [*found.get("class", "").split(), *found.get("id", "").split()]
        told = any(n in CONTENT for n in names)
        for name in names:
            words = set(_WORD.findall(name))
            marks = words & FURNITURE - ({"header"} if in_article or words & CONTENT else set())
            if marks:
                comments = comments or bool(marks & COMMENTS)
                sure = max(sure, 1 if told or words - FURNITURE - NEUTRAL - CONTENT else 2)
    return sure, comments


def blocks_of(page: str) -> list[tuple[str | None, str]]:
    """Text lines (blocks) of the page without structural furniture, each with its box (see _blocks). What would be removed by what it is called, but
    holds BULK of the page's text, as a form or a frame around all of it does, is no furniture; differencing decides about its lines."""
    spared: set[int] = set()
    while True:
        blocks, more = _blocks(page, spared)
        if not more:
            return blocks
        spared.add(more)


def _blocks(page: str, spared: set[int]) -> tuple[list[tuple[str | None, str]], int]:
    """Text lines with their boxes, and the number of an element to be spared, if any.

    The box is None outside of article and main elements, and in elements that may be furniture by a part of their name. Inside, it is the innermost box element by its
    name and attributes, so that boxes of one make are one; lines of the main element itself, and
    of an article that is the only one of its make, have the empty box.
    """
    blocks: list[tuple[str | None, str]] = []
    stack: list[tuple[str, bool, str, str | None]] = []  # open elements: name, furniture, zone and box inside
    open_, made = Counter(), Counter()
    inside: Counter[int] = Counter()  # text in furniture by the number of its outermost element, 0 for text outside
    number, outer, fixed = 0, 0, set()
    parts: list[str] = []
    off, zone, box = 0, "", None

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((box, text))

    def close(to: int) -> None:
        nonlocal off, zone, box
        while len(stack) > to:
            tag, bad, *_ = stack.pop()
            open_[tag] -= 1
            off -= bad
        zone, box = stack[-1][2:] if stack else ("", None)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            inside[outer if off else 0] += len(page[at:lt].strip())
            if not off:
                parts.append(page[at:lt])
        if lt >= n:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            # an unfinished tag at the end is none of the text; any other "<" is
            if page.find(">", lt) < 0 and lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] in "/!"):
                break
            if not off:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag not in INLINE:
                flush()
            if open_[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            if attributes.rstrip().endswith("/") and tag not in ENDLESS:
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n if tag in ENDLESS else at
            continue
        if tag == "br":
            if not off:
                parts.append("\n")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in INLINE and tag not in NAMED:
            continue
        if tag in CLOSES and stack:
            k = len(stack) - 1
            while k >= 0 and (stack[k][0] in INLINE or stack[k][0] in CLOSES[tag]):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                k -= 1
        bad, out = _furniture(tag, attributes, zone == "article")
        number += 1
        if number in spared:
            bad = 1
        if bad == 2:
            if not off:
                outer = number
                if out:
                    fixed.add(number)
            off += 1
        open_[tag] += 1
        if not off and tag in ("article", "main"):
            zone = "article" if tag == "article" or zone == "article" else "main"
            box = box or ""
        if not off and zone and tag in BOXES:
            box = f"{tag} {' '.join(attributes.split())}"
            made[box] += 1
        if not off and bad == 1:
            box = None
        stack.append((tag, bad == 2, zone, box))
    flush()
    total = inside.total()
    more = next((k for k, n in inside.items() if k and k not in fixed and n >= BULK * total), 0) if total else 0
    return [("" if b and b.startswith("article ") and made[b] == 1 else b, t) for b, t in blocks], more


def lines_of(page: str) -> tuple[list[str], bool]:
    """Text lines of the page without structural furniture, and whether any is in an article or main element."""
    blocks = blocks_of(page)
    return [t for _, t in blocks], any(b is not None for b, _ in blocks)


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of a in a longest common subsequence with b, by rows of bits."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if not x or not y:
        return out
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for v in x:
        row, hit = rows[-1], where.get(v, 0)
        u = row & hit
        rows.append(((row + u) | (row - u)) & full)
    # the length over the first i lines of x and j of y is the number of zeros in the j lower bits of rows[i]
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.add(low + i - 1)
            i, j = i - 1, j - 1
    return out


def main_lines(lines: list[str], boxes: list[str | None], own: list[int], other: list[int] | None) -> list[str]:
    """The lines without what the other page has too, both given by hashes.

    Shared lines outside of article and main elements go. Inside, sentences may be shared and true:
    shared lines of a box go only if all lines of the boxes of its make are shared, and only if they
    have less text than what remains; others stay. If all lines are shared, the pages are copies and the lines stay.
    """
    shared = shared_lines(own, other) if other else set()
    if not shared or len(shared) == len(lines):
        return lines
    single = {b for i, b in enumerate(boxes) if i not in shared}
    outside = {i for i in shared if boxes[i] is None}
    inside = {i for i in shared if boxes[i] and boxes[i] not in single}
    size = lambda at: sum(len(lines[i]) for i in at)
    if 2 * size(inside) >= size(range(len(lines))) - size(outside):
        inside = set()
    return [t for i, t in enumerate(lines) if i not in outside and i not in inside]


_LINES = "page_id long, url string, lines array<string>, boxes array<string>, hashes array<long>"


def _parsed(pages: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [blocks_of(h or "") for h in part["html"].to_pylist()]
                lines, boxes = ([[x[k] for x in g] for g in got] for k in (1, 0))
                hashes = [[xxhash.xxh64_intdigest(t) - 2**63 for t in x] for x in lines]
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], *(pa.array(x, pa.list_(pa.string())) for x in (lines, boxes)), pa.array(hashes, pa.list_(pa.int64()))],
                    ["page_id", "url", "lines", "boxes", "hashes"],
                )

    return map_arrow(pages.select("page_id", "url", "html"), parse, _LINES)


def _common(path: str, other: str) -> Column:
    """How long the beginning is that two columns have in common (found by halving, so up to 2**21 characters); -1 without other."""
    n = F.least(F.length(path), F.length(other))
    longer = lambda p, s: F.when((p + s <= n) & (F.substr(path, F.lit(1), p + s) == F.substr(other, F.lit(1), p + s)), p + s).otherwise(p)
    return F.when(F.col(other).isNull(), -1).otherwise(F.aggregate(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), F.lit(0), longer))


def _nearest(keys: DataFrame) -> DataFrame:
    """page_id, near_id: of the neighbours of a page (page_id, host, path, mark) in the order of host, path and
    page_id the one of its host with the longer common beginning of the path (the earlier, if equal); one of equal mark gives way.

    Pages are dealt into ranges of that order, and each range gets copies of the pages next to it, so a
    host of any size lies in many tasks. The driver has two rows for each range.
    """
    spark = keys.sparkSession
    order = ["host", "path", "page_id", "mark"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(keys.select(*order).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).withColumn("_copy", F.lit(False)))
    ends = sorted(ranged.groupBy("_range").agg(F.min(F.struct(*order)), F.max(F.struct(*order))).collect())
    copies = [(*ends[i - 1][2], ends[i][0], True) for i in range(1, len(ends))] + [(*ends[i + 1][1], ends[i][0], True) for i in range(len(ends) - 1)]
    both = ranged.unionByName(spark.createDataFrame(copies, ranged.schema))
    w = Window.partitionBy("_range").orderBy(*order)
    same = lambda f, c: F.when(f("host").over(w) == F.col("host"), f(c).over(w))
    near = both.select("page_id", "path", "mark", "_copy", *(same(f, c).alias(f"{n}_{c}") for f, n in ((F.lag, "before"), (F.lead, "after")) for c in ("path", "page_id", "mark"))).where("not _copy")
    copy = lambda n: F.coalesce(F.col(f"{n}_mark") == F.col("mark"), F.lit(False))
    earlier = _common("path", "before_path") >= _common("path", "after_path")
    earlier = F.when(earlier, ~copy("before") | F.col("after_page_id").isNull()).otherwise(copy("after") & F.col("before_page_id").isNotNull())
    near = near.select("page_id", F.when(earlier, F.col("before_page_id")).otherwise(F.col("after_page_id")).alias("near_id"))
    return near.groupBy("page_id").agg(F.min("near_id").alias("near_id")).where("near_id is not null")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    What structure says for sure goes first (see _furniture). Then every page is aligned by longest common subsequence with the page
    of the nearest URL, and the lines that both have are furniture of the host and go, but for those
    that main_lines keeps in articles. Nearest is, of the two neighbours in the order of paths within
    the host, the one with the longer common beginning (the earlier, if equal); one with the same
    lines gives way to the other. If all lines of a page are shared, the pages are copies and the
    lines stay. Null and empty html give an empty text; pages of null url have no neighbours; of repeated
    page_ids one stands for all as a neighbour; an empty table gives no rows; other columns are ignored.
    """
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    # the hashes alone are kept: lines of text are made again where they are joined, which moves them once and stores them never
    keys = written(_parsed(pages).where("url is not null and page_id is not null").select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("hashes").alias("mark"), "hashes"))
    chosen = written(_nearest(keys.drop("hashes")))
    hashes = keys.select(F.col("page_id").alias("near_id"), F.col("hashes").alias("near")).dropDuplicates(["near_id"])
    near = chosen.join(hashes, "near_id").select("page_id", "near")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in zip(*(batch[c].to_pylist() for c in ("lines", "boxes", "hashes", "near")), strict=True):
                texts.append(" ".join(main_lines(*row)))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(_parsed(pages).join(near, "page_id", "left"), difference, "page_id long, url string, text string, n_chars long")
