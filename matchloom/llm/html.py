"""Main-text extraction from HTML with removal of site templates.

Method.  A page is parsed into its elements.  Each element with text gets a hash of its
subtree (tags and text, without attributes), those that rules would delete too; Spark counts, for each host, on how many pages a subtree
stands, and subtrees found on more than ``RATIO`` of the host's pages, and on at least ``LEAST``, are deleted as template.
So are layout elements (``LAYOUT``; within an article ``PARTS`` only) found on over ``SHARE`` of the
pages and next to ``LEAST`` different articles or more.  The longest text in the largest part of the page
outside the element stands for the article next to it, so what recurs in near copies of an article is not taken for a template; nor is what
holds over half of a page's text counted on that page.
Elements whose tag, role, class or id says that they are navigation, header, footer, sidebar, notice,
advert, form, comments or hidden are deleted as well, after the templates; a class says so only if all of its parts do (``cookie-notice``, but not
``share-price``), and a form, or an element whose classes speak for both, stays if it holds most of the page's text.  Of what stays, the text of the article, with articles beside it at least half as long
(or of the main part, or the body), is returned, a line for each block.  Equal pages of a host
count once, so copies of a page do not turn it into a template.

Scale.  The counting pass shuffles hashes only, with partial aggregation, so a hot host is summed where
its pages lie.  A host has at most (elements a page) / SHARE template subtrees, as each stands on that share of its pages.
The table of them is written and measured: up to ``BROADCAST_BYTES`` it is broadcast, once for each worker, and the pages
never move; beyond, (page, subtree) hashes are joined with it and the few hits joined back.

Edge cases.  Null or empty html gives an empty text.  A null or unreadable url counts as one host of its own.
Unclosed and misplaced tags are closed as browsers do for paragraphs, items and cells; stray end tags are
ignored; an unclosed comment, script or tag reaches to the end.  Time is linear in the page, however deep it is nested.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RATIO, LEAST = 0.5, 10
SHARE = 0.01
BROADCAST_BYTES = 2 << 20

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
#: A start tag of the key closes an open element of the value, unless one of ``_FENCES`` is between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "body": ("head",),
}
_FENCES = frozenset("ul ol dl table select menu article section div main body html".split())
_KEEPS_P = frozenset(["caption", "legend", "summary", "figcaption"])
_ENDS_P = BLOCK - _KEEPS_P - {"body", "html", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: Elements that pages are laid out with, and those of them that also lay out an article's extras.
LAYOUT = frozenset("div section center header hgroup details fieldset address ul ol dl table".split())
PARTS = frozenset(["div", "section"])
#: Elements that never hold article text.
AWAY = frozenset("nav footer aside form button select option menu dialog template svg math canvas object audio video map head search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id values that mark such elements.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promotions banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer footers masthead topbar toolbar pagination pager "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond disqus replies reply share sharing social related recommended recommendations widget widgets skip search searchbox form".split()
)
#: Words that say nothing beside them.
FILLERS = frozenset(
    "area article articles bar block body bottom box btn btns button buttons close container content count entry global icon icons inner item items js left link links "
    "list main open outer page panel post posts primary right row secondary section site slot thread toggle top unit wp wrap wrapper".split()
)
_HEAD_MARKS = frozenset(["header", "headers"])
_OF_ARTICLE = frozenset("article articles entry post posts content section".split())
#: Words that call an element the article, whatever stands beside them.
CONTENT = frozenset("article entry post story content main".split())

#: Quotes open a value only after an equals sign; elsewhere they are characters of a name or a value.
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


@dataclass
class Page:
    """Elements in page order; ``texts`` holds (element, text) or (element, None) for a break between blocks."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    away: list[bool] = field(default_factory=list)
    header: list[bool] = field(default_factory=list)
    doubt: list[bool] = field(default_factory=list)
    texts: list[tuple[int, str | None]] = field(default_factory=list)

    def holding(self, *names: str) -> list[bool]:
        """For each element, whether an element of these names is inside it."""
        out = [False] * len(self.tags)
        for k in range(len(self.tags) - 1, -1, -1):
            if (parent := self.parents[k]) >= 0 and (out[k] or self.tags[k] in names):
                out[parent] = True
        return out


def _says(value: str, words: frozenset[str], fillers: frozenset[str]) -> bool:
    """Whether a class or id is made of the words and nothing but fillers and numbers beside them."""
    parts = [part for part in _WORD.findall(value) if not part[0].isdigit()]
    return not words.isdisjoint(parts) and all(part in words or part in fillers for part in parts)


def _marks(tag: str, raw: str) -> tuple[bool, bool, bool]:
    """Whether attributes send the element away, whether they call it a header of the site, and whether they doubt that it goes.

    A form is in doubt, which may be laid around a whole page, and a class with words of both kinds."""
    away = header = named = content = False
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN_STYLE.search(value):
            away = True
        elif name == "role":
            if value in ROLES:
                away = True
        elif name in ("class", "id"):
            for word in value.split():
                named = named or _says(word, MARKS, FILLERS)
                content = content or _says(word, CONTENT, FILLERS)
                header = header or _says(word, _HEAD_MARKS, FILLERS - _OF_ARTICLE)
    return away or named, header, not away and (content if named else tag == "form")


def parse(source: str) -> Page:
    page = Page()
    stack: list[int] = []
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name
    fences: list[int] = []
    tags, texts = page.tags, page.texts

    def last(name: str) -> int:
        found = places.get(name)
        return found[-1] if found else -1

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = tags[stack[-1]]
            if name in BLOCK:
                texts.append((stack[-1], None))
            stack.pop()
            places[name].pop()
            if name in _FENCES:
                fences.pop()

    def close_above_fence(names: tuple[str, ...]) -> None:
        fence = fences[-1] if fences else -1
        lowest = [at[k] for name in names if (at := places.get(name)) and (k := bisect_right(at, fence)) < len(at)]
        if lowest:
            close(min(lowest))

    def open_(tag: str, raw: str) -> None:
        away, header, doubt = _marks(tag, raw) if raw else (False, False, tag == "form")
        node = len(tags)
        tags.append(tag)
        page.parents.append(stack[-1] if stack else -1)
        page.away.append(away or tag in AWAY)
        page.header.append(header)
        page.doubt.append(doubt)
        places.setdefault(tag, []).append(len(stack))
        if tag in _FENCES:
            fences.append(len(stack))
        stack.append(node)
        if tag in BLOCK:
            texts.append((node, None))
        elif tag in ("td", "th"):
            texts.append((node, " "))

    at, end = 0, len(source)
    while at < end:
        found = _TAG.search(source, at)
        start = found.start() if found else end
        if start > at:
            texts.append((stack[-1] if stack else -1, entities.unescape(source[at:start])))
        if not found:
            break
        at = found.end()
        name = found[2]
        if not name:
            if source.startswith("<![CDATA[", start):
                texts.append((stack[-1] if stack else -1, source[start + 9 : at].removesuffix("]]>")))
            continue
        tag, raw = name.lower(), found[3] or ""
        if found[1]:  # an end tag
            k = last(tag)
            if k >= 0 and (tag in ("html", "body", "main", "article", "div", "section") or k > max(last("article"), last("main"), last("body"))):
                close(k)
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(source, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            texts.append((stack[-1] if stack else -1, None if tag == "hr" else " "))
            continue
        if tag in _ENDS_P and last("p") > (fences[-1] if fences else -1):
            close(last("p"))
        if tag in CLOSES:
            close_above_fence(CLOSES[tag])
        open_(tag, raw)
        if raw.endswith("/") and tag not in BLOCK:
            close(len(stack) - 1)
    close(0)
    return page


def _sizes(page: Page, gone: list[bool]) -> list[int]:
    """Characters of text below each element that is not gone, without blanks."""
    size = [0] * len(page.tags)
    for node, text in page.texts:
        if text is not None and node >= 0 and not gone[node]:
            size[node] += len(text) - text.count(" ")
    for k in range(len(size) - 1, -1, -1):
        if (parent := page.parents[k]) >= 0:
            size[parent] += size[k]
    return size


def _gone(page: Page) -> list[bool]:
    """For each element, whether it or one that holds it is away; one in doubt is not if it holds most of the page's text."""
    if any(page.doubt):
        sure = [a and not d for a, d in zip(page.away, page.doubt)]
        size = _sizes(page, _spread(page, sure))
        total = sum(n for n, parent in zip(size, page.parents) if parent < 0)
        return _spread(page, [s or a and 2 * n <= total for s, a, n in zip(sure, page.away, size)])
    return _spread(page, page.away)


def _spread(page: Page, away: list[bool]) -> list[bool]:
    out: list[bool] = []
    inside: list[bool] = []
    titled, framed = page.holding("h1", "h2"), page.holding("article", "main")
    for k, (tag, parent) in enumerate(zip(page.tags, page.parents)):
        within = parent >= 0 and (inside[parent] or page.tags[parent] in ("article", "main"))
        own = away[k] or tag == "header" and not (within and titled[k]) or page.header[k] and not within
        if framed[k] or tag in ("html", "body", "article", "main") and not (away[k] and within):
            own = own and not framed[k] and tag not in ("html", "body") and away[k]
        inside.append(within)
        out.append(own or parent >= 0 and out[parent])
    return out


def _trees(page: Page, gone: list[bool]) -> list[int]:
    """Subtree hashes as signed 64-bit integers, 0 for elements without text; the tree of an element that stays is without those in it that go."""
    parts: list[list[bytes]] = [[] for _ in page.tags]  # by element: its own texts, then the hashes of its children
    for node, text in page.texts:
        if text is not None and node >= 0 and (text := " ".join(text.split())):
            parts[node].append(text.encode("utf-8", "surrogatepass"))
    out = [0] * len(page.tags)
    for k in range(len(page.tags) - 1, -1, -1):
        if parts[k]:
            digest = xxhash.xxh3_64_digest(b"\0".join([page.tags[k].encode("utf-8", "surrogatepass"), *parts[k]]))
            out[k] = int.from_bytes(digest, "little", signed=True) or 1
            if (parent := page.parents[k]) >= 0 and gone[k] == gone[parent]:
                parts[parent].append(digest)
    return out


def _around(page: Page, gone: list[bool]) -> list[int | None]:
    """For each layout element with at most half of the page's text, and each that rules delete, a hash of the longest text in the largest part outside it; None for others."""
    n = len(page.tags)
    pieces: list[list[str]] = [[] for _ in page.tags]
    for node, text in page.texts:
        if text is not None and node >= 0 and not gone[node] and (text := " ".join(text.split())):
            pieces[node].append(text)
    own = [" ".join([*x, ""]) for x in pieces]
    size, longest = [len(x) for x in own], own.copy()  # all text below, and its longest piece
    top = [[(len(x), x, -1), (0, "", -1)] for x in own] + [[(0, "", -1), (0, "", -1)]]  # the two largest parts of each element: its own text and its children
    for k in range(n - 1, -1, -1):
        parent = page.parents[k]  # -1, the last of top, if none
        top[parent] = sorted([*top[parent], (size[k], longest[k], k)], key=lambda part: -part[0])[:2]
        if parent >= 0:
            size[parent] += size[k]
            longest[parent] = max(longest[parent], longest[k], key=len)
    total = sum(map(len, own))
    inside: list[bool] = []
    outside: list[tuple[int, str]] = []
    out: list[int | None] = []
    for k, (tag, parent) in enumerate(zip(page.tags, page.parents)):
        inside.append(tag in ("article", "main") or parent >= 0 and inside[parent])
        beside = next(part for part in top[parent] if part[2] != k)[:2]
        outside.append(max(beside, outside[parent] if parent >= 0 else beside, key=lambda part: part[0]))
        fits = gone[k] or tag in (PARTS if inside[k] else LAYOUT) and 0 < 2 * size[k] <= total
        out.append(xxhash.xxh3_64_intdigest(outside[k][1].encode("utf-8", "surrogatepass")) - (1 << 63) if fits and outside[k][0] else None)
    return out


def trees(source: str | None) -> dict[int, int | None]:
    """The distinct subtree hashes of a page, and for layout elements a hash of the text around."""
    if not source:
        return {}
    page = parse(source)
    gone = _gone(page)
    out: dict[int, int | None] = {}
    for k, (h, tag, around) in enumerate(zip(_trees(page, gone), page.tags, _around(page, gone))):
        within = gone[k] and page.parents[k] >= 0 and gone[page.parents[k]]  # goes with the element around it
        if h and not within and tag not in ("html", "body") and out.get(h) is None:
            out[h] = around
    return out


def main_text(source: str | None, template: frozenset[int] = frozenset()) -> str:
    """The article of a page, a line for each block, without the subtrees named."""
    if not source:
        return ""
    page = parse(source)
    gone = _gone(page)
    if template:
        for k, h in enumerate(_trees(page, gone)):
            gone[k] = gone[k] or h in template or page.parents[k] >= 0 and gone[page.parents[k]]
    size = _sizes(page, gone)
    chosen = _chosen(page, size)
    inside: list[bool] = []
    for k, parent in enumerate(page.parents):
        inside.append(not chosen or k in chosen or parent >= 0 and inside[parent])
    blocks, line = [], []
    for node, text in page.texts:
        if text is None or (bool(chosen) if node < 0 else gone[node] or not inside[node]):
            if text is None and line:
                blocks.append("".join(line))
                line = []
            continue
        line.append(text)
    if line:
        blocks.append("".join(line))
    return "\n".join(b for block in blocks if (b := " ".join(block.split())))


def _chosen(page: Page, size: list[int]) -> set[int]:
    """The elements that hold the article: the longest and those beside it of at least half its length, or the main part; none for the whole page."""
    longest = {name: max((k for k, tag in enumerate(page.tags) if tag == name and size[k]), key=lambda k: (size[k], -k), default=None) for name in ("article", "main")}
    article, main = longest["article"], longest["main"]
    if article is not None:
        beside = {k for k, tag in enumerate(page.tags) if tag == "article" and page.parents[k] == page.parents[article] and 2 * size[k] >= size[article]}
        if main is None or 2 * sum(size[k] for k in beside) >= size[main]:
            return beside
    return {main} if main is not None else set()


def host(url: Column) -> Column:
    """The host of a url, lowered; empty if there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _subtrees(pages: DataFrame) -> DataFrame:
    """host, page (hash of the html), tree (hash of a subtree) and the text around it (hash or null), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trees(x.as_py()) for x in batch.column(2)]
            arrays = [pa.array(x, pa.list_(pa.int64())) for x in ([list(f) for f in found], [list(f.values()) for f in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["host", "page", "trees", "around"])

    found = shared.bounded(pages).select("host", "page", "html").mapInArrow(run, "host string, page long, trees array<long>, around array<long>")
    return found.select("host", "page", F.explode(F.arrays_zip("trees", "around")).alias("x")).select("host", "page", F.col("x.trees").alias("tree"), F.col("x.around").alias("around")).distinct()


def templates(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host and trees, the hashes of its template subtrees, for hosts that have any.  Needs host, page and html."""
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    held = _subtrees(pages).groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("around").alias("articles")).where(F.col("n") >= least)
    usual, laid = F.col("n") > ratio * F.col("pages"), (F.col("articles") >= least) & (F.col("articles") > share * F.col("pages"))
    return held.join(total, "host").where(usual | laid).groupBy("host").agg(F.collect_list("tree").alias("trees"))


def extract(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    spark = pages.sparkSession
    hosted = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    common, path = shared.written(templates(hosted, ratio, least), "templates")
    known: Broadcast | None = None
    if shared.size(spark, path) <= broadcast_bytes:
        known = spark.sparkContext.broadcast({r["host"]: frozenset(r["trees"]) for r in common.collect()})
        shared.drop(spark, path)
        asked = hosted.select("page_id", "url", "html", "host")
    else:
        hits = _subtrees(hosted).join(common.select("host", F.explode("trees").alias("tree")), ["host", "tree"])
        asked = hosted.join(hits.groupBy("host", "page").agg(F.collect_list("tree").alias("trees")), ["host", "page"], "left").select("page_id", "url", "html", "trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in batches:
            of_row = [known.value.get(x, none) if known is not None else frozenset(x or ()) for x in batch.column(3).to_pylist()]
            texts = [main_text(x.as_py(), t) for x, t in zip(batch.column(2), of_row)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return shared.bounded(asked).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
