"""Main text of web pages by line-block distribution.

A page is stripped to lines, one for each block element; a line weighs the length of its text outside
links. Lines inside elements that can't be part of the article (navigation, headers, footers,
sidebars, forms, scripts, notices, adverts, reader comments: by element, role, or names of class and
id) have no text. A name counts if all its words are known, so not has-sidebar, entry-header or
social-science. Names go by what they say, in three ranks (LOOSE words, which layouts use too, others,
FOREIGN ones); a page that has no text outside named elements keeps those of the least rank that has
some. Sizes of elements decide nothing.

The weight of a block is the sum over the WINDOW lines around a line. A surge is a line with a weight
of its own whose block reaches SURGE, a dive a block of no weight. The text between the dives around
a surge stays, from the first line of weight to the last, link lines between them included. So does
everything between two surges of one container (at most one wrapper apart), and, at either end,
fewer than WINDOW link lines in a row in the container of that line, or a linked heading a wrapper
before it. A page without a surge keeps the stretch of most weight.

What a page marks as its article or main part weighs MARKED times its whole length, links too, and a
window ends where marks or named elements begin or end; beside a marked surge, other text needs blocks of a RATIO-th of
the heaviest one. Marks thus decide between texts of similar size, and nothing when they hold none.

Defined results: null or empty html gives the empty text; pages cut off inside a tag, a comment or an
element are read as far as they go; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import documents, slices, small_batches

WINDOW = 3
SURGE = 60
MARKED, RATIO = 64, 16

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: Elements whose content is no markup: skipped up to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that never hold article text.
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "canvas", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of class and id that mark what surrounds an article.
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "masthead", "topbar", "header", "footer", "copyright",
    "sidebar", "aside", "related", "recommended", "widget", "widgets", "share", "sharing", "social", "newsletter", "subscribe", "subscription",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "alert", "disclaimer",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "login", "signup", "search",
}
#: Of these, words of what may be longer than the article itself, and words that layouts of articles use as well.
FOREIGN = {"related", "recommended", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "cookie", "cookies", "consent", "gdpr", "newsletter"}
LOOSE = {"widget", "widgets", "header", "social", "search", "alert", "notice", "notices", "menu"}
#: Words that say nothing of what an element is: names of these and of WORDS count as names of WORDS.
NEUTRAL = {
    "site", "main", "page", "top", "bottom", "left", "right", "side", "bar", "bars", "box", "boxes", "container", "wrap", "wrapper", "inner", "outer", "block", "blocks", "area", "section",
    "list", "item", "items", "link", "links", "group", "row", "col", "column", "primary", "secondary", "global", "local", "fixed", "sticky", "mobile", "desktop", "small", "large", "button",
    "buttons", "btn", "icon", "icons", "form", "field", "title", "text", "content", "body", "label", "slot", "unit", "google", "media", "this", "posts", "articles", "stories", "toggle", "next", "prev",
    "previous", "warning", "info", "error", "open", "close", "js", "the", "and", "my", "new", "ul", "div",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An end tag may be left out: these end when a sibling or a block begins.
SELF_ENDING = {"p", "li", "dt", "dd", "option", "tr", "td", "th", "thead", "tbody", "tfoot", "colgroup"}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Line(NamedTuple):
    """Text, its length outside links, whether a mark holds it, open block elements, innermost element found by its words, whether it is a heading."""

    text: str
    weight: int
    marked: bool
    depth: int
    worded: int
    heading: bool


def _surrounds(tag: str, attributes: str, inside_main: bool) -> tuple[bool, set[str]]:
    """Whether the element certainly surrounds the article, and its words that say so of elements in general."""
    if tag in BOILERPLATE or (tag == "header" and not inside_main):
        return True, set()
    if not attributes or tag in ("html", "body"):
        return False, set()
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, set()
    if found.get("role", "").lower() in ROLES:
        return True, set()
    words: set[str] = set()
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{found.get('class', '')} {found.get('id', '')}").lower().split():
        parts = set(re.findall(r"[^\W\d_]+", re.sub(r"\d+x\d+", " ", name)))
        if parts <= WORDS | NEUTRAL:
            words |= parts & WORDS
    if inside_main:
        words.discard("header")
    return False, words & ({"comment", "comments", "reply", "related", "sidebar"} if tag in ("article", "main") else WORDS)


def _rank(words: set[str]) -> int:
    return 3 if words & FOREIGN else 1 if words <= LOOSE else 2


def _discarded(rows: list[Line], found: list[tuple[int, int]]) -> list[bool]:
    """Whether each element found by its words surrounds the article.

    It does if the page has text (a surge's worth, or of the marked article where there is one) outside
    elements of its rank and above.
    """
    marked = any(r.marked and r.weight for r in rows)
    weighed = any(r.weight for r in rows)
    ranks: list[int] = []
    for up, rank in found:  # outer elements come first
        ranks.append(max(rank, ranks[up] if up >= 0 else 0))
    text = [0] * 4
    for r in rows:
        if r.marked or not marked:
            text[ranks[r.worded] if r.worded >= 0 else 0] += r.weight if weighed else len(r.text)
    kept = next((k for k in range(4) if sum(text[: k + 1]) >= (1 if marked else SURGE)), None)
    if kept is None:  # no surge at all: what has any text
        kept = next((k for k in range(4) if text[k]), 3)
    return [k > kept for k in ranks]


def lines(page: str) -> list[Line]:
    """The lines of a page; those around the article are empty."""
    rows, found = _parsed(page, None)
    return _parsed(page, _discarded(rows, found))[0] if found else rows


def _parsed(page: str, gone: list[bool] | None) -> tuple[list[Line], list[tuple[int, int]]]:
    """(lines, the elements found by their words: the one around each, its rank).

    gone: which of these surround the article; None: lines end at their borders, and all stay.
    """
    out: list[Line] = []
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # (element, whether it surrounds the article, has words, marks the article)
    blocks: list[int] = []  # places of the block elements among them
    open_: dict[str, int] = {}
    skipping = mains = marks = links = headings = 0
    worded = -1
    text: list[str] = []
    weight = 0

    def flush() -> None:
        nonlocal weight
        line = " ".join("".join(text).split())
        out.append(Line(line, min(weight, len(line)), marks > 0, len(blocks), worded, headings > 0))
        text.clear()
        weight = 0

    def pop() -> None:
        nonlocal skipping, mains, marks, links, headings, worded
        tag, skip, by_words, mark = stack.pop()
        open_[tag] -= 1
        if by_words:
            if gone is None:
                flush()
            worded = found[worded][0]
        skipping -= skip
        mains -= tag in ("article", "main") and not by_words
        marks -= mark
        links -= tag == "a"
        headings -= tag in HEADINGS
        if tag not in INLINE:
            blocks.pop()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        chunk = page[at : m.start() if m else size]
        if chunk and not skipping:
            chunk = html.unescape(chunk)
            text.append(chunk)
            if not links:
                weight += len(chunk.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[1] or m[4]:
            if open_.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag not in INLINE:
            k = blocks[-1] if blocks else -1
            if k >= 0 and (stack[k][0] == "p" or stack[k][0] == tag and tag in SELF_ENDING):
                while len(stack) > k:
                    pop()
        skip, words = _surrounds(tag, attributes, mains > 0)
        if words:
            if gone is None:
                flush()
            else:
                skip = gone[len(found)]
            found.append((worded, _rank(words)))
            worded = len(found) - 1
        mark = tag in ("article", "main") and not skip and not (words and gone is None)
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, skip, bool(words), mark))
        open_[tag] = open_.get(tag, 0) + 1
        skipping += skip
        mains += tag in ("article", "main") and not words
        marks += mark
        links += tag == "a"
        headings += tag in HEADINGS
    flush()
    return out, found


def block_weights(weights: list[int], borders: list[bool]) -> list[int]:
    """Sums over the WINDOW lines around each line, as far as no border lies between. borders: whether one comes before each line."""
    out, half = [], WINDOW // 2
    begin = 0
    for i in range(1, len(weights) + 1):
        if i < len(weights) and not borders[i]:
            continue
        total = sum(weights[begin : begin + half])
        for k in range(begin, i):
            total += weights[k + half] if k + half < i else 0
            out.append(total)
            total -= weights[k - half] if k - half >= begin else 0
        begin = i
    return out


def select(rows: list[Line]) -> list[str]:
    """The texts between surge and dive points of the block distribution."""
    told, lows, low = [], [], 0  # lows: fewest open elements since the line before
    for r in rows:
        low = min(low, r.depth)
        if r.text:
            told.append(r)
            lows.append(low)
            low = r.depth
    n = len(told)
    weights = [MARKED * len(r.text) if r.marked else r.weight for r in told]
    borders = [i > 0 and (told[i].marked != told[i - 1].marked or told[i].worded != told[i - 1].worded) for i in range(n)]
    blocks = block_weights(weights, borders)
    marked = max((b for b, r in zip(blocks, told, strict=True) if r.marked), default=0)
    surge = [b >= (SURGE if r.marked else max(SURGE, marked / RATIO)) and w > 0 for b, w, r in zip(blocks, weights, told, strict=True)]

    stretches: list[tuple[int, int, bool]] = []  # first and past the last line of weight, whether one is a surge
    i = 0
    while i < n:
        if not blocks[i]:
            i += 1
            continue
        start = i
        while i < n and blocks[i] and (i == start or not borders[i]):
            i += 1
        first = next(k for k in range(start, i) if weights[k])
        last = next(k for k in range(i - 1, start - 1, -1) if weights[k])
        stretches.append((first, last + 1, any(surge[first : last + 1])))
    surges = [s for s in stretches if s[2]]
    if not surges and stretches:
        surges = [max(stretches, key=lambda s: (sum(weights[s[0] : s[1]]), -s[0]))]

    kept: set[int] = set()
    for a, b, _ in surges:
        kept.update(range(a, b))
        if told[a].marked:
            continue
        start = a  # link lines of its container
        while start and not weights[start - 1] and min(lows[start], told[start - 1].depth) >= told[a].depth - 1:
            start -= 1
        if a - start < WINDOW:
            kept.update(range(start, a))
        if start == a and a and not weights[a - 1] and told[a - 1].heading and min(lows[a], told[a - 1].depth) >= told[a].depth - 2:
            kept.add(a - 1)
        end = b
        while end < n and not weights[end] and min(lows[end], told[end].depth) >= told[b - 1].depth - 1:
            end += 1
        if end - b < WINDOW:
            kept.update(range(b, end))
    for (_, a, _), (b, _, _) in zip(surges, surges[1:], strict=False):
        if not told[a - 1].marked and not told[b].marked and min(lows[a : b + 1]) >= max(told[a - 1].depth, told[b].depth) - 2:
            kept.update(range(a, b))
    return [told[k].text for k in sorted(kept)]


def main_text(page: str | None) -> str:
    return " ".join(select(lines(page))) if page else ""


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "body"):
            texts = [main_text((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body")).mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extract": query}
