"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. A line weighs its characters that are no link text. Tags change
weights alone: lines of menus, headers, footers, sidebars, notices, adverts, forms and comments are no text and are
taken out, which ends nothing; on a page that marks an article (or a main part), lines outside it weigh an OUTSIDE-th.

Weights are summed over a sliding window of WINDOW lines. Text begins at a surge, where a window's sum leaves zero at a
line that has weight, and ends at the dive, where the sum is back at zero. Between the two every line is kept, short
ones and links too. Such a stretch is text if a window in it reaches SURGE characters, or else if it is the heaviest
one. Lines in an article or main element and lines outside it are stretches of their own. Within the element the first surge and the last dive count: what
lies between them, and links before and after them, are the article's own lines; an element without any surge, as a
list of teasers is, is no text beside others.

Null, empty and text-free pages have the empty text. Repeated rows are each extracted. Other columns stay; result
columns replace columns of the same names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import ready

#: Lines of one block of the distribution.
WINDOW = 3
#: Characters of a window that make a stretch text beside others.
SURGE = 80
#: Lines outside the marked element weigh one part in so many.
OUTSIDE = 8
#: Elements whose content is no text of the page: scripts, styles, markup of other kinds and controls of forms.
RAW = frozenset("script style noscript template textarea title svg iframe object select option button".split())
#: Elements that hold no main text.
APART = frozenset("nav header footer aside form menu dialog".split())
#: Words of class, id or role that mark such parts.
HINTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header "
    "menu modal nav navbar navigation newsletter notice notices popup promo related replies respond search share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset({"article", "main"})

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Line:
    text: str
    linked: int  # characters of link text
    apart: bool
    marked: bool  # in an article or main element


def _hinted(tag: str, attributes: str, marked: bool) -> bool:
    """Whether class, id or role name a part that is no text; an article's own header is one of its lines."""
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return tag == "article" and "comment" in attributes.lower()
    for name, a, b, c in _NAMES.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name != "aria-hidden" and not (HINTS - {"header"} if marked else HINTS).isdisjoint(_WORDS.findall(value)):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The page's lines of text in order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # name, apart, marked
    parts: list[str] = []
    linked = 0
    anchor: int | None = None  # how deep the stack was where a link began

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, min(linked, len(text)), bool(stack) and stack[-1][1], bool(stack) and stack[-1][2]))
            parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            linked += (lt - at) * (anchor is not None)
        if lt == n:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m.re.groups or m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "a":
                anchor = None
            if tag in BLOCKS:
                close()
            if any(tag == x[0] for x in stack):
                while stack and stack.pop()[0] != tag:
                    pass
                if anchor is not None and len(stack) < anchor:
                    anchor = None  # a link that was never closed ends with its block
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            close()
        if tag in VOID:
            continue
        if tag == "a":
            anchor = len(stack)
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack:
            # a paragraph, item or cell ends where the next one begins
            for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    if anchor is not None and len(stack) < anchor:
                        anchor = None
                    break
                if stack[k][0] in BLOCKS:
                    break
        above = stack[-1] if stack else ("", False, False)
        if tag in BLOCKS or tag in ("span", "ins"):
            stack.append((tag, above[1] or tag in APART and not (tag == "header" and above[2]) or _hinted(tag, m.group(3), above[2]), above[2] or tag in MARKED))
    close()
    return out


def stretches(weight: list[int]) -> list[tuple[int, int, int, int]]:
    """From surge to dive: the largest sum of a window, the whole weight, the first line and the one after the last."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    out: list[tuple[int, int, int, int]] = []
    i = 0
    while i < len(weight):
        if not weight[i]:
            i += 1
            continue
        end = i
        while end < len(weight) and sums[end]:  # the dive: a whole window without text
            end += 1
        out.append((max(sums[i:end]), sum(weight[i:end]), i, end))
        i = end
    return out


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by line feeds."""
    found = [x for x in lines(page or "") if not x.apart]
    any_marked = any(x.marked for x in found)
    text: list[tuple[int, int, int, int]] = []
    first = 0
    while first < len(found):
        last = first
        while last < len(found) and found[last].marked == found[first].marked:
            last += 1
        inside = found[first].marked
        part = 1 if inside or not any_marked else OUTSIDE
        own = stretches([(len(x.text) - x.linked) // part for x in found[first:last]])
        if inside and own:
            # the element says where the article ends: one stretch, its size unbounded by SURGE
            text.append((max(SURGE, *(x[0] for x in own)), sum(x[1] for x in own), first, last))
        else:
            text += [(top, all_, first + a, first + b) for top, all_, a, b in own]
        first = last
    kept = [x for x in text if x[0] >= SURGE] or [max(text, key=lambda x: x[1])] if text else []
    if not kept and any_marked:  # an article of links alone
        return "\n".join(x.text for x in found if x.marked)
    return "\n".join(x.text for _, _, a, b in kept for x in found[a:b])


def main_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the html column by text, the page's main text."""
    ready(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, "text")]
    given = pages.select(*rest, F.col(html).cast("string").alias(html))
    schema = StructType([*given.schema.fields[:-1], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*rest, "text"])

    return given.mapInArrow(run, schema)
