"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs the
characters it has outside links; ``BOOST`` times those and its links too where
the page marks an article; nothing in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, told by tag or by class, id or
role. Weights are summed over sliding windows of lines, which don't reach over
an article's edges. A surge is where a window's sum rises to the threshold:
``SURGE``, or a ``SHARE`` of the page's largest sum if that is more, or that
sum itself in a page that has less. A mark alone makes no surge: a marked line
counts as one ``BOOST`` times as long, and is outvoted where the page has runs
that are much longer still. The dive after a surge is where the sums fall to
nothing; the weighing lines between them are kept.

Defined cases: null html is empty; a page without text gives an empty text;
unclosed comments, scripts and styles reach to the end of the page; end tags
without an open element say nothing; a very long page is read whole, in time
in proportion to its length; equal rows are extracted alike; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the sum that makes a surge.
WINDOW, SURGE = 5, 40
#: How much more a marked article's characters weigh, and the part of the page's largest sum that a surge needs.
BOOST, SHARE = 8, 1 / 32

# Fixed values of HTML: elements whose content is no text, elements that start a line, elements without an end tag.
SILENT = "script style noscript template svg math head title textarea select option button iframe object canvas audio video datalist"
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
VOID = "area base br col embed hr img input link meta source track wbr"
# Fixed values of this extractor: elements and names that mark what is not the article.
ASIDE_TAGS = "nav footer aside form menu dialog"
ASIDE_NAMES = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-links comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets "
    "contentinfo complementary search alert"
)
ARTICLE_NAMES = "article-body articlebody article-content entry-content post-content post-body story-body main-content"

_silent, _blocks, _void = set(SILENT.split()), set(BLOCKS.split()), set(VOID.split())
_aside_tags, _aside_names, _article_names = set(ASIDE_TAGS.split()), set(ASIDE_NAMES.split()), set(ARTICLE_NAMES.split())
_token = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[|\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>?", re.S)
_marks = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_parts = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


class Line(NamedTuple):
    text: str
    linked: int
    aside: bool
    article: bool


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is aside, and whether it marks the article."""
    aside = tag in _aside_tags or tag == "header" and not in_article
    article = tag in ("article", "main")
    if attributes.strip():
        for name, value in _marks.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words = set(value.split())
                pieces = {p for w in words for p in re.split(r"[-_]", w)} if tag not in ("body", "html", "article", "main") else set()
                aside |= bool((words | pieces) & _aside_names)
                article |= bool(words & _article_names) or value == "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                aside = True
    return aside and tag not in ("body", "html"), article and not aside


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, aside, article: each with what is around it
    opened: Counter[str] = Counter()  # tags in the stack
    buffer: list[str] = []
    linked, links, last = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                _, aside, article = stack[-1] if stack else ("", False, False)
                out.append(Line(text, min(linked, len(text)), aside, article))
            buffer.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            buffer.append(text)
            if links:
                linked += len(text)

    size = len(page)
    while last < size:
        m = _token.search(page, last)
        if m is None:
            put(page[last:])
            break
        put(page[last : m.start()])
        last = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1] and tag in _silent and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, last)
            if tag == "head":
                end = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, last)
            last = end.end() if end else size
            if tag in ("textarea", "select", "button", "iframe", "object", "canvas", "audio", "video"):
                buffer.append(" ")
            continue
        if tag in _blocks:
            flush()
        elif tag == "br":
            buffer.append("\n")
        if tag in _void:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if tag not in _blocks and any(s[1] for s in stack[k:]):
                    flush()
                opened.subtract(s[0] for s in stack[k:])
                del stack[k:]
        elif not m[3].endswith("/"):
            if tag == "a":
                links += 1
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1  # their end tags may be left out
            _, in_aside, in_article = stack[-1] if stack else ("", False, False)
            aside, article = _kind(tag, m[3], in_article)
            if aside and not in_aside and tag not in _blocks:
                flush()
            stack.append((tag, in_aside or aside, in_article or article))
            opened[tag] += 1
    flush()
    return out


def block_sums(weight: np.ndarray, run: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sum of the ``window`` weights that start at each line and lie in its run."""
    before = np.concatenate(([0], np.cumsum(weight)))
    ends = np.searchsorted(run, run, side="right")  # runs are numbered in order
    at = np.arange(len(weight))
    return before[np.minimum(at + window, ends)] - before[at]


def kept_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge and the dive after it, and weigh something."""
    weight = np.array([0 if x.aside else BOOST * len(x.text) if x.article else len(x.text) - x.linked for x in lines], dtype=np.int64)
    article = np.array([x.article for x in lines])
    run = np.cumsum(np.concatenate(([False], article[1:] != article[:-1])))
    sums = block_sums(weight, run, window)
    peak = int(sums.max(initial=0))
    need = max(1, min(peak, max(surge, int(peak * SHARE))))
    keep = np.zeros(len(lines), dtype=bool)
    inside = -1  # the run in which a surge has not dived yet
    for at in range(len(lines)):
        if sums[at] == 0 or inside != run[at]:
            inside = run[at] if weight[at] and sums[at] >= need else -1
        keep[at] = inside >= 0 and weight[at] > 0
    return keep


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(page)
    if not lines:
        return ""
    return "\n\n".join(x.text for x, keep in zip(lines, kept_lines(lines, window, surge), strict=True) if keep)


def extract(pages: DataFrame, *, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": [main_text(x or "", window, surge) for x in frame["html"]]})

    return (
        pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
        .mapInPandas(run, "page_id string, url string, text string")
        .select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
    )
