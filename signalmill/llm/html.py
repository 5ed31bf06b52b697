"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. Pass one classifies each block:
where the page marks its parts (``article``, ``main``, ``nav``, class names such
as ``sidebar``) the mark decides; elsewhere stop-word density, length and link
density call a block good or bad, or leave it open when it is short or without
evidence. Where most text of a page's long blocks has no stop words (another
language, tables, code), they say nothing and length decides. Pass two lets open blocks inherit from the nearest decided neighbours:
good if both sides are good, and where they differ, from the nearer side.

NULL and empty pages give the empty text. Unclosed, crossed and unknown tags are
tolerated; repeated rows are extracted row by row; pages of any length are read
whole.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import plain, text_of

# Names of HTML elements and usual class names, and frequent words of four languages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section select summary table tbody td tfoot th thead tr ul""".split())
APART = frozenset("nav aside footer form menu dialog button select fieldset head".split())
APART_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar
nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent notice alert popup modal overlay
newsletter subscribe signup share sharing social related recommended comment comments disqus respond widget toolbar
pagination pager search login complementary contentinfo dialog gdpr paywall hidden masthead""".split())
CLOSED_BY = {"p": BLOCK - {"html", "body", "head"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
             "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "tr": frozenset(["tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}
STOP_WORDS = frozenset("""the of and to in a is that for it with as was on are be this by from at or an have not he you
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus
le la les de des du et en un une que est pour qui dans sur pas au par avec plus ce il se
el los las del y que en un una por con para es se no al lo como más su""".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s>]++))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
BAD, OPEN, GOOD = -1, 0, 1


def set_apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name or marks say that it is not part of the main text."""
    if tag in APART or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main", "p", "h1"):
        return False
    for name, value in _MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        words = set(_NAME.findall(value))
        if words & APART_NAMES or not inside and "header" in words:
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, int, int]]:
    """``(text, link characters, mark)`` per block in page order; the mark is BAD, GOOD (in an article) or OPEN."""
    blocks: list[tuple[str, int, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, set apart, in the article
    held: dict[str, int] = {}
    links = anchors = 0
    at, size = 0, len(page)
    lower = None

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if anchors:
                links += len(text)

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        if text:
            apart, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            blocks.append((text, links, BAD if apart else GOOD if inside else OPEN))
        pieces.clear()
        links = 0

    def close(tag: str) -> None:
        nonlocal anchors
        while stack:
            top = stack.pop()[0]
            held[top] -= 1
            anchors -= top == "a"
            if top == tag:
                break

    while at < size:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ending, attributes = found[1] or found[4], found[3] or found[6] or ""
        if tag in BLOCK:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if ending:
            if held.get(tag):
                close(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            lower = lower if lower is not None else page.lower() if len(page.lower()) == size else page
            end = lower.find("</" + tag, at)
            at = size if end < 0 else end
            if end >= 0:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            close(stack[-1][0])
        if tag in BLOCK and tag not in ("html", "body", "head"):
            while stack and stack[-1][0] not in BLOCK and stack[-1][0] != "a" and held.get("p") and tag == "p":
                close(stack[-1][0])  # an open <b> inside an open <p> ends with it
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                close(stack[-1][0])
        apart, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        inside = inside or tag in ("article", "main")
        apart = apart or set_apart(tag, attributes, inside)
        stack.append((tag, apart, inside))
        held[tag] = held.get(tag, 0) + 1
        anchors += tag == "a"
    flush()
    return blocks


def density_of(text: str) -> float:
    """Share of stop words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)


def boilerplate(block: tuple[str, int, int], most_links: float) -> bool:
    return block[1] > most_links * len(block[0]) or "©" in block[0]


def first_pass(block: tuple[str, int, int], marked: bool, spoken: bool, short: int, long: int, high: float, most_links: float) -> int:
    """GOOD, BAD or OPEN.

    ``marked``: the page has an article, so text outside it is not the main text.
    ``spoken``: stop words tell the page's texts apart.
    """
    text, links, mark = block
    if mark or marked:
        return mark or BAD
    if boilerplate(block, most_links):
        return BAD
    if len(text) < short:
        return BAD if links else OPEN
    return GOOD if len(text) > long and (not spoken or density_of(text) >= high) else OPEN


def second_pass(labels: list[int]) -> list[int]:
    """Open labels inherit from the nearest decided neighbour; equal distance: good only if both are good; nothing decided: all good."""
    n = len(labels)
    if not any(labels):
        return [GOOD] * n
    before, after = [(BAD, n + 1)] * n, [(BAD, n + 1)] * n
    for side, order, step in ((before, range(n), 1), (after, range(n - 1, -1, -1), 1)):
        label, distance = BAD, n + 1
        for i in order:
            distance += step
            if labels[i]:
                label, distance = labels[i], 0
            side[i] = (label, distance)
    out = []
    for own, (a, da), (b, db) in zip(labels, before, after):
        out.append(own or (a if a == b or da < db else b if db < da else BAD))
    return out


def main_text(page: str, short: int = 70, long: int = 140, low: float = 0.2, high: float = 0.3, most_links: float = 0.33) -> str:
    blocks = blocks_of(page)
    marked = any(mark == GOOD for _, _, mark in blocks)
    free = [] if marked else [b[0] for b in blocks if not b[2] and len(b[0]) >= short and not boilerplate(b, most_links)]
    spoken = 2 * sum(len(t) for t in free if density_of(t) >= low) >= sum(map(len, free))
    labels = second_pass([first_pass(b, marked, spoken, short, long, high, most_links) for b in blocks])
    return " ".join(text for (text, _, _), label in zip(blocks, labels) if label == GOOD)


def extract(html: Column, **limits: float) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), **limits) for p in pages], pa.string())

    return extracted(text_of(html))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  **limits: float) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``. Other columns are not kept."""
    rows = pages.select(plain(id_col).cast("bigint").alias("page_id"), plain(url_col).cast("string").alias("url"),
                        extract(plain(html_col), **limits).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
