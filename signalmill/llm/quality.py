"""Quality rules on repetition, from a suffix array over the words of each text.

Suffixes of a text are ranked by prefix doubling (ranks of 1, 2, 4, ... words).
Neighbours in the sorted order that share a prefix of ``min_words`` or more form
the intervals of the longest-common-prefix array; each start in such an interval
begins a maximal repeated substring as long as the larger of its two neighbour
prefixes. The union of these spans and the longest of them are limited.

A batch of texts is ranked at once in numpy, with the text's number as the first
part of every rank, so nothing is compared across texts. Batches are cut at
``BATCH_WORDS`` words; one longer text makes a batch of its own, whole.

Nulls count as the empty text: no words, which fails the base rule. Repeated rows
are judged row by row.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import SPACE, lines_with_words, plain, text_of

WINDOW = 8
BATCH_WORDS = 400_000
SYMBOLS = "#*$%&|<>"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def _rank(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    return np.unique(first.astype(np.int64) * (int(second.max(initial=0)) + 2) + second + 1, return_inverse=True)[1]


def repeats(words: list[np.ndarray], min_words: int) -> list[tuple[int, int, int]]:
    """Per text of word numbers: words in repeated windows of ``WINDOW``, words covered by maximal repeats, longest repeat."""
    sizes = np.array([len(w) for w in words])
    n = int(sizes.sum())
    none = [(0, 0, 0)] * len(words)
    if n == 0:
        return none
    text = np.repeat(np.arange(len(words)), sizes)
    left = np.concatenate([np.arange(s, 0, -1) for s in sizes])  # words to the end of the text
    level = [np.concatenate(words)]
    width = 1
    base = min(WINDOW, min_words)
    while 2 * width <= base:  # ranks of all starts by their first 2, 4, ... words
        prev = level[-1]
        second = np.where(left > width, np.concatenate([prev[width:], np.zeros(min(width, n), prev.dtype)])[:n], -1)
        level.append(_rank(text * (int(prev.max()) + 1) + prev if width == 1 else prev, second))
        width *= 2
    # Only starts whose first ``width`` words occur again can begin a repeat.
    whole = level[-1] if width > 1 else _rank(text, level[-1])
    times = np.bincount(whole)
    at = np.flatnonzero((times[whole] > 1) & (left >= width))
    if not len(at):
        return none
    small = [np.full(n, -1, np.int64)]
    small[0][at] = whole[at]
    span = width
    widths = [span]
    while True:  # double on, among these starts alone
        prev = small[-1]
        ahead = np.minimum(at + span, n - 1)
        # What follows is in the order of its first words, and where these occur again, of all its ``span`` words.
        second = np.where(left[at] > span, _rank(whole[ahead], prev[ahead]), -1)
        rank = _rank(prev[at], second)
        now = np.full(n, -1, np.int64)
        now[at] = rank
        small.append(now)
        span *= 2
        widths.append(span)
        if int(rank.max()) + 1 == len(at) or span >= int(sizes.max()):
            break
    order = at[np.argsort(small[-1][at], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    fine = [(w, r) for w, r in zip(widths, small)][::-1] + [(1 << k, level[k]) for k in range(len(level) - 2, -1, -1)]
    for w, r in fine:
        x, y = a + lcp, b + lcp
        ok = (x < n) & (y < n)
        xi, yi = np.minimum(x, n - 1), np.minimum(y, n - 1)
        ok &= (text[xi] == text[a]) & (text[yi] == text[b]) & (r[xi] == r[yi]) & (r[xi] >= 0)
        ok &= (left[xi] >= w) & (left[yi] >= w)
        lcp += w * ok
    best = np.zeros(n, np.int64)
    np.maximum.at(best, order[:-1], lcp)
    np.maximum.at(best, order[1:], lcp)
    out = []
    starts = np.concatenate([[0], np.cumsum(sizes)])
    touched = set(text[at].tolist())
    for t in range(len(words)):
        if t not in touched:
            out.append((0, 0, 0))
            continue
        mine = best[starts[t]:starts[t + 1]]
        out.append((covered(mine, WINDOW, True), covered(mine, min_words, False), int(mine.max()) if mine.max() >= min_words else 0))
    return out


def covered(best: np.ndarray, least: int, fixed: bool) -> int:
    """Words in the union of the spans that start where ``best`` reaches ``least``."""
    at = np.flatnonzero(best >= least)
    if not len(at):
        return 0
    edge = np.zeros(len(best) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (least if fixed else best[at]), -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(texts: list[str], min_words: int) -> list[dict]:
    """The figures of ``_FIELDS`` for each text."""
    number = defaultdict(count().__next__)
    rows, ids = [], []
    for t in texts:
        words = t.encode().split()
        lines = lines_with_words(t)
        rows.append({"n_words": len(words), "word_chars": len(t) - sum(map(t.count, SPACE)),
                     "n_symbols": sum(map(t.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines))})
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    for row, (again, cover, longest) in zip(rows, repeats(ids, min_words)):
        row |= {"n_repeat_words": again, "covered_words": cover, "longest_repeat": longest}
    return rows


def figures(text: Column, min_words: int = WINDOW) -> Column:
    """Struct of ``_FIELDS`` for a text column."""
    kind = pa.struct([(f, pa.int64()) for f in _FIELDS])

    @F.arrow_udf("struct<" + ", ".join(f"{f}: bigint" for f in _FIELDS) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        out, batch, size = [], [], 0
        for t in texts:
            t = t.as_py()
            if batch and size + len(t) > 6 * BATCH_WORDS:
                out += measure(batch, min_words)
                batch, size = [], 0
            batch.append(t)
            size += len(t)
        return pa.array(out + measure(batch, min_words), kind)

    return measured(text_of(text))


def verdict(f: Column, max_covered: float = 0.3, long_words: int = 50, max_longest: float = 0.2) -> tuple[Column, Column]:
    """``base_failed`` and ``kept`` from the figures.

    Kept: the base rule holds, maximal repeats cover at most ``max_covered`` of
    the words, and the longest one is short (``long_words``) or at most
    ``max_longest`` of the text.
    """
    n = f["n_words"]
    base = (n < 20) | (100 * f["n_repeat_words"] > 30 * n)
    fine = ((f["covered_words"] <= max_covered * n)
            & ((f["longest_repeat"] <= long_words) | (f["longest_repeat"] <= max_longest * n)))
    return base, ~base & fine


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """One row per document: id, the figures, ``base_failed`` and ``kept``. Other columns are not kept."""
    rows = docs.select(plain(id_col).cast("bigint").alias("doc_id"), figures(plain(text_col)).alias("f"))
    base, kept = verdict(F.col("f"), **limits)
    return rows.select("doc_id", *[F.col(f"f.{x}").alias(x) for x in _FIELDS], base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", **limits: float) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.where(verdict(figures(plain(text_col)), **limits)[1])
