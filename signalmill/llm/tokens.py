"""Exact token counts at every prefix of a text, by dynamic programming over a piece vocabulary.

The encoding of a prefix ends in exactly one piece ``p``: the one that is legal
after the last piece of what stands before it (two neighbouring pieces are legal
when merging their joined text gives those two back). So ``count[i] =
count[i - len(p)] + 1`` fills a table from left to right, and the table answers
any truncation or budget question without encoding anything again.

Merges never cross a point at which no vocabulary piece holds the two adjoining
characters. Texts are cut there, so one small table per distinct chunk, kept in
a bounded cache, and prefix sums over the chunks make up the table of the text.

Nulls count as the empty text (no tokens). Ties and repeated rows are counted
row by row; texts of any length are processed whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import Memo, plain, text_of

SPACER = "▁"
CHUNKS, STATES = 700_000, 1_000_000


class PrefixCounter:
    """Token counts of prefixes for one byte-fallback piece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = model.get_score(i)
        self.longest = max(map(len, self.rank))
        self.joined = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        # Spacers stand only at the start of a piece or in pieces of nothing else: a word never merges with the next.
        assert not any(a != SPACER and b == SPACER for a, b in self.joined) and not any("\n" in x for x in self.joined)
        self.names = [""] + [p for p in self.rank if self.merge(p) == [p]]  # pieces that encode as themselves
        self.number = {p: i for i, p in enumerate(self.names) if i}
        lengths: dict[str, set[int]] = {}
        for p in self.number:
            lengths.setdefault(p[-3:], set()).add(len(p))
        #: Sizes of the pieces that end in these last three (or two) characters, longest first.
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in lengths.items() if len(end) == 3}
        self.twos = {end: (2,) for end in lengths if len(end) == 2}
        for end in list(self.lengths):
            self.lengths[end] += self.twos.get(end[1:], ())

        self.legal: dict[int, bool] = {}
        self.states = Memo(STATES)
        self.totals = Memo(CHUNKS, self.total)

    def merge(self, text: str) -> list[str]:
        """The encoding by its definition: join the best-scored neighbours, leftmost first."""
        parts, rank = list(text), self.rank
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether one piece can stand after another: merging their joined text gives the two back."""
        if len(self.legal) > 1_000_000:
            self.legal.clear()
        pair = [self.names[before], self.names[piece]]
        known = self.legal[before << 16 | piece] = self.merge(pair[0] + pair[1]) == pair
        return known

    def state(self, part: str) -> int:
        """``count << 16 | last piece`` of a chunk; the states of all its prefixes are kept and shared by all chunks.

        Grows the longest prefix already known by one character at a time: the
        last piece is the one suffix that is a piece and legal after the last
        piece of what remains. Characters without a piece are spelled in bytes.
        """
        states, number, legal = self.states, self.number, self.legal
        n = len(part)
        m = n
        while m and part[:m] not in states:
            m -= 1
        known = states[part[:m]] if m else 0
        for i in range(m + 1, n + 1):
            for size in self.lengths.get(part[i - 3:i]) or self.twos.get(part[i - 2:i], ()) if i > 2 else self.twos.get(part[:i], ()):
                if size > i:
                    continue
                piece = number.get(part[i - size:i])
                if piece:
                    before = states[part[:i - size]] if size < i else 0
                    if before & 0xFFFF:
                        pair = (before & 0xFFFF) << 16 | piece
                        fits = legal.get(pair)
                        if fits is None:
                            fits = self.fits(before & 0xFFFF, piece)
                        if not fits:
                            continue
                    known = (before >> 16) + 1 << 16 | piece
                    break
            else:
                one = number.get(part[i - 1], 0)
                known = (known >> 16) + (1 if one else len(part[i - 1].encode())) << 16 | one
            states[part[:i]] = known
        return known

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut where no piece holds both neighbours."""
        word = _WORD.match(chunk)
        if word:
            cut = word.end(1)
            return [chunk] if cut == len(chunk) or chunk[cut - 1:cut + 1] in self.joined else [chunk[:cut], chunk[cut:]]
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1:i + 1] not in self.joined]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]

    def count_part(self, part: str) -> int:
        self.states.room()
        return (self.state(part) if len(part) <= 64 else self.table(part)[-1] << 16) >> 16

    def table(self, part: str) -> list[int]:
        """Token counts of all prefixes of a chunk, the empty one first; in place of the shared states for very long ones."""
        counts, last = [0], [0]
        for i in range(1, len(part) + 1):
            for size in self.lengths.get(part[i - 3:i]) or self.twos.get(part[i - 2:i], ()) if i > 2 else self.twos.get(part[:i], ()):
                piece = number if size <= i and (number := self.number.get(part[i - size:i])) else 0
                before = last[i - size] if piece else 0
                if piece and (not before or self.legal.get(before << 16 | piece, None) or self.fits(before, piece)):
                    counts.append(counts[i - size] + 1)
                    last.append(piece)
                    break
            else:
                one = self.number.get(part[i - 1], 0)
                counts.append(counts[-1] + (1 if one else len(part[i - 1].encode())))
                last.append(one)
        return counts

    def total(self, key: str) -> int:
        """Tokens of one chunk. A key without a leading spacer or line feed stands for the word after a spacer."""
        known = sum(map(self.count_part, self.parts(chunk_of(key))))
        if len(key) <= 64:
            self.totals[key] = known
        return known

    def chunk_totals(self, text: str) -> tuple[list[str], list[int]]:
        keys = chunk_keys(text)
        self.totals.room()
        return keys, list(map(self.totals.__getitem__, keys))

    def count(self, text: str) -> int:
        return sum(self.chunk_totals(text)[1]) if text else 0

    def prefix(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens."""
        if not text:
            return 0
        keys, totals = self.chunk_totals(text)
        before, tokens = -1, 0  # the encoding starts with a spacer that the text does not hold
        for key, upto in zip(keys, accumulate(totals)):
            chunk = chunk_of(key)
            if upto > limit:
                break
            before, tokens = before + len(chunk), upto
        else:
            return len(text)
        best = before
        for part in self.parts(chunk):
            table = self.table(part)
            for k in range(1, len(part) + 1):
                if tokens + table[k] <= limit:
                    best = before + k
            if tokens + table[-1] > limit + 16 * self.longest:
                break
            before, tokens = before + len(part), tokens + table[-1]
        return max(best, 0)


_WORD = re.compile(f"({SPACER}?[^\\W\\d_]{{1,40}})(?:[^\\w{SPACER}]{{0,20}})$")
_RUNS = re.compile(f"{SPACER}*[^{SPACER}\n]+|\n[^{SPACER}\n]*|{SPACER}+")


def chunk_of(key: str) -> str:
    return key if key[:1] in (SPACER, "\n") else SPACER + key


def chunk_keys(text: str) -> list[str]:
    """Cuts before every spacer run and line feed; plain words stay without their spacer."""
    if "  " in text or text[0] == " " or SPACER in text or "\n " in text:
        return _RUNS.findall(SPACER + text.replace(" ", SPACER))
    return text.replace("\n", " \n").split(" ")


@lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def token_counts(text: Column, model_file: str, limit: int) -> Column:
    """Struct of ``n_tokens`` and ``limit_chars`` (longest prefix of at most ``limit`` tokens) for a text column."""
    kind = pa.struct([("n_tokens", pa.int64()), ("limit_chars", pa.int64())])

    @F.arrow_udf("struct<n_tokens: bigint, limit_chars: bigint>")
    def counted(texts: pa.Array) -> pa.Array:
        c, out = counter(model_file), []
        for t in texts:
            t = t.as_py()
            n = c.count(t)
            out.append({"n_tokens": n, "limit_chars": len(t) if n <= limit else c.prefix(t, limit)})
        return pa.array(out, kind)

    return counted(text_of(text))


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit, limit_chars``. Other columns are not kept."""
    rows = docs.select(plain(id_col).cast("bigint").alias("doc_id"), text_of(plain(text_col)).alias("text"))
    return (rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
                        token_counts(F.col("text"), model_file, limit).alias("c"))
            .select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.limit_chars"))
