"""Token ids of whole texts for a tokenizer of lower-cased words with an end-of-word suffix.

The tokenizer's own library spends most of its time on bookkeeping (offsets,
alignments). Here texts are split at ASCII white space, which no piece and no
composed character spans, and each word that differs is done once in some
megabytes of text: Arrow numbers the words, and puts their ids together again.
No word is kept for the next megabytes.

Where a word allows, its pieces are marked in numpy and merged by tiktoken, from
the same merges; any other word goes to the library, which is loaded for the first.

Each piece is written with one character per byte: the bytes before the last in
one range, the last one in another, which stands for the end-of-word suffix. The
pieces then end by themselves and are split by one pattern. The characters are
the first merges; the tokenizer's follow in their order.

tiktoken merges by the token that results, the tokenizer by the pair. Both give
the same ids if every token, taken alone, merges into itself: the merges inside
a token do not depend on what surrounds it, so in its last state but one it is
always the same pair. Tokens for which that does not hold are never made and are
left out (``reachable``).
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The normalizer and the splitting this module reproduces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = (*range(9, 14), 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)
SHORT, LONG = "stmd", ("re", "ve", "ll")
# End of the fixed values.

SPACE, LETTER, NUMBER, OTHER, FOREIGN = range(5)
LONGEST = 1000  # bytes of a piece; merging takes the square of them
SHARED_BYTES = 1 << 20  # text whose words are done together; a worker holds several arrays of that order
AT_ONCE = 1 << 15  # words marked at once
_ENDS = "A-Z0-9\u0080-ÿʀ-˿"


def kinds() -> np.ndarray:
    """Class of each 16-bit character; scripts whose properties have long been stable, all others are FOREIGN."""
    out = np.full(1 << 16, FOREIGN, np.uint8)
    for c in (*range(0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070)):
        category = unicodedata.category(chr(c))
        if category != "Cn":
            out[c] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
    out[list(WHITE)] = SPACE
    out[0x3A3] = FOREIGN  # the capital sigma: Python lowers it by its place in the word
    for c in np.flatnonzero(out != FOREIGN).tolist():  # some letters lower into other scripts' ranges
        if any(ord(x) > 0xFFFF or out[ord(x)] == FOREIGN for x in chr(c).lower()):
            out[c] = FOREIGN
    return out


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(visible))
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


def inner(b: int) -> str:
    return chr(b) if b < 128 else chr(0x100 + b)


def final(b: int) -> str:
    c = chr(b)
    if b >= 128:
        return chr(0x200 + b)
    return c.upper() if c.islower() else c if c.isdigit() else chr(128 + b)


def reachable(symbols: list[str], rank: dict[tuple[str, str], int]) -> bool:
    """Whether the symbols merge into one token."""
    while len(symbols) > 1:
        found = [rank.get(p, len(rank)) for p in zip(symbols, symbols[1:])]
        low = min(found)
        if low == len(rank):
            return False
        at = found.index(low)
        symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
    return True


def blanked(text: str, lines: set[int]) -> str:
    return "\n".join("" if k in lines else line for k, line in enumerate(text.split("\n")))


class WordTokens:
    """Token ids of texts as little-endian bytes."""

    def __init__(self, tokenizer_file: str):
        self.file = tokenizer_file
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.marked = [t["content"] for t in spec["added_tokens"]]
        self.merger = self._merger(spec)
        self.kind = kinds()
        self.inner = np.array([ord(inner(b)) for b in range(256)], "<u2")
        self.final = np.array([ord(final(b)) for b in range(256)], "<u2")

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def _merger(self, spec: dict):
        """The tokenizer's merges for tiktoken, or None where the tokenizer is of another kind."""
        import tiktoken

        model, splits = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        suffix = model.get("end_of_word_suffix")
        known = (model.get("type") == "BPE" and suffix and not model.get("dropout") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix") and not spec["truncation"] and not spec["padding"]
                 and (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
                 and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
                 and splits[0]["pattern"] == {"Regex": PATTERN} and splits[0]["invert"] and splits[0]["behavior"] == "Removed"
                 and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
                 and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
                 and not any(set(m) & set(" \t\n\x0b\x0c\r") for m in self.marked))
        if not known:
            return None
        vocab, names = model["vocab"], byte_names()
        byte = {c: b for b, c in names.items()}
        upper = {names[b] for b in range(65, 91)}  # never left after lower-casing
        merges = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        rank = {p: k for k, p in enumerate(merges)}
        if len({a + b for a, b in merges}) < len(merges):
            return None
        ranks = {bytes([b]): b for b in range(256)}
        self.ids_of = np.zeros(768 + len(merges), "<u4")
        self.closed = np.zeros(768 + len(merges), bool)  # tokens with the suffix: each ends a piece
        for b, name in names.items():
            for place, (coded, token) in enumerate(((inner(b), name), (final(b), name + suffix))):
                if name in upper:
                    continue
                key = coded.encode()
                at = ranks.setdefault(key, 256 * (place + 1) + b)
                self.ids_of[at] = vocab[token]
                self.closed[at] = place
        for k, (a, b) in enumerate(merges):
            token = a + b
            closed = token.endswith(suffix)
            body = token[:-len(suffix)] if closed else token
            if upper & set(body) or len(body) > 1 and set("0123456789") & set(body):
                continue  # cannot occur: capitals are lowered, digits stand alone
            symbols = [*body[:-1], body[-1] + suffix * closed]
            if not reachable(symbols, rank):
                continue
            coded = "".join(inner(byte[c]) for c in body[:-1]) + (final if closed else inner)(byte[body[-1]])
            ranks[coded.encode()] = 768 + k
            self.ids_of[768 + k] = vocab[token]
            self.closed[768 + k] = closed
        return tiktoken.Encoding("words", pat_str=f"[^{_ENDS}]*[{_ENDS}]", mergeable_ranks=ranks, special_tokens={})

    def _coded(self, whole: str) -> tuple[str, np.ndarray, set[int]]:
        """The text's pieces, one character per byte, how many each line has, and the lines that the library has to do (0 pieces)."""
        text, refused = whole, set()
        for m in self.marked:
            if m in text:
                refused.update(k for k, line in enumerate(text.split("\n")) if m in line)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            units = np.frombuffer(text.encode("utf-16-le"), "<u2")
            foreign = np.flatnonzero(self.kind[units] == FOREIGN)
            if len(foreign):
                refused.update(np.searchsorted(np.flatnonzero(units == 10), foreign).tolist())
        if refused:
            text = blanked(text, refused)
        text = text.lower()
        kind = self.kind[np.frombuffer(text.encode("utf-16-le"), "<u2")]
        ends = np.empty(len(kind), bool)
        ends[:-1] = kind[:-1] != kind[1:]
        ends[-1:] = True
        ends |= kind == NUMBER
        at = text.find("'")
        while at >= 0:  # contractions: an apostrophe that begins a piece, and its letters
            if at == 0 or kind[at - 1] != OTHER:
                size = 1 if text[at + 1:at + 2] in tuple(SHORT) else 2 if text[at + 1:at + 3] in LONG else 0
                if size:
                    ends[at:at + size] = False
                    ends[at + size] = True
            at = text.find("'", at + 1)
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > len(kind):  # from characters to bytes
            first = (raw & 0xC0) != 0x80
            char = np.cumsum(first, dtype=np.int32) - 1
            kind, ends = kind[char], ends[char]
            ends[:-1] &= first[1:]
        words = kind != SPACE
        last, lines = np.flatnonzero(ends & words), np.flatnonzero(raw == 10)
        sizes = np.diff(np.cumsum(words, dtype=np.int32)[last], prepend=0)
        if len(last) and sizes.max() > LONGEST:
            refused.update(np.searchsorted(lines, last[sizes > LONGEST]).tolist())
            return *self._coded(blanked(whole, refused))[:2], refused
        counts = np.diff(np.searchsorted(last, lines), prepend=0, append=len(last))
        ends, raw = ends[words], raw[words]
        return np.where(ends, self.final[raw], self.inner[raw]).tobytes().decode("utf-16-le"), counts, refused

    def _marked_pieces(self, text: str) -> str | None:
        """The text's pieces, one character per byte; None where the library has to do a part of it."""
        pieces, _, refused = ("", None, True) if self.merger is None else self._coded(text)
        return None if refused else pieces

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids_of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each word; words hold no ASCII white space."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py()
        pieces, counts, refused = self._coded(text)
        tokens = self.merger.encode_to_numpy(pieces) if pieces else np.zeros(0, np.uint32)
        after = np.append(0, np.flatnonzero(self.closed[tokens]) + 1)  # tokens up to the end of each piece
        borders = 4 * after[np.append(0, np.cumsum(counts))]
        ids = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(borders), pa.py_buffer(self.ids_of[tokens])])
        if refused:
            place, refused, lines = np.arange(len(words)), sorted(refused), text.split("\n")
            place[refused] = len(words) + np.arange(len(refused))
            ids = pa.concat_arrays([ids, pa.array([self._by_library(lines[k]) for k in refused], ids.type)]).take(pa.array(place))
        return ids

    def _ids_of_texts(self, texts: pa.Array) -> tuple[pa.Buffer | None, list[int]]:
        """The ids of all texts one after the other, and the places between the texts."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        known, chunks = words.dictionary, [pa.array([], pa.large_binary())]
        for at in range(0, len(known), AT_ONCE):
            chunks.append(self._ids_of_words(known.slice(at, AT_ONCE)))
        ids = pa.concat_arrays(chunks).take(words.indices)
        _, borders, data = ids.buffers()
        return data, np.frombuffer(borders, "<i8")[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text."""
        if self.merger is None:
            yield from map(self._by_library, texts.to_pylist())
            return
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while at < len(texts):  # a text at least
            after = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SHARED_BYTES, "right")))
            data, borders = self._ids_of_texts(texts.slice(at, after - at))
            yield from (data[a:b].to_pybytes() if a < b else b"" for a, b in zip(borders, borders[1:]))
            at, data = after, None
        pa.default_memory_pool().release_unused()

    def ids(self, text: str) -> bytes:
        return next(self.batch(pa.array([text])))


@lru_cache(maxsize=2)
def word_tokens(tokenizer_file: str) -> WordTokens:
    return WordTokens(tokenizer_file)
