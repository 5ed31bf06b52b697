"""Token ids of batches: each word that differs is merged once, and the library gets single words only."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from signalmill.llm import queries, wordbpe


@pytest.fixture
def words():
    return wordbpe.WordTokens(public_tokenizers.path(queries.WORDS))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_batches_are_as_the_library_has_them(words, kind, monkeypatch):
    monkeypatch.setattr(wordbpe, "AT_ONCE", 7)
    rng = random.Random(3)
    some = ["the", "The", "don't", "'s", "x=1;", "Größe", "né", "́a", "Ⱥb", "aȾ", "J̌x", "İ", "Σσς", "日本", "😀", "٠1", "a\xa0b", "　c", "\x1c\x1d",
            "\x85", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "ab" * wordbpe.LONGEST, "c1" * wordbpe.LONGEST, "12", "", "\x00"]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\x0c\r", "\n\n "]
    texts = ["".join(x for _ in range(rng.randint(0, 9)) for x in (rng.choice(some), rng.choice(gaps))) for _ in range(300)]
    texts += ["", " ", "\n", *some]
    for batch, shared in ((texts, 2 << 20), (texts, 50), (texts, 1), ([], 50), ([""], 50), (["日"], 50)):
        monkeypatch.setattr(wordbpe, "SHARED_BYTES", shared)
        assert list(words.batch(pa.array(batch, kind))) == [words._by_library(t) for t in batch]
    assert all(words.ids(t) == words._by_library(t) for t in some)
    assert list(words.batch(pa.array(texts, kind).slice(5, 50))) == [words._by_library(t) for t in texts[5:55]]


def test_each_word_is_done_once(words, monkeypatch):
    merged, library, merge = [], [], words.merger.encode_to_numpy

    class Merger:
        def encode_to_numpy(self, pieces):
            merged.append(len(pieces))
            return merge(pieces)

    by_library = words._by_library
    monkeypatch.setattr(words, "merger", Merger())
    monkeypatch.setattr(words, "_by_library", lambda t: library.append(t) or by_library(t))
    texts = ["plain words here, and 日本 once more " * 100] * 50
    got = list(words.batch(pa.array(texts)))
    assert sum(merged) < 50 and library == ["日本"]
    assert set(got) == {by_library(texts[0])}
