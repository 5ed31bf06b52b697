"""Phrase collocations against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

from signalmill.llm import collocations


def brute(rows, least, longest, top, share):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        inside = set()
        for p, a in frequent.items():
            inside |= {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                       if j - i < len(p) and p[i:j] in frequent and 100 * a >= share * frequent[p[i:j]]}
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in inside:
                s, _, l, r = min((1000 * a * n[lang] // (frequent[p[:k]] * frequent[p[k:]]), k, frequent[p[:k]], frequent[p[k:]])
                                 for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), l, r))
        out |= {(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)}
    return out


ODD = [(None, "New York, new  york\tNEW YORK"), ("und", "new york. x new york new york"), ("en", None), ("en", ""), ("en", " \t\n,.;"),
       ("en", "a a a a a a a a"), ("en", "a a a a a a a a"), ("de", "Äpfel und Äpfel und äpfel und"), ("de", "x y x y \x1cz x y"),
       ("fr", "le chat noir dort ici " * 40), ("fr", "Le chat\rnoir le\x0bchat noir"), ("es", " ".join("ab"[k % 2] + "cd"[k % 3 % 2] for k in range(3000)))]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
@pytest.mark.parametrize("share", [100, 60])
def test_against_brute_force(spark, broadcast_rows, share):
    docs = spark.createDataFrame([(k, t, l, 9, "q") for k, (l, t) in enumerate(ODD)], "chunk long, text string, lang string, n long, word string")
    got = collocations.collocations(docs, least=3, top=12, share=share, broadcast_rows=broadcast_rows)
    assert {tuple(r) for r in got.collect()} == brute(ODD, 3, 5, 12, share)


def test_small_chunks_and_the_given_documents(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 500)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = {tuple(r) for r in collocations.collocations(docs, least=20, top=200).collect()}
    assert got == brute(rows, 20, 5, 200, 100) and len(got) > 100


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_dense_and_loose_tiles_count_alike():
    rng = np.random.default_rng(1)
    tiles, want = collocations.Tiles(), Counter()
    for part in range(3):
        seq = np.where(rng.random(200_000) < 0.1, -1, (rng.random(200_000) ** 3 * 3000).astype(np.int64))
        tiles.add(seq)
        want.update((a, b) for a, b in zip(seq.tolist(), seq[1:].tolist()) if a >= 0 and b >= 0)
    got, size = Counter(), collocations.TILE
    for row, column, cells, counts in tiles.rows():
        assert (np.diff(cells) > 0).all()
        for c, n in zip(cells.tolist(), counts.tolist()):
            got[row * size + c // size, column * size + c % size] += n
    assert got == want and tiles.dense
    only = collocations.Tiles()
    for _ in range(2):  # nothing but one dense tile
        only.add(np.zeros(100_000, np.int64))
    assert [(r, c, x.tolist(), n.tolist()) for r, c, x, n in only.rows()] == [(0, 0, [0], [2 * 99_999])]


def test_numbers_are_kept():
    x = np.array([-1, 0, 1, 65_534, 65_535, 65_536, (1 << 31) - 1])
    assert (collocations.unpack(collocations.pack(x)) == x).all()
    assert collocations.parts_of(0, 0) == 64 and collocations.parts_of(5000, 5000) == 1
