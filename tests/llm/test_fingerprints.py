"""Fingerprints by edit embedding: the walk step by step, the order of documents, near copies."""

import hashlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_joins import roots

from signalmill.llm import fingerprints as fp


def walk(text):
    """The embedding one step at a time: a bit for each step and class of characters says whether to go on."""
    goes_on = (fp._stays() == 1).reshape(fp.CLASSES, fp.PERIOD)
    starts, step = [], 0
    for c in text:
        row = int(fp.mixed(np.array([ord(c)], np.uint64))[0] % np.uint64(fp.CLASSES))
        starts.append(step)
        while not goes_on[row, step % fp.PERIOD]:
            step += 1
        step += 1
    return starts, step


@pytest.mark.parametrize("side_by_side", [1, 5, 1000])
def test_walk(monkeypatch, side_by_side):
    monkeypatch.setattr(fp, "SIDE_BY_SIDE", side_by_side)
    rng = np.random.default_rng(side_by_side)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, n)) for n in (0, 1, 7, 300, 6000, 0, 45)] + ["äöü🙂" * 9, " " * 5000]
    for t, (starts, byte, places) in zip(texts, fp.walks(texts)):
        assert (starts.tolist(), places) == walk(t) and len(byte) == len(t)
    assert fp.walks([]) == [] and [str(p) for p in fp.prints(["", ""])] == ["0:0:", "0:0:"]


def test_places_are_nested_and_one_to_a_stretch():
    for level in range(6):
        at = fp.finer(level, 0)
        assert (at >> level == np.arange(len(at))).all()
        above = fp.finer(level + 1, 0)[:len(at) // 2]
        assert np.isin(above, at).all() and (at[fp.finer(level + 1, level)[:len(above)]] == above).all()


def changed(text, edits, rng):
    out = list(text)
    for at in rng.integers(0, len(text), edits):
        out[at] = ("", "x", out[at] + "y")[rng.integers(0, 3)]
    return "".join(out)


def prose(words, rng):
    return " ".join("".join(chr(97 + k) for k in (rng.random(rng.integers(2, 9)) ** 2 * 26).astype(int)) for _ in range(words))


def test_likeness():
    rng = np.random.default_rng(8)
    for words in (30, 300, 3000):
        base, other = prose(words, rng), prose(words, rng)
        a, near, far, half = fp.prints([base, changed(base, words // 100 + 1, rng), other, fp.edited(base, other)])
        assert a.likeness(a) == 1 and a.likeness(far) < 0.25 and 0.4 < a.likeness(half) < 0.75 and a.likeness(near) > 0.5
        assert a.likeness(near) == near.likeness(a) and fp.Print.parse(str(a)).likeness(far) == a.likeness(far)
    empty, long_one = fp.prints(["", prose(20_000, rng)])
    assert empty.likeness(empty) == 1 and empty.likeness(long_one) == 0 == long_one.likeness(empty)


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = set()
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        c = text[:len(text) - half] + after[:half]
        a, b, n = (fp.prints([t])[0] for t in (text, c, after))
        out.add((i, len(text), hashlib.sha256(c.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(n)))
    return out


ODD = [(5, None), (9, ""), (-3, "a"), (70, "ab" * 40), (71, "ab" * 40), (8, "日本語" * 30), (7, "x" * 30_000), (6, "\x00\n\t")]


def got(spark, df):
    out = fp.next_document(df)
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = out.collect()
    assert all(r["candidate_edited"] for r in rows if r["near_edited"] == 1)
    return [tuple(r)[:7] for r in rows]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[2:4], []])
def test_next_document_of_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("p"), "role": F.lit("first")}).repartition(3)
    found = got(spark, df)
    assert set(found) == brute(rows) and len(found) == len(rows)


def test_next_document_of_the_given_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7)
    found = got(spark, docs)
    assert set(found) == brute([(r["doc_id"], r["text"]) for r in docs.collect()]) and len(found) == docs.count()
    assert np.mean([r[5] > r[6] for r in found if r[1] > 1]) > 0.95


def test_repeated_rows_and_missing_ids_keep_a_row_each(spark):
    rows = [(1, "one"), (1, "one"), (2, "two"), (None, "none"), (1, "another one")]
    out = fp.next_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in out) == [(0, 4), (1, 3), (1, 3), (1, 11), (2, 3)]
    last = next(r for r in out if r["doc_id"] is None)
    assert last["edited_sha256"] == hashlib.sha256(b"notw").hexdigest()  # followed by the first: id 2


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(fp, "TILE", 3)  # many tiles to a band
    rng, rows = np.random.default_rng(2), [(900, None), (901, ""), (902, " "), (None, "")]
    for k in range(12):
        base = prose(200, rng)
        rows += [(10 * k, base), (10 * k + 1, base), (10 * k + 2, base + " end"), (10 * k + 3, base[:-40] + "z" * 30)]
    found = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in
             fp.near_copies(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, band int, rep int"), 0.8).collect()}
    made = {i: fp.prints([t or ""])[0] for i, t in rows if i is not None}
    ids = sorted(made)
    links = [(a, b) for a in ids for b in ids if a < b and made[a].likeness(made[b]) >= 0.8 and np.isin(made[a].bands(), made[b].bands()).any()]
    want = roots(ids, links)
    assert {i: c for i, (_, c) in found.items() if i is not None} == want
    assert {i: n for i, (n, _) in found.items() if i is not None} == {i: sum(i in e for e in links) for i in ids}
    assert all(want[10 * k + j] == 10 * k for k in range(12) for j in range(4)) and found[None] == (0, None)
