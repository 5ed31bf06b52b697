"""Operators on single texts against brute force, on messy rows and on the small tables."""

import hashlib
import html as html_lib
import re
from collections import Counter

import public_tokenizers
import pytest
from conftest import SMALL

from signalmill.llm import chat, html, langid, licenses, packing, quality, queries, tokens

ODD = ["", " ", "a", "A  b\tC\n\n", "né́ ßx 你好 🙂", "<s> x </s> <|endoftext|>", "the cat sat on the mat " * 30, "w" * 3000, "\x00\x1c\x85　",
       "İ! don't I'M", "Under the MIT License. CC-BY NC; apache license, version 2.0", "one\ntwo\none\n \n", "▁x ▁ y  z", "#$%&*|<>"]


def messy(spark):
    rows = [(i, t, "en", 5) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", 5), (None, "no id", None, None), (50, None, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, size int")


def docs(spark):
    return [messy(spark), messy(spark).limit(0), spark.read.parquet(f"{SMALL}/documents.parquet")]


def by_row(df, *key):
    return Counter(tuple(r[k] for k in (key or df.columns)) for r in df.collect())


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path(queries.PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for d in docs(spark):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or "")), len(model.encode(r["text"] or "")) > 40)
                       for r in d.collect())
        assert by_row(tokens.count_tokens(d, path, limit=40), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    counter = tokens.counter(path)
    for t in ODD:
        for limit in (0, 1, 3, 10):
            cut = counter.prefix(t, limit)
            assert len(model.encode(t[:cut])) <= limit
            assert all(len(model.encode(t[:k])) > limit for k in range(cut + 1, min(len(t), cut + 60) + 1))


def test_packing(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORDS)
    tokenizer = Tokenizer.from_file(path)
    for d in docs(spark):
        want = Counter()
        for r in d.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            for k, at in enumerate(range(0, len(ids), 256)):
                part = ids[at:at + 256]
                want[(r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        got = packing.pack(d, path, capacity=256).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        windows = {}
        for r in got:
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 256
        total = sum(r["length"] for r in got)
        assert len(windows) <= -(-total // 256) * 1.1 + 1


def test_word_tokens():
    import random

    import numpy as np

    from signalmill.llm.wordbpe import LONGEST, word_tokens

    words = word_tokens(public_tokenizers.path(queries.WORDS))
    rng = random.Random(1)
    alphabet = ([*"abcdefghijklmnopqrstuvwxyz"] * 2 + [*"ABCXYZ0123456789'''''!?.,-#  \t\n\x0b\x85\xa0\x1c\x00éüßñÀÉİıſ…–—’“²½Жжά́ʼª​\xad"]
                + ["'s", "'ll", "'re", "'ve", "'d", "'t", "'m", "''s", "the", "ing"])
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(5000)]
    other = ["Σσς", "日本", "😀 a", "٠1 ก", "a<|endoftext|>b", "ab" * LONGEST]  # these go to the library whole
    assert all(words._marked_pieces(t) is None for t in other)
    assert sum(words._marked_pieces(t) is not None for t in texts) > 4900
    for t in [*texts, *other, "", " ", "it's 'tis don't o'clock 'S \"'s", "́a", *(t for t in ODD if t)]:
        assert words.ids(t) == np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_plan_is_best_fit():
    sizes = [9, 8, 7, 6, 5, 5, 4, 3, 2, 2, 1, 1, 1]
    plan = packing.plan_rounds(Counter(sizes), 10)
    assert sum(p[2] for p in plan) == len(sizes)
    assert max(p[3] + -(-p[2] // p[4]) for p in plan) == -(-sum(sizes) // 10)


def brute_quality(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    n = len(words)
    windows = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    again = {k for i in range(n - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    best = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    covered = {k for i in range(n) if best[i] >= 8 for k in range(i, i + best[i])}
    longest = max([b for b in best if b >= 8], default=0)
    failed = n < 20 or 100 * len(again) > 30 * n
    kept = not failed and len(covered) <= 0.3 * n and (longest <= 50 or longest <= 0.2 * n)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed, kept)


def test_quality(spark):
    small = docs(spark)[2].where("length(text) < 2500")
    for d in [*docs(spark)[:2], small]:
        want = Counter((r["doc_id"], *brute_quality(r["text"] or "")) for r in d.collect())
        got = by_row(quality.judge(d), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        assert got == want
        kept = Counter(r["doc_id"] for r in quality.keep_good(d).collect())
        assert kept == Counter(k[0] for k in want.elements() if k[-1]) and quality.keep_good(d).columns == d.columns


def test_quality_order_of_repeats():
    # Repeats of different lengths that overlap: the neighbours in the suffix order must be the closest ones.
    a = [str(i) for i in range(40)]
    text = " ".join(a[:20] + ["x"] + a[3:14] + ["y"] + a[:17] + ["z"] + a[8:30])
    row = quality.measure([text, text], 8)
    assert row[0] == row[1]
    assert (row[0]["n_repeat_words"], row[0]["longest_repeat"]) == (brute_quality(text)[4], 17)


def test_language(spark):
    d = docs(spark)[2]
    net = langid.train(d)
    got = {r["doc_id"]: r for r in langid.identify(d, net).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.collect() if r["lang"]}
    held = [k for k in truth if got[k]["held_out"]]
    assert sum(got[k]["lang_pred"] == truth[k] for k in held) >= 0.9 * len(held)
    odd = langid.identify(messy(spark), net).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd if r["doc_id"] in (0, 1, 13, 50))
    assert len(odd) == len(ODD) + 3
    assert {r["lang_pred"] for r in langid.identify(messy(spark).withColumnRenamed("n_words", "lang").limit(0)).collect()} == set()
    # The same sample trains the same network.
    again = {r["doc_id"]: r["score"] for r in langid.identify(d).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-6 for k in again)


def test_license_base(spark):
    def brute(text):
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        at, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i:i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    for d in docs(spark):
        got = licenses.scan(d)
        want = Counter((r["doc_id"], *brute(r["text"] or "")) for r in d.collect())
        assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
        assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
    ("Released under the MIT License.", "mit"),
    ("This is under the GNU General Public License version 3; all rights reserved", "all-rights-reserved,gpl-3"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("the mit of license", ""),
])
def test_license_rules(spark, text, labels):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels
    assert len(licenses.rules()) > 200


def example_matches(expression):
    """Texts that a rule's expression matches: each way through its alternatives, optional parts out and in."""
    from re import _constants as c, _parser

    def ways(parsed):
        out = [""]
        for op, arg in parsed:
            if op is c.LITERAL:
                own = [chr(arg)]
            elif op is c.IN:
                first = next(((o, a) for o, a in arg if o is not c.NEGATE))
                own = [chr(first[1] if first[0] is c.LITERAL else first[1][0])] if first[0] is not c.CATEGORY else ["x"]
            elif op is c.MAX_REPEAT:
                own = ([""] if arg[0] == 0 else []) + [w * max(arg[0], 1) for w in ways(arg[2])]
            elif op is c.SUBPATTERN:
                own = ways(arg[-1])
            else:
                assert op is c.BRANCH, op
                own = [w for branch in arg[1] for w in ways(branch)]
            out = [a + b for a in out for b in own]
        return out

    return ways(_parser.parse(expression))


def test_every_license_match_holds_its_keyword():
    for label, _, _, keyword, expression in licenses.rules():
        tail = expression.removeprefix(licenses.GRANT)  # the grant holds no keyword
        for text in example_matches(tail):
            assert re.fullmatch(tail, text) and f" {keyword}" in f" {text} ", (label, keyword, text)


@pytest.mark.parametrize("text, labels", [
    ("Released under the GNU GPL version 3", "gpl-3"), ("distributed under the GPL v2 or later", "gpl-2"), ("available under Apache 2.0", "apache-2"),
    ("put into the public\ndomain", "public-domain"), ("in the public-domain", "public-domain"), ("under the Expat licence", "mit"),
    ("the Zero-Clause BSD License", "0bsd"), ("Open Data Base License 1.0", "odbl-1"), ("a permit to discuss access, commit it", "")])
def test_license_notices_without_gate_words(spark, text, labels):
    around = "An account of the access to other works. " * 5
    rows = [r["labels"] for r in licenses.scan(spark.createDataFrame([(1, text), (2, around + text)], "doc_id long, text string")).collect()]
    assert rows == [labels, labels]


def test_html_pages(spark):
    def truth(page):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (html_lib.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split() for b in re.split("</?(?:p|h1)>", article))
        return " ".join(" ".join(b) for b in blocks if b)

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    for r in html.extract_pages(pages).collect():
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (2, "u", "<p", "x"), (None, "u", "<div>a&amp;b<script>no</script>", "x")],
                                "page_id long, url string, html string, text string")
    assert by_row(html.extract_pages(odd)) == Counter([(1, None, "", 0), (1, "u", "", 0), (2, "u", "", 0), (None, "u", "a&b", 3)])
    assert html.extract_pages(odd.limit(0)).count() == 0


def test_html_blocks_without_marks():
    long = " ".join(["the words of this long paragraph are in the main text and it is fine"] * 4)
    page = (f"<body><header><h1>Site</h1></header><div class='menu'><a href=x>One</a></div><div><p>{long}<p>Short one.<p>{long}</div>"
            f"<div id=comments><p>{long}</p></div><div><a href=1>link text</a></div><p>&copy; 2020 a b c</body>")
    assert html.main_text(page) == f"{long} Short one. {long}"
    assert html.second_pass([1, 0, 0, -1, 0]) == [1, 1, -1, -1, -1]
    assert html.main_text("<article><p>a&nbsp; b<br>c <script>x</script>d<div class=ad>no</div></article>") == "a b c d"


@pytest.mark.parametrize("long, short", [
    ("Это длинный абзац статьи, в котором нет слов из списка; он рассказывает о погоде, море и людях. " * 2, "Коротко."),
    ("Questo articolo racconta storie di mare e di persone che vivono sulla costa, tra barche e mercati. " * 2, "Breve."),
    ("這是一篇關於天氣、海洋和人們的長文章，其中沒有列表中的任何單詞。" * 6, "短句。"),
    ("Ten długi akapit opowiada o pogodzie, morzu i ludziach, którzy mieszkają nad brzegiem. " * 2, "Krótko.")])
def test_html_without_marks_in_other_languages(long, short):
    long = long.strip()
    page = (f"<body><div class=menu><a href=x>One</a></div><div><a href=1>{short} {short}</a></div><h1>{short}</h1><p>{long}<p>{short}<p>{long}"
            f"<div id=comments><p>{long}</p></div><div><a href=1>{long}</a></div><p>&copy; 2020 a b c"
            "<p>This is a note on the use of cookies and it is for you to read.</body>")
    kept = html.main_text(page)
    assert kept.startswith(long) or kept.startswith(f"{short} {long}")
    assert kept.count(long) == 2 and "2020" not in kept


def test_html_tables_and_code_between_paragraphs():
    long = " ".join(["the words of this long paragraph are in the main text and it is fine"] * 4)
    code = "def total(values): return sum(value * weight for value, weight in zip(values, weights)) or None"
    page = f"<body><p>{long}<pre>{code}</pre><table><tr><td>{code}</table><p>{long}<div class=menu>{code}</div></body>"
    assert html.main_text(page) == f"{long} {code} {code} {long}"


def digests(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nhi", "\\<\\|im_end|>", None, "", "x " * 4000]
    rows = [(1, k, ("system" if k == 0 else ("user", "assistant")[k % 2]), t) for k, t in enumerate(odd * 4)]
    rows += [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, None, "n"), (3, None, "us\ner", "q")]
    small = spark.read.parquet(f"{SMALL}/conversations.parquet")
    path = public_tokenizers.path(queries.RANKS)
    messy_rows = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    for d in (messy_rows, messy_rows.limit(0), small):
        formatted = chat.format_conversations(d, path, public_tokenizers.PATTERN, budget=200)
        got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
        own = {}
        for r in d.collect():
            own.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
        assert set(got) == set(own)
        for conv, turns in own.items():
            turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
            r = got[conv]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests([t[1:] for t in turns])
        for w in formatted.collect():
            assert w["over_budget"] == (w["n_tokens"] > 200) and (not w["over_budget"] or w["n_turns"] - w["n_repeated"] == 1)
