"""License scans by ordered signature rules, in DataFrame expressions only.

Rules are regular expressions over the words of a text (lower case, one space
between words), built from the families and phrasings below. Each rule has a
keyword: only rules whose keyword occurs are matched, and only texts that hold a
keyword of all are normalised at all. Detections are intervals of words. Of
overlapping ones, a detection falls when another with the same or a higher
priority contains it (same interval: the earlier rule stays).

The base phrases are counted apart and their labels always stay. All columns come
from one projection of the row: no shuffle, whatever the sizes. NULL texts count
as empty, repeated rows are scanned row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import count_words, plain, text_of

#: Words after lower-casing A-Z, and the same over the raw text.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# License families as (label, keyword, name in words, versions).
FAMILIES = (
    ("mit", "mit", "mit", ()),
    ("mit", "expat", "expat", ()),
    ("apache", "apache", "apache", ("1.0", "1.1", "2.0", "2")),
    ("gpl", "general public", "(?:gnu )?general public", ("1", "2", "3")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2.1", "3")),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", ("2.1", "3")),
    ("lgpl", "library general", "(?:gnu )?library general public", ("2",)),
    ("agpl", "affero", "(?:gnu )?affero general public", ("1", "3")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("3",)),
    ("fdl", "free documentation", "(?:gnu )?free documentation", ("1.1", "1.2", "1.3")),
    ("bsd-2-clause", "bsd", "(?:2 clause|two clause|simplified) bsd|bsd (?:2 clause|two clause)", ()),
    ("bsd-3-clause", "bsd", "(?:3 clause|three clause|new|modified|revised) bsd|bsd (?:3 clause|three clause)", ()),
    ("bsd-4-clause", "bsd", "(?:4 clause|four clause|original) bsd|bsd (?:4 clause|four clause)", ()),
    ("bsd", "bsd", "bsd|bsd style", ()),
    ("0bsd", "0bsd", "0bsd", ()),
    ("0bsd", "zero clause bsd", "zero clause bsd", ()),
    ("isc", "isc", "isc", ()),
    ("mpl", "mozilla", "mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", "eclipse public", ("1.0", "2.0")),
    ("cddl", "common development", "common development and distribution", ("1.0", "1.1")),
    ("cpl", "common public", "common public", ("1.0",)),
    ("eupl", "european union", "european union public", ("1.1", "1.2")),
    ("artistic", "artistic", "(?:perl )?artistic", ("1.0", "2.0")),
    ("bsl", "boost", "boost(?: software)?", ("1.0",)),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("zlib", "zlib", "zlib|zlib libpng", ()),
    ("psf", "python software", "python software foundation", ("2",)),
    ("ofl", "open font", "(?:sil )?open font", ("1.0", "1.1")),
    ("odbl", "open database", "open database|open database commons", ("1.0",)),
    ("odbl", "open data base", "open data base", ("1.0",)),
    ("odc-by", "open data commons", "open data commons attribution", ("1.0",)),
    ("ms-pl", "microsoft public", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", ()),
    ("upl", "universal permissive", "universal permissive", ("1.0",)),
    ("osl", "open software", "open software", ("2.1", "3.0")),
    ("afl", "academic free", "academic free", ("2.1", "3.0")),
    ("ecl", "educational community", "educational community", ("2.0",)),
    ("cecill", "cecill", "cecill", ("2.1",)),
    ("openrail", "openrail", "(?:bigscience )?openrail(?: m)?", ()),
    ("bsl-business", "business source", "business source", ("1.1",)),
    ("sspl", "server side public", "server side public", ("1",)),
    ("elastic", "elastic", "elastic", ("2.0",)),
    ("ruby", "ruby", "ruby", ()),
    ("php", "php", "php", ("3.01",)),
    ("vim", "vim", "vim", ()),
)
CC_PARTS = (("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
            ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
            ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
            ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by", "by", "attribution"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Notices that name no license, as (label, keyword, words).
NOTICES = (("all-rights-reserved", "rights reserved", "all rights reserved"),
           ("public-domain", "public domain", "(?:in|into|to) the public domain"),
           ("cc0", "cc0", "cc0(?: 1 0)?"), ("cc0", "creative commons zero", "creative commons zero"),
           ("copyright", "copyright", "copyright (?:c )?[12][0-9]{3}"),
           ("proprietary", "proprietary", "proprietary and confidential"),
           ("proprietary", "redistribution", "redistribution (?:\\S+ )?(?:is )?(?:strictly )?prohibited"),
           ("bsd", "redistribution", "redistribution and use in source and binary forms"),
           ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
           ("isc", "permission to use", "permission to use copy modify and or distribute this software"))
GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|issued) under (?:the )?(?:terms of (?:the )?)?"


def rules() -> list[tuple[str, int, float, str, str]]:
    """``(label, priority, score, keyword, expression)`` in order, hundreds of them: grants before names before notices."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        named = f"(?:{name})(?: software)?(?: public)? licen[cs]e"
        for v in versions:
            words, short = v.replace(".", " "), v.removesuffix(".0")
            tail = f"(?: licen[cs]e)?(?: version| v| ver)? ?v?{words}(?: only| or later| or any later version)?"
            out.append((f"{label}-{short}", 4, 1.0, keyword, f"{GRANT}(?:{name}){tail}"))
            out.append((f"{label}-{short}", 3, 0.9, keyword, f"(?:{name}) licen[cs]e(?: version| v| ver)? ?v?{words}"))
            out.append((f"{label}-{short}", 3, 0.9, "spdx", f"spdx license identifier {label.replace('-', ' ')} {words}(?: only| or later)?"))
        out.append((label, 3, 0.9, keyword, f"{GRANT}{named}"))
        out.append((label, 2, 0.8, "spdx", f"spdx license identifier {label.replace('-', ' ')}"))
        out.append((label, 1, 0.6, keyword, named))
    for label, short, long in CC_PARTS:
        for v in CC_VERSIONS:
            words = v.replace(".", " ")
            out.append((f"{label}-{v}", 4, 1.0, "cc", f"cc {short} {words}"))
            out.append((f"{label}-{v}", 4, 1.0, "creative commons", f"creative commons {long}(?: {words}| (?:international |unported )?(?:public )?licen[cs]e {words})"))
        out.append((label, 3, 0.9, "cc", f"cc {short}"))
        out.append((label, 3, 0.9, "creative commons", f"creative commons {long}(?: licen[cs]e)?"))
    for label, keyword, words in NOTICES:
        out.append((label, 0, 0.5, keyword, words))
    return out


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _matches(norm: Column, expression: Column) -> tuple[Column, Column]:
    """Matched stretches, and the pieces between them."""
    bounded = F.concat(F.lit("(?<= )(?:"), expression, F.lit(")(?= )"))
    return F.regexp_extract_all(norm, bounded, F.lit(0)), F.split(norm, bounded, -1)


def _intervals(norm: Column, rule: Column) -> Column:
    """Intervals of words, last word included, of all matches of one rule."""
    hits, pieces = _matches(norm, rule["expression"])
    zero = F.struct(F.lit(-1).cast("bigint").alias("at"), F.array().cast("array<struct<a: bigint, b: bigint>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + _spaces(pair["piece"])
        end = start + _spaces(pair["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(start.alias("a"), end.alias("b"))).alias("found"))

    pairs = F.zip_with(hits, F.slice(pieces, F.lit(1), F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p.alias("piece")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


def _surviving(found: Column, levels: int) -> Column:
    """Labels and best score of detections that no other of the same or a higher priority contains.

    In order of start, longest first, a containing interval comes before; one
    running largest end per priority is all that has to be remembered.
    """
    zero = F.struct(*[F.lit(-1).cast("bigint").alias(f"m{k}") for k in range(levels)],
                    F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        reach = F.lit(-1).cast("bigint")
        for k in range(levels):
            reach = F.greatest(reach, F.when(d["priority"] <= k, acc[f"m{k}"]).otherwise(-1))
        stays = reach < d["b"]
        return F.struct(
            *[F.when(d["priority"] == k, F.greatest(acc[f"m{k}"], d["b"])).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in range(levels)],
            F.when(stays & ~F.array_contains(acc["labels"], d["label"]), F.array_append(acc["labels"], d["label"]))
            .otherwise(acc["labels"]).alias("labels"),
            F.when(stays, F.greatest(acc["score"], d["score"])).otherwise(acc["score"]).alias("score"))

    return F.aggregate(found, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def detections(norm: Column) -> Column:
    """All matches of all rules in a normalised text, sorted by start, longest, highest priority, rule order."""
    known: dict[str, list[Column]] = {}
    for i, (label, p, s, k, e) in enumerate(rules()):
        known.setdefault(k, []).append(F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"),
                                                F.lit(s).alias("score"), F.lit(e).alias("expression")))
    table = F.array(*[F.struct(F.lit(f" {k}").alias("keyword"), F.array(*own).alias("rules")) for k, own in known.items()])
    gated = F.flatten(F.transform(F.filter(table, lambda k: F.contains(norm, k["keyword"])), lambda k: k["rules"]))
    found = F.flatten(F.transform(gated, lambda r: F.transform(_intervals(norm, r), lambda x: F.struct(
        x["a"].alias("a"), (-x["b"]).alias("back"), (-r["priority"]).alias("low"), r["rule"].alias("rule"), x["b"].alias("b"),
        r["priority"].alias("priority"), r["label"].alias("label"), r["score"].alias("score")))))
    return F.array_sort(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    rows = docs.select(plain(id_col).cast("bigint").alias("doc_id"), text_of(plain(text_col)).alias("text"))
    words = F.trim(F.regexp_replace(F.translate("text", _UPPER, _LOWER), _BETWEEN, " "))
    rows = rows.select("doc_id", count_words(F.col("text"), _RAW_BETWEEN).alias("n_words"), F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))
    rows = rows.withColumn("d", _surviving(detections(F.col("norm")), 5))
    n, labels, firsts, lasts = F.lit(0).cast("bigint"), [], [], []
    for phrase, label in BASE:
        hits, pieces = _matches(F.col("norm"), F.lit(phrase))
        some = F.contains("norm", F.lit(phrase)) & (F.size(hits) > 0)
        n = n + F.when(some, F.size(hits).cast("bigint")).otherwise(0)
        labels.append(F.when(some, F.lit(label)))
        firsts.append(F.when(some, _spaces(pieces[0]) - 1))
        tail = _spaces(F.element_at(pieces, -1)) + _spaces(F.element_at(hits, -1))
        lasts.append(F.when(some, _spaces(F.col("norm")) - tail - 1))
    rows = rows.select("doc_id", "n_words", "d", n.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
                       F.array_sort(F.array_compact(F.array(*labels))).alias("base"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.col("d.labels"), F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("d.score"), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                       F.array_join(every, ",").alias("labels"), score.alias("score"))
