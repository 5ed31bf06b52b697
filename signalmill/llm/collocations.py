"""Phrase collocations by direct-address tiling of pair counts.

Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends,
and pieces into words. Everything is counted per language; a NULL language is
``und``.

Each task turns its documents into *chunks*: sequences of numbers, one per word,
with breaks between pieces. Words of at least ``least`` occurrences are ranked by
frequency and numbered by rank. Adjacent numbers are pairs; a pair lies in the
tile of ``TILE`` by ``TILE`` numbers around it. Numbers are frequency ranks, so
the head of the vocabulary fills few tiles densely: these are counted by
``bincount`` on the address inside the tile. All other tiles hold sorted
coordinates with counts. Tiles are added up over the cluster; tiles near the
head, which every task has, are first added up in several parts.

Frequent pairs are ranked in turn and numbered, the sequences are rewritten in
these numbers, and adjacent numbers are again pairs: of two phrases that overlap
in all but their ends. A phrase of ``m`` words is thus a pair of two phrases of
``m - 1``, and both of these are frequent when it is, so nothing is lost. Sizes
of all its beginnings and ends come down by two joins a level.

The numbers of a level are broadcast where there are at most ``broadcast_rows``
of them. Beyond that each chunk gets the numbers of its own words or pairs by a
join. Both ways give the same rows. A language may have up to 2^31 frequent
phrases of one length; beyond that the operator raises an error.

Empty and NULL texts have no words. Repeated rows count as often as they occur.
A long text is one chunk, whole. An empty table gives no rows. Of the input only
the two named columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from signalmill.llm.common import plain, text_of
from signalmill.session import materialise

TILE = 512
DENSE = TILE * TILE // 16  # occurrences from which a tile of a chunk is counted by address
CHUNK = 1 << 19  # words
HELD = 2_000_000  # coordinates a task holds before it hands them on
HEAD_PARTS = 64  # parts in which the tile of the most frequent numbers is added up
BROADCAST_ROWS = 1_000_000

_BREAK = b"\xff"  # a byte that UTF-8 never has
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if b in _MARKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from -1 on, lower halves before upper ones, which compresses well."""
    x = (numbers + 1).astype("<u4")
    return x.astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    half = np.frombuffer(raw, "<u2").astype(np.int64).reshape(2, -1)
    return half[0] + (half[1] << 16) - 1


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text, with ``_BREAK`` where a piece ends."""
    return raw.translate(_TABLE).replace(_BREAK, b" \xff ").split()


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Chunk:
    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers({_BREAK: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))  # a document ends
        self.size += len(words)

    def row(self) -> tuple[bytes, list[bytes], list[int]]:
        seq = np.concatenate(self.parts) - 1
        counts = np.bincount(seq[seq >= 0], minlength=len(self.numbers) - 1)
        return pack(seq), list(self.numbers)[1:], counts.tolist()


def _chunks(size: int):
    kind = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("seq", pa.binary()),
                      ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, _Chunk] = {}
        made = TaskContext.get().partitionId() << 32

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            seq, words, counts = opened.pop(lang).row()
            made += 1
            words = pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([made]), pa.array([seq], pa.binary()), words,
                                               pa.array([counts], pa.list_(pa.int64()))], schema=kind)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                words = words_of(text.as_py())
                if not words:
                    continue
                chunk = opened.setdefault(lang, _Chunk())
                chunk.add(words)
                if chunk.size >= size:
                    yield closed(lang)
                elif sum(c.size for c in opened.values()) >= 2 * size:  # many languages at once
                    yield closed(max(opened, key=lambda x: opened[x].size))
        for lang in list(opened):
            yield closed(lang)

    return run


def rewritten(seq: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The sequence in new numbers, by sorted keys; -1 for what has none, and one -1 in a row only."""
    if not len(keys):
        return np.full(1, -1, np.int64)
    at = np.minimum(np.searchsorted(keys, seq), len(keys) - 1)
    out = np.where(keys[at] == seq, numbers[at], -1)
    return out[np.concatenate([[True], (out[1:] >= 0) | (out[:-1] >= 0)])]


def pair_keys(seq: np.ndarray) -> np.ndarray:
    """Key of each adjacent pair; -1 where either side is a break."""
    return np.where((seq[:-1] >= 0) & (seq[1:] >= 0), (seq[:-1] << 31) | seq[1:], -1)


def _sequences(known, paired: bool):
    """Rows of chunks to rows of ``lang, chunk, seq`` in new numbers. ``known`` is a broadcast, or None where rows bring their own."""
    def table(row: dict) -> tuple[np.ndarray, np.ndarray]:
        if known is None:
            keys, numbers = (np.array(row[c] or [], np.int64) for c in ("keys", "numbers"))
        elif paired:
            return known.value.get(row["lang"], (np.empty(0, np.int64),) * 2)
        else:
            numbers = known.value.get(row["lang"], {})
            numbers = np.array([numbers.get(w, -1) for w in row["words"]], np.int64)
            keys = np.arange(len(numbers))
        order = np.argsort(keys)
        return keys[order], numbers[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in b.schema.names}
                seq = unpack(row["seq"])
                out = rewritten(pair_keys(seq) if paired else seq, *table(row))
                if (out >= 0).any():
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]], pa.string()), pa.array([row["chunk"]], pa.int64()),
                                                      pa.array([pack(out)], pa.binary())], ["lang", "chunk", "seq"])

    return run


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, chunk, raw in zip(*(b.column(n).to_pylist() for n in ("lang", "chunk", "seq"))):
            keys = np.unique(pair_keys(unpack(raw)))
            keys = keys[keys >= 0]
            for at in range(0, len(keys), 100_000):
                part = keys[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([chunk] * len(part), pa.int64()),
                                                  pa.array(part)], ["lang", "chunk", "key"])


def added(cells: list[np.ndarray], counts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct cells with summed counts: by address where they fill much of the tile, else by sorting."""
    if len(cells) == 1:
        return cells[0], counts[0]
    cell, count = np.concatenate(cells), np.concatenate(counts)
    if len(cell) * 4 >= size:
        total = np.zeros(size, np.int64)
        for c, n in zip(cells, counts):
            total[c] += n  # cells of one part are distinct
        cell = np.flatnonzero(total)
        return cell, total[cell]
    order = np.argsort(cell, kind="stable")
    cell, count = cell[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first], np.add.reduceat(count, first)


class Tiles:
    """Pair counts of one language in one task: dense tiles by address, the others as sorted coordinates."""

    def __init__(self):
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.loose: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, seq: np.ndarray) -> None:
        whole = (seq[:-1] >= 0) & (seq[1:] >= 0)
        left, right = seq[:-1][whole], seq[1:][whole]
        if not len(left):
            return
        # Tiles of the first few hundred thousand numbers can be dense; the search for them is a bincount too.
        row, column = left // TILE, right // TILE
        side = min(int(max(row.max(), column.max())) + 1, 512)
        near = (row < side) & (column < side)
        filled = np.bincount(row[near] * side + column[near], minlength=side * side)
        loose = np.ones(len(left), bool)
        for tile in np.flatnonzero(filled >= DENSE).tolist():
            key = divmod(tile, side)
            here = (row == key[0]) & (column == key[1])
            loose &= ~here
            found = np.bincount(left[here] % TILE * TILE + right[here] % TILE, minlength=TILE * TILE)
            if key in self.dense:
                self.dense[key] += found
            else:
                self.dense[key] = found
                self.held += TILE * TILE
        keys, counts = np.unique((left[loose] << 31) | right[loose], return_counts=True)
        if len(keys):
            self.loose.append((keys, counts))
            self.held += len(keys)

    def combine(self) -> None:
        """Adds up coordinates that came in several times."""
        if len(self.loose) > 1:
            self.held -= sum(len(k) for k, _ in self.loose)
            self.loose = [added([k for k, _ in self.loose], [n for _, n in self.loose], 1 << 62)]
            self.held += len(self.loose[0][0])

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Each tile's ``row, column, cells, counts``; a tile may come twice, dense and loose."""
        self.combine()
        for (row, column), total in self.dense.items():
            cell = np.flatnonzero(total)
            yield row, column, cell, total[cell]
        for keys, counts in self.loose:
            left, right = keys >> 31, keys & ((1 << 31) - 1)
            place = (((left // TILE) << 22 | right // TILE) << 18) + left % TILE * TILE + right % TILE  # numbers are below 2^31
            del left, right
            order = np.argsort(place)
            place, counts = place[order], counts[order]
            tile = place >> 18
            edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])).tolist()
            for at, end in zip(edges, [*edges[1:], len(place)]):
                yield *divmod(int(tile[at]), 1 << 22), place[at:end] & ((1 << 18) - 1), counts[at:end]


_TILE_ROW = "lang string, row bigint, col bigint, part int, parts int, cells binary, counts binary"


def parts_of(row: int, column: int) -> int:
    """In how many parts a tile is added up first: many at the head, one where ranks are high."""
    return max(1, HEAD_PARTS >> ((row + 1).bit_length() + (column + 1).bit_length() - 2))


def _tile_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _TILE_ROW.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    held, size = [], 0
    for lang, row, column, part, parts, cells, counts in rows:
        held.append((lang, row, column, part, parts, cells.astype("<i4").tobytes(), counts.astype("<i8" if counts.max() >= 1 << 31 else "<i4").tobytes()))
        size += len(held[-1][5]) + len(held[-1][6])
        if size > 8_000_000 or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of a task's chunks."""
    task = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        open_: dict[str, Tiles] = {}

        def out(lang: str) -> Iterator[tuple]:
            for row, column, cells, counts in open_.pop(lang).rows():
                parts = parts_of(row, column)
                yield lang, row, column, task % parts, parts, cells, counts

        for b in batches:
            for lang, raw in zip(b.column("lang").to_pylist(), b.column("seq")):
                open_.setdefault(lang, Tiles()).add(unpack(raw.as_py()))
                if sum(t.held for t in open_.values()) > HELD:
                    for t in open_.values():
                        t.combine()
                    if sum(t.held for t in open_.values()) > HELD // 2:
                        for k in list(open_):
                            yield from out(k)
        for k in list(open_):
            yield from out(k)

    return _tile_batches(rows())


def _read_tile(cells: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    cell = np.frombuffer(cells, "<i4")
    return cell.astype(np.int64), np.frombuffer(counts, "<i8" if len(counts) == 2 * len(cells) else "<i4").astype(np.int64)


def _added(least: int, last: bool):
    """Adds up tiles, which come sorted. Tiles that are whole leave only their frequent cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(n).to_pylist() for n in ("lang", "row", "col", "part", "parts", "cells", "counts")))

        def rows() -> Iterator[tuple]:
            for key, group in groupby(stream(), key=lambda r: r[:3] if last else r[:4]):
                cells, counts, n = [], [], 0
                for r in group:
                    c, m = _read_tile(*r[5:])
                    cells.append(c)
                    counts.append(m)
                    n += len(c)
                    if n > 4 * TILE * TILE:
                        c, m = added(cells, counts, TILE * TILE)
                        cells, counts, n = [c], [m], len(c)
                cell, count = added(cells, counts, TILE * TILE)
                if last or r[4] == 1:
                    kept = count >= least
                    cell, count = cell[kept], count[kept]
                if len(cell):
                    yield *key[:3], 0, r[4], cell, count

        return _tile_batches(rows())

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, row, column, cells, counts in zip(*(b.column(n).to_pylist() for n in ("lang", "row", "col", "cells", "counts"))):
            cell, count = _read_tile(cells, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(row * TILE + cell // TILE),
                                              pa.array(column * TILE + cell % TILE), pa.array(count)], ["lang", "left", "right", "f"])


def pair_counts(sequences: DataFrame, least: int) -> DataFrame:
    """``lang, left, right, f`` of the adjacent pairs that occur at least ``least`` times."""
    tiles = sequences.select("lang", "seq").mapInArrow(_counted, _TILE_ROW)
    part = ["lang", "row", "col", "part"]
    tiles = tiles.repartition(*part).sortWithinPartitions(*part).mapInArrow(_added(least, False), _TILE_ROW)
    whole = ["lang", "row", "col"]
    tiles = tiles.repartition(*whole).sortWithinPartitions(*whole).mapInArrow(_added(least, True), _TILE_ROW)
    return tiles.mapInArrow(_pairs, "lang string, left bigint, right bigint, f bigint")


def numbered(df: DataFrame, *ties: str) -> tuple[DataFrame, int]:
    """Rows with ``number``: the rank by frequency in their language, from 0; and the number of rows.

    A sort by range over the cluster; what goes to the driver is one row per partition and language in it.
    """
    df, seen = materialise(df, "phrases", n=F.count(F.lit(1)))
    order = [F.col("lang"), F.col("f").desc(), *ties]
    kept, _ = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "phrases")
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    before: dict[str, int] = {}
    shifts = []
    for lang, part, n, low in sorted(kept.groupBy("lang", "_part").agg(F.count(F.lit(1)), F.min("_at")).collect()):
        shifts.append((lang, part, before.get(lang, 0) - low))
        before[lang] = before.get(lang, 0) + n
    if max(before.values(), default=0) >= 1 << 31:
        raise ValueError("more than 2^31 frequent phrases of one length in a language")
    shift = df.sparkSession.createDataFrame(shifts, "lang string, _part bigint, _shift bigint")
    rows = kept.join(shift, ["lang", "_part"]).withColumn("number", F.col("_at") + F.col("_shift"))
    return rows.drop("_at", "_part", "_shift"), seen["n"]


def _renumbered(chunks: DataFrame, level: DataFrame, size: int, paired: bool, broadcast_rows: int) -> DataFrame:
    """Chunks in the numbers of a level (words, or pairs of the numbers they are in)."""
    kind = "lang string, chunk bigint, seq binary"
    if size <= broadcast_rows:
        known: dict = {}
        if paired:
            got = level.select("lang", F.shiftleft("left", 31).bitwiseOR(F.col("right")).alias("key"), "number").toPandas()
            for lang, rows in got.groupby("lang"):
                rows = rows.sort_values("key")
                known[lang] = rows["key"].to_numpy(np.int64), rows["number"].to_numpy(np.int64)
        else:
            for lang, word, number in level.select("lang", "word", "number").toLocalIterator():
                known.setdefault(lang, {})[word] = number
        shared = chunks.sparkSession.sparkContext.broadcast(known)
        columns = ["lang", "chunk", "seq"] + ["words"] * (not paired)
        return chunks.select(*columns).mapInArrow(_sequences(shared, paired), kind)
    if paired:
        mine = chunks.select("lang", "chunk", "seq").mapInArrow(_distinct_pairs, "lang string, chunk bigint, key bigint")
        numbers = level.select("lang", F.shiftleft("left", 31).bitwiseOR(F.col("right")).alias("key"), "number")
        matched = mine.join(numbers, ["lang", "key"])
    else:
        mine = chunks.select("lang", "chunk", F.posexplode("words").alias("key", "word"))
        matched = mine.join(level.select("lang", "word", "number"), ["lang", "word"])
    matched = matched.groupBy("chunk").agg(F.collect_list(F.struct(F.col("key").cast("bigint").alias("key"), "number")).alias("m"))
    rows = chunks.select("lang", "chunk", "seq").join(matched, "chunk").select(
        "lang", "chunk", "seq", F.col("m.key").alias("keys"), F.col("m.number").alias("numbers"))
    return rows.mapInArrow(_sequences(None, paired), kind)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text",
            broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times, and ``lang, n`` with all words counted.

    Phrases are rows of ``lang, length, words, f, starts, ends, inside``: ``starts[k - 1]`` is the frequency of the first ``k``
    words, ``ends[k - 1]`` that of the last ``k``, ``inside`` the highest frequency of a phrase of one word more around it.
    """
    lang = F.coalesce(plain(lang_col).cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, text_of(plain(text_col)).cast("binary").alias("text"))
    chunks, _ = materialise(texts.mapInArrow(_chunks(CHUNK), "lang string, chunk bigint, seq binary, words array<string>, counts array<bigint>"),
                            "phrases")
    said = chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).withColumnsRenamed({"words": "word", "counts": "f"})
    totals = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = said.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    ranked, size = numbered(words, "word")
    none = F.array().cast("array<bigint>")
    level, _ = materialise(ranked.select("lang", "word", "number", "f", F.array("word").alias("words"), none.alias("starts"), none.alias("ends")), "phrases")
    sequences, paired, levels = chunks, False, []
    for length in range(1, longest + 1):
        levels.append(level)
        if length == longest or not size:
            break
        sequences, _ = materialise(_renumbered(sequences, level, size, paired, broadcast_rows), "phrases")
        ranked, size = numbered(pair_counts(sequences, least), "left", "right")
        paired = True

        def side(name: str) -> DataFrame:
            return level.select("lang", F.col("number").alias(name), F.struct("words", "f", "starts", "ends").alias("_" + name))

        grown = ranked.join(side("left"), ["lang", "left"]).join(side("right"), ["lang", "right"])
        level, _ = materialise(grown.select(
            "lang", "left", "right", "number", "f",
            F.concat("_left.words", F.array(F.element_at("_right.words", -1))).alias("words"),
            F.concat("_left.starts", F.array("_left.f")).alias("starts"),
            F.concat("_right.ends", F.array("_right.f")).alias("ends")), "phrases")
    out = []
    for k, one in enumerate(levels):
        one = one.select("lang", F.lit(k + 1).alias("length"), "number", "words", "f", "starts", "ends")
        if k + 1 < len(levels):
            above = levels[k + 1]
            around = above.select("lang", F.col("left").alias("number"), F.col("f").alias("inside")).unionByName(
                above.select("lang", F.col("right").alias("number"), F.col("f").alias("inside")))
            one = one.join(around.groupBy("lang", "number").agg(F.max("inside").alias("inside")), ["lang", "number"], "left")
        else:
            one = one.withColumn("inside", F.lit(None).cast("bigint"))
        out.append(one.drop("number"))
    return reduce(DataFrame.unionByName, out), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, lang_col: str = "lang",
                 text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``. Other columns are not kept.

    A phrase goes when a longer one around it has at least ``share`` percent of its occurrences. The phrases of one more word
    suffice for that test: frequencies only fall as phrases grow.
    """
    found, totals = phrases(docs, least, longest, lang_col, text_col, broadcast_rows)
    kept = found.where((F.col("length") > 1) & (F.coalesce("inside", F.lit(0)) * 100 < F.col("f") * share)).join(totals, "lang")
    # Products of two counts may pass 64 bits; of decimals without a fraction they are exact.
    cut = F.expr("""array_min(transform(sequence(1, length - 1), k -> named_struct(
        'score', (cast(1000 as decimal(20,0)) * cast(f as decimal(20,0)) * cast(n as decimal(20,0)))
                 div (cast(element_at(starts, k) as decimal(20,0)) * cast(element_at(ends, length - k) as decimal(20,0))),
        'cut', k, 'l', element_at(starts, k), 'r', element_at(ends, length - k))))""")
    best = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", cut.alias("_best"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (best.select("lang", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), "n", F.col("_best.score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
