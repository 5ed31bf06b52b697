"""Document fingerprints by randomised edit embedding.

A text is walked over with shared random bits: at step ``s`` the walk writes the
character it stands on and goes on to the next one if the bit of that step and
character is 1. Texts a few edits apart fall into step again after each edit, so
edit distance becomes Hamming distance of what is written. How long the walk
stays on a character is one look-up (``_STAYS``), so a text of n characters takes
n steps; many texts are walked side by side in numpy.

Of the about 2n places written, a fingerprint keeps a sample: one place of each
stretch of ``2^level``, with the level such that ``SAMPLES`` to ``2 * SAMPLES``
are kept. The places of a level are among those of the level below, so texts of
unlike length can be compared, at the higher level. A sample is one byte, a hash
of the character. ``likeness`` is the share of agreeing samples; places that
only the longer text has do not agree.

For finding near copies, samples are dealt into ``BANDS`` bands. Texts that agree
on all samples of a band, at their own level or the one above, are candidates;
candidates are verified by their likeness. Band groups are compared in tiles of
``TILE`` by ``TILE`` different fingerprints, on many tasks; a tile gives each
fingerprint its number of links and the smallest one it is connected to, never
the pairs, and a pair counts in its first common band.

NULL texts are empty. Empty texts are alike among themselves (1) and unlike all
others (0). Long texts are walked whole. In ``next_document`` order rows with one
id come in order of a hash of their text, rows without an id last; repeated rows
keep a row each. A table of one row is followed by itself, an empty one gives no
rows. Only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from signalmill.llm.common import plain, text_of
from signalmill.llm.components import components, forest
from signalmill.session import materialise

SAMPLES = 128
BANDS = 16
TILE = 512
PERIOD = 1 << 12  # steps after which the random bits repeat
CLASSES = 256  # characters are hashed into so many
SIDE_BY_SIDE = 100  # texts from which numpy steps pay
BATCH = 6_000_000  # characters walked together


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed hash of 64-bit numbers."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _stays() -> np.ndarray:
    """For each class of characters and step, how many places the walk stays on the character."""
    on = np.random.default_rng(7).integers(0, 2, (CLASSES, 2 * PERIOD), np.uint8)
    on[:, PERIOD:] = on[:, :PERIOD]
    on[:, PERIOD - 1] = on[:, -1] = 1
    stays = np.zeros((CLASSES, 2 * PERIOD), np.uint8)
    stays[:, -1] = 1
    for s in range(2 * PERIOD - 2, -1, -1):
        stays[:, s] = np.where(on[:, s] == 1, 1, stays[:, s + 1] + 1)
    return np.ascontiguousarray(stays[:, :PERIOD]).ravel()


def walks(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each text the place at which each character begins, a byte for each character, and the number of places."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    hashed = mixed(codes)
    byte = (hashed >> np.uint64(40)).astype(np.uint8)
    row = ((hashed % np.uint64(CLASSES)).astype(np.int32)) * PERIOD
    del hashed
    starts = np.empty(len(codes), np.int64)
    places = np.zeros(len(texts), np.int64)
    stays, mask = _stays(), PERIOD - 1
    order = np.argsort(-sizes, kind="stable")
    long_first = -sizes[order]
    begin, at = begins[order], np.zeros(len(texts), np.int64)
    step, active = 0, int(np.searchsorted(long_first, 0))
    while active >= SIDE_BY_SIDE:
        until = int(sizes[order[active - 1]])  # the shortest text that is still walked
        for step in range(step, until):
            where = begin[:active] + step
            now = at[:active]
            starts[where] = now
            now += stays[row[where] + (now & mask)]
        step = until
        active = int(np.searchsorted(long_first, -step))
    table = stays.tobytes()
    for k in range(active):
        a, b = int(begin[k]) + step, int(begin[k] + sizes[order[k]])
        now, out = int(at[k]), []
        for r in row[a:b].tolist():
            out.append(now)
            now += table[r + (now & mask)]
        starts[a:b], at[k] = out, now
    places[order] = at
    return [(starts[a:b], byte[a:b], int(n)) for a, b, n in zip(begins, ends, places)]


def level_of(places: int) -> int:
    return max(0, (places // SAMPLES).bit_length() - 1)


def _finer(index: np.ndarray, level: int, low: int) -> np.ndarray:
    """Indices of samples of ``level`` among those of the lower level ``low``."""
    for one in range(level, low, -1):
        index = 2 * index + (mixed(index + (one << 48)) >> np.uint64(17) & np.uint64(1)).astype(np.int64)
    return index


@lru_cache(maxsize=256)
def finer(level: int, low: int) -> np.ndarray:
    return _finer(np.arange(2 * SAMPLES, dtype=np.int64), level, low)


class Print:
    """A fingerprint: the level, the number of places, the samples."""

    __slots__ = ("level", "places", "samples")

    def __init__(self, level: int, places: int, samples: np.ndarray):
        self.level, self.places, self.samples = level, places, samples

    @classmethod
    def of(cls, starts: np.ndarray, byte: np.ndarray, places: int) -> "Print":
        level = level_of(places)
        at = finer(level, 0)
        at = at[at < places]  # the last stretch may end before its place
        return cls(level, places, byte[np.searchsorted(starts, at, "right") - 1] if places else np.empty(0, np.uint8))

    @classmethod
    def parse(cls, text: str) -> "Print":
        level, places, samples = text.split(":")
        return cls(int(level), int(places), np.frombuffer(bytes.fromhex(samples), np.uint8))

    def __str__(self) -> str:
        return f"{self.level}:{self.places}:{self.samples.tobytes().hex()}"

    def at_level(self, level: int) -> np.ndarray:
        """Samples at this level or a higher one."""
        if level == self.level:
            return self.samples
        index = finer(level, self.level)
        # Both the sample and its place have to be there.
        return self.samples[index[index < len(self.samples)]]

    def likeness(self, other: "Print") -> float:
        level = max(self.level, other.level)
        a, b = self.at_level(level), other.at_level(level)
        most = max(len(a), len(b))
        if not most:
            return 1.0
        both = min(len(a), len(b))
        return int((a[:both] == b[:both]).sum()) / most

    def bands(self) -> np.ndarray:
        """Keys of the bands at the own level, then at the one above."""
        out = []
        for level in (self.level, self.level + 1):
            samples = self.at_level(level).astype(np.uint64)
            index = np.arange(len(samples), dtype=np.int64)
            salted = mixed(samples + (index.astype(np.uint64) << np.uint64(8)))
            sums = np.zeros(BANDS, np.uint64)
            np.add.at(sums, index % BANDS, salted)
            out.append(mixed(sums + (np.arange(BANDS, dtype=np.uint64) << np.uint64(32)) + np.uint64(level << 56)))
        return np.concatenate(out).view(np.int64)


def prints(texts: list[str]) -> list[Print]:
    """Fingerprints of texts, walked in batches of bounded size."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
            size += len(texts[end])
            end += 1
        out += [Print.of(*w) for w in walks(texts[at:end])]
        at = end
    return out


def edited(text: str, after: str) -> str:
    """The text with its second half replaced by the beginning of the one after it."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, candidate_edited boolean, candidate_next boolean")
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]


def _meet(a: Print, b: Print) -> bool:
    return bool(np.isin(a.bands(), b.bands()).any())


def compared(ids: list, texts: list[str], after: list[str], after_prints: list[Print], own: list[Print]) -> list[tuple]:
    changed = [edited(t, n) for t, n in zip(texts, after)]
    rows = []
    for i, t, c, mine, other, next_one in zip(ids, texts, changed, own, prints(changed), after_prints):
        rows.append((i, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), str(mine), str(other),
                     mine.likeness(other), mine.likeness(next_one), _meet(mine, other), _meet(mine, next_one)))
    return rows


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each with the next one. The partition's first and last row are handed on with their texts."""
    part = TaskContext.get().partitionId()
    kinds = [*_KINDS, pa.int32(), pa.string(), pa.string()]

    def out(rows: list[tuple], role: str | None = None, text: str | None = None) -> pa.RecordBatch:
        columns = zip(*[(*r, part, role, text) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*_NAMES, "part", "role", "text"])

    def stretches() -> Iterator[tuple[list, list]]:
        """Stretches of about ``BATCH`` characters."""
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= BATCH // 2:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    empty = (None,) * (len(_NAMES) - 1)
    held: tuple | None = None
    for ids, texts in stretches():
        if held is None:
            yield out([(ids[0], *empty)], "first", texts[0])
            own = prints(texts)
        else:
            own = [held[2], *prints(texts)]
            ids, texts = [held[0], *ids], [held[1], *texts]
        rows = compared(ids[:-1], texts[:-1], texts[1:], own[1:], own[:-1])
        if rows:
            yield out(rows)
        held = ids[-1], texts[-1], own[-1]
    if held is not None:
        yield out([(held[0], *empty)], "last", held[1])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, text, after in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "after"))):
            own, next_one = prints([text, after])
            rows = compared([i], [text], [after], [next_one], [own])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def next_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its fingerprint, held against its edited text and the next document in descending id.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, candidate_edited, candidate_next``;
    a candidate shares a band. One shuffle, by range: each task has the next document of all its rows but the last, and these
    meet the first row of the following task by a join of one row per task.
    """
    rows = docs.select(plain(id_col).cast("bigint").alias("doc_id"), text_of(plain(text_col)).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    kept, _ = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                          .mapInArrow(_in_order, f"{_OUT}, part int, role string, text string"), "fingerprints")
    parts = sorted(r["part"] for r in kept.where("role = 'first'").select("part").collect())  # one number per task
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, _next int")
    first = kept.where("role = 'first'").select(F.col("part").alias("_next"), F.col("text").alias("after"))
    last = kept.where("role = 'last'").select("doc_id", "part", "text").join(following, "part").join(first, "_next")
    return kept.where("role is null").select(*_NAMES).unionByName(last.select("doc_id", "text", "after").mapInArrow(_borders, _OUT))


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = prints(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([str(p) for p in made], pa.string()),
                                          pa.array([p.bands().tolist() for p in made], pa.list_(pa.int64()))], ["doc_id", "fingerprint", "bands"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, bands`` of every document."""
    rows = docs.select(plain(id_col).cast("bigint").alias("doc_id"), text_of(plain(text_col)).alias("text"))
    return rows.mapInArrow(_fingerprinted, "doc_id bigint, fingerprint string, bands array<bigint>")


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("band", "i", "j", "chunk", "rep", "weight", "fingerprint", "bands")
        stream = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))
        for (band, i, j), rows in groupby(stream, key=lambda r: r[:3]):
            sides: list[list] = [[], []]
            for r in rows:
                sides[r[3] != i].append((r[4], r[5], Print.parse(r[6]), r[7]))
            left, right = sides[0], sides[0] if i == j else sides[1]
            linked = np.zeros((len(left), len(right)), bool)
            for x, a in enumerate(left):
                for y, b in enumerate(right):
                    if a[0] != b[0] and a[2].likeness(b[2]) >= least:
                        # Counted in the first band both have.
                        linked[x, y] = next(k for k in a[3] if k in b[3]) == band if a[0] < b[0] else next(k for k in b[3] if k in a[3]) == band
            if not linked.any():
                continue
            ids = [np.array([r[0] for r in s]) for s in (left, right)]
            weights = [np.array([r[1] for r in s]) for s in (left, right)]
            root = forest(linked, *ids)
            out = [(int(a), int(n), root[int(a)]) for a, n in zip(ids[0], linked @ weights[1]) if n]
            if i != j:
                out += [(int(b), int(n), root[int(b)]) for b, n in zip(ids[1], weights[0] @ linked) if n]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rep", "links", "root"])

    return run


def near_copies(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_links, component_id``; links are candidates by band with a likeness of ``least`` or more.

    Documents of one fingerprint are one while bands are compared. Empty texts link among themselves. Rows without an id link
    with nothing.
    """
    found, _ = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    able = found.where("doc_id is not null")
    classes, _ = materialise(able.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("weight"),
                                                             F.first("bands").alias("bands")), "fingerprints")
    spread = classes.select("rep", "weight", "fingerprint", "bands", F.explode(F.array_distinct("bands")).alias("band"))
    counts = spread.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("chunks"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    spread = spread.join(counts, "band").withColumn("chunk", F.pmod(F.xxhash64("rep", "fingerprint"), F.col("chunks")).cast("int"))
    tiles = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "band", F.least("chunk", "_other").alias("i"), F.greatest("chunk", "_other").alias("j"), "chunk", "rep", "weight", "fingerprint", "bands")
    linked, _ = materialise(tiles.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
                            .mapInArrow(_tiles(least), "rep bigint, links bigint, root bigint"), "fingerprints")
    reached = components(linked.select(F.col("root").alias("a"), F.col("rep").alias("b")), "fingerprints")
    links = linked.groupBy("rep").agg(F.sum("links").alias("_links"))
    known = (classes.select("fingerprint", "rep", "weight").join(links, "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
             .select("fingerprint", "weight", F.coalesce("component", "rep").alias("_component"), F.coalesce("_links", F.lit(0)).alias("_links")))
    ids = found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("fingerprint")).alias("fingerprint"))
    return ids.join(known, "fingerprint", "left").select(
        "doc_id", F.coalesce(F.col("_links") + F.col("weight") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_component", "doc_id").alias("component_id"))
