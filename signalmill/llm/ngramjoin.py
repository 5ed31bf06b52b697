"""Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

The rows of the matrix are distinct sets of n-grams (documents with equal sets
are one row with a weight), the columns n-grams. The product of the matrix with
its transpose holds all overlaps; a pair is a link when its overlap reaches the
bound that follows from the two sizes.

Which blocks can hold a link: all sets are put in one order of n-grams, common
ones last. A linked partner shares at least ``ceil(t * size)`` n-grams, so it
shares one of the first ``size - ceil(t * size) + 1``: only these are shuffled,
by n-gram. Rows that meet in an n-gram are connected when their sizes allow a
link and their sketches are near: ``SKETCH`` bits, each of which differs for a
linked pair with a chance of at most ``(1 - t) / 2``, on its own, however few
n-grams a set has. As many may differ as leave a chance below ``MISSED`` that a
linked pair is not connected. Without the sketches, texts that share one n-gram
by chance would grow into large blocks. In an n-gram of more than ``HOT`` rows
neighbours by size are connected without regard to sketches; rows between two
linked ones have sizes in between, so the chain joins them. What is connected is a block of the matrix. The order is a
matter of cost only: n-grams that many documents share (up to ``COMMON`` of
them, counted over all documents) come last.

Inside a block rows are dealt by size into bands, so that linked rows lie in one
band or in two adjacent ones, and bands into chunks of at most about
``TILE_BYTES`` of hashes and ``TILE`` rows. Chunks of bands that can be linked
are multiplied in tiles on many tasks, a slice of columns at a time. Overlaps add
up; after each slice, pairs that cannot reach their bound with the columns left
are discarded, and rows without such pairs are left out of the product. A tile
gives each row its number of links and the smallest row it is connected to inside
the tile, never the pairs. Where the tiles together hold more than half of all
n-grams, they are done in rounds of about so much, so that the disk they take
does not grow with the square of a block.

Words are what stands between ASCII white space, A-Z in lower case. NULL texts,
and texts without words, have the empty set and link with nothing; a text of
fewer words than ``n`` is one n-gram. Sets are of 64-bit hashes: two different
n-grams are taken for one with a chance of 2^-64 per pair. A very long text is
one row, whole, in a chunk of its own. Repeated rows count once; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations_with_replacement, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import Memo, bounded_batches, plain, text_of
from signalmill.llm.components import components, forest
from signalmill.session import materialise

TILE = 1024  # rows of a chunk
TILE_BYTES = 4 << 20  # hashes of a chunk, in the mean
SLICE = 4096  # columns multiplied at once
COMMON = 1 << 20  # n-grams that are ordered by how many documents have them
SEEN = 1_000_000  # n-grams of a task that are counted together
OFTEN = 8  # documents of those that make an n-gram a candidate for COMMON
SKETCH = 128
MISSED = 1e-10  # bound of the chance that a linked pair's sketches differ in more bits than allowed
HOT = 8192  # rows of an n-gram that are compared with each other
PART = 1024  # of these, at once
ROUND = 1 << 25  # n-grams in the tiles of a round, if that is more than half of all
_MIXERS = np.random.default_rng(SKETCH).integers(0, 1 << 32, SKETCH, np.uint64).astype(np.uint32) | np.uint32(1)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WORDS = Memo(150_000)


def _learn(word: bytes) -> int:
    known = xxhash.xxh3_64_intdigest(word)
    if len(word) <= 64:
        _WORDS[word] = known
    return known


_WORDS.make = _learn


def grams(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    _WORDS.room()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64) * _ODD[3]  # whole texts of fewer words differ by their length
    for k in range(n):
        total = spread(total + h[k:len(h) - n + 1 + k] * _ODD[k % 3])
    return np.unique(total)


def _often(n: int):
    """N-grams that several documents of a task share, with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often])], ["gram", "n"])

        for b in batches:
            for t in b.column("text"):
                held.append(grams(t.as_py(), n))
                size += len(held[-1])
                if size >= SEEN:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


def common_grams(rows: DataFrame, n: int):
    """Broadcast of sorted hashes of the most common n-grams and their rank in the order: at most ``COMMON``, 9 bytes each."""
    counted = rows.select("text").mapInArrow(_often(n), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("n").desc(), "gram").limit(COMMON).toPandas()
    hashes = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    rank = np.ceil(8 * np.log2(np.maximum(top["n"].to_numpy(np.float64), 1))).clip(1, 255).astype(np.uint8)
    return rows.sparkSession.sparkContext.broadcast((hashes[order], rank[order]))


def prefix(found: np.ndarray, percent: int, hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The n-grams of which a linked partner has one at least: the first ones in the common order."""
    count = len(found) - -(-percent * len(found) // 100) + 1 if len(found) else 0
    if not len(hashes):
        return found[:count]
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    place = np.where(hashes[at] == found, rank[at], 0).astype(np.uint8)
    return found[np.argsort(place, kind="stable")[:count]]  # equal ranks by hash


def sketch(found: np.ndarray) -> bytes:
    """One bit of the least n-gram in each of ``SKETCH`` orders; the orders have nothing in common, so neither have the bits."""
    mixed = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(mixed), 4096):
        np.minimum(least, (_MIXERS[:, None] * mixed[None, at:at + 4096]).min(1), out=least)
    return np.packbits((least >> np.uint32(8)).astype(np.uint8) & np.uint8(1)).tobytes()


def may_differ(percent: int) -> int:
    """Bits in which the sketches of a linked pair differ at most, but for a chance of ``MISSED``."""
    p = Fraction(100 - percent, 200)
    left = Fraction(1)
    for k in range(SKETCH + 1):
        left -= math.comb(SKETCH, k) * p ** k * (1 - p) ** (SKETCH - k)
        if left < MISSED:
            return k
    return SKETCH


def _connected(percent: int):
    """Edges between rows of one n-gram, which come sorted by n-gram and size."""
    allowed = may_differ(percent)

    def chain(reps: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        near = (sizes[:-1] * 100 >= sizes[1:] * percent) & (reps[1:] != reps[:-1])
        return zip(reps[:-1][near].tolist(), reps[1:][near].tolist())

    def edges(reps: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        for a, b in combinations_with_replacement([slice(at, at + PART) for at in range(0, len(reps), PART)], 2):
            if sizes[a][-1] * 100 < sizes[b][0] * percent:  # sorted by size
                continue
            bits = np.bitwise_count(prints[a][:, None] ^ prints[b][None]).sum(2)
            least, most = (f(sizes[a][:, None], sizes[b][None]) for f in (np.minimum, np.maximum))
            near = (bits <= allowed) & (least * 100 >= most * percent) & (reps[a][:, None] != reps[b][None])
            if near.any():
                yield from ((low, node) for node, low in forest(near, reps[a], reps[b]).items() if node != low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        out: list[tuple[int, int]] = []
        chained = None  # the n-gram of which so many rows have come that only its last one is held

        def closed(upto: int) -> None:
            gram = held[0][:upto]
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if upto else np.empty(0, np.int64)
            lengths = np.diff(np.append(starts, upto))
            for at, n in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist()):
                rows = [c[at:at + n] for c in held[1:]]
                out.extend(chain(*rows[:2]) if n > HOT or gram[at] == chained else edges(*rows))

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out.clear()

        for b in batches:
            fresh = [b.column(n).to_numpy(zero_copy_only=False) for n in ("gram", "rep", "size")]
            raw = b.column("sketch")
            fresh.append(np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(-1, SKETCH // 64))
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            if not len(held[0]):
                continue
            upto = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if (held[0] != held[0][-1]).any() else 0  # the last n-gram may go on
            closed(upto)
            held = [c[upto:] for c in held]
            if len(held[0]) > 4 * HOT:
                out.extend(chain(*held[1:3]))
                chained, held = held[0][-1], [c[-1:] for c in held]
            if len(out) > 50_000:
                yield from flushed()
        if held is not None and len(held[0]):
            closed(len(held[0]))
        yield from flushed()

    return run


def shape(text: Column, n: int, percent: int, common) -> Column:
    """Struct of ``size`` of the set, its ``key`` (equal for equal sets), its prefix and its sketch."""
    kind = pa.struct([("size", pa.int64()), ("key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])

    @F.arrow_udf("struct<size: bigint, key: binary, prefix: array<bigint>, sketch: binary>")
    def shaped(texts: pa.Array) -> pa.Array:
        hashes, rank = common.value
        sizes, keys, found, sketches = [], [], [], []
        for t in texts:
            g = grams(t.as_py(), n)
            sizes.append(len(g))
            keys.append(xxhash.xxh3_128_digest(g.tobytes()))
            found.append(prefix(g, percent, hashes, rank).view(np.int64))
            sketches.append(sketch(g))
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(sketches, pa.binary())],
                                          fields=list(kind))

    return shaped(text)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of two lists of sets are similar enough: the product of two sparse 0/1 matrices, a slice of columns at a time."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    need = -(-percent * (sizes[0][:, None] + sizes[1][None]) // (100 + percent))
    possible = need <= np.minimum(sizes[0][:, None], sizes[1][None])
    total = np.zeros(need.shape, np.int64)
    alive = [np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))]
    if not len(alive[0]):
        return possible
    both = [np.unique(np.concatenate([side[k] for k in kept])) for side, kept in zip((left, right), alive)]
    columns = np.intersect1d(*both, assume_unique=True)
    where, rest = [], []
    for side, kept in zip((left, right), alive):
        hashes = np.concatenate([side[k] for k in kept])
        row = np.repeat(kept, [len(side[k]) for k in kept])
        at = np.minimum(np.searchsorted(columns, hashes), max(len(columns) - 1, 0))
        hit = columns[at] == hashes if len(columns) else np.zeros(len(hashes), bool)
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        where.append((row[order], at[order]))
        rest.append(np.bincount(row, minlength=len(side)))
    for low in range(0, len(columns), SLICE):
        parts, place = [], np.empty(max(need.shape), np.int64)
        for (row, at), kept, left_over in zip(where, alive, rest):
            a, b = np.searchsorted(at, [low, low + SLICE])
            x = np.zeros((len(kept), min(SLICE, len(columns) - low)), np.float32)
            place[:] = -1
            place[kept] = np.arange(len(kept))
            to = place[row[a:b]]
            x[to[to >= 0], at[a:b][to >= 0] - low] = 1
            left_over -= np.bincount(row[a:b], minlength=len(left_over))
            parts.append(x)
        here = np.ix_(*alive)
        total[here] += (parts[0] @ parts[1].T).astype(np.int64)  # exact: at most SLICE
        possible[here] &= total[here] + np.minimum(rest[0][alive[0]][:, None], rest[1][alive[1]][None]) >= need[here]
        alive = [alive[0][possible[here].any(1)], alive[1][possible[here].any(0)]]
        if not len(alive[0]):
            break
    return possible & (total >= need)


def _tiles(n: int, percent: int):
    """Tiles of texts. Texts travel, not their hashes: they compress, and hashes are made in a fraction of the time they save."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("grp", "i", "j", "slot", "rep", "print", "weight", "text")
        stream = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))
        out: list[tuple[int, int, int]] = []
        for (_, i, j), rows in groupby(stream, key=lambda r: r[:3]):
            sides: list[list] = [[], []]
            last = None
            for r in rows:
                if r[3:6] != last:  # repeated rows stand together
                    sides[r[3] != i].append((r[4], r[6], grams(r[7], n)))
                last = r[3:6]
            left, right = sides[0], sides[0] if i == j else sides[1]
            if not left or not right:
                continue
            ids = [np.array([x[0] for x in s]) for s in (left, right)]
            weights = [np.array([x[1] for x in s]) for s in (left, right)]
            linked = linked_pairs([x[2] for x in left], [x[2] for x in right], percent)
            linked &= ids[0][:, None] != ids[1][None]
            if not linked.any():
                continue
            root = forest(linked, *ids)
            out += [(int(a), int(n), root[int(a)]) for a, n in zip(ids[0], linked @ weights[1]) if n]
            if i != j:
                out += [(int(b), int(n), root[int(b)]) for b, n in zip(ids[1], weights[0] @ linked) if n]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rep", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rep", "links", "root"])

    return run


def dealt(members: DataFrame, percent: int) -> DataFrame:
    """Members of blocks (``grp``, ``rep``, ``print``, ``size`` and more) with their ``slot``, once for each tile ``i, j`` they take part in.

    A block that fits into one chunk is one tile. A larger one is dealt into bands by size, a little wider than the ratio of two
    linked sizes, so that linked rows are at most one band apart. A block has few bands; one row each says in how many chunks
    they are dealt.
    """
    chunks = F.greatest(F.ceil(F.sum("size") * 8 / TILE_BYTES), F.ceil(F.count(F.lit(1)) / TILE)).cast("int")
    band = F.floor(F.ln("size") * (0.999 / -np.log(percent / 100))) if percent < 100 else F.col("size")
    whole = members.groupBy("grp").agg(chunks.alias("_chunks"))
    members = members.join(whole, "grp").withColumn("band", F.when(F.col("_chunks") > 1, band.cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    counts = members.groupBy("grp", "band").agg(chunks.alias("chunks"))
    # Chunks of a band and of the bands beside it, brought together by adding up over shifted copies of the counts.
    shifted = counts.withColumn("_by", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    of = lambda by: F.sum(F.when(F.col("_by") == by, F.col("chunks")).otherwise(0)).cast("int")
    around = shifted.groupBy("grp", (F.col("band") + F.col("_by")).alias("band")).agg(
        of(0).alias("own"), of(1).alias("below"), of(-1).alias("above")).where("own > 0")
    slot = lambda band, chunk: band * (1 << 24) + chunk
    placed = members.join(around, ["grp", "band"]).withColumn("slot", slot(F.col("band"), F.pmod(F.xxhash64("rep", "print"), F.col("own"))))

    def slots(count: str, by: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda k: slot(F.col("band") + by, k))
        return F.when(F.col(count) > 0, found).otherwise(F.array().cast("array<bigint>"))

    tiled = placed.withColumn("_other", F.explode(F.concat(slots("below", -1), slots("own", 0), slots("above", 1))))
    return tiled.withColumns({"i": F.least("slot", "_other"), "j": F.greatest("slot", "_other")})


def _linked(texts: DataFrame, tiles: DataFrame, n: int, percent: int) -> DataFrame:
    """Links and roots that some of the tiles give."""
    # By sorting at every size: the table of tiles grows with the documents, so it is not for broadcasting.
    seated = texts.join(tiles.hint("merge"), ["rep", "print"])
    order = ["grp", "i", "j", "slot", "rep", "print"]
    linked, _ = materialise(seated.select(*order, "weight", "text").repartition("grp", "i", "j").sortWithinPartitions(*order)
                            .mapInArrow(_tiles(n, percent), "rep bigint, links bigint, root bigint"), "ngram")
    return linked


def join(docs: DataFrame, n: int = 3, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``. Other columns are not kept.

    ``component_id`` is the smallest id reachable by links; ``n_links`` counts
    the other documents linked directly. Rows that share an id are one document
    for links, and each gets a row. A NULL id keeps its row and links with nothing.
    """
    bounded_batches(docs)
    percent = round(threshold * 100)
    rows = docs.select(plain(id_col).cast("bigint").alias("doc_id"), text_of(plain(text_col)).alias("text"))
    common = common_grams(rows, n)
    rows = rows.withColumn("print", F.xxhash64("text"))  # which of several rows with one id
    shaped, seen = materialise(rows.select("doc_id", "print", shape(F.col("text"), n, percent, common).alias("s")).select("doc_id", "print", "s.*"),
                               "ngram", size=F.sum("size"))
    found = shaped.where("size > 0 and doc_id is not null")
    classes, _ = materialise(found.groupBy("key").agg(
        F.min(F.struct("doc_id", "print")).alias("_first"), F.count_distinct("doc_id").alias("weight"), F.first("size").alias("size")).select(
        "key", F.col("_first.doc_id").alias("rep"), F.col("_first.print").alias("print"), "weight", "size"), "ngram")
    firsts = found.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("prefix").alias("prefix"),
                                      F.first("sketch").alias("sketch"))
    postings = firsts.select("rep", "size", "sketch", F.explode("prefix").alias("gram"))
    pairs = postings.repartition("gram").sortWithinPartitions("gram", "size", "rep").mapInArrow(_connected(percent), "a bigint, b bigint")
    groups = components(pairs, "ngram-groups")
    members = groups.select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    members = members.unionByName(members.select(F.col("grp").alias("rep"), "grp").distinct())
    weighted = members.join(classes.drop("key"), "rep")  # a rep may stand for several sets when ids repeat
    tiles, load = materialise(dealt(weighted, percent).select("grp", "i", "j", "slot", "rep", "print", "weight", "size"), "ngram", size=F.sum("size"))
    texts = rows.withColumnRenamed("doc_id", "rep")
    rounds = -(-(load["size"] or 0) // max(ROUND, (seen["size"] or 0) // 2)) or 1
    if rounds > 1:
        texts, _ = materialise(texts.join(weighted.select("rep", "print").hint("merge"), ["rep", "print"], "left_semi"), "ngram")
    turn = F.pmod(F.xxhash64("grp", "i", "j"), F.lit(rounds))
    linked = reduce(DataFrame.unionAll, [_linked(texts, tiles.where(turn == k), n, percent) for k in range(rounds)])
    reached = components(linked.select(F.col("root").alias("a"), F.col("rep").alias("b")), "ngram-links")
    links = linked.groupBy("rep").agg(F.sum("links").alias("_links"))
    known = (classes.drop("size", "print").join(links, "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
             .select("key", "weight", F.coalesce("component", "rep").alias("_component"), F.coalesce("_links", F.lit(0)).alias("_links")))
    return (shaped.select("doc_id", "size", F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
            .join(known, "key", "left").select(
                "doc_id", F.col("size").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"),
                F.coalesce(F.col("_links") + F.col("weight") - 1, F.lit(0)).cast("bigint").alias("n_links")))
