"""Language identification by a small byte-level convolutional network.

Texts are lower-cased, encoded in UTF-8 and cut into windows of ``WINDOW`` bytes
(all of the text, the last window padded with zeros). Filters of two, three and
four bytes run over each window, each filter's largest response is kept, and a
softmax over the languages follows; a text gets the mean of its windows'
probabilities. Training is plain numpy on windows of a bounded sample: about
``per_language`` labelled documents of each of at most ``max_languages``
languages, chosen by a hash of their id, ``SPREAD`` windows of each, evenly
spaced over the whole text. For prediction the filters become sums of two table
lookups (over pairs of bytes), so nothing is multiplied there.

A text that is NULL or has no letter gets ``und`` with score 0, and so does
every text when there is nothing to learn from. Repeated rows are predicted row
by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.common import bounded_batches, has_letter, plain

WINDOW, WIDTHS, FILTERS, EMBED, SPREAD = 128, (2, 3, 4), 16, 8, 3
BATCH_WINDOWS = 2048


def windows_of(text: str) -> np.ndarray:
    """All windows of a text as rows of bytes."""
    raw = text.lower().encode()
    raw += bytes(-len(raw) % WINDOW) or (b"" if raw else bytes(WINDOW))
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)


class Network:
    """Weights as plain arrays; small enough to travel with a task."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype("f4")
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype("f4") for w in WIDTHS]
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype("f4")
        self.bias = np.zeros(len(languages), "f4")

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.out, self.bias]

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the cross-entropy, with the gradient through the largest response of each filter."""
        rng = np.random.default_rng(11)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                step += 1
                pick = order[at:at + batch]
                grads = self._gradients(windows[pick], labels[pick])
                for w, g, (m, v) in zip(self.weights(), grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * 0.7 ** epoch * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        seen = self.embed[x]
        best, where, strips = [], [], []
        for w, kernel in zip(WIDTHS, self.filters):
            strip = np.concatenate([seen[:, k:WINDOW - w + 1 + k] for k in range(w)], 2)
            response = strip @ kernel
            where.append(response.argmax(1))
            best.append(np.take_along_axis(response, where[-1][:, None], 1)[:, 0])
            strips.append(strip)
        hidden = np.maximum(np.concatenate(best, 1), 0)
        error = softmax(hidden @ self.out + self.bias)
        error[np.arange(n), y] -= 1
        error /= n
        back = (error @ self.out.T) * (hidden > 0)
        embed = np.zeros_like(self.embed)
        kernels = []
        for i, (w, kernel) in enumerate(zip(WIDTHS, self.filters)):
            g = back[:, i * FILTERS:(i + 1) * FILTERS]
            chosen = strips[i][np.arange(n)[:, None], where[i]]  # window x filter x bytes of the filter
            kernels.append(np.einsum("nf,nfd->df", g, chosen))
            down = (g[:, :, None] * kernel.T[None]).reshape(n, FILTERS, w, EMBED)
            for k in range(w):
                np.add.at(embed, x[np.arange(n)[:, None], where[i] + k], down[:, :, k])
        return [embed, *kernels, hidden.T @ error, error.sum(0)]

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Per width: responses to pairs of bytes; what a filter answers is the sum over its pairs."""
        found = []
        for w, kernel in zip(WIDTHS, self.filters):
            single = [self.embed @ kernel[k * EMBED:(k + 1) * EMBED] for k in range(w)]
            pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS))
            found.append((pair(single[0], single[1]),) + ((single[2],) if w == 3 else (pair(single[2], single[3]),) if w == 4 else ()))
        return found


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(net: Network, tables: list, x: np.ndarray) -> np.ndarray:
    pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
    best = []
    for w, parts in zip(WIDTHS, tables):
        n = WINDOW - w + 1
        response = parts[0].take(pairs[:, :n], axis=0)
        if w == 3:
            response += parts[1].take(x[:, 2:], axis=0)
        elif w == 4:
            response += parts[1].take(pairs[:, 2:2 + n], axis=0)
        best.append(response.max(1))
    return softmax(np.maximum(np.concatenate(best, 1), 0) @ net.out + net.bias)


def predict(net: Network, tables: list, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text, over all its windows, in batches of windows."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    owners, chunks, held = [], [], 0
    sums = np.zeros((len(texts), len(net.languages)))
    counts = np.zeros(len(texts))

    def flush() -> None:
        x, who = np.concatenate(chunks), np.concatenate(owners)
        for at in range(0, len(x), BATCH_WINDOWS):
            p, w = probabilities(net, tables, x[at:at + BATCH_WINDOWS]), who[at:at + BATCH_WINDOWS]
            np.add.at(sums, w, p)
            np.add.at(counts, w, 1)
        owners.clear()
        chunks.clear()

    for i, t in enumerate(texts):
        if not net.languages or t is None or not has_letter(t):
            continue
        w = windows_of(t)
        chunks.append(w)
        owners.append(np.full(len(w), i))
        held += len(w)
        if held >= 8 * BATCH_WINDOWS:
            flush()
            held = 0
    if chunks:
        flush()
    for i in np.flatnonzero(counts):
        mean = sums[i] / counts[i]
        out[i] = (net.languages[int(mean.argmax())], float(mean.max()))
    return out


def held_out(id_col: str) -> Column:
    return F.crc32(plain(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          per_language: int = 400, max_languages: int = 64) -> Network:
    """Fits a network to labelled documents outside the held-out fold.

    Only counts per language (``max_languages`` rows at most) and the sample's
    windows reach the driver.
    """
    bounded_batches(docs)
    # A NULL id has no fold; such a row is left out of training.
    known = docs.select(plain(id_col).cast("string").alias("id"), plain(lang_col).cast("string").alias("lang"),
                        plain(text_col).cast("string").alias("text"), (~held_out(id_col)).alias("mine"))
    known = known.where("mine and lang is not null and text is not null")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return Network([])
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000.0

    @F.arrow_udf("array<binary>")
    def spread(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            w = windows_of(t.as_py())
            out.append([w[i].tobytes() for i in sorted({0, len(w) // 2, max(0, len(w) - 2)})])
        return pa.array(out, pa.list_(pa.binary()))

    rows = (known.where(draw < F.element_at(share, F.col("lang"))).select("id", "lang", spread("text").alias("w"))
            .orderBy("lang", "id", "w").collect())
    languages = sorted({r["lang"] for r in rows})
    net = Network(languages)
    if rows:
        x = np.frombuffer(b"".join(bytes(w) for r in rows for w in r["w"]), np.uint8).reshape(-1, WINDOW)
        net.train(x, np.array([languages.index(r["lang"]) for r in rows for _ in r["w"]]))
    return net


def language(text: Column, net: Network) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(texts: pa.Array) -> pa.Array:
        tables = _tables_for(net)
        return pa.array([{"lang_pred": a, "score": b} for a, b in predict(net, tables, texts.to_pylist())], kind)

    return found(text.cast("string"))


def _tables_for(net: Network) -> list:
    """The lookup tables, made once per worker and network."""
    if getattr(net, "_made", None) is None:
        net._made = net.tables()
    return net._made


def identify(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **sample: int) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``. Other columns are not kept; a NULL id is not held out."""
    net = net or train(docs, text_col, lang_col, id_col, **sample)
    return docs.select(plain(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                       language(plain(text_col), net).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")


def keep_known(docs: DataFrame, min_score: float = 0.3, text_col: str = "text", lang_col: str = "lang",
               id_col: str = "doc_id") -> DataFrame:
    """Documents whose language is recognised with at least ``min_score``, with all their columns."""
    found = language(plain(text_col), train(docs, text_col, lang_col, id_col))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= min_score))
