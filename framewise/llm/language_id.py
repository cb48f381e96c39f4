"""Language identification by a byte convolutional network trained in numpy (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import LOWER, slices, text_buffer

#: Bytes in a window, filter widths and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bytes whose windows are made at a time (a multiple of WINDOW).
PART = 1 << 20
#: At most so many labelled documents of one language are sampled (by hash of the id) to fit the network.
SAMPLE = 1500


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All fixed-length windows of every row, zero padded, with max(WIDTHS) - 1 zeros behind; and each window's row."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    flat = np.zeros(len(row) * WINDOW, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat[np.arange(len(buf)) - offsets[owner] + first[owner] * WINDOW] = LOWER[buf]
    out = np.zeros((len(row), WINDOW + max(WIDTHS) - 1), np.uint8)
    out[:, :WINDOW] = flat.reshape(-1, WINDOW)
    return out, row


class Network:
    """relu(max over positions of byte filters of several widths), then a softmax layer."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.taps = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.weights = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        self.pairs: dict[int, list[np.ndarray]] = {}

    def fuse(self) -> None:
        """Tables over byte pairs, so that a filter of width w costs w/2 lookups a position."""
        for w, taps in self.taps.items():
            self.pairs[w] = [(taps[k][:, None] + taps[k + 1][None]).reshape(65536, FILTERS) if k + 1 < w else taps[k] for k in range(0, w, 2)]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for w, tables in self.pairs.items():
            conv = tables[0].take(pair[:, :WINDOW], axis=0)
            if w > 2:
                conv += tables[1].take((pair if w == 4 else x)[:, 2 : WINDOW + 2], axis=0)
            out.append(conv.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1), 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(x[i : i + 64]) for i in range(0, len(x), 64)]) @ self.weights + self.bias

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Network:
        """Adagrad on cross-entropy; gradients pass only through the position that each filter's maximum took."""
        rng = np.random.default_rng(seed)
        cost = 1 / np.maximum(np.bincount(y, minlength=len(self.langs)), 1)
        cost = (cost / cost[y].mean()).astype(np.float32)
        params = [*self.taps.values(), self.weights, self.bias]
        seen = [np.full(p.shape, 1e-3, np.float32) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                best, tops = [], []
                for w, taps in self.taps.items():
                    conv = sum(taps[k].take(xb[:, k : k + WINDOW], axis=0) for k in range(w))
                    best.append(conv.argmax(axis=1))
                    tops.append(np.take_along_axis(conv, best[-1][:, None], 1)[:, 0])
                top = np.concatenate(tops, axis=1)
                hidden = np.maximum(top, 0)
                z = hidden @ self.weights + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= cost[yb][:, None] / len(yb)
                back = (p @ self.weights.T) * (top > 0)
                grads = []
                for i, (w, taps) in enumerate(self.taps.items()):
                    g, part = np.zeros_like(taps), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (xb[np.arange(len(xb))[:, None], best[i] + k], np.arange(FILTERS)[None]), part)
                    grads.append(g)
                grads += [hidden.T @ p, p.sum(axis=0)]
                for q, s, g in zip(params, seen, grads, strict=True):
                    s += g * g
                    q -= rate * g / np.sqrt(s)
        return self

    def classify(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and probability of the language of each row: softmax of the mean logits of all its windows."""
        n = len(offsets) - 1
        total, seen = np.zeros((n, len(self.langs))), np.zeros(n)
        parts = [(0, offsets)] if len(buf) <= 2 * PART else [(i, np.array([a, min(a + PART, offsets[i + 1])])) for i in range(n) for a in range(offsets[i], offsets[i + 1], PART)]
        for i, at in parts:
            x, row = windows(buf[at[0] : at[-1]], at - at[0])
            if len(x):
                np.add.at(total, row + i, self.logits(x))
                seen += np.bincount(row + i, minlength=n)
        total /= np.maximum(seen, 1)[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Fit on rows with a language and a text; None if there are none.

    A row is drawn if the hash of its id and text falls under `sample` over the language's count; equal rows are one, so
    repeated ids and texts add nothing. Two windows (the first and one at a hashed place) of each drawn row reach the
    driver: about `sample` rows of a language, and never more than twice as many over all, by a limit in the plan. Every
    language is a class of the network. Null and empty texts teach nothing.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.element_at(F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, sample / n)))), F.col("lang"))
    place = F.lit(1) + F.pmod(F.xxhash64("id", "text", F.lit(2)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int")
    drawn = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(1_000_000)) < rate * 1_000_000)
    drawn = drawn.select("lang", F.xxhash64("id", "text").alias("k"), F.substring("text", 1, WINDOW).alias("a"), F.col("text").substr(place, F.lit(WINDOW)).alias("b")).distinct()
    got = drawn.orderBy("k", "lang", "a", "b").limit(2 * sample * len(counts)).toPandas()
    got = got.sort_values("k", kind="stable")
    langs = sorted(counts)
    texts = [*got["a"], *got["b"]]
    raw = [t.encode()[:WINDOW] for t in texts]
    x, row = windows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
    y = np.array([langs.index(v) for v in got["lang"]] * 2, np.int64)[row]
    return Network(langs).fit(x, y)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from all windows of its whole text.

    Null texts, texts without a letter, and every text if the network is None (nothing to learn from) are 'und' with
    score 0. Very long texts are classified by all their windows, a bounded number at a time. Repeated rows and ids get
    equal answers for equal texts, ties go to the first language by name. Empty table: no rows. Extra columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    asked = base.select("id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), "text")
    if network is None:
        return base.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network.fuse()
        names = np.array([*network.langs, "und"], object)
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            for i, j in slices(off):
                best, score = network.classify(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                letter = batch.column("letter").slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(names[np.where(letter, best, -1)], pa.string()), pa.array(np.where(letter, score, 0.0))], [id_col, "lang_pred", "score"])

    return asked.mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")
