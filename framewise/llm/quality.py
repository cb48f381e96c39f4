"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import slices, span_hashes, text_buffer, word_spans

#: At most about so many labelled rows (drawn by hash of the id) are used to fit the trees.
SAMPLE = 20000
STATISTICS = (
    "bytes words upper digit punctuation wide space newline bang pipe star percent dollar amp hash "
    "word_bytes word_deviation capitalised shouted ends_mark single distinct_words top_word repeated_next lines line_bytes distinct_lines "
    "ends_stop lower"
).split()


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(STATISTICS)) numbers from the whole bytes of each row; zeros for an empty row."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    if not len(buf):
        return out
    put = dict(zip(STATISTICS, out.T, strict=True))
    some = np.maximum(sizes, 1)
    owner = np.repeat(np.arange(n), sizes)
    hist = np.bincount(owner * 256 + buf, minlength=n * 256).reshape(n, 256) / some[:, None]
    put["bytes"][:] = np.log1p(sizes)
    for name, codes in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "punctuation": [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], "wide": range(128, 256), "space": [32], "newline": [10], "bang": b"!", "pipe": b"|", "star": b"*", "percent": b"%", "dollar": b"$", "amp": b"&", "hash": b"#"}.items():
        put[name][:] = hist[:, list(codes)].sum(axis=1)
    s, e, row = word_spans(buf, offsets)
    words = np.bincount(row, minlength=n)
    any_ = np.maximum(words, 1)
    put["words"][:] = np.log1p(words)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n) / any_

    if len(s):
        size = (e - s).astype(float)
        put["word_bytes"][:] = mean = np.bincount(row, size, n) / any_
        put["word_deviation"][:] = np.sqrt(np.maximum(np.bincount(row, size * size, n) / any_ - mean**2, 0))
        upper = (buf >= 65) & (buf <= 90)
        lower = np.concatenate([[0], np.cumsum((buf >= 97) & (buf <= 122))])
        put["capitalised"][:] = share(upper[s])
        put["shouted"][:] = share(lower[e] == lower[s])
        last = buf[e - 1]
        put["ends_stop"][:] = share(last == 46)
        put["ends_mark"][:] = share((last < 48) & (last != 46) & (last != 44))
        put["single"][:] = share(size == 1)
        h = span_hashes(buf, s, e)
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        put["repeated_next"][:] = np.bincount(row[1:][same], minlength=n) / any_
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])
        at = np.flatnonzero(new)
        put["distinct_words"][:] = np.bincount(rs[at], minlength=n) / any_
        np.maximum.at(put["top_word"], rs[at], np.diff(np.concatenate([at, [len(hs)]])) / any_[rs[at]])
    cut = np.flatnonzero(buf == 10)
    begin = np.union1d(offsets[:-1][sizes > 0], np.setdiff1d(cut + 1, offsets))
    end = np.concatenate([begin[1:], [len(buf)]])
    of = np.searchsorted(offsets, begin, "right") - 1
    lines = np.maximum(np.bincount(of, minlength=n), 1)
    put["lines"][:] = np.log1p(lines) * (sizes > 0)
    put["line_bytes"][:] = np.log1p(sizes / lines)
    trim = np.where(buf[end - 1] == 10, end - 1, end)
    h = span_hashes(buf, begin, trim)
    order = np.lexsort((h, of))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])
    put["distinct_lines"][:] = np.bincount(of[order][new], minlength=n) / lines
    return out


class Trees:
    """Boosted trees for a 0/1 label, kept as flat arrays: node k splits feature[k] at threshold[k], children at left[k] and left[k] + 1."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.value, self.roots = [], [], [], [], []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(edges, x.T, strict=True)], 1)  # bin b holds values <= edges[b]
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.base)
        cols = np.arange(x.shape[1]) * bins
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            self.roots.append(self._add())
            live = [(self.roots[-1], np.arange(len(y)))]
            for level in range(depth + 1):
                todo = []
                for node, rows in live:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    self.value[node] = rate * gs / (hs + ridge)
                    if level < depth and len(rows) >= 2 * least and (split := self._split(binned[rows] + cols, g[rows], h[rows], bins, ridge, least)):
                        f, b = split
                        go = binned[rows, f] <= b
                        self.feature[node], self.threshold[node] = f, edges[f][b]
                        self.left[node] = self._add()
                        self._add()
                        todo += [(self.left[node], rows[go]), (self.left[node] + 1, rows[~go])]
                    else:
                        margin[rows] += self.value[node]
                live = todo
        for name, kind in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("value", float), ("roots", np.int64)):
            setattr(self, name, np.array(getattr(self, name), kind))
        self.depth = depth
        return self

    def _add(self) -> int:
        for a, v in ((self.feature, 0), (self.threshold, 0.0), (self.left, -1), (self.value, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    @staticmethod
    def _split(cells: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, ridge: float, least: int) -> tuple[int, int] | None:
        n_cols = cells.shape[1]
        flat = cells.ravel()
        gs, hs, cs = (np.bincount(flat, w, n_cols * bins).reshape(n_cols, bins).cumsum(1) for w in (np.repeat(g, n_cols), np.repeat(h, n_cols), None))
        gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
        gain[(cs < least) | (cs[:, -1:] - cs < least)] = 0
        gain[:, -1] = 0
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        return (int(f), int(b)) if gain[f, b] > 1e-6 else None

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows and all trees walk down together, level by level."""
        margin = np.full(len(x), self.base)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            for _ in range(self.depth):
                left = self.left[node]
                value = np.take_along_axis(part, self.feature[node], 1)
                node = np.where(left < 0, node, left + (value > self.threshold[node]))
            margin[a : a + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = text_buffer(batch.column("text"))
        for i, j in slices(off):
            x = statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, j - i), batch.column("quality").slice(i, j - i), lists], ["k", "quality", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees | None:
    """Fit on labelled documents; None where no label 0 or 1 meets a document.

    Null labels and null ids are left out; of several labels of one id the least counts. About `sample` labels are
    drawn by hash of the id, so what is broadcast is bounded. Equal texts of one id are one row, and never more than twice
    `sample` rows (those of least hash), a vector of statistics each, reach the driver. Empty tables: None.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("quality")).where("i is not null and quality in (0, 1)")
    known = known.groupBy("i").agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    drawn = known.where(F.pmod(F.xxhash64("i", F.lit(8)), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000)
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    got = base.join(F.broadcast(drawn), "i").select(F.xxhash64("i", "text").alias("k"), "quality", "text").mapInArrow(_measure, "k bigint, quality int, x array<double>")
    got = got.dropDuplicates(["k"]).orderBy("k").limit(2 * sample).toPandas()
    if not len(got):
        return None
    return Trees().fit(np.stack(got["x"].to_numpy()), got["quality"].to_numpy().astype(float))


def score_quality(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row, from statistics of its whole text; predicted is 1 if score >= threshold.

    Null and empty texts have statistics of zero and get the score of those. Without trees (nothing to learn from) every
    score is 0.5. Equal texts get equal scores, whatever their ids. A very long text is measured whole, in memory of about
    ten times its bytes. Empty table: no rows. Extra columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            for i, j in slices(off):
                x = statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                p = trees.predict(x) if trees else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return base.mapInArrow(predict, f"`{id_col}` {kind}, score double, predicted int")


def keep_quality(docs: DataFrame, trees: Trees | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score reaches the threshold. Nothing is shuffled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(text_col))
            good = [np.zeros(0, bool)]
            for i, j in slices(off):
                x = statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                good.append((trees.predict(x) if trees else np.full(len(x), 0.5)) >= threshold)
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)
