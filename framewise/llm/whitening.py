"""Whitening of embeddings on the leading components, found by matrix-free block Lanczos (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import Scratch

#: Vectors of one Krylov block, and bytes of vectors that a task works on at a time.
BLOCK, SLICE = 8, 8 << 20
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """Components of the fit list: unit vectors (columns), their variances, and what they were derived from."""

    components: np.ndarray
    variances: np.ndarray
    n: int
    sums: tuple[int, ...]
    trace: float
    identity_error: float


def finite_vectors(rows: DataFrame, vector_col: str = "embedding", scale: float = 256.0, into: str = "x") -> DataFrame:
    """Rows whose vector is not null and holds no null or non-finite entry, with `into`: floor(scale * entry) as longs.

    Entries beyond a long's range become its bound.
    """
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(good).withColumn(into, F.transform(v, lambda c: F.floor(c * F.lit(scale)).cast("bigint")))


def _matrices(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Rows of a list column as int64 matrices of d columns, a bounded slice at a time; shorter vectors end in zeros."""
    step = max(1, SLICE // (8 * max(d, 1)))
    for i in range(0, len(column), step):
        part = column.slice(i, step)
        values, sizes = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(part.offsets.to_numpy())
        if (sizes == d).all():
            yield values.reshape(len(part), d)
        else:
            out = np.zeros((len(part), d), np.int64)
            out[np.repeat(np.arange(len(part)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
            yield out


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: in longs where they hold it, else in Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max((abs(s) for s in sums), default=0) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _deviations(x, n, sums).astype(np.float64) / n


def squares(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 of each row, exactly."""
    y = _deviations(x, n, sums)
    if y.dtype == object or (len(y) and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2.0**62):
        y = y.astype(object)
        return [int(s) for s in (y * y).sum(axis=1)] if y.shape[1] else [0] * len(y)
    return np.einsum("ij,ij->i", y, y).tolist()


def _added(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of `part`, which gives `size` doubles for a matrix of rows. Tasks add up what they hold; Spark
    adds the tasks' sums place by place, so the driver gets `size` numbers whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in _matrices(batch.column(0), d):
                total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "value"])

    rows = fit.select("x").mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.place] = r.value
    return out


def _fresh(rng: np.random.Generator, basis: np.ndarray, k: int) -> np.ndarray:
    """k random unit vectors, orthogonal to the basis and each other (fewer where the space is full)."""
    out = np.zeros((len(basis), 0))
    while out.shape[1] < min(k, len(basis) - basis.shape[1]):
        v = rng.standard_normal(len(basis))
        for _ in range(3):
            v -= basis @ (basis.T @ v) + out @ (out.T @ v)
            v /= np.linalg.norm(v)
        out = np.column_stack([out, v])
    return out


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, tolerance: float | None = None, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the `wanted` leading eigenpairs of a symmetric d x d matrix that is only known by its products.

    `product(Q)` multiplies a d x b block. Every new block is orthogonalised twice against the whole basis. Columns that
    vanish in that (a breakdown: the Krylov space is invariant) are replaced by fresh random ones, so multiple eigenvalues
    are found too. Stops when the residuals of all wanted pairs are at most `tolerance` times the largest value (by default
    what rounding leaves of a product of d terms), or when the basis spans the space. Holds d x (basis) numbers, no d x d matrix unless the basis gets there.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    tolerance = 8 * np.finfo(float).eps * np.sqrt(d) if tolerance is None else tolerance
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    now = _fresh(rng, basis, min(block, d))
    while True:
        found = product(now)
        basis, image = np.column_stack([basis, now]), np.column_stack([image, found])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:wanted]
        values, turn = values[order], turn[:, order]
        vectors = basis @ turn
        left = np.linalg.norm(image @ turn - vectors * values, axis=0)
        if basis.shape[1] == d or (len(order) == wanted and (left <= tolerance * max(values[0], 0.0)).all()):
            return values, vectors
        rest, size = found, np.linalg.norm(found, axis=0)
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        kept = np.zeros((d, 0))
        for k in range(rest.shape[1]):
            v = rest[:, k]
            for _ in range(2):
                v = v - kept @ (kept.T @ v) - basis @ (basis.T @ v)
            if (norm := np.linalg.norm(v)) > 1e-10 * max(size[k], 1e-300) and basis.shape[1] + kept.shape[1] < d:
                v = v / norm
                v = v - kept @ (kept.T @ v) - basis @ (basis.T @ v)
                kept = np.column_stack([kept, v / np.linalg.norm(v)])
        broken = rest.shape[1] - kept.shape[1]
        now = np.column_stack([kept, _fresh(rng, np.column_stack([basis, kept]), broken)])


def fit_whitening(vectors: DataFrame, components: int = 4, block: int = BLOCK) -> Whitening | None:
    """The leading components of the distinct vectors `x` (arrays of longs without nulls); None where there is no vector.

    The covariance is never formed: each step is one pass over the distinct vectors (a written table) that multiplies the
    centred vectors and their transposes with a block, task by task. n, S and the sum of deviations are exact integers;
    that sum gives the trace, so shares need no further components. Components without variance are left out. The dimension is
    that of the longest vector; shorter ones end in zeros.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    n, d = (widest := vectors.agg(F.count("*"), F.max(F.size("x"))).first())[0], widest[1] or 0
    if not n or not d:
        return None
    short = F.lit(d) - F.size("x")
    fit = scratch.table(vectors.select(F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), short)).alias("x")).distinct())
    n = fit.count()
    each = fit.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    got = {r.place: int(r.s) for r in each.collect()}
    sums = tuple(got[i] for i in range(d))

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return (y.T @ (y @ q)).reshape(-1)

        return _added(fit, d, q.size, part).reshape(q.shape) / n

    values, found = block_lanczos(times, d, components, block)

    def deviation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(squares(x, n, sums)) for batch in batches for x in _matrices(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["value"])

    # sums of tasks are added in two parts, as they may be longer than a decimal
    parts = fit.mapInArrow(deviation, "value string")
    parts = parts.select(F.lpad("value", 60, "0").alias("v")).select(*(F.substring("v", 1 + 20 * i, 20).cast("decimal(38,0)").alias(f"p{i}") for i in range(3)))
    high = parts.agg(*(F.sum(f"p{i}") for i in range(3))).first()
    total = sum(int(x or 0) * 10 ** (20 * (2 - i)) for i, x in enumerate(high))
    trace = total / n**3
    some = values > 1e-13 * max(trace, 0.0)
    values, found = values[some], found[:, some]
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ found / np.sqrt(values)
        return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])

    told = _added(fit, d, k + k * k, moments) / n
    error = np.abs(told[k:].reshape(k, k) - np.outer(told[:k], told[:k]) - np.eye(k)).max(initial=0.0)
    return Whitening(found, values, n, sums, trace, float(error))


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each component of every vector.

    deviation is exact, and null where it exceeds a long. Rows need not be in the fit list. No model: no rows.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, k = model.components.shape
    turn, shares = model.components / np.sqrt(model.variances), model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices(batch.column(1), d):
                m = len(x)
                far = [s if s <= _LONG else None for s in squares(x, model.n, model.sums)]
                w = centred(x, model.n, model.sums) @ turn
                take = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column(0).slice(at, m).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(far, pa.int64()).take(take), pa.array(w.reshape(-1)), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += m

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
