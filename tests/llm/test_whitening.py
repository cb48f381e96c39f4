import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import queries
from framewise.llm.whitening import block_lanczos, finite_vectors, fit_whitening, whiten

SF = "/root/testdata/sf0.01"


def plain(rows, k=4):
    """(n, deviation by row, whitened by row, shares) by a dense covariance of the distinct integer vectors."""
    x = [tuple(int(np.floor(256 * np.float64(c))) for c in v) for v in rows]
    d = max(map(len, x))
    x = [v + (0,) * (d - len(v)) for v in x]
    fit = sorted(set(x))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    w = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x]) @ q / np.sqrt(e)
    return n, [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x], w, e / np.trace(y.T @ y / n)


def compare(got, rows, close=1e-9):
    n, deviation, w, shares = plain([v for _, v in rows])
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == 4 * len(rows)
    for i, (k, _) in enumerate(rows):
        for c in range(1, 5):
            r = by[k, c]
            assert (r.n, r.deviation) == (n, deviation[i] if deviation[i] < 2**63 else None) and r.identity_error <= close and abs(r.explained - shares[c - 1]) <= close * shares[c - 1]
    for c in range(4):
        mine = np.array([by[k, c + 1].whitened for k, _ in rows])
        assert min(np.abs(mine - w[:, c]).max(), np.abs(mine + w[:, c]).max()) < 10 * close


def test_whole_table_against_a_dense_covariance(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(queries.QUERIES["op12_whitening"](spark, SF).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 10.0 ** rng.integers(-3, 3), 7)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000, [1.0, -0.0]), (2001, [1e6] * 7)]
    bad = [(3000, None), (3001, [1.0, None] + [0.0] * 5), (3002, [float("nan")] * 7), (3003, [float("-inf")] + [0.0] * 6)]
    df = spark.createDataFrame([(*r, "a", 0) for r in rows + bad], "vec_id long, embedding array<double>, x string, component int")
    vectors = finite_vectors(df)
    compare(whiten(vectors, fit_whitening(vectors.select("x"))).collect(), rows, 1e-6)  # variances from 1e10 to 1e3: each is known to 1e-16 of the greatest
    assert fit_whitening(vectors.where("false").select("x")) is None
    assert whiten(vectors, None).collect() == []


def test_few_and_huge_vectors(spark):
    one = spark.createDataFrame([(1, [0.5, 1.5]), (2, [0.5, 1.5]), (None, [0.5, 1.5])], "vec_id long, embedding array<float>")
    vectors = finite_vectors(one)
    assert whiten(vectors, fit_whitening(vectors.select("x"))).collect() == []  # no variance
    line = finite_vectors(spark.createDataFrame([(1, [1.0, 1.0]), (None, [2.0, 2.0])], "vec_id long, embedding array<float>"))
    got = whiten(line, fit_whitening(line.select("x"))).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [(1, 1, 2, 2 * 256**2), (None, 1, 2, 2 * 256**2)]
    assert [abs(r.whitened) for r in got] == pytest.approx([1, 1]) and got[0].explained == pytest.approx(1)
    far = finite_vectors(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>"))
    got = whiten(far, fit_whitening(far.select("x"))).collect()
    assert {r.deviation for r in got} == {None} and abs(got[0].whitened) == pytest.approx(1)


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q * np.array(values) @ q.T


@pytest.mark.parametrize("values", [[5.0] * 6 + [1.0] * 40, [9.0, 9.0, 3.0] + [0.0] * 50, list(1.0 + np.arange(60) / 60), [2.0**-i for i in range(90)], [3.0, 1.0], [0.0] * 5])
def test_block_lanczos(values):
    a = matrix(values)
    steps = []
    e, v = block_lanczos(lambda q: steps.append(q) or a @ q, len(values), 4)
    k = min(4, len(values))
    assert np.allclose(e, sorted(values)[::-1][:k], atol=1e-12)
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-13) and np.abs(a @ v - v * e).max() <= 1e-12
    q = np.column_stack(steps)
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12


def test_no_more_passes_than_needed():
    a, steps = matrix([100.0, 50.0, 20.0, 10.0] + [1e-3] * 400), []
    block_lanczos(lambda q: steps.append(1) or a @ q, 404, 4)
    assert len(steps) <= 6
