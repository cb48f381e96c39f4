import math
import random

import numpy as np
import pytest

from framewise.operators import bootstrap


def draw_counts(n, side, iterations, seed="seed"):
    """How often each row is drawn, one draw after the other in Python's integers."""
    import hashlib

    start, p = int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) % bootstrap.PRIME, bootstrap.PRIME
    out = np.zeros((iterations, n), int)
    for t in range(iterations):
        at, e = [], 0.0
        for i in range(n + 1):
            h = (i + 1) % p
            for k in bootstrap.KEYS:
                h = pow(h + (t * 2 + side + start) % p * k, 5, p)
            e -= math.log((h + 0.5) / p)
            at.append(e)
        for s in at[:-1]:
            out[t, math.floor(n * s / e)] += 1
    return out


def auc(picks, rejects, w, v):
    wins = sum(a * b * (1.0 if x > y else 0.5 if x == y else 0.0) for x, a in zip(picks, w, strict=True) for y, b in zip(rejects, v, strict=True))
    return wins / (sum(w) * sum(v))


def plain(rows, iterations):
    sides = [sorted(r for r in rows if r[1] == label and r[2] is not None and r[3] is not None) for label in ("pick", "reject")]
    counts = [draw_counts(len(s), i, iterations) for i, s in enumerate(sides)]
    delta = lambda w, v: auc([r[2] for r in sides[0]], [r[2] for r in sides[1]], w, v) - auc([r[3] for r in sides[0]], [r[3] for r in sides[1]], w, v)
    found = sorted(delta(counts[0][t], counts[1][t]) for t in range(iterations))
    return delta([1] * len(sides[0]), [1] * len(sides[1])), found[max(0, math.floor(iterations * 0.025) - 1)], found[min(iterations - 1, math.ceil(iterations * 0.975) - 1)]


def test_against_single_draws(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["pick", "reject", "neutral"]), float(rng.randint(0, 9)), rng.gauss(0, 1)) for i in range(60)] + [(100, "pick", None, 1.0), (101, "reject", 1.0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, label string, l double, r double").repartition(5)
    got = bootstrap.bootstrap_delta(df, key="k", left="l", right="r", iterations=80).first()
    assert tuple(got) == pytest.approx(plain(rows, 80), abs=1e-12)


def test_several_blocks_and_one_hot_value(spark):
    rng = random.Random(5)
    rows = [(i, "pick" if i % 3 else "reject", 1.0 if i % 2 else float(i % 50), rng.random()) for i in range(3600)]
    df = spark.createDataFrame(rows, "k long, label string, l double, r double")
    got = bootstrap.bootstrap_delta(df, key="k", left="l", right="r", iterations=6).first()
    sides = [[r for r in rows if r[1] == x] for x in ("pick", "reject")]
    counts = [draw_counts(len(s), i, 6) for i, s in enumerate(sides)]

    def fast(c, t):  # ranks of values repeated as often as drawn
        p, n = (np.repeat([r[c] for r in s], k[t]) for s, k in zip(sides, counts, strict=True))
        n = np.sort(n)
        return (np.searchsorted(n, p) + np.searchsorted(n, p, "right")).sum() / 2 / len(p) / len(n)

    deltas = sorted(fast(2, t) - fast(3, t) for t in range(6))
    assert (got.low, got.high) == pytest.approx((deltas[0], deltas[5]), abs=1e-12)


def test_draws_are_multinomial():
    e = np.concatenate([bootstrap.exponentials(7, s, 2000, 0, 201) for s in (0, 1)])
    at = np.cumsum(e, axis=1)
    row = np.floor(200 * at[:, :200] / at[:, -1:]).astype(int)
    counts = np.array([np.bincount(r, minlength=200) for r in row])
    assert np.allclose(counts.mean(axis=0), 1, atol=0.08) and abs(counts.var() - 199 / 200) < 0.02
    assert abs(np.corrcoef(counts[:, 3], counts[:, 150])[0, 1]) < 0.07 and abs(np.corrcoef(counts[:2000].ravel(), counts[2000:].ravel())[0, 1]) < 0.01


def test_a_class_without_rows_raises(spark):
    df = spark.createDataFrame([(1, "pick", 1.0, 1.0), (2, "reject", None, 1.0)], "k long, label string, l double, r double")
    with pytest.raises(ValueError, match="picks and rejects"):
        bootstrap.bootstrap_delta(df, key="k", left="l", right="r")
