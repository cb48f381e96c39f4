import random

import pytest
from pyspark.sql import functions as F

from framewise.functions import scalars
from framewise.operators import dedup, suppression

near_hash = lambda bits: lambda r, k: scalars.hamming(r["hash"], k["hash"]) <= bits


def folded(rows, near):
    """Plain fold: (group, name, anchor) of (group, name, score, value) rows."""
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g, some in groups.items():
        kept = []
        for r in sorted(some, key=lambda r: (r[2], r[1]), reverse=True):
            anchor = next((k[1] for k in kept if r[3] is not None and near(r[3], k[3])), None)
            if anchor is None and r[3] is not None:
                kept.append(r)
            out.append((g, r[1], anchor))
    return sorted(out, key=str)


def close(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count() <= 3


def hashes(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(max(2, n // 20))]
    for _ in range(n):
        h = rng.choice(seeds) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        yield f"{h:016x}"


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "g string, name string, score double, hash string")
    got = suppression.suppress_near(df, group="g", name="name", order=[F.col("score")], fields=["hash"], near=near_hash(3), keys=lambda f: suppression.block_keys(f["hash"], 3, 1000), **options)
    return sorted(map(tuple, got.collect()), key=str)


def test_rounds_equal_the_fold(spark):
    rng = random.Random(1)
    rows = [("a", f"n{i}", float(rng.randint(0, 50)), h) for i, h in enumerate(hashes(rng, 400))]
    rows += [("b", f"n{i}", 1.0, h) for i, h in enumerate(hashes(rng, 60))] + [(None, f"n{i}", None if i % 7 == 0 else 2.0, h) for i, h in enumerate(hashes(rng, 60))]
    rows += [("a", f"z{i}", 60.0, None) for i in range(5)] + [("c", f"n{i}", float(i % 3), "00000000000000ff") for i in range(80)] + [("d", "one", 1.0, "0" * 16)]
    want = folded([(g, n, -1.0 if s is None else s, h) for g, n, s, h in rows], close)
    assert sum(a is not None for _, _, a in want) > 150
    assert run(spark, rows, first=16, fold=40) == want
    assert run(spark, rows, fold=1000) == want


def test_a_chain_whose_order_runs_along_it(spark):
    rows = [("a", f"n{i:03d}", float(-i), f"{(1 << i) - 1:016x}") for i in range(64)]
    assert run(spark, rows, first=8, fold=0) == folded(rows, close)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_clump_makes_no_pairs(spark):
    """40,000 rows in a few clumps and one hot hash: the joins stay linear, the result is the fold's by its own rules."""
    base = spark.range(40_000).select(F.lit("g").alias("g"), F.format_string("n%06d", "id").alias("name"), (F.xxhash64("id") % 1000).cast("double").alias("score"), "id")
    bit = F.expr("lpad(lower(hex(shiftleft(1L, cast(id % 60 as int)))), 16, '0')")
    df = base.select("g", "name", "score", F.when(F.col("id") % 3 == 0, "0" * 16).otherwise(bit).alias("hash"))
    got = suppression.suppress_near(df, group="g", name="name", order=[F.col("score")], fields=["hash"], near=near_hash(3), keys=lambda f: suppression.block_keys(f["hash"], 3, 40_000))
    kept = got.where("anchor is null").collect()
    assert len(kept) == 1 and got.where("anchor is not null").select("anchor").distinct().collect()[0][0] == kept[0].name and got.count() == 40_000


@pytest.mark.parametrize(("radius", "rows"), [(2, 10), (6, 1_000_000), (20, 500)])
def test_keys_of_near_hashes_meet(spark, radius, rows):
    rng = random.Random(radius)
    pairs = []
    for i in range(200):
        a = rng.getrandbits(64)
        z = a
        for b in rng.sample(range(64), radius):
            z ^= 1 << b
        pairs.append((i, f"{a:016x}", f"{z:016x}"))
    df = spark.createDataFrame(pairs, "i int, a string, z string")
    keys = lambda c: suppression.block_keys(F.col(c), radius, rows)
    assert df.where(F.arrays_overlap(keys("a"), keys("z"))).count() == 200


def test_pairs_within_a_step(spark):
    values = [random.Random(i).uniform(0, 50) for i in range(100)] + [1.0, 1.0, 3.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, name long, value double")
    got = suppression.near_pairs(df, group="g", name="name", fields=["value"], near=lambda r, k: F.abs(r["value"] - k["value"]) <= 2, keys=lambda f: suppression.step_keys(f["value"], 2))
    assert {tuple(r) for r in got.collect()} == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if abs(values[i] - values[j]) <= 2}


def test_fold_is_unchanged(spark):
    df = spark.createDataFrame([("a", "x", 1.0, "0" * 16), ("a", "y", 2.0, "0" * 16)], "g string, name string, score double, hash string")
    assert {tuple(r) for r in dedup.greedy(df, group="g", name="name", order=[F.col("score")], fields=["hash"], near=near_hash(0)).collect()} == {("a", "x", "y"), ("a", "y", None)}


@pytest.mark.parametrize("block", [16, 10_000])
def test_hash_pairs_compare_each_two_rows_once(spark, block, monkeypatch):
    rng = random.Random(9)
    rows = [(g, i, h) for i, (g, h) in enumerate(zip(("a", "b", None) * 40, hashes(rng, 120), strict=True))] + [("a", 500, None), ("a", 501, "f" * 16), ("a", 502, "f" * 15 + "e")]
    df = spark.createDataFrame(rows, "g string, name long, hash string")
    monkeypatch.setattr(suppression, "_met", None)  # keys of three bits meet nearly every pair, several times
    got = sorted(map(tuple, suppression.hash_pairs(df, group="g", name="name", hash_="hash", radius=20, block=block).collect()))
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == sorted((a[1], b[1], far(a[2], b[2])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] and b[2] and far(a[2], b[2]) <= 20)
    assert suppression.hash_pairs(df.where("false"), group="g", name="name", hash_="hash", radius=20).count() == 0
