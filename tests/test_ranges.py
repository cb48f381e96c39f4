import random

from pyspark.sql import functions as F

from framewise.operators import ranges, sampling


def order_key(r):
    return tuple((v is not None, v) if not isinstance(v, str) else (True, v.encode()) for v in r)


def test_numbers_by_text_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("scene-" + (f"{rng.randint(0, 9999):04d}" if rng.random() < 0.5 else "hot"), i, rng.randint(-3, 9)) for i in range(4000)] + [(None, -1, 1), (None, -2, 2), ("", 5000, 3), ("Ü", 5001, 4), ("\U0001f600", 5002, 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, k long, v long").repartition(6)
    got = {(r.name, r.k): (r.at, r.total) for r in ranges.running(ranges.numbered(df, ["name", "k"], "at"), ["name", "k"], F.col("v"), "total").collect()}
    total = 0
    for i, r in enumerate(sorted(rows, key=order_key)):
        total += r[2]
        assert got[r[0], r[1]] == (i + 1, total)
    cut = df.withColumn("_range", ranges.row_place(df, ["name", "k"], ranges.row_cuts(df, ["name", "k"], 32)))
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) >= 28 and max(sizes) < 3 * 4005 / 32  # half of all rows share one name


def test_numbers_with_a_hot_leading_number(spark):
    rows = [(7 if i % 10 else i, f"n{(i * 37) % 2000:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b string")
    got = {(r.a, r.b): r.at for r in ranges.numbered(df, ["a", "b"], "at", 16).collect()}
    assert got == {r: i + 1 for i, r in enumerate(sorted(rows))}
    assert ranges.numbered(df.where("false"), ["b"], "at").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strata_keep_few_rows_before_they_meet(spark):
    rows = [(i, "abc"[i % 3], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, s string, p int")
    out = sampling.round_robin(df, 7, stratum="s", priority="p", order=["k"])
    assert "WindowGroupLimit [s" in plan(out) and "Partial" in plan(out)
    assert [r.k for r in out.collect()] == [0, 1, 2, 3, 4, 5, 6]
    seen = sampling.interleaved(df.select("k", "s").union(df.where("k % 4 = 0").select("k", F.lit("d"))), category="s", item="k", order=["k"], cap=6)
    assert sorted((r.position, r.k, r.reasons) for r in seen.collect()) == [(1, 0, "a,d"), (2, 1, "b"), (3, 2, "c"), (4, 3, "a"), (5, 4, "b,d"), (6, 5, "c")]
