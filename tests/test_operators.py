from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framewise.functions import scalars, tiles
from framewise.operators import bootstrap, dedup, evaluate, logs, models, ranking, sampling, scenes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_scenes_by_gap_and_sequence(spark):
    t = datetime(2024, 1, 1)
    df = frame(spark, [(f"DSC000{i}", "a", t, i) for i in (1, 2, 8)], "stem string, folder string, mtime timestamp_ntz, seq long")
    got = scenes.assign_scenes(df, folder="folder", time="mtime", order=["seq"], sequence="seq", max_gap=999, max_step=2)
    assert rows(got.select("stem", "scene_id", "scene_index")) == [("DSC0001", "scene-0001", 1), ("DSC0002", "scene-0001", 2), ("DSC0008", "scene-0002", 1)]
    gaps = frame(spark, [(1, "a", t, 0), (2, "a", t + timedelta(seconds=4), 9), (3, "a", t + timedelta(seconds=8, microseconds=1), 10), (4, "b", t, 0)], "k long, folder string, mtime timestamp_ntz, seq long")
    got = scenes.assign_scenes(gaps, folder="folder", time="mtime", order=["k"], sequence="seq")
    assert rows(got.select("k", "scene_number")) == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert {r.k for r in scenes.limit_scenes(got, 1).collect()} == {1, 2}


def test_blend_orders_and_misses(spark):
    data = [("A", 400.0, 10.0), ("B", 400.0, 1.0), ("C", 100.0, 3.0), ("D", 200.0, 5.0), ("E", 500.0, 7.0)]
    df = frame(spark, data, "name string, local double, learned double")
    got = {r.name: r.s for r in ranking.blend(df, "local", "learned", 0.25, "s").collect()}
    assert got["A"] == pytest.approx(0.75 * 0.625 + 0.25)
    with pytest.raises(Exception, match="no learned"):
        ranking.blend(df.withColumn("learned", F.nullif("learned", F.lit(1.0))), "local", "learned", 0.25).collect()
    with pytest.raises(ValueError):
        ranking.blend(df, "local", "learned", 2)
    assert rows(ranking.average_percentile(df.limit(1), "local", "p").select("p")) == [(0.5,)]


def test_score_truthiness(spark):
    df = frame(spark, [(0.0,), (None,), (118.0,), (100.0,)], "b double")
    zero = F.lit(None).cast("double")
    got = [r[0] for r in df.select(ranking.local_score(zero, zero, zero, zero, zero, zero, zero, F.col("b"))).collect()]
    assert got == [0.0, 0.0, 0.0, pytest.approx(-2.7)]


def test_gate(spark):
    df = frame(spark, [(True, True, True, None, 2), (None, True, True, True, 1), (True, True, True, True, 2), (True, True, None, None, 1), (True, False, True, True, 1)], "a boolean, b boolean, c boolean, d boolean, n int")
    weak, votes, _ = ranking.gate([F.col("a"), F.col("b")], [F.col("c"), F.col("d")], 1)
    assert [tuple(r) for r in df.select(weak & (votes >= F.greatest(F.lit(1), F.col("n")))).collect()] == [(False,), (False,), (True,), (False,), (False,)]


def test_labels_and_decisions(spark):
    df = frame(spark, [(None, -1, 0), (None, 0, 1), (None, 0, 0), (True, -1, -1), (False, 5, 1)], "good boolean, rating int, pick int")
    label = ranking.human_label(F.col("good"), F.col("rating"), F.col("pick"))
    assert [r[0] for r in df.select(label).collect()] == ["reject", "pick", "neutral", "pick", "reject"]
    with pytest.raises(Exception, match="conflicting"):
        frame(spark, [(None, -1, 1)], "good boolean, rating int, pick int").select(label).collect()
    assert spark.range(1).select(ranking.legacy_bucket(F.lit(None).cast("string"), F.lit(True))).first()[0] == "pick"


def test_auc_ties_and_evaluation(spark):
    df = frame(spark, [("s", "pick", 2.0), ("s", "pick", 1.0), ("s", "reject", 1.0)], "signal string, label string, value double")
    assert evaluate.auc(df, by=["signal"]).first().auc == 0.75
    one = frame(spark, [("s", "x", "pick", 3.0), ("s", "x", "reject", 1.0), ("s", "x", "reject", 2.0)], "signal string, burst string, label string, value double")
    b = evaluate.burst_metrics(one, by=["signal"], burst="burst", order=[F.desc("value")]).first()
    assert (b.pairwise, b.top1, b.top3) == (1.0, 1.0, 1.0)
    s = evaluate.signal_summary(one, ["signal"]).first()
    assert (s.zero_fr_rejects, s.zero_fr_coverage) == (2, 2 / 3)
    assert evaluate.auc(df.where("label = 'pick'"), by=["signal"]).first().auc is None
    nan = frame(spark, [(1, float("nan"), float("inf"), None, 1.0)], "k int, a double, b double, c double, d double")
    assert [r.signal for r in evaluate.long_signals(nan, ["a", "b", "c", "d"], ["k"]).collect()] == ["d"]


def test_bootstrap_and_confusion(spark):
    df = frame(spark, [(1, "pick", 3.0, 2.0), (2, "reject", 1.0, 2.0)], "k int, label string, l double, r double")
    assert tuple(bootstrap.bootstrap_delta(df, key="k", left="l", right="r", iterations=20).first()) == (0.5, 0.5, 0.5)
    c = evaluate.gate_confusion(df.withColumn("rejected", F.col("label") == "reject")).first()
    assert (c.precision, c.false_reject_rate, c.recall) == (1.0, 0.0, 1.0)


def test_cap_cohorts_and_rescue(spark):
    df = frame(spark, [("A", "s1", 500.0), ("B", "s1", 400.0), ("C", "s1", 300.0), ("D", "s2", 200.0)], "name string, scene string, score double")
    top = scenes.top_per_scene(df, 2, scene="scene", order=[F.desc("score"), "name"])
    assert {r.name for r in top.collect()} == {"A", "B", "D"}
    got = scenes.cohorts(df, 2, scene="scene", order=[F.desc("score")])
    assert rows(got.select("name", "cohort_number")) == [("A", 1), ("B", 1), ("C", 2), ("D", 3)]
    low = frame(spark, [("A", "s", 95.0, False), ("B", "s", 80.0, False), ("C", "t", 20.0, False), ("D", "u", 99.0, True)], "name string, scene string, blur double, ready boolean")
    assert [r.name for r in scenes.rescue(low, scene="scene", ready="ready", order=[F.desc("blur")], floors={"blur": 110.0}).collect()] == ["A"]


def greedy_plain(items, t):
    kept, out = [], {}
    for name, h in items:
        anchor = next((k for k, g in kept if h is not None and g is not None and (int(h, 16) ^ int(g, 16)).bit_count() <= t), None)
        out[name] = anchor
        if anchor is None:
            kept.append((name, h))
    return out


def test_greedy_fold_against_plain(spark):
    import random

    rng = random.Random(5)
    data = [(f"n{i:03d}", f"s{i % 3}", float(rng.randint(0, 9)), None if i % 11 == 0 else f"{rng.getrandbits(4) | (i % 3) << 60:016x}") for i in range(120)]
    df = frame(spark, data, "name string, scene string, score double, hash string")
    got = {r.name: r.anchor for r in dedup.greedy(df, group="scene", name="name", order=[F.col("score")], fields=["hash"], near=lambda r, k: F.coalesce(scalars.hamming(r["hash"], k["hash"]) <= 1, F.lit(False))).collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        want |= greedy_plain([(n, h) for n, g, v, h in sorted(data, key=lambda r: (r[2], r[0]), reverse=True) if g == s], 1)
    assert got == want and any(got.values())


def test_samples(spark):
    df = spark.range(10)
    assert sorted(r.id for r in sampling.evenly_spaced(df, 4, order=["id"]).collect()) == [1, 3, 6, 8]
    with pytest.raises(Exception, match="larger"):
        sampling.evenly_spaced(df, 11, order=["id"]).collect()
    folders = frame(spark, [(f, f"{f}{i}") for f in "abcd" for i in range(30)], "folder string, name string")
    got = sampling.balanced(folders, folder="folder", name="name", folders=3, total=7, seed="x")
    assert sorted(r["count"] for r in got.groupBy("folder").count().collect()) == [2, 2, 3]
    assert rows(got) == rows(sampling.balanced(folders, folder="folder", name="name", folders=3, total=7, seed="x"))
    numbers = frame(spark, [("g", f"n{i}", i if i % 10 else None) for i in range(50)], "g string, name string, s long")
    kept = [int(r.name[1:]) for r in dedup.gap_sample(numbers, group="g", name="name", sequence="s", order=scalars.draw("name"), gap=10).collect()]
    with_number = sorted(k for k in kept if k % 10)
    assert all(b - a >= 10 for a, b in zip(with_number, with_number[1:], strict=False)) and {0, 10, 20, 30, 40} <= set(kept)
    strata = frame(spark, [(1, "pick", 0), (2, "pick", 0), (3, "reject", 1), (4, "neutral", 2)], "k long, label string, p int")
    assert {r.label for r in sampling.round_robin(strata, 3, stratum="label", priority="p", order=["k"]).collect()} == {"pick", "reject", "neutral"}


def test_logs(spark, tmp_path):
    log = frame(spark, [("a", 1, "bad"), ("a", 2, "ok"), ("b", 1, None)], "k string, offset long, status string")
    assert rows(logs.latest(log, key=["k"], offset="offset")) == [("a", 2, "ok"), ("b", 1, None)]
    base = frame(spark, [("frame.arw",)], "k string")
    merged = logs.merge_signals(base, [frame(spark, [("frame.arw", "q", 5.0), ("other", "q", 1.0)], "k string, signal string, value double"), frame(spark, [("frame.arw", "q", None)], "k string, signal string, value double")], "k")
    assert rows(merged) == [("frame.arw", "q", None)]
    pair = frame(spark, [("raw", None, 4), ("jpg", "raw", None)], "k string, partner string, rating int")
    assert rows(logs.mirror_pairs(pair, key="k", partner="partner", columns=["rating"])) == [("jpg", "raw", 4), ("raw", None, 4)]
    path = str(tmp_path / "locked")
    logs.write_or_verify(base, path)
    logs.write_or_verify(base, path)
    with pytest.raises(ValueError):
        logs.write_or_verify(frame(spark, [("x",)], "k string"), path)
    with pytest.raises(Exception, match="gone"):
        logs.required(log, "status", "gone").collect()
    cache = frame(spark, [("a", {"q": 1.0, "r": 2.0}), ("b", {"q": 1.0})], "k string, signals map<string,double>")
    assert rows(logs.cache_hits(log.select("k").distinct(), cache, ["k"], ["q", "r"])) == [("a",)]


def test_models(spark):
    human = ["reject", "review", "pick"]
    data = [(i, h, h, "review") for i, h in enumerate(human)]
    df = frame(spark, data, "item long, human string, a string, b string")
    long = df.select("item", "human", F.expr("stack(2, 'a', a, 'b', b) as (model, p)"))
    exact = {r.model: r.exact for r in models.ordinal_accuracy(long, by=["model"], human="human", predicted="p").collect()}
    assert exact == {"a": 3, "b": 1}
    assert tuple(models.paired_wins(df, item="item", human="human", left="a", right="b").first()) == (2, 0, 1)


def test_scalars(spark):
    df = frame(spark, [("DSC0012",), ("x",), ("Ab--c 9!",)], "s string")
    assert [r[0] for r in df.select(scalars.sequence_suffix(F.col("s"))).collect()] == [12, 0, 0]
    assert df.select(scalars.slug(F.col("s"))).collect()[2][0] == "ab-c-9"
    one = spark.range(1)
    h = lambda a, b: one.select(scalars.hamming(F.lit(a), F.lit(b))).first()[0]
    assert h("ffffffffffffffff", "0000000000000000") == 64 and h("8000000000000001", "8000000000000000") == 1
    assert one.select(scalars.loose_int(F.lit("3.9")), scalars.strict_int(F.lit("3.9")), scalars.strict_int(F.lit(" -4 ")), scalars.loose_bool(F.lit("YES")), scalars.loose_bool(F.lit("yes"), wide=False)).first()[:] == (3, None, -4, True, None)
    assert one.select(scalars.percent(F.lit(0.125)), scalars.metric(F.lit(None).cast("double"))).first()[:] == ("12.5%", "n/a")
    assert one.select(scalars.stem(F.lit("/a/b.c/D.e.ARW")), scalars.parent(F.lit("/a/b.c/D.e.ARW"))).first()[:] == ("D.e", "/a/b.c")


def test_tiles(spark):
    flat = spark.range(1).select(F.array_repeat(F.lit(3.0), 64).alias("t"))
    assert flat.select(tiles.contrast(tiles.laplacian(F.col("t"), 8)), tiles.mean(tiles.gradient(F.col("t"), 8)), tiles.sign_hash(F.col("t")), tiles.quantile(F.col("t"), 0.9)).first()[:] == (0.0, 0.0, "f" * 16, 3.0)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_signals_are_not_dealt_out_by_signal(spark):
    """One value in four of all rows met in one task, where the floors' size was left to an estimate."""
    long = spark.range(4000).selectExpr("'s' || id % 4 as signal", "cast(id % 100 as double) as value", "case when id % 3 = 0 then 'pick' else 'reject' end as label")
    out = evaluate.signal_summary(long, ["signal"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert shuffles(out) == 2  # both of partial sums
    assert out.where("signal = 's0'").first().available == 1000


def test_bursts_are_dealt_out_once(spark):
    wide = spark.range(4000).selectExpr("'n' || id as name", "id % 500 as burst", "case (id * id div 500) % 5 when 0 then 'pick' when 1 then 'reject' else 'neutral' end as label", "cast((id * 31 + id div 500) % 7 as double) as x", "if(id % 5 > 0, cast(id div 500 % 3 as double), null) as y")
    order = [F.desc("value"), F.lower("name"), "label"]
    dealt = evaluate.burst_metrics(evaluate.long_signals(wide, ["x", "y"], ["name", "burst", "label"], "burst"), by=["signal"], burst="burst", order=order)
    assert shuffles(dealt) == 2  # the rows, and sums a signal
    plain = evaluate.long_signals(wide, ["x", "y"], ["name", "burst", "label"]).collect()
    want = {}
    for s in ("x", "y"):
        bursts = {}
        for r in plain:
            if r.signal == s:
                bursts.setdefault(r.burst, []).append(r)
        good = [b for b in bursts.values() if {"pick", "reject"} <= {r.label for r in b}]
        pairs = [(p.value > q.value) + (p.value == q.value) / 2 for b in good for p in b for q in b if p.label == "pick" and q.label == "reject"]
        tops = [[r.label for r in sorted(b, key=lambda r: (-r.value, r.name, r.label))[:3]] for b in good]
        want[s] = (len(good), sum(pairs) / len(pairs), sum(t[0] == "pick" for t in tops) / len(good), sum("pick" in t for t in tops) / len(good))
    got = {r.signal: (r.bursts, r.pairwise, r.top1, r.top3) for r in dealt.collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for s in want for a, b in zip(got[s], want[s], strict=True))


def test_rows_without_a_partner_are_dealt_by_their_own_key(spark):
    data = [(k, k - 1 if k % 10 == 9 else None, None if k % 10 == 9 else k % 7) for k in range(5000)] + [(5001, 5000, None), (None, None, 3), (5003, 5002, None), (5002, None, None)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        got = logs.mirror_pairs(frame(spark, data, "k long, partner long, rating int"), key="k", partner="partner", columns=["rating"])
        told = got.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    own = {k: r for k, _, r in data}
    assert sorted(((r.k, r.partner, r.rating) for r in told), key=str) == sorted(((k, p, own.get(p) if r is None and p is not None else r) for k, p, r in data), key=str)
    held = [sum(r.task == t for r in told) for t in {r.task for r in told}]
    assert max(held) < len(data) / 4


def test_chunks_of_one_large_scene_are_counted_before_they_are_numbered(spark):
    df = frame(spark, [(s, i) for s, n in ((1, 3), (2, 5000), (4, 1)) for i in range(n)], "scene long, at int")
    got = scenes.cohorts(df, 2, scene="scene", order=["at"])
    want = [(1, 0, 1), (1, 1, 1), (1, 2, 2)] + [(2, i, 3 + i // 2) for i in range(5000)] + [(4, 0, 2503)]
    assert sorted(tuple(r) for r in got.select("scene", "at", "cohort_number").collect()) == want
    assert "distinct" not in (plan := got._jdf.queryExecution().optimizedPlan().toString().lower()) and "max(_chunk" in plan
