"""Decision states, reviews, albums, render checks and sinks on small frames."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators import album, decisions, ranges, render, review
from framewise.sources import files, sinks


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_gate_trace_with_absent_metrics(spark):
    lit, none = F.lit, F.lit(None).cast("double")

    def trace(blur, ten, musiq, nima, required=1):
        t = decisions.gate_trace({"laplacian": (blur, 10.0), "tenengrad": (ten, 10.0)}, {"musiq": (musiq, 50.0, False), "nima": (nima, 5.0, False)}, required, {"musiq", "nima"})
        return one(spark, t).c0

    weak = trace(lit(1.0), lit(1.0), lit(1.0), none, 2)
    assert not weak.rejected and weak.weak_support == 1 and weak.votes.nima is None and "insufficient" in weak.explanation
    assert trace(lit(1.0), lit(1.0), lit(1.0), lit(1.0), 2).rejected
    lost = trace(none, lit(1.0), lit(1.0), lit(1.0))
    assert not lost.rejected and lost.votes.laplacian and "incomplete" in lost.explanation
    assert trace(lit(1.0), lit(1.0), none, none, 0).required == 1
    assert "acceptable" in trace(lit(99.0), lit(99.0), lit(1.0), lit(1.0)).explanation


def test_colours_and_bounds_raise(spark):
    assert one(spark, decisions.colour(F.lit(" reD ")), decisions.colour(F.lit("none")))[:] == ("Red", None)
    with pytest.raises(Exception, match="unsupported colour"):
        one(spark, decisions.colour(F.lit("mauve")))
    assert one(spark, decisions.bounded(F.lit(None), 0, 1, "x"), decisions.bounded_int(F.lit(3.0), 0, 5, "x"))[:] == (0.0, 3)
    for bad in (decisions.bounded(F.lit(2.0), 0, 1, "x"), decisions.bounded_int(F.lit(1.5), 0, 5, "x")):
        with pytest.raises(Exception, match="x must be"):
            one(spark, bad)


def test_sidecar_flags(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(spark, decisions.is_picked(lit("false"), lit("5"), lit("1")), decisions.is_picked(none, lit("2"), none), decisions.is_picked(none, lit("x"), none))[:] == (False, True, False)
    assert one(spark, decisions.is_rejected(lit("-1"), none), decisions.is_rejected(lit("-1.0"), lit("0")))[:] == (True, False)


def test_union_selection(spark):
    run = spark.createDataFrame([("A", "pick"), ("b", "reject"), ("C", "pick"), ("d", None)], "name string, bucket string")
    held = spark.createDataFrame([("B",), ("c",)], "name string")
    names = lambda mode: [r.name for r in album.union_selection(run, held, key="name", mode=mode).collect()]
    assert names("machine") == ["A"] and names("union") == ["A", "C", "b"] and names("ignore") == ["A", "C"]
    with pytest.raises(ValueError, match="missing"):
        album.union_selection(run, held.union(spark.createDataFrame([("z",)], "name string")), key="name", mode="union")


def test_suppression_needs_neighbours_and_keeps_representatives(spark):
    grey, other = [100.0] * 4, [200.0] * 4
    rows = [("DSC00001", 1.0, "0" * 16, grey, "pick"), ("DSC00002", 1.0, "0" * 15 + "1", grey, "pick"), ("DSC00003", 2.0, "0" * 16, grey, "pick"), ("DSC00004", 1.0, "0" * 16, other, "pick"), ("DSC00009", 1.0, "0" * 16, grey, "pick"), ("ABC00003", 1.0, "0" * 16, grey, "pick"), ("DSC00005", 1.0, "0" * 16, grey, "review"), ("plain", 1.0, "0" * 16, grey, "pick")]
    df = spark.createDataFrame(rows, "name string, score double, hash string, preview array<double>, bucket string")
    out = album.suppress(df, name="name", score="score", stem=F.col("name"), hash_="hash", preview="preview")
    got = {r.name: (r.bucket, r.represented_by) for r in out.collect()}
    assert {k: v[1] for k, v in got.items() if v[1]} == {"DSC00001": "DSC00003", "DSC00002": "DSC00003"}
    assert got["DSC00001"][0] == "reject" and got["DSC00005"] == ("review", None) and album.unrepresented(out, name="name").count() == 0
    told = album.album_summary(out.withColumn("before", F.lit("pick")), before="before").first()
    assert (told.photos, told.selected, told.represented, told.from_pick) == (8, 5, 2, 5)


def test_partial_cohorts_raise(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "cohort int, key string")
    done = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert [r.cohort for r in album.open_cohorts(rows, done("a", "b", "c"), cohort="cohort", key="key").collect()] == [3]
    with pytest.raises(Exception, match="partial cohort"):
        album.open_cohorts(rows, done("a"), cohort="cohort", key="key").collect()


def test_answers(spark):
    asked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "batch int, id int, name string")
    assert review.answer_faults(asked, asked, by=["batch"], key="id", name="name").count() == 0
    twice = asked.union(asked.where("batch = 2"))
    assert [r.fault for r in review.answer_faults(asked, twice, by=["batch"], key="id", name="name").collect()] == ["count"]
    with pytest.raises(Exception, match="incomplete batch: names"):
        review.checked_answers(asked, asked.withColumn("name", F.upper("name")), by=["batch"], key="id", name="name").collect()


def test_recipes(spark):
    kind = "verdict string, a double, n struct<a:double>"
    rows = spark.createDataFrame([("accept", None, None), ("reject", None, None), ("refine", None, None), ("refine", 2.0, (2.0,))], kind)
    flat = review.flattened(rows, nested="n", fields=["a"])
    out = review.filled(flat, verdict="verdict", accepted={"a": F.lit(7.0)}, neutral={"a": F.lit(0.0)})
    assert [r.a for r in out.collect()] == [7.0, 0.0, None, 2.0]
    for bad in ((1.0, (2.0,)), (None, (None,))):
        with pytest.raises(Exception, match="nested"):
            review.flattened(spark.createDataFrame([("refine", *bad)], kind), nested="n", fields=["a"]).collect()
    texts = spark.createDataFrame([('x {bad {"b": 1, "a": {"c": "}"}} {"z": 0}',), ("none",), (None,)], "t string")
    assert [r.j for r in texts.select(review.first_object("t").alias("j")).collect()] == ['{"a": {"c": "}"}, "b": 1}', None, None]
    assert review.config_mismatches({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == ["b", "c"]


def test_artifacts(spark):
    found = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, content string")
    ledger = found.select("name", F.sha2("content", 256).alias("sha256"))
    assert review.verified(ledger, found, key="name") is found
    with pytest.raises(ValueError, match="b is missing"):
        review.verified(ledger, found.where("name = 'a'"), key="name")


def test_served_cohorts(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "cohort int, id int, name string")
    call = lambda f: f.assign(bucket=["pick" if n == "a" else "review" for n in f["name"]])
    kind = "cohort int, id int, name string, bucket string"
    got = review.served(rows, call, kind, cohort="cohort", key="id", name="name").collect()
    assert sorted((r.name, r.bucket) for r in got) == [("a", "pick"), ("b", "review"), ("c", "review")]
    for bad in (lambda f: call(f).iloc[:1], lambda f: call(f).assign(name="z")):
        with pytest.raises(Exception, match="answer"):
            review.served(rows, bad, kind, cohort="cohort", key="id", name="name").collect()
    review.register("echo")(call)
    assert review.model_registry()["echo"] is call
    with pytest.raises(ValueError):
        review.register("echo")(call)
    assert [len(x) for x in review.batches(iter([pd.DataFrame({"a": range(5)})]), 2)] == [2, 2, 1]


def test_render_checks(spark):
    tried = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.98), (2, 0, 1.0), (2, 1, 0.5), (2, 2, 0.5)], "k int, n int, cost double")
    assert sorted((r.k, r.n, r.cost) for r in render.best_candidate(tried, by=["k"], cost="cost", order="n").collect()) == [(1, 0, 1.0), (2, 1, 0.5)]
    w, h = render.transport_size(F.lit(8000), F.lit(4000), F.lit(10))
    assert one(spark, w, h)[:] == (2560, 1280)
    lit = F.lit
    plan = render.crop_plan(lit(1000.0), lit(800.0), lit(0.0), lit(0.0), lit(1.0), lit(0.5), lit(0.0))
    assert one(spark, plan).c0[:] == (0.0, 0.0, 1000.0, 400.0)
    for edges, angle, text in (((0.0, 0.0, 1.0, 1.0), 5.0, "needs a crop"), ((0.5, 0.0, 0.5, 1.0), 0.0, "empty"), ((0.0, 0.0, 0.2, 0.2), 0.0, "tenth")):
        with pytest.raises(Exception, match=text):
            one(spark, render.crop_plan(lit(1000.0), lit(800.0), *map(lit, edges), lit(angle)))
    lines = spark.createDataFrame([(1, 1.0, 5.0), (1, 1.3, 5.0), (1, 9.0, 1.0), (1, 40.0, 99.0), (2, 1.0, 1.0)], "k int, angle double, w double")
    got = {r.k: (r.lines, r.slope, r.agreement) for r in render.level_evidence(lines, by=["k"], angle="angle", weight="w").collect()}
    assert got == {1: (3, 1.3, 0.909), 2: (1, None, None)}
    assert one(spark, render.finite(lit(math.nan)), render.finite(lit(math.inf)), render.finite(lit(1.5)))[:] == (None, None, 1.5)


def test_sinks(spark, tmp_path):
    path, rows = str(tmp_path / "m"), spark.createDataFrame([(2, "b"), (1, "a")], "k int, a string")
    sinks.write_manifest(rows, path)
    sinks.write_manifest(spark.read.json(path).where("k = 1").select("k", "a"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":"a","k":1}']
    log = str(tmp_path / "log")
    assert sinks.append_log(rows, log, order=["k"]) == 2 and sinks.append_log(rows, log, order=["k"]) == 4
    assert sorted((r.offset, r.k) for r in spark.read.parquet(log).collect()) == [(0, 1), (1, 2), (2, 1), (3, 2)]
    lock = str(tmp_path / "lock")
    assert sinks.write_or_upgrade(rows.select("k"), lock, ["k"]) == "written"
    assert sinks.write_or_upgrade(rows, lock, ["k"]) == "upgraded" and sinks.write_or_upgrade(rows, lock, ["k"]) == "same"
    with pytest.raises(ValueError):
        sinks.write_or_upgrade(rows.where("k = 1"), lock, ["k"])
    sinks.write_csv(rows.orderBy("k").coalesce(1), str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["k,a", "1,a", "2,b"]
    assert sinks.markdown(rows.orderBy("k")) == "| k | a |\n|-|-|\n| 1 | a |\n| 2 | b |\n"
    with pytest.raises(ValueError):
        sinks.markdown(rows, 1)
    assert one(spark, sinks.escaped(F.lit("<a & 'b\">"))).c0 == "&lt;a &amp; &#x27;b&quot;&gt;"


def test_scans(spark, tmp_path):
    (tmp_path / "x.ARW").write_bytes(b"raw")
    got = files.scan_files(spark, str(tmp_path), files.RAW, content=True).first()
    assert bytes(got.content) == b"raw" and got.xmp_path == f"{tmp_path}/x.xmp"
    xml = '<m xmlns:p="u"><d p:Rating="3" p:good="False" Label="Red"/></m>'
    sides = spark.createDataFrame([("a", xml), ("b", '<m Rating="-1"/>')], "path string, xml string")
    assert sorted((r.path, r.label, r.colour) for r in files.sidecar_labels(sides, path="path", xml="xml").collect()) == [("a", "reject", "Red"), ("b", "reject", None)]
    tags = spark.createDataFrame([("", "x", None)], "a string, b string, c string")
    assert files.embedded_flags(tags, {"look": ["a", "b"], "mask": ["c"]}).select("look", "mask").first()[:] == (True, False)
    scores = spark.createDataFrame([("f", 1.0, math.nan)], "name string, s double, t double")
    assert [tuple(r) for r in files.table_signals(scores, keep=["name"], signals={"s": "sharp", "t": "tone"}).collect()] == [("f", "sharp", 1.0)]
    path = tmp_path / "m.jsonl"
    path.write_text('{"filename": "a"}\n')
    import hashlib

    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert files.read_guarded_manifest(spark, str(path), files.MANIFEST, state="complete", sha256=digest).count() == 1
    for state, d in (("open", digest), ("complete", "0" * 64)):
        with pytest.raises(ValueError):
            files.read_guarded_manifest(spark, str(path), files.MANIFEST, state=state, sha256=d)


def test_numbers_by_range(spark):
    rows = [(i, float(i * 7919 % 1000) if i % 50 else None, f"n{i % 40}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, v double, s string").repartition(7)
    for order in (["v", "k"], ["s", "k"], ["k"]):
        got = [r.k for r in ranges.numbered(df, order, "i").orderBy("i").collect()]
        value = lambda r, c: (r["kvs".index(c)] is not None, r["kvs".index(c)])
        assert got == [r[0] for r in sorted(rows, key=lambda r: [value(r, c) if r["kvs".index(c)] is not None else (False,) for c in order])]
    plan = ranges.numbered(df, ["v", "k"], "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1  # for the sums of the ranges, a row each
    assert "hashpartitioning(_range" in plan[plan.index("SinglePartition") :]
    assert ranges.numbered(df.where("false"), ["v"], "i").count() == 0


def test_unique_targets_and_short_samples(spark):
    from framewise.operators import dedup, logs

    df = spark.createDataFrame([("a.xmp", "a.arw"), ("b.xmp", "b.arw")], "target string, owner string")
    assert logs.unique_targets(df, target="target", owner="owner") is df
    with pytest.raises(ValueError, match="a.xmp has 2"):
        logs.unique_targets(df, target="target", owner="owner", siblings=spark.createDataFrame([("A.xmp", "a.nef")], "target string, owner string"))
    rows = spark.createDataFrame([("f", i) for i in range(10)], "folder string, k long")
    some = lambda least: dedup.gap_sample(rows, group="folder", name="k", sequence="k", order=F.col("k"), gap=4, least=least)
    assert sorted(r.k for r in some(3).collect()) == [0, 4, 8]
    with pytest.raises(Exception, match="not enough"):
        some(4).collect()
