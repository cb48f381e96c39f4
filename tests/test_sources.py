import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.sources import files
from framewise.streaming import scenes


def test_scan_and_pairs(spark, tmp_path):
    for name in ("a/X1.ARW", "a/x1.jpg", "a/._X2.arw", "a/output/X3.arw", ".hid/X4.arw", "b/y.JPEG", "b/Z.dng", "b/note.txt", "OUTPUT.arw"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    raw, jpeg = (files.scan_files(spark, str(tmp_path), s) for s in (files.RAW, files.JPEG))
    assert [r.path.removeprefix(f"{tmp_path}/") for r in raw.collect()] == ["OUTPUT.arw", "a/X1.ARW", "b/Z.dng"]
    got = {r.path.rpartition("/")[2]: r.paired_raw_path for r in files.paired_assets(raw, jpeg).collect()}
    assert got == {"OUTPUT.arw": None, "X1.ARW": None, "x1.jpg": f"{tmp_path}/a/X1.ARW", "y.JPEG": None, "Z.dng": None}
    assert files.latest_run(spark, str(tmp_path)) == "b"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"k": "a", "v": 1}\n{bad\n\n{"v": 2}\n')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    assert [tuple(r) for r in files.read_json_lines(spark, str(path), schema, key="k").collect()] == [("a", 1)]
    with pytest.raises(Exception, match="alformed"):
        files.read_json_lines(spark, str(path), schema, strict=True).collect()


def test_header_and_records(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(map(json.dumps, [{"schema": 2}, {"raw_path": "a", "status": "ok", "suggestion": {"ev": 0.5}}, {"raw_path": "b", "ev": 1.5}, {"raw_path": "c", "status": "failed", "suggestion": {"ev": 9.0}}])))
    header, records = files.read_header_and_records(spark, str(path), T.StructType([T.StructField("ev", T.DoubleType())]))
    assert header.count() == 1 and sorted((r.raw_path, r.ev) for r in records.collect()) == [("a", 0.5), ("b", 1.5)]


def test_manifest_checksums_and_sidecar(spark, tmp_path):
    rows = [("x.arw", "scene-0001", "scored", (4, "Green", None, True, "vision", ""), {"topiq": 6.5, "other": 1.0})]
    got = files.signals_of_manifest(spark.createDataFrame(rows, files.MANIFEST), ["topiq"])
    assert sorted(tuple(r) for r in got.collect()) == [("x.arw", "cull:scene-0001", "pipeline_reject", 0.0), ("x.arw", "cull:scene-0001", "topiq", 6.5)]
    path = tmp_path / "sums"
    path.write_text(f"{'a' * 64}  one\n")
    assert files.read_checksums(spark, str(path)).first().name == "one"
    path.write_text(f"{'a' * 64}  one\n{'b' * 64}  one\n")
    with pytest.raises(Exception, match="bad checksum"):
        files.read_checksums(spark, str(path)).collect()
    xml = '<m xmlns:p="u"><d p:Rating="1"/><d p:Rating="5" Label="Red"/></m>'
    assert spark.range(1).select(files.sidecar_attribute(F.lit(xml), "Rating"), files.sidecar_attribute(F.lit(xml), "good")).first()[:] == ("5", None)


def test_stream_of_frames_and_resumable_log(spark, tmp_path):
    src, log = tmp_path / "in", str(tmp_path / "log")
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:04"), ("a", "2024-01-01 00:00:09"), ("z", "2024-01-02 00:00:00")], "folder string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = scenes.session_scenes(stream, folder="folder", time="at").writeStream.format("memory").queryName("sc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.folder, r.frames) for r in spark.table("sc").collect()) == [("a", 1), ("a", 2)]
    tries = []

    def work(batch):
        tries.append(batch.count())
        return batch.select("folder", F.lit("ok").alias("status"))

    for _ in range(2):
        scenes.resumable(stream, log, str(tmp_path / f"cp{len(tries)}"), "folder", work).awaitTermination()
    assert tries == [4, 0] and spark.read.parquet(log).count() == 4


def test_table_scan_by_bounds(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.createDataFrame([(i, float(i) / 2, f"n{i}") for i in range(1000)] + [(None, 1.0, "none")], "k int, v double, name string").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    except Exception as e:
        if "ClassNotFound" in str(e) or "EmbeddedDriver" in str(e):
            pytest.skip("no embedded database among the jars")
        raise
    options = {"column": '"k"', "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    got = files.read_table_by_bounds(spark, url, "t", tasks=7, **options)
    assert got.rdd.getNumPartitions() == 7
    assert sorted(r.name for r in got.collect()) == sorted([*(f"n{i}" for i in range(1000)), "none"])
    some = files.read_table_by_bounds(spark, url, "t", tasks=7, where='"k" >= 10 AND "k" < 14', **options)
    assert some.rdd.getNumPartitions() == 4 and sorted(r.k for r in some.collect()) == [10, 11, 12, 13]
    assert max(map(len, some.rdd.glom().collect())) == 1  # bounds are those of the rows asked for
    assert "PushedFilters: [*IsNotNull(k), *EqualTo(k,11)]" in some.where("k = 11")._jdf.queryExecution().executedPlan().toString()
    assert files.read_table_by_bounds(spark, url, "t", where='"k" > 5000', **options).count() == 0
