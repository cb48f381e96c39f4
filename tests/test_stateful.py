import random
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators.scenes import assign_scenes
from framewise.sources import commits
from framewise.streaming import stateful


def test_streamed_scenes_equal_the_batch_on_shuffled_input(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for folder in ("a", "b", "c"):
        at, seq = 0.0, 1
        for i in range(60):
            at += rng.choice([0.5, 2, 4, 4.001, 9])
            seq += rng.choice([1, 1, 3, 4, -2])
            rows.append((folder, at, f"{folder}{i:03d}", rng.choice([0, seq, seq, seq])))
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 20))  # at most 20 seconds out of order
    rows.append(("end", 10_000.0, "z", 0))
    df = spark.createDataFrame(rows, "folder string, s double, name string, seq long").withColumn("at", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))
    src = str(tmp_path / "in")
    for i in range(0, len(rows), 40):  # several batches
        spark.createDataFrame(df.collect()[i : i + 40], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    told = stateful.stream_scenes(stream, folder="folder", time="at", name="name", sequence="seq", late="30 seconds")
    q = told.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("told").collect()))
    batch = assign_scenes(df.where("folder != 'end'"), folder="folder", time="at", order=["name"], sequence="seq")
    least = batch.groupBy("folder").agg(F.min("scene_number").alias("first"))
    want = batch.join(least, "folder").select("folder", "name", (F.col("scene_number") - F.col("first") + 1).alias("scene"), "scene_index")
    assert got == sorted(map(tuple, want.collect())) and len({(f, s) for f, _, s, _ in got}) > 30


def test_work_is_retried_and_a_killed_batch_is_not_written_twice(spark, tmp_path, monkeypatch):
    src, log, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    put = lambda *rows: spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(src)

    def work(unit: pd.DataFrame):
        if unit["v"].max() < 0:
            raise ValueError("negative")
        return "ok", str(int(unit["v"].sum()))

    def run():
        stream = spark.readStream.schema("k string, v long").parquet(src)
        stateful.work_through(stream, key="k", log=log, checkpoint=cp, work=work).awaitTermination()
        return sorted(map(tuple, commits.read(spark, log).collect()), key=str)

    put(("a", 1), ("a", 2), ("b", -1), (None, 5))
    first = [("a", 1, "ok", "3"), ("b", 1, "failed", "ValueError: negative"), (None, 1, "ok", "5")]
    assert run() == sorted(first, key=str)
    put(("a", 9), ("b", 4))
    real = commits.put_if_absent
    monkeypatch.setattr(commits, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("killed between write and commit")))
    with pytest.raises(Exception, match="killed"):
        run()
    assert sorted(map(tuple, commits.read(spark, log).collect()), key=str) == sorted(first, key=str)  # written, not committed
    monkeypatch.setattr(commits, "put_if_absent", real)
    then = sorted([*first, ("b", 2, "ok", "4")], key=str)
    assert run() == then
    assert run() == then  # nothing new


def test_a_batch_is_appended_once(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.range(3)
    assert commits.append_batch(rows, log, 7) and not commits.append_batch(rows, log, 7) and commits.append_batch(rows, log, 8)
    assert commits.read(spark, log).count() == 6


def test_writers_at_a_time_do_not_clash(spark, tmp_path):
    log, got = str(tmp_path / "log"), []

    def write(k):
        got.append(commits.append(spark.range(k * 100, k * 100 + 20 + k).toDF("k"), log, order=["k"]))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    total = sum(20 + k for k in range(4))
    assert sorted(x for a, z in got for x in range(a, z)) == list(range(total))
    rows = commits.read(spark, log).collect()
    assert sorted(r.offset for r in rows) == list(range(total))
    by = sorted((r.offset, r.k) for r in rows)
    assert all(z[1] == a[1] + 1 for a, z in zip(by, by[1:], strict=False) if z[1] // 100 == a[1] // 100)
    assert commits.last_commit(spark, log)[0] == 3
    spark.range(5).withColumn("offset", F.lit(0)).write.parquet(f"{log}/data/_write=wleft")  # a writer that died before its commit
    assert commits.read(spark, log).count() == total
