"""Append-only logs with a commit file for each write: readers see whole writes, several writers may append at a time.

`log/data/_write=...` holds the rows of one write, `log/commits/<number>.json` says that it counts. A number is taken by one
writer alone (put if absent), so offsets that are given with it never clash; rows of a write without a commit are never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.ranges import numbered
from framewise.sources.sinks import _fs, exists


def put_if_absent(spark: SparkSession, uri: str, data: bytes) -> bool:
    """Create a small file with all of its content, unless the name is taken; whether it was created.

    A local name is taken by a hard link; elsewhere by a rename, which fails where the name exists (as HDFS has it).
    """
    fs, place = _fs(spark, uri)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = hadoop(f"{uri}.{uuid.uuid4().hex}.part")
    fs.mkdirs(place.getParent())
    out = fs.create(part, False)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(place) and fs.rename(part, place)
        try:
            os.link(re.sub(r"^file:/+", "/", part.toString()), re.sub(r"^file:/+", "/", place.toString()))
        except FileExistsError:
            return False
        return True
    finally:
        if fs.exists(part):
            fs.delete(part, False)


def last_commit(spark: SparkSession, log: str) -> tuple[int, dict]:
    """(number, content) of the last commit; (-1, {}) of a log without any."""
    fs, place = _fs(spark, f"{log}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    last = max((int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)), default=-1)
    if last < 0:
        return -1, {}
    return last, json.loads(spark.read.text(f"{log}/commits/{last:012d}.json").first()[0])


def append(df: DataFrame, log: str, *, order: list[str], offset: str = "offset") -> tuple[int, int]:
    """Append rows with consecutive offsets in `order`; returns the offsets of this write, from and to (exclusive).

    Rows are written first, numbered range by range from 0; the commit then gives them their start. A writer that comes second
    to a number takes the next one: nothing is written again. The log is never read.
    """
    spark, folder = df.sparkSession, f"w{uuid.uuid4().hex}"
    numbered(df, order, offset).withColumn(offset, F.col(offset) - 1).write.parquet(f"{log}/data/_write={folder}")
    n = spark.read.parquet(f"{log}/data/_write={folder}").count()
    while True:
        number, before = last_commit(spark, log)
        start = before.get("start", 0) + before.get("rows", 0)
        content = json.dumps({"_write": folder, "rows": n, "start": start}).encode()
        if put_if_absent(spark, f"{log}/commits/{number + 1:012d}.json", content):
            return start, start + n


def append_batch(df: DataFrame, log: str, batch: int) -> bool:
    """Append the rows of a numbered batch once, however often it is replayed; whether this call did so.

    A replay of a batch that has its commit writes nothing. What a killed attempt left without a commit is written over.
    """
    spark, folder = df.sparkSession, f"b{batch:012d}"
    name = f"{log}/commits/{batch:012d}.json"
    if exists(spark, name):
        return False
    df.write.mode("overwrite").parquet(f"{log}/data/_write={folder}")
    return put_if_absent(spark, name, json.dumps({"_write": folder, "rows": 0, "start": 0}).encode())


def read(spark: SparkSession, log: str, offset: str = "offset") -> DataFrame:
    """The committed rows, with their offsets where the log has any. An absent log raises."""
    told = spark.read.schema("_write string, rows bigint, start bigint").json(f"{log}/commits")
    rows = spark.read.parquet(f"{log}/data").join(told.select("_write", F.col("start").alias("_start")), "_write")
    if offset in rows.columns:
        rows = rows.withColumn(offset, F.col(offset) + F.col("_start"))
    return rows.drop("_write", "_start")
