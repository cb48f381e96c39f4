"""Sinks: manifests, logs, locked artifacts, wide exports and small reports.

Every table is written through the commit protocol of its format: files appear in a folder of the job's own and take their
names when it commits, so a reader sees the old rows or the new ones. `replace` does the same for a whole folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.logs import same_rows


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _fs(spark, path)
    return store.exists(place)


def replace(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Write beside `path`, then take its place: a failed write leaves the old rows, and rows may be read while they are
    rewritten from themselves."""
    spark, part, old = df.sparkSession, f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.old"
    store, place = _fs(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        df.write.options(**options).format(kind).save(part)
        if store.exists(place):
            store.rename(place, hadoop(old))
        if not store.rename(hadoop(part), place):
            raise OSError(f"{part} could not take the name {path}")
        store.delete(hadoop(old), True)
    finally:
        store.delete(hadoop(part), True)


def put_files(df: DataFrame, root: str, *, path: str, content: str) -> int:
    """A file below `root` for each row, written by the task that has the row; returns how many. A task that is tried again
    writes the same bytes over."""
    base = re.sub(r"^file:/+", "/", root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = (fs.LocalFileSystem(), f"{base}/{name}") if base.startswith("/") else fs.FileSystem.from_uri(f"{base}/{name}")
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at, compression=None) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select(F.col(path), F.col(content).cast("binary")).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines, fields of a row in order of name, in place of what stood there."""
    replace(df.select(*sorted(df.columns)), path, "json", ignoreNullFields="false")


def append_log(df: DataFrame, path: str, *, order: list[str], offset: str = "offset") -> int:
    """Append rows with consecutive offsets in `order` after those that stand there; returns the next offset.

    Offsets are given range by range. One writer at a time: a log has one owner.
    """
    spark = df.sparkSession
    start = 0
    if exists(spark, path):
        start = (spark.read.parquet(path).agg(F.max(offset)).first()[0] or 0) + 1
    from framewise.operators.ranges import numbered

    out = numbered(df, order, offset).withColumn(offset, F.col(offset) - 1 + start)
    out.write.mode("append").parquet(path)
    return (spark.read.parquet(path).agg(F.max(offset)).first()[0] or 0) + 1


def write_or_upgrade(df: DataFrame, path: str, legacy: list[str]) -> str:
    """'written', 'same' or 'upgraded'. A locked artifact that holds the projection of `df` on its legacy columns is
    rewritten in full; any other content raises."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
        return "written"
    old = spark.read.parquet(path)
    if same_rows(old.select(*sorted(old.columns)), df.select(*sorted(df.columns))):
        return "same"
    if sorted(old.columns) != sorted(legacy) or not same_rows(old.select(*sorted(legacy)), df.select(*sorted(legacy))):
        raise ValueError(f"{path} holds other rows")
    replace(df, path)
    return "upgraded"


def wide_scores(rows: DataFrame, signals: DataFrame, names: list[str], *, key: str) -> DataFrame:
    """One row a key with a column for each signal, absent ones null, in order of the lower-cased key."""
    wide = signals.groupBy(key).pivot("signal", names).agg(F.first("value"))
    return rows.join(wide, key, "left").orderBy(F.lower(key), key)


def write_csv(df: DataFrame, path: str) -> None:
    replace(df, path, "csv", header="true", emptyValue="")


def escaped(text: Column) -> Column:
    """Text as it may stand in HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table. More than `most` rows raise: reports are of aggregates."""
    rows: Iterable = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    cell = lambda v: "n/a" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def render_plan(df: DataFrame, *, source: str, folder: str, quality: int) -> DataFrame:
    """What a renderer is to do for each source: its working copy, sidecar, output and quality."""
    name = F.element_at(F.split(source, "/"), -1)
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return df.select("*", F.concat(F.lit(folder + "/"), name).alias("copy"), F.concat(F.lit(folder + "/"), name, F.lit(".rrdata")).alias("sidecar"), F.concat(F.lit(folder + "/"), bare, F.lit(".jpg")).alias("output"), F.lit(quality).alias("quality"))
