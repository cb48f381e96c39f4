"""Cutting a plan where several later steps read it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local one in local mode, else an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[[^]]*])?$", master):
        raise ValueError(f"set spark.checkpoint.dir: the executors of {master} share no local folder")
    made = "file://" + tempfile.mkdtemp(prefix="framewise-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder: they outlive lost executors, and later steps plan from them
    instead of from everything before."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; it goes when the driver ends."""
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        sc = spark.sparkContext
        if sc._jsc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)
    return place
