"""Incremental work: scenes by session windows, and a resumable log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_scenes(df: DataFrame, *, folder: str, time: str, gap: str = "4 seconds", late: str = "1 minute") -> DataFrame:
    """Scenes of a stream (or batch) of frames by time gap; late frames are waited for up to `late`."""
    frames = df.withWatermark(time, late) if df.isStreaming else df
    # a session window ends at its last event plus the gap and holds an event at exactly the gap
    return frames.groupBy(folder, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("frames"), F.min(time).alias("first"), F.max(time).alias("last")).select(folder, "first", "last", "frames")


def resumable(stream: DataFrame, log: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run `work` on rows whose key has no successful record in the log (key, status, ...), micro-batch by micro-batch.

    Failed keys come again with a later batch. The checkpoint and the log together make a restart go on where it was.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.parquet(log).where("status = 'ok'").select(key).distinct()
            batch = batch.join(done, key, "left_anti")
        work(batch).write.mode("append").parquet(log)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
