"""Operators of a stream that keep state by key: scenes with the sequence rule, and work that is retried until it succeeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from framewise.sources import commits

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed_store(spark: SparkSession) -> None:
    """Typed state by key needs the store that keeps it on disk; a session that has chosen one that can keeps it."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Scenes(StatefulProcessor):
    """Frames wait until the watermark has passed them; then they go in order through the rule, which needs the last one."""

    def __init__(self, max_gap: float, max_step: int):
        self.gap, self.step = int(max_gap * 1_000_000), max_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, name string, sequence bigint")
        self.last = handle.getValueState("last", "at bigint, sequence bigint, scene bigint, place bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for part in rows:
            self.waiting.appendList([(int(a), str(n), int(s)) for a, n, s in zip(part["at"], part["name"], part["sequence"], strict=True)])
            due |= {int(a) // 1000 + 1 for a in part["at"]}
        # one timer for all that wait: it is set again while some do
        known = set(self.handle.listTimers())
        if due and not known:
            self.handle.registerTimer(min(due))
        elif due and min(due) < min(t[0] if isinstance(t, tuple) else t for t in known):
            self.handle.registerTimer(min(due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        frames = sorted(tuple(f) for f in self.waiting.get())
        ready, rest = [f for f in frames if f[0] < passed], [f for f in frames if f[0] >= passed]
        at, sequence, scene, place = self.last.get() if self.last.exists() else (None, 0, 0, 0)
        out = []
        for now, name, number in ready:
            new = at is None or now - at > self.gap or (sequence and number and number - sequence > self.step)
            scene, place = (scene + 1, 1) if new else (scene, place + 1)
            at, sequence = now, number
            out.append((key[0], name, scene, place))
        if ready:
            self.last.update((at, sequence, scene, place))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["folder", "name", "scene", "scene_index"])


def stream_scenes(frames: DataFrame, *, folder: str, time: str, name: str, sequence: str | None = None, max_gap: float = 4.0, max_step: int = 3, late: str = "1 minute") -> DataFrame:
    """(folder, name, scene, scene_index) of a stream of frames, by the rule of `operators.scenes.assign_scenes`: a scene ends at
    a gap above max_gap seconds, or where two sequence numbers that are not zero step up by more than max_step.

    Scenes are numbered within a folder. Frames may come in any order as long as none comes more than `late` after a later one;
    such a frame is dropped by the watermark. A frame is given out once the watermark has passed it. State holds one row
    a folder and its frames of the last `late`. Frames of one time go by name; a null time or folder goes.
    """
    _keyed_store(frames.sparkSession)
    number = F.coalesce(F.col(sequence).cast("bigint"), F.lit(0)) if sequence else F.lit(0).cast("bigint")
    rows = frames.select(F.col(folder).alias("folder"), F.col(time).cast("timestamp").alias("time"), F.col(name).cast("string").alias("name"), number.alias("sequence"))
    rows = rows.where("folder is not null and time is not null").withColumn("at", F.unix_micros("time")).withWatermark("time", late)
    kind = rows.schema["folder"].dataType.simpleString()
    told = rows.groupBy("folder").transformWithStateInPandas(_Scenes(max_gap, max_step), f"folder {kind}, name string, scene bigint, scene_index bigint", "Append", "EventTime")
    return told.withColumnRenamed("folder", folder)


class _Attempts(StatefulProcessor):
    def __init__(self, work: Callable[[pd.DataFrame], tuple[str, str | None]], attempts: int):
        self.work, self.most = work, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "attempts int, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        unit = pd.concat(list(rows), ignore_index=True)
        n, status = self.state.get() if self.state.exists() else (0, None)
        if status == "ok" or (self.most and n >= self.most):
            return
        try:
            status, detail = self.work(unit)
        except Exception as e:  # what fails is logged, and comes again with the next batch that asks for it
            status, detail = "failed", f"{type(e).__name__}: {e}"
        self.state.update((n + 1, status))
        yield pd.DataFrame({"key": [key[0]], "attempt": [n + 1], "status": [status], "detail": [detail]})


def work_through(units: DataFrame, *, key: str, log: str, checkpoint: str, work: Callable[[pd.DataFrame], tuple[str, str | None]], attempts: int = 0) -> StreamingQuery:
    """Run `work` on the rows of each key until it gives the status 'ok'; every attempt is a row (key, attempt, status, detail) of
    the log (see `sources.commits.read`).

    Whether a key is done is state of the query, so the log is never read. A batch is one commit: state and rows of a
    batch that a crash interrupts are made again from the same input, and a batch whose commit stands is not written twice.
    A key is one unit of work: its rows of a batch meet in one task. `work` that raises is a failed attempt; a key is tried
    once a batch in which it comes, `attempts` times at most (0: without a limit). A null key is a key.
    """
    _keyed_store(units.sparkSession)
    kind = units.schema[key].dataType.simpleString()
    done = units.groupBy(key).transformWithStateInPandas(_Attempts(work, attempts), f"key {kind}, attempt int, status string, detail string", "Append", "None")
    told = done.withColumnRenamed("key", key)

    def commit(batch: DataFrame, number: int) -> None:
        commits.append_batch(batch, log, number)

    return told.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
