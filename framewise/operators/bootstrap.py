"""Paired bootstrap of two AUCs: multinomial counts of ranked rows, drawn block by block in order, weigh ranked values.

The sorted positions of n uniform draws are partial sums of n + 1 exponentials over their total. So the draws of an iteration
come out in order of the rows: a block of draws falls on a short run of rows, and its counts leave the task as one array
a row. No draw is a row of its own, and no draw looks up a row elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import ranges
from framewise.operators.lineage import settled

#: A Mersenne prime below which products of two fit a long, and the multipliers of the round keys.
PRIME, KEYS = 2**31 - 1, (1, 48271, 16807)
#: Draws of one iteration that a task makes at a time.
BLOCK = 1024


def exponentials(seed: int, side: int, iterations: int, first: int, n: int) -> np.ndarray:
    """[iteration, slot]: -ln(u) of slots first .. first + n - 1; u comes from three rounds of x -> (x + key)^5 modulo PRIME."""
    slot = np.arange(first, first + n, dtype=np.int64)
    y = ((np.arange(iterations, dtype=np.int64) * 2 + side + seed) % PRIME)[:, None] + slot // PRIME * 7919
    h = np.broadcast_to((slot + 1) % PRIME, (iterations, n))
    for k in KEYS:
        a = (h + y * k) % PRIME
        square = a * a % PRIME
        h = square * square % PRIME * a % PRIME
    return -np.log((h + 0.5) / PRIME)


def _sums(seed: int, iterations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, block, slots in zip(*(batch.column(c).to_pylist() for c in ("side", "block", "slots")), strict=True):
                total = exponentials(seed, side, iterations, block * BLOCK, slots).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(iterations, side)), pa.array(np.full(iterations, block)), pa.array(np.arange(iterations)), pa.array(total)], ["side", "block", "iteration", "total"])

    return run


def _counts(seed: int, iterations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(side, rn, counts): how often each iteration's draws of a block fall on row rn; a byte an iteration."""
        for batch in batches:
            for side, block, slots, n, spans in zip(*(batch.column(c).to_pylist() for c in ("side", "block", "slots", "n", "spans")), strict=True):
                before, total = (np.array([s[k] for s in spans]) for k in ("before", "total"))
                draws = min(slots, n - block * BLOCK)  # the last slot of all only ends the last gap
                at = before[:, None] + np.cumsum(exponentials(seed, side, iterations, block * BLOCK, slots), axis=1)[:, :draws]
                row = np.minimum(np.floor(n * at / total[:, None]).astype(np.int64), n - 1)
                low, high = int(row.min()), int(row.max()) + 1
                for a in range(low, high, 4 * BLOCK):  # early and late iterations may lie far apart
                    z = min(high, a + 4 * BLOCK)
                    t, k = np.nonzero((row >= a) & (row < z))
                    counts = np.bincount((row[t, k] - a) * iterations + t, minlength=(z - a) * iterations).reshape(z - a, iterations)
                    some = np.flatnonzero(counts.any(axis=1))
                    weights = np.minimum(counts[some], 255).astype(np.uint8)  # a row has 256 of n equal draws once in 10**500
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), side)), pa.array(some + a), pa.array([w.tobytes() for w in weights], pa.binary())], ["side", "rn", "counts"])

    return run


def _wins(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (range, value): (range, wins, picks, rejects) arrays over iterations, wins within the range alone."""
        zero = lambda: np.zeros(width)
        here, value, sums, tie = None, None, None, None

        def settle() -> None:
            sums[0] += tie[0] * (sums[2] + tie[1] / 2)
            sums[1] += tie[0]
            sums[2] += tie[1]

        for batch in batches:
            for r, v, side, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "value", "side", "counts")), strict=True):
                if tie is not None and (r != here or v != value):
                    settle()
                    tie = None
                if r != here:
                    if sums is not None:
                        yield _told(here, sums)
                    here, sums = r, [zero(), zero(), zero()]
                if tie is None:
                    value, tie = v, [zero(), zero()]
                tie[side] += np.frombuffer(counts, np.uint8)
        if sums is not None:
            settle()
            yield _told(here, sums)

    return run


def _told(number: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([s.astype("<f8").tobytes()], pa.binary()) for s in sums)], ["range", "wins", "picks", "rejects"])


def _aucs(weighted: DataFrame, column: str, width: int) -> np.ndarray:
    """AUC of each iteration. A range of values is a task's; its picks also beat the rejects of all ranges before it."""
    value = F.col(column)
    cut = weighted.select("side", "counts", value.alias("value"), ranges.place(value, ranges.cuts(weighted, column)).cast("int").alias("range"))
    told = cut.repartition("range").sortWithinPartitions("range", "value").mapInArrow(_wins(width), "range int, wins binary, picks binary, rejects binary")
    wins, picks, rejects = np.zeros(width), np.zeros(width), np.zeros(width)
    for r in told.orderBy("range").toLocalIterator():  # at most a row a range, of fixed length
        w, p, n = (np.frombuffer(x, "<f8") for x in (r.wins, r.picks, r.rejects))
        wins += w + p * rejects
        picks, rejects = picks + p, rejects + n
    return wins / (picks * rejects)


def bootstrap_delta(df: DataFrame, *, key: str, left: str, right: str, iterations: int = 2000, seed: str = "seed") -> DataFrame:
    """Stratified paired bootstrap of AUC(left) - AUC(right): (observed, low, high), a 95 % interval by order statistics.

    Picks and rejects are each drawn with replacement, as many as there are; a row counts in both AUCs as often as it was
    drawn. Rows without one of the values, and other labels, do not count; a class without rows raises. Rows are ordered
    by `key`, which should be unique: draws depend on the seed and that order alone.

    What is shuffled is `iterations` bytes a row (once for each of the two orders), not a row a draw. Rows are numbered range
    by range, and values are ranked range by range, so no task holds a class; the driver gets `iterations` numbers a range.
    """
    spark = df.sparkSession
    rows = df.where(F.col("label").isin("pick", "reject") & F.col(left).isNotNull() & F.col(right).isNotNull())
    rows = rows.select((F.col("label") == "reject").cast("int").alias("side"), F.col(key).alias("key"), F.col(left).cast("double").alias("left"), F.col(right).cast("double").alias("right"))
    rows = settled(ranges.running(settled(rows), ["key"], F.lit(1).cast("bigint"), "rn", by=["side"]).withColumn("rn", F.col("rn") - 1))
    size = {r.side: r.n for r in rows.groupBy("side").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        raise ValueError("the comparison needs picks and rejects")
    start = int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) % PRIME
    blocks = None
    for side, n in size.items():
        slots = F.least(F.lit(BLOCK), F.lit(n + 1) - F.col("block") * BLOCK)
        some = spark.range(-(-(n + 1) // BLOCK)).select(F.lit(side).cast("bigint").alias("side"), F.col("id").alias("block")).withColumn("slots", slots).withColumn("n", F.lit(n).cast("bigint"))
        blocks = some if blocks is None else blocks.union(some)
    each = blocks.repartition("side", "block").mapInArrow(_sums(start, iterations), "side bigint, block bigint, iteration bigint, total double")
    w = Window.partitionBy("side", "iteration")
    ahead = F.coalesce(F.sum("total").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    spans = each.select("side", "block", "iteration", ahead.alias("before"), F.sum("total").over(w).alias("total"))
    spans = spans.groupBy("side", "block").agg(F.array_sort(F.collect_list(F.struct("iteration", "before", "total"))).alias("spans"))
    drawn = blocks.where("block * %d < n" % BLOCK).join(spans, ["side", "block"]).repartition("side", "block").mapInArrow(_counts(start, iterations), "side bigint, rn bigint, counts binary")
    drawn = drawn.select("side", "rn", F.concat("counts", F.lit(b"\0")).alias("counts"))
    whole = rows.select(F.col("side").cast("bigint"), "rn", F.lit(b"\0" * iterations + b"\1").alias("counts"))  # the last place: each row once
    weighted = settled(rows.select(F.col("side").cast("bigint"), "rn", "left", "right").join(drawn.unionByName(whole), ["side", "rn"]))
    delta = _aucs(weighted, "left", iterations + 1) - _aucs(weighted, "right", iterations + 1)
    low, high = max(0, math.floor(iterations * 0.025) - 1), min(iterations - 1, math.ceil(iterations * 0.975) - 1)
    ordered = np.sort(delta[:-1])
    return spark.createDataFrame([(float(delta[-1]), float(ordered[low]), float(ordered[high]))], "observed double, low double, high double")
