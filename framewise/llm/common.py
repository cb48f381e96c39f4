"""Helpers shared by the training-data operators: scratch tables, skew-safe joins, vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.lineage import shared_dir

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


#: Open `stage_scratch` blocks, and the scratch folders made in each.
_STAGES: list[list[Scratch]] = []


@contextlib.contextmanager
def stage_scratch() -> Iterator[None]:
    """Scratch tables made inside go when the block ends: for results that are written by then."""
    _STAGES.append([])
    try:
        yield
    finally:
        for s in _STAGES.pop():
            s.drop()


class Scratch:
    """Written tables in the shared folder. They cut lineage, survive lost executors and go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop)
        if _STAGES:
            _STAGES[-1].append(self)

    def folder(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        df.write.parquet(path := self.folder())
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def attach(big: DataFrame, small: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """Join `small` (unique keys; column n counts the key's rows in `big`) to `big` whatever the skew.

    Keys with more than 1/2000 of all rows number at most 2000: these alone are broadcast. The rest is an ordinary
    shuffle join in which no key is large. Both inputs should be cheap to read twice (written tables).
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    cut = max(200, total // 2000)
    hot, cold = small.where(F.col(n) > cut), small.where(F.col(n) <= cut)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return big.join(F.broadcast(hot), on, "inner").unionByName(rest)


#: Bits of a `sieve`: its words are a bounded table (262,144 rows), whatever the number of keys.
SIEVE = 1 << 24


def sieve(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Add boolean `_hit` to rows: true where the bit of the row's key (bigint) is set by one of `keys`, so false only if the key is
    none of these. No row is shuffled; what remains is for an ordinary join to tell. Keys far beyond SIEVE select less."""
    slot = F.pmod(F.col(key), F.lit(SIEVE))
    words = keys.select(F.shiftright(slot, 6).alias("_word"), (slot % 64).cast("int").alias("_at")).groupBy("_word")
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, _at)")).alias("_bits"))
    told = rows.withColumn("_slot", slot).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("shiftright(_bits, cast(_slot % 64 as int)) & 1L") == 1, F.lit(False))
    return told.withColumn("_hit", hit).drop("_slot", "_word", "_bits")


def looked_up(rows: DataFrame, book: DataFrame, key: str, value: str, most: int, rounds: int = 2, slots: int = SIEVE) -> tuple[DataFrame, DataFrame]:
    """(rows with `_told`, what is left of the book): the value, 0 to `most`, that `book` (a row a key, cheap to read often) has for
    the row's key, where bounded tables of bits tell it; null where they do not, and those keys are the book that is left.

    The book must hold every key of rows. A slot whose keys all have one value tells it surely, as the row's own key is one
    of these; keys that share a slot with another value are asked again by another hash. No row is shuffled; what is null
    is for an ordinary join with the book that is left. Keys far beyond `slots` are told less.
    """
    bits, left, asked = range(most.bit_length()), book, rows.withColumn("_told", F.lit(None).cast("int"))
    number = F.col(value).cast("int")
    for r in range(rounds):
        slot = F.pmod(F.xxhash64(F.lit(r), F.col(key)), F.lit(slots))
        mask = F.expr("shiftleft(1L, _at)")
        held = lambda test: F.bit_or(F.when(test, mask).otherwise(F.lit(0).cast("bigint")))
        words = left.select(F.shiftright(slot, 6).alias("_word"), (slot % 64).cast("int").alias("_at"), number.alias("_v")).groupBy("_word")
        known = F.col("_v").between(0, most)
        ones, zeros = ([held(F.coalesce(known & (F.col("_v").bitwiseAND(1 << j) == (want << j)), F.lit(False))).alias(f"_{want}_{j}") for j in bits] for want in (1, 0))
        words = words.agg(*ones, *zeros, held(~F.coalesce(known, F.lit(False))).alias("_mixed"))
        mixed = F.col("_mixed")
        for j in bits:
            mixed = mixed.bitwiseOR(F.col(f"_1_{j}").bitwiseAND(F.col(f"_0_{j}")))
        words = F.broadcast(words.select("_word", mixed.alias("_mixed"), *(f"_1_{j}" for j in bits)))

        def told(df: DataFrame, slot=slot, words=words) -> DataFrame:
            df = df.withColumn("_slot", slot).join(words, F.shiftright("_slot", 6) == F.col("_word"), "left")
            bit = lambda c: F.expr(f"cast(shiftright({c}, cast(_slot % 64 as int)) & 1L as int)")
            here = sum((bit(f"_1_{j}") * (1 << j) for j in bits), F.lit(0))
            return df.withColumn("_told", F.coalesce("_told", F.when(bit("_mixed") == 0, here))).drop("_slot", "_word", "_mixed", *(f"_1_{j}" for j in bits))

        asked = told(asked)
        left = told(left.withColumn("_told", F.lit(None).cast("int"))).where("_told is null").drop("_told")
    return asked, left


def crc(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column, without a copy. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.LargeStringArray | pa.LargeBinaryArray):
        wide = np.int64
    else:
        wide = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = at[-1] - at[0]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and size else np.zeros(0, np.uint8)
    return whole, at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; one row may be larger."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.full(size, f, np.uint64)) for f in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of each maximal run of non-white bytes; runs end at row ends."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~SPACE[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begins = offsets[:-1][offsets[:-1] < len(buf)]
    first[begins] = ink[begins]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = ink[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one running polynomial."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[e] - total[s]) * down[s])


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (ASCII case folded) row by row, and their row offsets.

    A row of 1 to width-1 words has one shingle: all its words. A row without words has none.
    """
    low = LOWER[buf]
    s, e, row = word_spans(low, offsets)
    n_rows = len(offsets) - 1
    words = np.bincount(row, minlength=n_rows)
    h = span_hashes(low, s, e)
    out = np.zeros(len(h), np.uint64)
    first = np.concatenate([[0], np.cumsum(words)])
    pos = np.arange(len(h)) - first[row]
    for k in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - k)] = h[k:]
        part[pos + k >= words[row]] = 0  # only in rows shorter than the width
        out = out * np.uint64(0xD6E8FEB86659FD93) + part
    count = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    return mix(out[pos < count[row]]), np.concatenate([[0], np.cumsum(count)])
