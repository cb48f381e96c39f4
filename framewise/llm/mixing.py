"""Mixing sources to target weights by cube-method balanced sampling (operator 7)."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import Scratch, attach

#: Documents whose inclusion probabilities move together; what a block leaves open meets again in a later block.
BLOCK = 2000
#: Units of a source that the landing settles, besides two that the flight leaves open.
HELD = 12


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Share the total by weight; no target above `most` times its source's size, the excess is shared again by weight."""
    out, live, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while live:
        whole = sum(weights[i] for i in live)
        full = [i for i in live if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in live:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        live = [i for i in live if i not in set(full)]
    return out


def flight(units: list[tuple[float, float]], rng: random.Random) -> tuple[list[float], list[int]]:
    """Move the probabilities of (size, probability) units along the null space of the two balance equations.

    Three open units always leave a direction that changes neither the expected number of documents nor that of tokens;
    a step along it settles one of them at 0 or 1. Units come largest first, so that what stays open is small. Returns all probabilities and the indices of the two left open at most.
    """
    p, live, queue = [u[1] for u in units], [], iter(range(len(units)))
    while True:
        live = [i for i in live if 1e-9 < p[i] < 1 - 1e-9]
        for i in itertools.islice(queue, 3 - len(live)):
            live.append(i)
        if len(live) < 3:
            break
        if any(not 1e-9 < p[i] < 1 - 1e-9 for i in live):
            continue
        x, y, z = (units[i][0] for i in live)
        u = (z - y, x - z, y - x) if x != y or y != z else (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) if d > 0 else p[i]) / abs(d) for i, d in zip(live, u, strict=True) if d)
        down = min((p[i] if d > 0 else (1 - p[i])) / abs(d) for i, d in zip(live, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(live, u, strict=True):
            p[i] += step * d
            p[i] = 0.0 if p[i] < 1e-9 else 1.0 if p[i] > 1 - 1e-9 else p[i]
    return p, [i for i in live if 1e-9 < p[i] < 1 - 1e-9]


def landing(units: list[tuple[float, float]], p: list[float], left: list[int]) -> None:
    """Settle the last open units: of all roundings whose document count is within 1 of its expectation, the one whose
    tokens are nearest to theirs (at most 2 ** (HELD + 2) roundings)."""
    if not left:
        return
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = picks - np.array([p[i] for i in left])
    tokens, documents = np.abs(off @ np.array([units[i][0] for i in left])), np.abs(off.sum(axis=1))
    best = np.lexsort((documents, tokens, documents > 1))[0]
    for v, i in zip(picks[best], left, strict=True):
        p[i] = float(v)


def settle_last(units: list[tuple[float, float]], rng: random.Random) -> list[float]:
    """Flight of a source's last block, in which HELD units of evenly spread sizes wait for the landing."""
    held = sorted({round(k) for k in np.linspace(0, len(units) - 1, min(HELD, len(units)))})
    rest = [i for i in range(len(units)) if i not in set(held)]
    p = [u[1] for u in units]
    moved, left = flight([units[i] for i in rest], rng)
    for i, v in zip(rest, moved, strict=True):
        p[i] = v
    landing(units, p, [rest[i] for i in left] + held)
    return p


def _settle(seed: int, level: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, rows, kept) -> None:
            units = [(float(size), p) for size, p in rows]
            rng = random.Random(f"{seed}/{level}/{key[0]}/{key[1]}")
            kept += settle_last(units, rng) if key[2] == 1 else flight(units, rng)[0]

        key, rows, held, p = None, [], [], []
        for batch in batches:
            held.append(batch)
            for k in zip(*(batch.column(c).to_pylist() for c in ("rank", "block", "blocks", "size", "p")), strict=True):
                if k[:3] != key:
                    if rows:
                        done(key, rows, p)
                    key, rows = k[:3], []
                rows.append(k[3:])
        if rows:
            done(key, rows, p)
        at = 0
        for batch in held:
            new = pa.array(p[at : at + batch.num_rows])
            at += batch.num_rows
            yield batch.set_column(batch.schema.get_field_index("p"), "p", new)

    return settle


def source_plan(totals: DataFrame, scratch: Scratch, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, rank, source_size, target, f, blocks): `targets` as a table, for any number of sources.

    Sources are ranked by ranges; only a count a range meets in one task. Each round of sharing is one pass over the
    table and brings two sums to the driver.
    """
    ranges = max(2, min(2000, int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = scratch.table(totals.repartitionByRange(ranges, F.col("source").isNull(), "source").withColumn("_range", F.spark_partition_id()))
    heads = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    heads = heads.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("_ahead")
    now = cut.join(F.broadcast(heads), F.col("_range") == F.col("_r")).withColumn("rank", place.cast("bigint")).drop("_range", "_r", "_ahead")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    now = scratch.table(now.withColumn("weight", weight).withColumn("full", F.col("size") <= 0))
    while True:
        live = ~F.col("full")
        whole, total, spent, open_ = now.agg(F.sum(F.when(live, F.col("weight"))), F.sum("size"), F.sum(F.when(~live, most * F.col("size"))), F.count_if(live)).first()
        if not open_:
            break
        share = (float(total) - (spent or 0.0)) * F.col("weight") / whole
        over = live & (share > most * F.col("size"))
        if now.where(over).isEmpty():
            now = now.withColumn("share", share)
            break
        now = scratch.table(now.withColumn("full", F.col("full") | over))
    if "share" not in now.columns:
        now = now.withColumn("share", F.lit(0.0))
    target = F.when(F.col("size") <= 0, 0.0).when(F.col("full"), most * F.col("size")).otherwise(F.col("share"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    told = now.withColumn("target", target).select("source", "rank", F.col("size").alias("source_size"), "target", F.coalesce(F.try_divide("target", F.col("size").cast("double")), F.lit(0.0)).alias("f"), blocks.alias("blocks"), "rows")
    return scratch.table(told)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 11) -> DataFrame:
    """(id, source, size, source_size, target, taken, repeats) of every row.

    size counts the words (runs of characters other than space and tab to carriage return) of the whole text, 0 for a
    null. Sources in code point order, null last and a source of its own, take `weights` in turn; `targets` shares the
    total size. With f = target / source_size, each document is taken floor(f) times, and once more if the cube sample
    with inclusion probability f - floor(f) holds it: the sample balances the source's documents and words at once.
    A source without words has target 0. Sources may be any number: their plan is a table. Reruns agree; of equal repeated rows any may be the one that is taken again.
    Repeated and null ids are fine. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    rows = scratch.table(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n"), F.count("*").alias("rows"))
    plan = source_plan(totals, scratch, weights, most)
    key = [F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source")]
    named = attach(rows.select("*", *key), plan.select(*key, *plan.columns).drop("source"), ["_null", "_source"], "rows").drop("_null", "_source", "rows")
    named = named.withColumn("base", F.floor("f").cast("bigint")).withColumn("p", F.when(F.col("size") > 0, F.col("f") - F.floor("f")).otherwise(0.0)).drop("f")
    named = scratch.table(named)
    is_open = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    settled, now, level = named.where(~is_open), named.where(is_open), 0
    while True:
        dealt = now.withColumn("block", F.pmod(F.xxhash64("id", "size", F.lit(seed + level)), F.col("blocks")).cast("int")).repartition("rank", "block")
        dealt = dealt.sortWithinPartitions("rank", "block", F.desc("size"), F.xxhash64("id"), "id")
        fields = T.StructType(dealt.schema.fields)
        moved = scratch.table(dealt.mapInArrow(_settle(seed, level), fields)).drop("block")
        settled = settled.unionByName(moved.where(~is_open))
        now = moved.where(is_open).withColumn("blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / BLOCK)).cast("int"))
        if now.isEmpty():  # the last block of a source leaves nothing open
            break
        level += 1
    repeats = F.col("base") + (F.col("p") > 0.5).cast("bigint")
    return settled.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"))
