"""Greedy near-duplicate suppression of groups of any size: rounds of joins over shared keys in place of an ordered fold.

What the fold retains is the lexicographically first maximal independent set of the nearness graph, in the fold's order. It is
found in batches of doubling size, best rows first: a batch's own near pairs are few, because what earlier batches retained
has by then removed its neighbours from all later ones. So the pairs within a large clump of alike rows never exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.operators.dedup import greedy
from framewise.operators.lineage import settled

#: Rows of a group in its first batch (the next has twice as many), and rows up to which a group is folded in one task.
FIRST, FOLD = 1024, 512
#: Keys of one row at most.
KEYS = 512


def choose_blocks(radius: int, rows: int, bits: int = 64) -> int:
    """How many of radius + k blocks a key joins, so that keys and expected strangers that share one are fewest together.

    Hashes within `radius` bits differ in at most `radius` blocks, so they agree in k: in one key at least, whatever k.
    """
    best = (float("inf"), 1)
    for k in range(1, bits - radius + 1):
        keys = comb(radius + k, k)
        if keys > KEYS and k > 1:
            break
        best = min(best, (keys * (1 + rows / 2 ** (bits * k / (radius + k))), k))
    return best[1]


def block_keys(hash_: Column, radius: int, rows: int, bits: int = 64) -> Column:
    """Keys of a hash of `bits` bits in hex: any two hashes within `radius` bits share one. A null hash has none."""
    k = choose_blocks(radius, rows, bits)
    cuts = [bits * i // (radius + k) for i in range(radius + k + 1)]
    text = F.concat(*(F.lpad(F.conv(F.substring(hash_, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(bits // 32)))
    def every(bit_text: Column) -> Column:
        blocks = [F.substring(bit_text, a + 1, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return F.array(*(F.xxhash64(F.lit(i), *some) for i, some in enumerate(combinations(blocks, k))))

    # bound by a lambda, the text of the bits is made once a row and not once a key
    return F.when(hash_.isNotNull(), F.element_at(F.transform(F.array(text), every), 1))


def step_keys(value: Column, step: float) -> Column:
    """Keys of a number: any two that lie within `step` of each other share one."""
    at = F.floor(value / step)
    return F.when(value.isNotNull(), F.array(at, at + 1))


def _met(left: DataFrame, right: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """(lo, hi) of rows of one group that share a key and are near, lo of `left` standing before hi of `right`."""
    a = left.select(F.col("place").alias("lo"), F.col("g").alias("ga"), F.col("f").alias("fa"), F.explode("keys").alias("ka"))
    z = right.select(F.col("place").alias("hi"), F.col("g").alias("gz"), F.col("f").alias("fz"), F.explode("keys").alias("kz"))
    both = a.join(z, (F.col("ka") == F.col("kz")) & F.col("ga").eqNullSafe(F.col("gz")) & (F.col("lo") < F.col("hi")) & near(F.col("fz"), F.col("fa")))
    return both.select("lo", "hi").distinct()


def independent(edges: DataFrame) -> DataFrame:
    """(hi): the nodes of a graph of edges lo < hi that the greedy pass in ascending order drops, by rounds.

    A node with no undecided neighbour before it stays, and those it is joined with go. Only edges between undecided
    nodes come to the next round; on a graph in arbitrary order their number falls geometrically.
    """
    gone, now = [], settled(edges)
    while not now.isEmpty():
        kept = now.select("lo").distinct().join(now.select(F.col("hi").alias("lo")), "lo", "left_anti")
        out = settled(now.join(kept, "lo", "left_semi").select("hi").distinct())
        gone.append(out)
        now = settled(now.join(out, "hi", "left_anti").join(out.select(F.col("hi").alias("lo")), "lo", "left_anti"))
    dropped = edges.select("hi").limit(0)
    for g in gone:
        dropped = dropped.unionByName(g)
    return dropped


def _placed(classes: DataFrame, orders: list[str]) -> DataFrame:
    """Add `place`, which ascends with a group's order from best to last, and `batch`."""
    by = [F.col("g"), *(F.col(f"head.{o}").desc() for o in orders)]
    placed = settled(classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    parts = placed.groupBy("g", part.alias("part")).agg(F.min("place").alias("least"), F.count("*").alias("n"))
    # a row for each partition that holds some of the group
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("g").alias("pg"), "part", "least", ahead.alias("ahead"))
    return placed.join(parts, placed["g"].eqNullSafe(parts["pg"]) & (part == parts["part"])).withColumn("position", F.col("place") - F.col("least") + F.col("ahead")).drop("pg", "part", "least", "ahead")


def suppress_near(
    df: DataFrame, *, group: str, name: str, order: list[Column], fields: list[str], near: Callable[[Column, Column], Column],
    keys: Callable[[Column], Column], first: int = FIRST, fold: int = FOLD,
) -> DataFrame:
    """(group, name, anchor): what `dedup.greedy` gives, for groups of any size. anchor is the first retained row that is near,
    null if the row stays; rows are taken in descending `order`, then of name.

    `near(row, retained)` sees `fields` only, is symmetric and holds between equal rows; a row that is not near itself
    (null fields) is near nothing. `keys(fields)` is an array of which near rows share an element. Names are unique in
    a group. A null group is a group.

    Groups of at most `fold` rows are folded, each in a task. In others rows of equal fields are one class, which its
    best row stands for: copies meet in a pre-aggregated groupBy and are never paired. Classes go in batches of doubling
    size (see above); each batch costs a join among its own rows, some rounds of joins on its near pairs, and one join
    of what it retains with the rows that are left. No group is gathered in a task; skewed keys are split by AQE.
    """
    orders = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.col(group).alias("g"), F.col(name).alias("name"), *(o.alias(n) for o, n in zip(order, orders, strict=True)), F.struct(*fields).alias("f"))
    large = settled(df.groupBy(F.col(group).alias("gl")).count().where(F.col("count") > fold))
    if large.isEmpty():
        return greedy(df, group=group, name=name, order=order, fields=fields, near=near)
    small = df.join(large, F.col(group).eqNullSafe(F.col("gl")), "left_anti")
    folded = greedy(small, group=group, name=name, order=order, fields=fields, near=near)
    rows = settled(rows.join(large, F.col("g").eqNullSafe(F.col("gl")), "left_semi"))
    alike = F.coalesce(near(F.col("f"), F.col("f")), F.lit(False))
    alone = rows.where(~alike).select(F.col("g").alias(group), F.col("name").alias(name), F.lit(None).cast(rows.schema["name"].dataType).alias("anchor"))
    classes = rows.where(alike).groupBy("g", "f").agg(F.max(F.struct(*orders, "name")).alias("head"))
    placed = _placed(classes, [*orders, "name"])
    batch = F.floor(F.log2(F.col("position") / first + 1)).cast("int")
    left = settled(placed.select("g", "f", "place", F.col("head.name").alias("name"), batch.alias("batch"), keys(F.col("f")).alias("keys")))
    every = left.select("place", "g", "f", "name")
    found = []
    while (now := left.agg(F.min("batch")).first()[0]) is not None:
        mine, rest = left.where(F.col("batch") == now), left.where(F.col("batch") > now)
        edges = settled(_met(mine, mine, near))
        dropped = independent(edges)
        kept = settled(mine.join(dropped.select(F.col("hi").alias("place")), "place", "left_anti"))
        inner = edges.join(kept.select(F.col("place").alias("lo")), "lo", "left_semi").groupBy(F.col("hi").alias("place")).agg(F.min("lo").alias("anchor"))
        later = _met(kept, rest, near).groupBy(F.col("hi").alias("place")).agg(F.min("lo").alias("anchor"))
        found.append(gone := settled(inner.unionByName(later)))
        left = settled(rest.join(gone, "place", "left_anti"))
    anchors = every.select("place").limit(0).withColumn("anchor", F.col("place"))
    for g in found:
        anchors = anchors.unionByName(g)
    names = every.select(F.col("place").alias("anchor"), F.col("name").alias("anchor_name"))
    told = every.join(anchors, "place", "left").join(names, "anchor", "left").select(F.col("g").alias("hg"), F.col("f").alias("hf"), F.col("name").alias("head"), "anchor_name")
    members = rows.where(alike).select("g", "f", "name")
    same = members["g"].eqNullSafe(told["hg"]) & (members["f"] == told["hf"])
    anchor = F.coalesce("anchor_name", F.when(F.col("name") != F.col("head"), F.col("head")))
    split = members.join(told, same).select(F.col("g").alias(group), F.col("name").alias(name), anchor.alias("anchor"))
    return folded.unionByName(split).unionByName(alone)


def near_pairs(df: DataFrame, *, group: str, name: str, fields: list[str], near: Callable[[Column, Column], Column], keys: Callable[[Column], Column]) -> DataFrame:
    """(a, b) with a < b: all near rows of a group. They meet by a shared key, so no group is paired with itself; the result is
    as large as its pairs are many."""
    rows = settled(df.select(F.col(name).alias("place"), F.col(group).alias("g"), F.struct(*fields).alias("f")))  # keys repeat their fields
    keyed = rows.withColumn("keys", keys(F.col("f")))
    return _met(keyed, keyed, near).select(F.col("lo").alias("a"), F.col("hi").alias("b"))


#: Rows of a block of hashes; two blocks are compared in one piece of work.
BLOCK = 8192


def _compare(radius: int):
    def cell(names: pa.Array, bits: np.ndarray, cross: np.ndarray | None) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """Near rows of one cell, 64 rows at a time against all others: what is held at once is 64 x BLOCK."""
        left, right = (np.arange(len(bits)),) * 2 if cross is None else (np.flatnonzero(cross), np.flatnonzero(~cross))
        other = bits[right]
        for i in range(0, len(left), 64):
            some = left[i : i + 64]
            far = np.bitwise_count(bits[some][:, None] ^ other)
            hit = far <= radius
            if cross is None:
                hit &= some[:, None] < right
            r, c = np.nonzero(hit)
            if len(r):
                yield names.take(pa.array(some[r])), names.take(pa.array(right[c])), far[r, c].astype(np.int32)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            names, groups = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            bits, block = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            label = groups.dictionary_encode("encode").indices.to_numpy()  # groups whose hashes are equal stay apart
            for g in range(label.max() + 1):
                of = np.flatnonzero(label == g)
                for a, z, far in cell(names.take(pa.array(of)), bits[of].view(np.uint64), None if key[1] == key[2] else block[of] == key[1]):
                    yield pa.RecordBatch.from_arrays([a, z, pa.array(far)], ["a", "b", "distance"])

        for batch in batches:
            cells = np.stack([batch.column(i).to_numpy() for i in range(3)])
            at = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(0)) + 1), batch.num_rows]
            for i, j in zip(at[:-1], at[1:], strict=True):
                if i == j:
                    continue
                if (now := tuple(cells[:, i])) != key:
                    yield from flush()
                    key, held = now, []
                held.append((*(batch.column(c).slice(i, j - i) for c in (4, 6)), *(batch.column(c).slice(i, j - i).to_numpy().copy() for c in (5, 3))))
        yield from flush()

    return compare


def hash_pairs(df: DataFrame, *, group: str, name: str, hash_: str, radius: int, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) with a < b: all rows of a group whose 64-bit hashes (16 hex digits) differ in at most `radius` bits.

    For a radius that keys do not select (20 of 64 bits: nearly every two hashes share a block of three): each two rows
    are compared once, by the bits of a long. Groups are dealt into blocks of about `block` rows, and each two blocks of a
    group are one piece of work, so no group meets in a task and a task holds two blocks. Work and result grow with
    the square of a group. A null hash is near nothing; a null group is a group.
    """
    rows = settled(df.where(F.col(hash_).isNotNull()).select(F.xxhash64(group).alias("g"), F.col(name).alias("name"), F.conv(hash_, 16, -10).cast("bigint").alias("bits"), F.col(group).alias("group")))
    sizes = settled(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    cells = sizes.agg(F.sum((F.col("blocks") * (F.col("blocks") + 1) / 2).cast("bigint"))).first()[0] or 0
    blocks = F.coalesce("blocks", F.lit(1))
    cut = rows.join(F.broadcast(sizes), "g", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("name"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    dealt = cut.select("g", F.explode(pairs).alias("p"), "block", "name", "bits", "group").select("g", "p.x", "p.y", "block", "name", "bits", "group")
    # a number of its own: the rows are few bytes for the work that hangs on them
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, 20_000))
    dealt = dealt.repartition(tasks, "g", "x", "y").sortWithinPartitions("g", "x", "y")
    kind = df.schema[name].dataType
    found = dealt.mapInArrow(_compare(radius), T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.IntegerType())]))
    return found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
