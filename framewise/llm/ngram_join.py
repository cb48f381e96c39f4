"""N-gram Jaccard join: MinHash banding for candidates, full shingle sets for verification (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import Scratch, attach, mix, shingles, sieve, slices, text_buffer
from framewise.llm.graph import components

#: Members of one candidate cluster that are compared in one block; larger clusters are dealt out as pairs of blocks.
BLOCK = 128


def choose_bands(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose banding finds a pair at `threshold` with probability `recall`."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within most_hashes reaches the recall")
    return best


def _digests(sh: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes a row that identify its set of shingles."""
    out = []
    for i in range(len(at) - 1):
        u = np.unique(sh[at[i] : at[i + 1]])
        a, b = np.bitwise_xor.reduce(mix(u + np.uint64(1))) if len(u) else 0, u.sum(dtype=np.uint64)
        out.append(int(a).to_bytes(8, "big") + int(mix(np.array([b ^ np.uint64(len(u))], np.uint64))[0]).to_bytes(8, "big"))
    return out


def _signer(width: int, bands: int, rows: int):
    rng = np.random.default_rng(7)
    flips = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    odds = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                part = off[i : j + 1] - off[i]
                sh, at = shingles(buf[off[i] : off[j]], part, width)
                full = np.flatnonzero(np.diff(at))
                low = np.zeros((bands * rows, len(full)), np.uint64)
                for a in range(0, len(full), 64):  # some tens of thousands of shingles: they stay in the cache
                    rows_ = full[a : a + 64]
                    x = sh[at[rows_[0]] : at[rows_[-1] + 1]]
                    begin, t = at[rows_] - at[rows_[0]], np.empty_like(x)
                    for k in range(bands * rows):
                        np.bitwise_xor(x, flips[k], out=t)
                        np.multiply(t, odds[k], out=t)
                        low[k, a : a + len(rows_)] = np.minimum.reduceat(t, begin)
                keys = np.zeros((len(full), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(31) + low.reshape(bands, rows, -1)[:, r, :].T)
                sizes = np.zeros(j - i, np.int64)
                sizes[full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(_digests(sh, at), pa.binary()), lists], ["id", "key", "node", "bands"])

    return sign


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep one row of each shingle set that is asked for (a key may stand for another text too, and for repeated rows)."""
        told: set[bytes] = set()
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            for i, j in slices(off):
                sh, at = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                want = batch.column("node").slice(i, j - i).to_pylist()
                good = [k for k, d in enumerate(_digests(sh, at)) if d == want[k] and not (d in told or told.add(d))]
                got = [np.unique(sh[at[k] : at[k + 1]]).view(np.int64) for k in good]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *got])))
                take = pa.array([i + k for k in good], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("comp", "num", "copies", "blocks")), lists], ["comp", "node", "copies", "blocks", "sh"])

    return sets


def _overlaps(sets: list[np.ndarray], i: int, uid: np.ndarray, at: np.ndarray, begin: np.ndarray, posting: np.ndarray) -> np.ndarray:
    u = uid[at[i] : at[i + 1]]
    size = begin[u + 1] - begin[u]
    where = np.repeat(begin[u] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(posting[where], minlength=len(sets))


def linked(sets: list[np.ndarray], threshold: float, cross: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Index pairs of sets with Jaccard >= threshold, through an inverted index; cross: only pairs with unequal flags."""
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    _, uid = np.unique(np.concatenate(sets), return_inverse=True)
    posting = np.repeat(np.arange(len(sets)), sizes)[np.argsort(uid, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(uid))])
    for i in range(len(sets)):
        both = _overlaps(sets, i, uid, at, begin, posting)
        hit = both >= threshold * (sizes[i] + sizes - both) - 1e-9
        hit[: i + 1] = False
        if cross is not None:
            hit &= cross != cross[i]
        for j in np.flatnonzero(hit):
            yield i, int(j)


def _verifier(threshold: float):
    def flush(key, kept) -> Iterator[tuple]:
        if len(kept) < 2:
            return
        parent, links = list(range(len(kept))), [0] * len(kept)

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        cross = np.array([r[3] for r in kept]) if key[1] != key[2] else None
        for i, j in linked([r[2] for r in kept], threshold, cross):
            links[i] += kept[j][1]
            links[j] += kept[i][1]
            if (a := find(i)) != (b := find(j)):
                parent[max(a, b)] = min(a, b)
                yield kept[i][0], kept[j][0], 0
        for r, n in zip(kept, links, strict=True):
            if n:
                yield r[0], None, n

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            lists = batch.column("sh")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (c, a, b, node, n, block) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("comp", "a", "b", "node", "copies", "block")), strict=True)):
                if (c, a, b) != key:
                    out += flush(key, rows)
                    key, rows = (c, a, b), []
                if not rows or rows[-1][0] != node:  # repeated rows of one text come one after the other
                    rows.append((node, n, values[at[k] : at[k + 1]].copy(), block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64()), strict=True)], ["u", "v", "links"])
                out = []
        if out := [*flush(key, rows)]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64()), strict=True)], ["u", "v", "links"])

    return verify


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """One row per input row: (id, class_id, n_links).

    Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles (words: runs of non-white
    bytes, ASCII case folded; a shorter text is one shingle) is at least `threshold`. class_id is the least id among the
    texts connected by links, n_links the number of other rows whose text is linked with the row's own or equal to it.
    Rows without words (null, empty, white) have equal, empty sets: they form one class. Repeated ids are fine, a null
    id counts after all others. Empty table: no rows.

    Texts of equal shingle sets are one node from the start, so copies meet in a pre-aggregated groupBy and are never
    paired. A node's text is fetched by a hash of id and text, so rows that share an id (or have none) meet their own node
    alone, and only texts that a sieve of the asked hashes lets through are shuffled. Nodes go by number. MinHash bands of
    the nodes (band and row counts from `choose_bands`) are shuffled by band hash, once; each bucket is a star, stars are
    joined to candidate clusters, and every pair within a cluster is verified on full shingle sets, in blocks of BLOCK
    nodes. Blocks return a spanning forest and link counts, never the pairs.
    """
    joined = _classes(docs, id_col, text_col, width, threshold, recall)
    return joined.select(F.col("id").alias(id_col), "class_id", "n_links")


#: A band hash with so many nodes in a draw of one in DRAW is hot: its nodes are dealt into SALTS parts.
DRAW, HOT, SALTS = 64, 32, 64


def _stars(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect the nodes of each bucket (equal band hash), most of them with the least node of the bucket.

    Rows are shuffled once. Parts of hot buckets have heads of their own, which are then joined with the least of them; the
    draw only says which buckets are cut. Bands share one hash space: should two of them meet, there are more candidates.
    """
    keyed = nodes.select("num", F.posexplode("bands").alias("band", "b")).select("num", F.xxhash64("band", "b").alias("h"))
    drawn = nodes.where(F.pmod(F.xxhash64("num"), F.lit(DRAW)) == 0)
    drawn = drawn.select(F.posexplode("bands").alias("band", "b")).select(F.xxhash64("band", "b").alias("h"))
    hot = scratch.table(drawn.groupBy("h").count().where(F.col("count") >= HOT).select("h", F.lit(True).alias("hot")))
    salted = keyed.join(F.broadcast(hot), "h", "left").select("h", "num", F.when(F.col("hot"), F.pmod(F.xxhash64("num"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt"), F.col("hot").isNotNull().alias("hot"))
    part = Window.partitionBy("h", "salt")
    heads = salted.withColumn("v", F.first("num").over(part.orderBy("num")))
    stars = scratch.table(heads.where("v != num or hot").select(F.col("num").alias("u"), "v", F.when(F.col("hot") & (F.col("v") == F.col("num")), F.col("h")).alias("h")))
    tops = stars.where("h is not null").select("u", "h")
    least = tops.groupBy("h").agg(F.min("u").alias("v"))
    return stars.where("u != v").select("u", "v").unionByName(tops.join(least, "h").select("u", "v").where("u != v"))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """(id, node, key, comp, class_id, n_links, members) of every row: node identifies its shingle set, comp its class of so
    many rows, key is a hash of id and text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    bands, rows = choose_bands(threshold, recall)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.select("id", "text", F.xxhash64("id", "text").alias("key"))
    kind = base.schema["id"].dataType.simpleString()
    signed = scratch.table(base.mapInArrow(_signer(width, bands, rows), f"id {kind}, key bigint, node binary, bands array<bigint>"))
    nodes = signed.groupBy("node").agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes.withColumn("num", F.monotonically_increasing_id()))  # fixed by the written table
    clusters = scratch.table(components(scratch, _stars(scratch, nodes)).withColumnRenamed("node", "num"))
    size = scratch.table(clusters.groupBy("comp").agg(F.count("*").alias("n")))
    members = attach(clusters, size, ["comp"], "n").join(nodes.select("num", "node", "key", "copies"), "num")
    members = scratch.table(members.select("comp", "num", "node", "copies", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    sifted = sieve(base.select("text", "key"), members, "key").where("_hit").drop("_hit")
    asked = attach(sifted, members, ["key"], "copies").select("comp", "num", "node", "copies", "blocks", "text")
    sets = asked.mapInArrow(_setter(width), "comp bigint, node bigint, copies bigint, blocks int, sh array<bigint>")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("a"), F.greatest("block", j).alias("b")))
    dealt = sets.withColumn("block", block).select("comp", "node", "copies", "sh", "block", F.explode(pairs).alias("p")).select("comp", "p.a", "p.b", "node", "copies", "block", "sh")
    dealt = dealt.repartition(F.col("comp"), F.col("a"), F.col("b")).sortWithinPartitions("comp", "a", "b", "node")
    verified = scratch.table(dealt.mapInArrow(_verifier(threshold), "u bigint, v bigint, links bigint"))
    joined = components(scratch, verified.where("v is not null").select("u", "v")).withColumnRenamed("node", "num")
    links = verified.where("v is null").groupBy(F.col("u").alias("num")).agg(F.sum("links").alias("links"))
    full = nodes.drop("bands", "key").join(joined, "num", "left").join(links, "num", "left")
    full = scratch.table(full.select("node", "rep", "copies", F.coalesce("comp", "num").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = scratch.table(full.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("members"), F.count("*").alias("n")))
    told = scratch.table(attach(full, named, ["comp"], "n").select("node", "copies", "comp", "class_id", "n_links", "members"))
    return attach(signed.select("id", "node", "key"), told, ["node"], "copies").select("id", "node", "key", "comp", "class_id", "n_links", "members")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, **options) -> DataFrame:
    """One row of `docs` for each near-duplicate class, all columns kept: the one with the least id, null counting last.

    Of the rows of a class that share the least id, that of the least text stays. Rows of other classes may share it too:
    they stand for their own. Rows that are all of their class pass without a shuffle, as far as a sieve can tell them.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    joined = scratch.table(_classes(docs, id_col, text_col, width, **options))
    keep = joined.where(F.col("class_id").eqNullSafe(F.col("id"))).select(F.col("id").alias("kept"), F.col("node").alias("of"), F.col("comp").alias("class")).distinct()
    # columns go by number, so no name of theirs can clash
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col(text_col).cast("string").alias("read"))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    marked = sieve(numbered.withColumn("key", F.xxhash64(columns[docs.columns.index(id_col)], "read")), joined.where("members > 1"), "key").drop("key")
    alone = marked.where("not _hit").select(*(F.col(c).alias(name) for c, name in zip(columns, docs.columns, strict=True)))
    numbered = marked.where("_hit").drop("_hit")
    names, text, id_ = [*numbered.columns, "node"], f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(id_col)}"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(len(names) - 2))
            nodes = [d for i, j in slices(off) for d in _digests(*shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names)

    rows = numbered.mapInArrow(add, T.StructType([*(T.StructField(f.name, f.dataType) for f in numbered.schema), T.StructField("node", T.BinaryType())]))
    rows = rows.join(keep, rows[id_].eqNullSafe(keep["kept"]) & (rows["node"] == keep["of"]))
    least = rows.groupBy("class").agg(F.min_by(F.struct(*columns), F.struct(text)).alias("row"))
    return alone.union(least.select(*(F.col("row")[c].alias(name) for c, name in zip(columns, docs.columns, strict=True))))
