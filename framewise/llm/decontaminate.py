"""Benchmark decontamination with SimHash windows and a multi-index over Hamming blocks, in DataFrame functions only
(operator 5)."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import Scratch

WIDTH, STRIDE = 5, 4
#: Shingles of windows that are matched exactly (all but the first lie STRIDE apart, those of one shingle everywhere).
SIZES = (1, 4, 8, 16)
#: Shingles of item-sized windows: an item takes the largest that fits at STRIDE places in a row (7 bits count 96 at most).
LADDER = (96, 64, 48, 32, 24, 16, 8, 4, 1)
#: Lanes of 7 bits, 9 to a long: 7 longs count 63 bits of up to 127 shingles.
LANES, COUNTS = sum(1 << (7 * k) for k in range(9)), [f"c{j}" for j in range(7)]
MASK = (1 << 63) - 1
#: Blocks (first bit, bits) of a fingerprint. Within RADIUS bits, some block differs in at most RADIUS // 4.
BLOCKS, RADIUS = ((0, 16), (16, 16), (32, 16), (48, 15)), 7
#: Rows of an index that are broadcast at most (about 100 bytes each), and items; larger ones are joined by a shuffle.
INDEX, ITEMS = 500_000, 50_000
#: Bits of the table of item shingles: 32 a shingle, between these bounds (the greater is 8 MB). A fuller table lets more texts pass.
BITS = (1 << 16, 1 << 26)
#: Number of the block that is the whole fingerprint.
WHOLE = len(BLOCKS)
WHITE = " \t\n\r\f\x0b"


def words(text: Column) -> Column:
    """Lower-cased words between white bytes; no words for an empty text."""
    trimmed = F.btrim(F.lower(text), F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t\\n\\r\\f\\x0B]+")).otherwise(F.array().cast("array<string>"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: the optimizer copies no expression across a generator."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def shingled(df: DataFrame, w: Column) -> DataFrame:
    """Add s: 63-bit hashes of the WIDTH-word shingles of the words w, of which each is hashed once."""
    df = _once(df, "_h", F.transform(w, lambda x: F.xxhash64(x)))
    places = F.when(F.size("_h") >= WIDTH, F.sequence(F.lit(0), F.size("_h") - WIDTH)).otherwise(F.array().cast("array<int>"))
    return _once(df, "s", F.transform(places, lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(WIDTH))).bitwiseAND(F.lit(MASK)))).drop("_h")


def _signer(size: int):
    def sign(x: Column, i: Column) -> Column:
        """Bit set where more than half of the window's hashes have it: the count and a fitting addend reach 64."""
        over = [F.shiftright((x[c] + F.lit((64 - size // 2 - 1) * LANES)).bitwiseAND(F.lit(LANES << 6)), 6) for c in COUNTS]
        out = over[0]
        for j in range(1, 7):
            out = out.bitwiseOR(F.shiftleft(over[j], j))
        return F.struct((i * STRIDE).alias("pos"), F.lit(size).alias("size"), out.alias("f"))

    return sign


def windows(df: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Explode shingle hashes s into x (pos, size, f): the SimHash of windows at places 0, STRIDE, 2 STRIDE ..., of every
    size that fits; of one shingle at every place.

    Counts of set bits are kept 9 to a long in lanes of 7 bits. They are summed once for each STRIDE shingles and windows
    add those sums up by doubling, so a size costs 7 additions a window whatever its shingles.
    """
    found = []
    if 1 in sizes:
        found.append(F.transform("s", lambda h, i: F.struct(i.alias("pos"), F.lit(1).alias("size"), h.alias("f"))))
    wide = sorted(s for s in sizes if s > 1)
    if wide:
        lanes = lambda h, j: F.shiftright(F.coalesce(h, F.lit(0).cast("bigint")), j).bitwiseAND(F.lit(LANES))
        blocks = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
        df = _once(df, f"_b{STRIDE}", F.transform(blocks, lambda i: F.struct(*(sum((lanes(F.get("s", i + k), j) for k in range(1, STRIDE)), lanes(F.get("s", i), j)).alias(c) for j, c in enumerate(COUNTS)))))
        have = {STRIDE}

        def add(size: int) -> None:
            nonlocal df
            if size in have:
                return
            low = next(p for p in (64, 32, 16, 8, 4) if p < size)
            add(low)
            add(size - low)
            left, right, zero = f"_b{low}", f"_b{size - low}", F.lit(0).cast("bigint")
            df = _once(df, f"_b{size}", F.transform(left, lambda x, i: F.struct(*((x[c] + F.coalesce(F.get(right, i + low // STRIDE)[c], zero)).alias(c) for c in COUNTS))))
            have.add(size)

        for size in wide:
            add(size)
            found.append(F.transform(F.slice(f"_b{size}", F.lit(1), F.greatest(F.lit(0), F.floor((F.size("s") - size) / STRIDE).cast("int") + 1)), _signer(size)))
    rest = [c for c in df.columns if c != "s" and not c.startswith("_b")]
    return df.select(*rest, F.explode(F.concat(*found)).alias("x")).select(*rest, "x.pos", "x.size", "x.f")


def _block(f: Column, k: int) -> Column:
    first, bits = BLOCKS[k]
    return F.shiftright(f, first).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def least_lengths(threshold: float, repeats: int) -> list[tuple[int, int]]:
    """(size, least shingles) by falling size: an item of so many shingles shares with every passage of its own length
    (one word more or less, or cut off by the text) that reaches `threshold` a run of size + STRIDE - 1 shingles at least.

    A passage that shares s shingles has 1 / threshold - 1 times s others at most, its own and the item's. Where two runs
    meet in the passage at least 4 - `repeats` (the words of the longest word sequence the item holds twice) of its
    shingles are new, and as many of the item's are lost, but for one word of length. Longer repeats prove nothing: only
    single shingles are sure, as STRIDE of them are taken at each place.
    """
    out = [(SIZES[0], 1)]
    if repeats < WIDTH - 1:
        for size in SIZES[1:]:
            good = None
            for shared in range(2000, 0, -1):
                runs = 1 + int(((1 / threshold - 1) * shared + 1 + 1e-9) / (2 * (WIDTH - 1 - repeats)))
                if -(-shared // runs) < size + STRIDE - 1:
                    break
                good = shared
            if good:
                out.append((size, next(n for n in itertools.count(good) if math.ceil(threshold * n - 1e-9) >= good)))
    return out[::-1]


def _whole(f: Column) -> Column:
    return f.bitwiseXOR(F.shiftright(f, 32)).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def item_index(items: DataFrame, radius: int = RADIUS, threshold: float = 0.8) -> DataFrame:
    """(size, block, key, f, item, n, offset): windows of every item at every place; n counts the item's shingles.

    Item-sized windows (LADDER) have a row for every key near one of their blocks: a block's key takes every value within
    radius // 4 flips, so by the pigeonhole principle a document window within `radius` bits shares a key. Document windows
    lie STRIDE apart and an item-sized one fits at STRIDE places in a row, so an unedited passage meets one in step.
    Windows of the size of `least_lengths` are matched by their whole fingerprint: no passage at `threshold` is missed.
    """

    def twice(k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, F.lit(k)), " "))
        return F.size(F.array_distinct(grams)) < F.size(grams)

    fit = shingled(items.select("item", "words", F.coalesce(*(F.when(twice(k), k) for k in range(WIDTH - 1, 0, -1)), F.lit(0)).alias("repeats")), F.col("words"))
    fit = fit.select("item", "s", F.size("s").alias("n"), "repeats", F.explode(F.sequence(F.lit(0), F.lit(STRIDE - 1))).alias("phase")).where(F.col("n") > F.col("phase"))
    sure = F.coalesce(*(F.when((F.col("repeats") == k) & (F.col("n") >= least), size) for k in range(WIDTH) for size, least in least_lengths(threshold, k)))
    wide = F.coalesce(*(F.when(F.col("n") >= size + STRIDE - 1, size) for size in LADDER), F.lit(1))
    fit = fit.select("item", "n", "phase", sure.alias("sure"), wide.alias("wide"), F.slice("s", F.col("phase") + 1, F.col("n")).alias("s"))
    cut = windows(fit, tuple(sorted({*SIZES, *LADDER}))).where((F.col("size") > 1) | (F.col("phase") == 0))
    cut = cut.withColumn("offset", F.col("pos") + F.col("phase"))
    flips = [[sum(1 << b for b in c) for d in range(radius // len(BLOCKS) + 1) for c in itertools.combinations(range(bits), d)] for _, bits in BLOCKS]

    def around(k: int) -> Column:
        return F.transform(F.array(*map(F.lit, flips[k])), lambda m: F.struct(F.lit(k).alias("block"), _block(F.col("f"), k).bitwiseXOR(m).alias("key")))

    near = cut.where(F.col("size") == F.col("wide")).select("size", "f", "item", "n", "offset", F.explode(F.concat(*map(around, range(len(BLOCKS))))).alias("k"))
    whole = cut.where(F.col("size") == F.col("sure")).select("size", F.lit(WHOLE).alias("block"), _whole(F.col("f")).alias("key"), "f", "item", "n", "offset")
    return near.select("size", "k.block", "k.key", "f", "item", "n", "offset").unionByName(whole)


def _probes(h: Column, bits: int) -> list[Column]:
    """Three places of a 63-bit hash in a table of `bits` (a power of two) bits."""
    return [F.shiftright(h, k).bitwiseAND(F.lit(bits - 1)) for k in (0, 18, 36)]


def _shingle_table(listed: DataFrame, shingles: int) -> tuple[Column, int]:
    """A table of bits (an array literal of longs) that every shingle of an item sets, and its number of bits.

    Only the table, of a bounded size, reaches the driver.
    """
    bits = min(max(BITS[0], 1 << (32 * shingles - 1).bit_length()), BITS[1])
    at = shingled(listed.select("words"), F.col("words")).select(F.explode("s").alias("h")).select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("p"))
    one = F.lit(1).cast("bigint")
    longs = at.groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    table = [0] * (bits >> 6)
    for r in longs.collect():
        table[r["id"]] = r.b
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), bits  # folded to one literal


def _shingles(w: Column) -> Column:
    places = F.when(F.size(w) >= WIDTH, F.sequence(F.lit(1), F.size(w) - WIDTH + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i, F.lit(WIDTH)), " "))


def _likeness(a: str, b: str) -> Column:
    """Weighted Jaccard of two array columns as multisets: shared weight over joint weight."""

    def times(xs: str, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    repeated = F.aggregate(F.array_distinct(b), F.lit(0), lambda t, x: t + F.least(times(a, x), times(b, x)))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(repeated)
    return both / (F.size(a) + F.size(b) - both)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(id, item, place, similarity): passages of documents that repeat a benchmark item.

    A passage at `threshold` holds that part of its item's shingles, so texts with fewer of any item's shingles (a table of
    bits tells, some more pass) than that part of the shortest item need no windows.
    Every window of every other whole text is fingerprinted; all within `radius` bits of an item-sized window, and all
    that equal a window of an item, are candidates (`least_lengths`: no passage at `threshold` lacks one). All passages
    of the item's length, or a word more or less, that hold a candidate are compared with the whole item by weighted
    Jaccard of 5-word shingles; the best at `threshold` or more is kept, the first place of ties. The corpus is read once
    whatever the number of items: an index beyond INDEX rows is joined by a shuffle.

    Items under 5 words have no shingle and match nothing, as do such texts, nulls and empty ones. Null ids of documents
    are kept apart by null-safe joins, items are joined by a number of their own, so that a null id is as good as any; rows
    that share an id share their matches; equal items all match. Empty tables: no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    listed = items.select(F.col(item_col).alias("item"), words(F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))).alias("words")).where(F.size("words") >= WIDTH)
    listed = scratch.table(listed.distinct().select(F.monotonically_increasing_id().alias("number"), F.col("item").alias("name"), "words"))
    names, listed = listed.select("number", "name"), listed.select(F.col("number").alias("item"), "words")
    number, places, least = listed.agg(F.count("*"), F.sum(F.size("words")), F.min(F.size("words"))).first()
    if not number:
        kind = base.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, item {names.schema['name'].dataType.simpleString()}, place int, similarity double")
    index = scratch.table(item_index(listed, radius, threshold))
    indexed, sizes = index.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()
    small = number <= ITEMS and places <= 20 * ITEMS
    table, bits = _shingle_table(listed, places)

    def known(h: Column) -> Column:
        one = lambda p: F.call_function("shiftright", F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        a, b, c = map(one, _probes(h, bits))
        return a & b & c

    asked = shingled(base.select("id", "text"), words(F.col("text"))).where(F.size(F.filter("s", known)) >= math.ceil(threshold * (least - WIDTH + 1) - 1e-9))
    asked = scratch.table(asked.select(F.monotonically_increasing_id().alias("row"), "id", "text"))
    keys = F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("f"), k).alias("key")) for k in range(len(BLOCKS))), F.struct(F.lit(WHOLE).alias("block"), _whole(F.col("f")).alias("key")))
    cut = windows(shingled(asked.select("row", "text"), words(F.col("text"))).select("row", "s"), tuple(sizes))
    cut = cut.select("row", "pos", "size", "f", F.explode(keys).alias("k")).select("row", "pos", F.col("size").alias("wsize"), F.col("f").alias("wf"), F.col("k.block").alias("wblock"), F.col("k.key").alias("wkey"))
    near = (F.col("wkey") == F.col("key")) & (F.col("wblock") == F.col("block")) & (F.col("wsize") == F.col("size")) & (F.bit_count(F.col("wf").bitwiseXOR(F.col("f"))) <= radius)
    found = cut.join(F.broadcast(index) if indexed <= INDEX else index, near)
    found = scratch.table(found.select("row", "item", "n", F.floor((F.col("pos") - F.col("offset")) / F.col("n")).cast("int").alias("cell")).distinct())
    full = asked.join(found, "row").select("id", "item", "n", "cell", words(F.col("text")).alias("w"))
    first = F.greatest(F.lit(0), (F.col("cell") - 1) * F.col("n"))
    full = full.select("id", "item", "n", first.alias("first"), F.slice("w", first + 1, 4 * F.col("n") + 2 * WIDTH).alias("w")).where(F.size("w") >= WIDTH)
    listed = listed.withColumns({"n": F.size("words") - WIDTH + 1, "b": _shingles(F.col("words"))}).drop("words")
    full = full.join(F.broadcast(listed) if small else listed, ["item", "n"]).withColumn("a", _shingles(F.col("w")))
    # Of an item's shingles a passage must hold `threshold`: so must its surroundings, and each start that is tried.
    need = F.ceil(threshold * F.col("n") - 1e-9)
    full = full.where(F.col("n") - F.size(F.array_except("b", "a")) >= need).withColumn("held", F.transform("a", lambda x: F.array_contains("b", x)))
    starts = F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: F.size(F.filter(F.slice("held", i, F.col("n") + 1), lambda x: x)) >= need)
    tried = full.select("id", "item", "n", "first", "a", "b", F.explode(starts).alias("start"))
    tried = tried.select("id", "item", "first", "start", "a", "b", F.explode(F.array(*(F.col("n") + e for e in (-1, 0, 1)))).alias("m")).where("m > 0")
    cut = tried.select("id", "item", (F.col("first") + F.col("start") - 1).alias("at"), F.slice("a", F.col("start"), F.col("m")).alias("a"), "b")
    rated = cut.select("id", "item", "at", _likeness("a", "b").alias("similarity"))
    kept = rated.where(F.col("similarity") >= threshold - 1e-9)
    named = kept.join(F.broadcast(names) if small else names, F.col("item") == F.col("number")).select("id", F.col("name").alias("item"), "at", "similarity")
    best = named.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("at")).alias("at"))).alias("b"))
    return scratch.table(best.select(F.col("id").alias(id_col), "item", (-F.col("b.at")).alias("place"), F.col("b.similarity").alias("similarity")))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document row: (id, contaminated, items array, similarity: the best, null without a match)."""
    found = matches(docs, items, id_col, **options)
    told = found.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"])).alias("items"), F.max("similarity").alias("similarity"))
    ids = docs.select(id_col)
    return ids.join(told, ids[id_col].eqNullSafe(told["_id"]), "left").select(id_col, F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array()).alias("items"), "similarity")
