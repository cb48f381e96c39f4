"""Canonical exact document fingerprints, in DataFrame functions only (operator 3)."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import Scratch, attach


@functools.cache
def _tables() -> tuple[str, str, str, str]:
    """From the Unicode database: JSON maps of decompositions, compositions and combining classes, and a class of the
    characters whose compatibility composition differs from themselves."""
    apart, together, order, odd = {}, {}, {}, []
    for code in range(sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if (d := unicodedata.normalize("NFKD", c)) != c:
            apart[c] = d
        if unicodedata.combining(c):
            order[c] = str(unicodedata.combining(c))
        if unicodedata.normalize("NFKC", c) != c:
            odd.append(code)
        pair = unicodedata.normalize("NFD", c) if c in apart else ""
        if len(pair) >= 2 and unicodedata.normalize("NFC", pair) == c:
            together[unicodedata.normalize("NFC", pair[:-1]) + pair[-1]] = c
    runs: list[list[int]] = []
    for code in odd:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)
    return json.dumps(apart), json.dumps(together), json.dumps(order), ranges


def _map(text: str) -> Column:
    return F.from_json(F.lit(text), "map<string,string>")


def _composed(cluster: Column) -> Column:
    """NFKC of a short run of characters: decompose, order the marks, compose."""
    apart, together, order, _ = (_map(x) if x[0] == "{" else x for x in _tables())

    def rank(c: Column) -> Column:
        return F.coalesce(F.try_element_at(order, c).cast("int"), F.lit(0))

    chars = F.regexp_extract_all(cluster, F.lit("(?s)."), F.lit(0))
    loose = F.flatten(F.transform(chars, lambda c: F.regexp_extract_all(F.coalesce(F.try_element_at(apart, c), c), F.lit("(?s)."), F.lit(0))))
    ranked = F.transform(loose, lambda c: F.struct(c.alias("c"), rank(c).alias("r")))
    keyed = F.transform(ranked, lambda x, i: F.struct(F.size(F.filter(F.slice(ranked, F.lit(1), i + 1), lambda y: y["r"] == 0)).alias("base"), x["r"].alias("r"), i.alias("i"), x["c"].alias("c")))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("tail"), F.lit(-1).alias("last"))

    def step(s: Column, x: Column) -> Column:
        one = F.try_element_at(together, F.concat(s["starter"], x["c"]))
        free = (s["starter"] != "") & one.isNotNull() & (s["last"] < x["r"])
        grown = F.struct(s["done"].alias("done"), one.alias("starter"), s["tail"].alias("tail"), s["last"].alias("last"))
        begun = F.struct(F.concat(s["done"], s["starter"], s["tail"]).alias("done"), x["c"].alias("starter"), F.lit("").alias("tail"), F.lit(-1).alias("last"))
        kept = F.struct(s["done"].alias("done"), s["starter"].alias("starter"), F.concat(s["tail"], x["c"]).alias("tail"), x["r"].alias("last"))
        return F.when(free, grown).when(x["r"] == 0, begun).otherwise(kept)

    return F.aggregate(F.array_sort(keyed), start, step, lambda s: F.concat(s["done"], s["starter"], s["tail"]))


def _replaced(text: Column, pattern: str, by) -> Column:
    """Every distinct match of the pattern replaced, the longest first; a text has few distinct ones."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    longest = F.reverse(F.array_sort(F.transform(found, lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))))
    pairs = F.transform(longest, lambda x: F.struct(x["c"].alias("a"), by(x["c"]).alias("b")))
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["a"], p["b"]))


def _syllable(cluster: Column) -> Column:
    """Hangul composition by arithmetic on the code points of a leading, a vowel and perhaps a trailing letter."""

    def code(i: int) -> Column:
        return F.ascii(F.substring(cluster, i, 1))

    whole = code(1) >= 0xAC00
    block = F.when(whole, code(1)).otherwise((code(1) - 0x1100) * 588 + (code(2) - 0x1161) * 28 + 0xAC00)
    tail = F.when(whole, code(2) - 0x11A7).when(F.length(cluster) > 2, code(3) - 0x11A7).otherwise(F.lit(0))
    return F.decode(F.unhex(F.hex(block + tail)), "UTF-16BE")


def normalised(text: Column) -> Column:
    """NFKC. Texts of ASCII and plain Latin letters, which are their own NFKC, pass after one scan.

    `replace` works on code points: a cluster is replaced wherever it stands, so clusters hold the marks behind a
    character, and the longest are replaced first.
    """
    ranges = _tables()[3]
    jamo = "[\\x{1100}-\\x{1112}][\\x{1161}-\\x{1175}][\\x{11A8}-\\x{11C2}]?|[\\x{AC00}-\\x{D7A3}][\\x{11A8}-\\x{11C2}]"
    loose = _replaced(text, f"(?s)[{ranges}]\\p{{M}}*|.\\p{{M}}+", _composed)
    # Latin-1 characters that NFKC changes, and all from U+0132 on
    suspect = "[\\x{A0}\\x{A8}\\x{AA}\\x{AF}\\x{B2}-\\x{B5}\\x{B8}-\\x{BA}\\x{BC}-\\x{BE}]|[^\\x{0}-\\x{131}]"
    return F.when(text.rlike(suspect), _replaced(loose, jamo, _syllable)).otherwise(text)


def with_canonical(df: DataFrame, source: str, to: str) -> DataFrame:
    """Add column `to`: `source` in NFKC, case folded by way of upper case, normalised again, white runs to one space.

    One projection a step: each step names the column before it several times, and nested expressions would repeat it.
    The empty string between the case functions keeps the optimizer from dropping the inner one.
    """
    df = df.withColumn(to, normalised(F.col(source)))
    df = df.withColumn(to, F.lower(F.concat(F.upper(to), F.lit(""))))
    df = df.withColumn(to, normalised(F.col(to)))
    return df.withColumn(to, F.trim(F.regexp_replace(to, "[\\p{IsWhite_Space}]+", " ")))


def wide_hash(text: Column) -> tuple[Column, Column]:
    """128 bits: two xxhash64 of different seeds."""
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def _hex(a: str, b: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(x)), 16, "0") for x in (a, b))))


def _clashes(hashed: DataFrame, buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets (a, b) that hold different canonical texts c. Bytes are compared through the least and the greatest text
    of each bucket of two or more rows, pre-aggregated, so a hot bucket does not gather in one task."""
    shared = scratch.table(buckets.where("copies > 1"))
    compared = attach(hashed, shared, ["a", "b"], "copies").groupBy("a", "b").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    return scratch.table(compared.where("least != most").select("a", "b", F.lit(True).alias("clash")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, copies) of every row: texts with the same canonical form, and only they, share a fingerprint.

    A null text is an empty one. Rows are grouped by the 128-bit hash of the canonical text and bytes are compared within
    each bucket; should a bucket hold different texts, the SHA-256 of each is added to its fingerprint. Empty table: no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    a, b = wide_hash(F.col("c"))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = with_canonical(base, "text", "c").select("id", "c", a.alias("a"), b.alias("b"))
    rows = scratch.table(hashed.select("id", "a", "b"))
    buckets = scratch.table(rows.groupBy("a", "b").agg(F.count("*").alias("copies")))
    clash = _clashes(hashed, buckets, scratch)
    if clash.isEmpty():
        return attach(rows, buckets, ["a", "b"], "copies").select(F.col("id").alias(id_col), _hex("a", "b").alias("fingerprint"), "copies")
    print_ = F.when(F.col("clash"), F.concat(_hex("a", "b"), F.lit("-"), F.sha2("c", 256))).otherwise(_hex("a", "b"))
    named = scratch.table(hashed.join(clash, ["a", "b"], "left").select("id", print_.alias("fingerprint")))
    counts = scratch.table(named.groupBy("fingerprint").agg(F.count("*").alias("copies")))
    return attach(named, counts, ["fingerprint"], "copies").select(F.col("id").alias(id_col), "fingerprint", "copies")


def following(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Distinct rows of the keys, each with the next one in ascending order as struct `next`; after the last the first.

    The order is cut into ranges and found range by range; only the heads of the ranges (a few hundred) meet in one task.
    """
    spark = rows.sparkSession
    distinct = rows.select(*keys).distinct()
    ranges = max(2, min(2000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cut = scratch.table(distinct.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    key = F.struct(*keys)
    heads = cut.groupBy("_range").agg(F.min(key).alias("head"))
    ring = Window.orderBy("_range")
    heads = heads.select(F.col("_range").alias("_r"), F.coalesce(F.lead("head").over(ring), F.first("head").over(ring)).alias("head"))
    inner = cut.withColumn("next", F.lead(key).over(Window.partitionBy("_range").orderBy(*keys)))
    return inner.join(F.broadcast(heads), F.col("_range") == F.col("_r")).select(*keys, F.coalesce("next", "head").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending id, after the last that of the first. Repeated ids are ordered by text hash, equal rows have
    one successor, null ids come first. An exact digest's likeness is 1 for equal fingerprints, else 0; equality with
    the edited text is decided on bytes.
    """
    scratch = Scratch(docs.sparkSession, "edited")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a, b = wide_hash(F.col("text"))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", a.alias("ta"), b.alias("tb"))
    keyed = scratch.table(base.select("id", "ta", "tb", F.char_length("text").cast("bigint").alias("n")))
    after = scratch.table(following(keyed, ["id", "ta", "tb", "n"], scratch))
    prefix = base.alias("d").join(after.alias("s"), F.col("d.id").eqNullSafe(F.col("s.next.id")) & (F.col("d.ta") == F.col("s.next.ta")) & (F.col("d.tb") == F.col("s.next.tb")))
    prefix = prefix.select("s.id", "s.ta", "s.tb", F.expr("substring(d.text, 1, cast(s.n div 4 as int))").alias("pre")).groupBy("id", "ta", "tb").agg(F.first("pre").alias("pre"))
    both = base.alias("d").join(prefix.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.ta") == F.col("p.ta")) & (F.col("d.tb") == F.col("p.tb")))
    n = F.char_length("text").cast("bigint")
    made = both.select("d.id", "d.ta", "d.tb", "d.text", n.alias("n"), F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("pre")).alias("edited"))
    made = made.select("id", "ta", "tb", "n", "text", "edited", F.sha2("edited", 256).alias("sha"))
    made = with_canonical(with_canonical(made, "text", "c"), "edited", "e")
    ha, hb, ea, eb = (*wide_hash(F.col("c")), *wide_hash(F.col("e")))
    made = scratch.table(made.select("id", "ta", "tb", "n", "sha", ha.alias("a"), hb.alias("b"), ea.alias("ea"), eb.alias("eb"), (F.col("c") == F.col("e")).alias("same")))
    # only texts of buckets that several rows share are folded once more, after they have been picked
    shared = scratch.table(made.groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1"))
    picked = scratch.table(attach(made.select("ta", "tb", "a", "b"), shared, ["a", "b"], "copies").groupBy("ta", "tb").agg(F.count("*").alias("n")))
    texts = attach(base.select("ta", "tb", "text"), picked, ["ta", "tb"], "n").select("ta", "tb", "text")
    hashed = with_canonical(texts, "text", "c").select("ta", "tb", "c", ha.alias("a"), hb.alias("b"))
    compared = hashed.groupBy("a", "b").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    clash = scratch.table(compared.where("least != most").select("a", "b", F.lit(True).alias("clash")))
    told = made.withColumn("f", _hex("a", "b"))
    if not clash.isEmpty():
        split = hashed.join(clash, ["a", "b"], "left_semi").select("ta", "tb", F.sha2("c", 256).alias("more")).distinct()
        told = told.join(split, ["ta", "tb"], "left").withColumn("f", F.concat_ws("-", "f", "more"))
    told = told.select("id", "ta", "tb", "n", "sha", "f", _hex("ea", "eb").alias("e"), "same")
    nexts = told.select("id", "ta", "tb", "f").distinct()
    next_f = after.join(nexts.alias("x"), F.col("next.id").eqNullSafe(F.col("x.id")) & (F.col("next.ta") == F.col("x.ta")) & (F.col("next.tb") == F.col("x.tb"))).select(after["id"].alias("i"), after["ta"].alias("ja"), after["tb"].alias("jb"), F.col("x.f").alias("nf"))
    out = told.join(next_f, told["id"].eqNullSafe(F.col("i")) & (told["ta"] == F.col("ja")) & (told["tb"] == F.col("jb")))
    edited = F.when(F.col("same"), F.col("f")).when(F.col("e") == F.col("f"), F.concat("e", F.lit("-e"))).otherwise(F.col("e"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("f").alias("fingerprint"), edited.alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"), (F.col("f") == F.col("nf")).cast("double").alias("near_next"),
    )
