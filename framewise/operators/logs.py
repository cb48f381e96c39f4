"""Append-only logs, lookups, merges and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, *, key: list[str], offset: str) -> DataFrame:
    """The last record of each key, by an explicit offset; partial aggregation keeps hot keys apart."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(offset)).alias("_r")).select(*key, *(F.col("_r")[c].alias(c) for c in rest))


def merge_signals(base: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """(key, signal, value) of base keys: a later source wins for each (key, signal), even with a null value."""
    ranked = [s.select(key, "signal", F.struct(F.lit(i).alias("rank"), F.col("value")).alias("x")) for i, s in enumerate(sources)]
    merged = reduce(DataFrame.unionByName, ranked).groupBy(key, "signal").agg(F.max_by("x.value", "x.rank").alias("value"))
    return base.select(key).distinct().join(merged, key)


def merge_records(base: DataFrame, rows: DataFrame, *, key: str, rank: str, fields: list[str]) -> DataFrame:
    """`base` with the signals of its rows' matches laid over its own, and `matched`, their number.

    Keys are compared in lower case. Of several matches the greatest rank wins for each signal, even with a null; a field
    is taken from the last match that has it. rows: (key, rank, signal, value, fields...), one row a signal.
    """
    k = F.lower(key)
    last = rows.groupBy(k.alias("_k"), "signal").agg(F.max_by("value", rank).alias("value"))
    told = last.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("signal", "value"))).alias("_new"))
    found = rows.groupBy(k.alias("_k")).agg(F.count_distinct(rank).alias("_n"), *(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(rank))).alias(f"_{f}") for f in fields))
    joined = base.withColumn("_k", k).join(told, "_k", "left").join(found, "_k", "left")
    own = F.coalesce("signals", F.create_map().cast(base.schema["signals"].dataType))
    new = F.coalesce("_new", F.create_map().cast(base.schema["signals"].dataType))
    merged = F.map_concat(F.map_filter(own, lambda n, v: ~F.map_contains_key(new, n)), new)
    out = joined.withColumns({"signals": merged, "matched": F.coalesce("_n", F.lit(0).cast("bigint")), **{f: F.coalesce(f"_{f}", f) for f in fields}})
    return out.select(*base.columns, "matched")


def mirror_pairs(df: DataFrame, *, key: str, partner: str, columns: list[str]) -> DataFrame:
    """Rows with a partner take its columns where their own are null. Rows without one are dealt by their own key, not by a
    null that one task would get."""
    other = df.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns)).where(F.col(f"_{columns[0]}").isNotNull())
    joined = df.join(other, (F.coalesce(df[partner], df[key]) == F.col("_k")) & df[partner].isNotNull(), "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_k", *(f"_{c}" for c in columns))


def set_difference(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, side): missing from `got`, or unexpected in it."""
    a, b = expected.select(key).distinct().withColumn("_a", F.lit(1)), got.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "missing").otherwise("unexpected").alias("side"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Locked artifacts: equal as multisets of rows."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_or_verify(df: DataFrame, path: str) -> None:
    """Write a locked artifact, or raise if another one stands there."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df.write.parquet(path)
    elif not same_rows(spark.read.schema(df.schema).parquet(path), df):
        raise ValueError(f"{path} holds other rows")


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    """Names that several rows share but for case."""
    return df.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def output_name(df: DataFrame, *, name: str, key: str, to: str = "output") -> DataFrame:
    """The name, with the key in front of it where the name is not unique."""
    n = F.count("*").over(Window.partitionBy(F.lower(name)))
    return df.withColumn(to, F.when(n > 1, F.concat_ws("-", F.col(key).cast("string"), name)).otherwise(F.col(name)))


def shared_targets(df: DataFrame, *, target: str, owner: str) -> DataFrame:
    """Targets that different owners claim."""
    return df.groupBy(F.lower(target).alias("target")).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def unique_targets(df: DataFrame, *, target: str, owner: str, siblings: DataFrame | None = None) -> DataFrame:
    """`df`, once no target is claimed by two owners, rows that it leaves out (`siblings`) included; else ValueError. One
    row reaches the driver."""
    claims = df.select(target, owner)
    claims = claims if siblings is None else claims.unionByName(siblings.select(target, owner))
    bad = shared_targets(claims, target=target, owner=owner).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['target']} has {bad[0]['owners']} owners")
    return df


def required(df: DataFrame, column: str, message: str) -> DataFrame:
    """Raise on a null when the rows are read."""
    kind = df.schema[column].dataType.simpleString()
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(message)).cast(kind)).otherwise(F.col(column)))


def cache_hits(rows: DataFrame, cache: DataFrame, keys: list[str], signals: list[str], column: str = "signals") -> DataFrame:
    """Rows whose cache entry has the same keys and every signal name."""
    names: Column = F.array(*map(F.lit, signals))
    full = cache.where(F.forall(names, lambda k: F.map_contains_key(F.col(column), k)))
    return rows.join(full.select(*keys), keys, "left_semi")
