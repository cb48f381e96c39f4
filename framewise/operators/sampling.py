"""Reproducible samples: draws come from md5, so they do not depend on the engine or on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.scalars import draw
from framewise.operators.ranges import numbered


def evenly_spaced(df: DataFrame, k: int, *, order: list[str]) -> DataFrame:
    """Rows at int((i + 1/2) n / k); more than there are raises. Rows are numbered range by range."""
    ranked = numbered(df, order, "_i").withColumn("_i", F.col("_i") - 1).crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    places = df.sparkSession.range(k).select(F.col("id").alias("sample"))
    met = ranked.join(F.broadcast(places), F.col("_i") == F.floor((F.col("sample") + 0.5) * F.col("_n") / k))
    checked = F.when(F.col("_n") < k, F.raise_error(F.lit("sample is larger than the table")).cast("bigint")).otherwise(F.col("sample"))
    return met.withColumn("sample", checked).drop("_i", "_n")


def balanced(df: DataFrame, *, folder: str, name: str, folders: int, total: int, seed: str) -> DataFrame:
    """`total` rows from `folders` folders in drawn order: each gives total div folders, the first few one more."""
    chosen = df.select(folder).distinct().withColumn("_d", draw(F.lit(seed), folder)).orderBy("_d", folder).limit(folders)
    chosen = chosen.withColumn("place", F.row_number().over(Window.orderBy("_d", folder)))
    quota = F.lit(total // folders) + F.when(F.col("place") <= total % folders, 1).otherwise(0)
    rows = df.join(F.broadcast(chosen.withColumn("quota", quota).drop("_d")), folder)
    rn = F.row_number().over(Window.partitionBy(folder).orderBy(draw(F.lit(seed), folder, name), name))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def first_of_each(df: DataFrame, n: int, *, by: str, order: list[Column | str], to: str) -> DataFrame:
    """The first n rows of each value of `by`, numbered. As the number is bounded, Spark keeps n rows a value in each task before
    it shuffles (up to `spark.sql.optimizer.windowGroupLimitThreshold`), so a few large strata do not meet whole."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(to) <= n)


def round_robin(df: DataFrame, n: int, *, stratum: str, priority: str, order: list[Column | str]) -> DataFrame:
    """One row of each stratum a pass, strata in order of priority, until there are n."""
    return first_of_each(df, n, by=stratum, order=order, to="_rn").orderBy("_rn", priority, *order).limit(n).drop("_rn")


def interleaved(df: DataFrame, *, category: str, item: str, order: list[Column | str], cap: int) -> DataFrame:
    """(item, position, reasons): categories in turn, first appearance kept, all reasons listed, `cap` items.

    An item stands once in a category, so the first `cap` rows of each category hold the first `cap` items. The reasons of
    these alone are then looked up in the whole table, by a broadcast of `cap` rows.
    """
    ranked = first_of_each(df, cap, by=category, order=order, to="_rn")
    first = ranked.groupBy(item).agg(F.min(F.struct("_rn", category)).alias("_at")).orderBy("_at", item).limit(cap)
    placed = first.withColumn("position", F.row_number().over(Window.orderBy("_at", item))).drop("_at")  # cap rows
    told = df.join(F.broadcast(placed), item).groupBy(item, "position")
    return told.agg(F.array_join(F.array_sort(F.collect_set(category)), ",").alias("reasons"))


def ab_assignment(df: DataFrame, key: str, seed: str) -> DataFrame:
    return df.withColumn("first_model", F.when(draw(F.lit(seed), key) % 2 == 0, "A").otherwise("B"))


def first_middle_last(df: DataFrame, *, partition: str, order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(partition)
    rn, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return df.withColumn("place", rn).withColumn("_n", n).where((F.col("place") == 1) | (F.col("place") == F.floor(F.col("_n") / 2) + 1) | (F.col("place") == F.col("_n"))).drop("_n")
