"""Greedy, order-dependent duplicate suppression as ordered folds within a group (no Python worker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(df: DataFrame, *, group: str, name: str, order: list[Column], fields: list[str], near) -> DataFrame:
    """(group, name, anchor): anchor is the first retained row that `near(row, retained)` matches, null if the row stays.

    Rows of a group are taken in descending order of `order`, then of name. A row is compared with retained rows only, so
    nearness is not transitive. The fold is quadratic in the rows that a group retains: groups are scenes, small.
    """
    key = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(name).alias("name"), F.struct(*fields).alias("f"))
    rows = df.groupBy(group).agg(F.reverse(F.array_sort(F.collect_list(key))).alias("rows"))
    kind = next(f.dataType for f in rows.schema["rows"].dataType.elementType.fields if f.name == "f").simpleString()
    names = df.schema[name].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<name:{names},f:{kind}>>").alias("kept"), F.array().cast(f"array<struct<name:{names},anchor:{names}>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        anchor = F.try_element_at(F.filter(s["kept"], lambda k: near(r["f"], k["f"])), F.lit(1))["name"]
        kept = F.when(anchor.isNull(), F.array_append(s["kept"], F.struct(r["name"].alias("name"), r["f"].alias("f")))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), F.array_append(s["out"], F.struct(r["name"].alias("name"), anchor.alias("anchor"))).alias("out"))

    folded = rows.select(group, F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("x"))
    return folded.select(group, F.col("x.name").alias(name), F.col("x.anchor").alias("anchor"))


def gap_sample(df: DataFrame, *, group: str, name: str, sequence: str, order: Column, gap: int, least: int = 0) -> DataFrame:
    """(group, name) accepted in `order`: every accepted sequence number lies `gap` or more away; rows without a number
    always pass. A group that yields fewer than `least` raises when it is read."""
    key = F.struct(order.alias("o"), F.col(name).alias("name"), F.col(sequence).cast("bigint").alias("s"))
    names = df.schema[name].dataType.simpleString()
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("rows"))
    start = F.array().cast(f"array<struct<name:{names},s:bigint>>")

    def step(kept: Column, r: Column) -> Column:
        free = r["s"].isNull() | ~F.exists(kept, lambda k: F.coalesce(F.abs(k["s"] - r["s"]) < gap, F.lit(False)))
        return F.when(free, F.array_append(kept, F.struct(r["name"].alias("name"), r["s"].alias("s")))).otherwise(kept)

    taken = F.aggregate("rows", start, step)
    if least:
        rows = rows.withColumn("rows", taken)
        taken = F.when(F.size("rows") < least, F.raise_error(F.lit("not enough rows lie apart")).cast(f"array<struct<name:{names},s:bigint>>")).otherwise(F.col("rows"))
    return rows.select(group, F.explode(taken).alias("x")).select(group, F.col("x.name").alias(name))
