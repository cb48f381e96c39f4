"""Numbers and running sums over a whole table, without a window that gathers it in one task.

The table is cut into ranges of its order; windows run range by range, and only one row a range meets elsewhere. Cuts are
approximate quantiles of a leading number or time, or else, for texts and for keys that many rows share, of all columns of
the order: a bounded list. Rows that are equal in the order always share a range.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def _quantiles(df: DataFrame, key: str, ranges: int) -> list:
    shares = [i / ranges for i in range(1, ranges)]
    kind = df.schema[key].dataType.simpleString()
    value = F.col(key) if kind not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(key).cast("timestamp"))
    return [c for c in df.agg(F.percentile_approx(value, shares, 2000).alias("c")).first()["c"] or () if c == c]


def cuts(df: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Ascending distinct cut points of a numeric or timestamp column; none for an empty table."""
    return sorted(set(_quantiles(df, key, ranges)))


def row_cuts(df: DataFrame, order: list[str], ranges: int = RANGES) -> list:
    """Ascending cut points of the order itself: values of all its columns, from about 64 rows a range that are drawn at random.

    They only say where to cut; which rows were drawn changes no result. Texts and hot keys need them: a key that many
    rows share is cut by the columns after it.
    """
    share = min(1.0, 64 * ranges / max(df.count(), 1))
    drawn = [tuple(r) for r in df.select(*order).where(F.rand(7) < share).orderBy(*order).collect()]
    return list(dict.fromkeys(drawn[len(drawn) * i // ranges] for i in range(1, ranges))) if drawn else []


def row_place(df: DataFrame, order: list[str], points: list) -> Column:
    """Number of the range of a row: the cut points before it in the order (nulls first)."""
    if not points:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in order]
    struct = lambda values: F.struct(*(v.cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))))
    listed = F.array(*(struct([F.lit(v) for v in p]) for p in points))
    return F.size(F.filter(listed, lambda c: c < struct([F.col(o) for o in order])))


def place(key: Column, points: list) -> Column:
    """Number of the range of a key: the cut points below it. Null keys come first, NaN last."""
    if not points:
        return F.lit(0)
    listed = F.array(*map(F.lit, points))
    at = F.size(F.filter(listed, lambda c: c < key))
    return F.when(key.isNull(), F.lit(-1)).otherwise(at)


#: A value that so many of the quantiles share is hot: it is cut by the next columns of the order.
HOT = 8


def _range(df: DataFrame, order: list[str], ranges: int | Column) -> DataFrame:
    if isinstance(ranges, Column):
        return df.withColumn("_range", ranges)
    key = order[0]
    kind = df.schema[key].dataType.simpleString()
    if kind == "string":
        return df.withColumn("_range", row_place(df, order, row_cuts(df, order, ranges)))
    value = F.unix_micros(F.col(key).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(key)
    found = _quantiles(df, key, ranges)
    if len(order) > 1 and max(Counter(found).values(), default=0) >= HOT:
        return df.withColumn("_range", row_place(df, order, row_cuts(df, order, ranges)))
    return df.withColumn("_range", place(value, sorted(set(found))))


def running(df: DataFrame, order: list[str], value: Column, to: str, ranges: int | Column = RANGES, by: list[str] | None = None) -> DataFrame:
    """Add the sum of `value` over all rows (of each `by`) up to this one in ascending `order`, which should be total.

    ranges: their number, or the range of each row where one is known, as an expression that ascends with the order.
    """
    by = by or []
    cut = _range(df.withColumn("_value", value), order, ranges)
    totals = cut.groupBy(*by, "_range").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    ahead = totals.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_ahead"))
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = cut.withColumn(to, F.sum("_value").over(w)).join(ahead, same)
    return joined.withColumn(to, F.col(to) + F.col("_ahead")).drop("_range", "_value", "_ahead", "_r", *(f"_by{i}" for i in range(len(by))))


def numbered(df: DataFrame, order: list[str], to: str, ranges: int | Column = RANGES) -> DataFrame:
    """Add the place of each row, from 1 on, in ascending `order` (which should be total)."""
    return running(df, order, F.lit(1).cast("bigint"), to, ranges)


#: Consecutive numbers to a range, for keys that are themselves numbers without large gaps.
BLOCK = 1 << 16


def block(key: str) -> Column:
    """The range of a key that counts up: no look at the table is needed."""
    return F.floor(F.col(key) / BLOCK)
