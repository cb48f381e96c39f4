"""Scores, percentiles, gates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import ranges


def average_percentile(df: DataFrame, value: str, to: str) -> DataFrame:
    """Mean position of equal values over n - 1; 0.5 for a single row.

    Positions come from counts of distinct values, summed range by range: neither rows nor values meet in one task.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    points = ranges.place(F.col(value), ranges.cuts(df, value))
    below = ranges.running(counts, [value], F.col("_c"), "_b", points).withColumn("_b", F.col("_b") - F.col("_c"))
    placed = below.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    pct = F.when(F.col("_n") == 1, F.lit(0.5)).otherwise((F.col("_b") + (F.col("_c") - 1) / 2) / (F.col("_n") - 1))
    return df.join(placed.select(F.col(value).alias("_v"), pct.alias(to)), df[value].eqNullSafe(F.col("_v"))).drop("_v")


def positional_percentile(df: DataFrame, value: str, name: str, to: str, partition: list[str] | None = None) -> DataFrame:
    """(position - 1) / (n - 1) by value, then name; 0.5 for a single row. Without a partition it is found range by range."""
    if not partition:
        placed = ranges.numbered(df.withColumn("_low", F.lower(name)), [value, "_low", name], "_i").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
        return placed.withColumn(to, F.when(F.col("_n") == 1, F.lit(0.5)).otherwise((F.col("_i") - 1) / (F.col("_n") - 1))).drop("_low", "_i", "_n")
    w = Window.partitionBy(*partition)
    n = F.count("*").over(w)
    return df.withColumn(to, F.when(n == 1, F.lit(0.5)).otherwise((F.row_number().over(w.orderBy(value, F.lower(name), name)) - 1) / (n - 1)))


def blend(df: DataFrame, local: str, learned: str, weight: float, to: str = "combined_rank_score") -> DataFrame:
    """(1 - w) x percentile of local + w x percentile of learned. w = 0 gives null; a missing learned score raises."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie in [0, 1]")
    if weight == 0:
        return df.withColumn(to, F.lit(None).cast("double"))
    checked = df.withColumn(learned, F.when(F.col(learned).isNull(), F.raise_error(F.lit(f"a row has no {learned}")).cast("double")).otherwise(F.col(learned)))
    both = average_percentile(average_percentile(checked, local, "_a"), learned, "_b")
    return both.withColumn(to, (1 - weight) * F.col("_a") + weight * F.col("_b")).drop("_a", "_b")


def _or(c: Column, other: float) -> Column:
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(other))


def local_score(blur: Column, tenengrad: Column, contrast: Column, musiq: Column, nima: Column, cpbd: Column, brisque: Column, brightness: Column, faces: Column | None = None, eyes: Column | None = None) -> Column:
    """Weighted sum of quality metrics; absent or zero metrics count 0, an absent or zero brightness 118."""
    terms = _or(blur, 0.0) + 4.0 * _or(tenengrad, 0.0) + 0.5 * _or(contrast, 0.0) + 3.0 * _or(musiq, 0.0) + 25.0 * _or(nima, 0.0) + 60.0 * _or(cpbd, 0.0) - 0.8 * _or(brisque, 0.0)
    terms = terms - 0.15 * F.abs(_or(brightness, 118.0) - 118.0)
    if faces is not None and eyes is not None:
        terms = terms + 20.0 * F.coalesce(faces, F.lit(0)) + 10.0 * F.coalesce(eyes, F.lit(0))
    return terms


def gate(primary: list[Column], support: list[Column], required: int) -> tuple[Column, Column, Column]:
    """(primaries weak, weak support votes, reject). Votes are three-valued: an absent primary never rejects and an absent
    support vote is no weak vote; at least one weak support vote is always required."""
    weak = F.lit(True)
    for p in primary:
        weak = weak & F.coalesce(p, F.lit(False))
    votes = sum((F.coalesce(s, F.lit(False)).cast("int") for s in support), F.lit(0))
    return weak, votes, weak & (votes >= max(1, required))


def normalised_decision(bucket: Column, rating: Column, label: Column) -> tuple[Column, Column]:
    """(rating, label): reject is -1 and Yellow, review 0 and null, pick at least 4 (if below 1) and Green by default."""
    r = F.when(bucket == "reject", -1).when(bucket == "review", 0).otherwise(F.when(rating < 1, 4).otherwise(rating))
    return r.cast("int"), F.when(bucket == "reject", "Yellow").when(bucket == "review", F.lit(None)).otherwise(F.coalesce(label, F.lit("Green")))


def display_label(bucket: Column, label: Column, source: Column) -> Column:
    return F.when(bucket.isin("pick", "review"), label).when((bucket == "reject") & (source == "local"), "Red").otherwise("Yellow")


def human_label(good: Column, rating: Column, pick: Column) -> Column:
    """good decides; else -1 rejects, a positive value picks, both raise, neither is neutral."""
    no = (F.coalesce(rating, F.lit(0)) == -1) | (F.coalesce(pick, F.lit(0)) == -1)
    yes = (F.coalesce(rating, F.lit(0)) > 0) | (F.coalesce(pick, F.lit(0)) > 0)
    return F.when(good.isNotNull(), F.when(good, "pick").otherwise("reject")).when(no & yes, F.raise_error(F.lit("conflicting labels")).cast("string")).when(no, "reject").when(yes, "pick").otherwise("neutral")


def legacy_bucket(bucket: Column, keep: Column) -> Column:
    return F.coalesce(bucket, F.when(keep, "pick").otherwise("reject"))


def clamped(value: Column, current: Column, reach: float, low: float, high: float) -> Column:
    """value within `reach` of the current one and within its own range."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.least(current + reach, F.greatest(current - reach, value))))


def safe_inset(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height of the largest centred rectangle of the same shape that a rotation leaves filled."""
    a = F.radians(F.abs(degrees))
    c, s = F.cos(a), F.sin(a)
    scale = F.least(F.lit(1.0), width / (width * c + height * s), height / (width * s + height * c))
    return width * scale, height * scale


def crop_rectangle(left: Column, top: Column, right: Column, bottom: Column, enabled: Column) -> tuple[Column, Column]:
    """(has_crop, area): a full frame is no crop, a disabled one resets to it, a side under 0.2 raises."""
    full = (left <= 0) & (top <= 0) & (right >= 1) & (bottom >= 1)
    small = enabled & ((right - left < 0.2) | (bottom - top < 0.2))
    has = F.when(small, F.raise_error(F.lit("crop is too small")).cast("boolean")).otherwise(enabled & ~full)
    return has, F.when(has, (right - left) * (bottom - top)).otherwise(F.lit(1.0))
