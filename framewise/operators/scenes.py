"""Scene detection and ordered grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.scalars import gap_seconds
from framewise.operators import ranges


def assign_scenes(df: DataFrame, *, folder: str, time: str, order: list[str], sequence: str | None = None, max_gap: float = 4.0, max_step: int = 3) -> DataFrame:
    """Add scene_number, scene_id and scene_index.

    Rows of a folder in order of time (then `order`) begin a new scene where the gap is above max_gap, or where both
    sequence numbers are non-zero and the signed step is above max_step. Scenes are numbered through all folders in
    folder order: windows run folder by folder, and folders are numbered range by range.
    """
    w = Window.partitionBy(folder).orderBy(time, *order)
    before, step = F.lag(time).over(w), F.lit(False)
    if sequence:
        last = F.lag(sequence).over(w)
        step = (F.col(sequence) != 0) & (last != 0) & (F.col(sequence) - last > max_step)
    new = before.isNull() | (gap_seconds(before, F.col(time)) > max_gap) | step
    local = df.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counts = local.groupBy(folder).agg(F.max("_local").alias("_n"))
    blocks = ranges.block(folder) if df.schema[folder].dataType.simpleString() in ("int", "bigint") else ranges.RANGES
    offsets = ranges.running(counts, [folder], F.col("_n"), "_offset", blocks).withColumn("_offset", F.col("_offset") - F.col("_n")).drop("_n")
    out = local.join(offsets, folder).withColumn("scene_number", F.col("_local") + F.col("_offset"))
    index = F.row_number().over(Window.partitionBy("scene_number").orderBy(time, *order))
    return out.withColumn("scene_id", F.format_string("scene-%04d", "scene_number")).withColumn("scene_index", index).drop("_new", "_local", "_offset")


def limit_scenes(df: DataFrame, n: int, scene: str = "scene_id") -> DataFrame:
    """Whole scenes: the first n scene ids as strings."""
    return df.join(F.broadcast(df.select(scene).distinct().orderBy(scene).limit(n)), scene, "left_semi")


def cohorts(df: DataFrame, size: int, *, scene: str, order: list[Column | str], prefix: str = "scene-cohort-") -> DataFrame:
    """Consecutive chunks of `size` rows within a scene; cohort_id counts through the scenes in order."""
    chunk = F.floor((F.row_number().over(Window.partitionBy(scene).orderBy(*order)) - 1) / size).cast("bigint")
    cut = df.withColumn("_chunk", chunk)
    blocks = ranges.block(scene) if df.schema[scene].dataType.simpleString() in ("int", "bigint") else ranges.RANGES
    counts = cut.groupBy(scene).agg((F.max("_chunk") + 1).alias("_n"))  # a row a scene, however large
    heads = ranges.running(counts, [scene], F.col("_n"), "_to", blocks)
    number = F.col("_to") - F.col("_n") + F.col("_chunk") + 1
    return cut.join(heads, scene).withColumn("cohort_number", number).withColumn("cohort_id", F.format_string(prefix + "%03d", "cohort_number")).drop("_chunk", "_n", "_to")


def top_per_scene(df: DataFrame, k: int, *, scene: str, order: list[Column | str]) -> DataFrame:
    return df.withColumn("rank_in_scene", F.row_number().over(Window.partitionBy(scene).orderBy(*order))).where(F.col("rank_in_scene") <= k)


def rescue(df: DataFrame, *, scene: str, ready: str, order: list[Column | str], floors: dict[str, float], share: float = 0.75) -> DataFrame:
    """The best rejected row of each scene without a ready row, if a metric reaches `share` of its floor."""
    w = Window.partitionBy(scene)
    ranked = df.withColumn("_any", F.max(F.col(ready).cast("int")).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(*order)))
    good = F.lit(False)
    for name, floor in floors.items():
        good = good | (F.coalesce(F.col(name), F.lit(0.0)) >= share * floor)
    return ranked.where((F.col("_any") == 0) & (F.col("_rn") == 1) & good).drop("_any", "_rn")


def winner_disagreement(df: DataFrame, *, scene: str, left: str, right: str, name: str) -> DataFrame:
    """Scenes of two rows or more whose winners by two scores differ; ties go to the greatest name."""
    best = df.groupBy(scene).agg(F.count("*").alias("n"), *(F.max(F.struct(c, F.lower(name).alias("k"), F.col(name).alias("name"))).getField("name").alias(f"{c}_winner") for c in (left, right)))
    return best.where((F.col("n") >= 2) & (F.col(f"{left}_winner") != F.col(f"{right}_winner")))
