"""Album selection: protected picks, near-identical neighbours, summaries and checkpoints by cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.scalars import hamming, split_suffix
from framewise.functions.tiles import mean_difference
from framewise.operators.suppression import FIRST, FOLD, step_keys, suppress_near


def union_selection(run: DataFrame, protected: DataFrame, *, key: str, bucket: str = "bucket", mode: str = "machine") -> DataFrame:
    """Rows of a run to work on, in order of key, by mode.

    machine: picks of the run that nobody protects; union: these and all protected rows, and a protected key that the run
    lacks raises; ignore: picks of the run, whatever is protected. Keys are compared in lower case.
    """
    if mode not in ("machine", "union", "ignore"):
        raise ValueError("mode is machine, union or ignore")
    picked = F.coalesce(F.col(bucket) == "pick", F.lit(False))
    if mode == "ignore":
        return run.where(picked).orderBy(key)
    names = protected.select(F.lower(key).alias("_key")).distinct()
    if mode == "union":
        lost = names.join(run.select(F.lower(key).alias("_key")).distinct(), "_key", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"protected pick is missing from the run: {lost[0]['_key']}")
    told = run.withColumn("_key", F.lower(key)).join(names.withColumn("_held", F.lit(True)), "_key", "left")
    held = F.coalesce("_held", F.lit(False))
    return told.where((picked | held) if mode == "union" else (picked & ~held)).drop("_key", "_held").orderBy(key)


def near_identical(step: int = 3, bits: int = 2, difference: float = 8.0):
    """A predicate for `suppress`: neighbours by number whose hashes and small previews agree."""

    def near(r: Column, k: Column) -> Column:
        return (F.abs(r["_number"] - k["_number"]) <= step) & (hamming(r["hash"], k["hash"]) <= bits) & (mean_difference(r["preview"], k["preview"]) <= difference)

    return near


def suppress(df: DataFrame, *, name: str, score: str, stem: Column, hash_: str, preview: str, bucket: str = "bucket", step: int = 3, near=None, fold: int = FOLD, first: int = FIRST) -> DataFrame:
    """Add represented_by: the better selected neighbour that a selected row repeats; such a row becomes a reject.

    Only picks with a number and a hash are compared, within one name prefix and where numbers lie at most `step` apart, best
    score first and greatest name first among equals, and with retained rows only: so every representative is itself
    retained. Names are unique. Close numbers meet by shared keys (`suppression`), whatever the size of an album.
    """
    near = near or near_identical(step)
    prefix, digits = split_suffix(stem)
    asked = df.select(name, F.col(score).alias("_score"), prefix.alias("_prefix"), digits.try_cast("bigint").alias("_number"), F.col(hash_).alias("hash"), F.col(preview).alias("preview"), bucket)
    asked = asked.where((F.col(bucket) == "pick") & F.col("_number").isNotNull() & F.col("hash").isNotNull())
    close = lambda r, k: (F.abs(r["_number"] - k["_number"]) <= step) & near(r, k)
    found = suppress_near(asked, group="_prefix", name=name, order=[F.coalesce("_score", F.lit(0.0))], fields=["_number", "hash", "preview"], near=close, keys=lambda f: step_keys(f["_number"], step), fold=fold, first=first)
    told = df.join(found.where("anchor is not null").select(name, F.col("anchor").alias("represented_by")), name, "left")
    return told.withColumn(bucket, F.when(F.col("represented_by").isNotNull(), "reject").otherwise(F.col(bucket)))


def unrepresented(df: DataFrame, *, name: str, bucket: str = "bucket") -> DataFrame:
    """Suppressed rows whose representative is not selected: none, after `suppress`."""
    kept = df.where(F.col(bucket) == "pick").select(F.col(name).alias("represented_by"))
    return df.where("represented_by is not null").join(kept, "represented_by", "left_anti")


def album_summary(df: DataFrame, *, before: str, bucket: str = "bucket") -> DataFrame:
    """(photos, selected, represented, and the selected by the bucket they had before)."""
    pick = F.col(bucket) == "pick"
    was = lambda b: F.count_if(pick & (F.col(before) == b)).alias(f"from_{b}")
    return df.agg(F.count("*").alias("photos"), F.count_if(pick).alias("selected"), F.count("represented_by").alias("represented"), was("reject"), was("review"), was("pick"))


def open_cohorts(rows: DataFrame, done: DataFrame, *, cohort: str, key: str) -> DataFrame:
    """Cohorts still to do. A checkpoint that holds some but not all rows of a cohort raises when it is read."""
    told = rows.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    n = told.groupBy(cohort).agg(F.count("*").alias("_n"), F.count("_done").alias("_d")).where("_d < _n")
    return n.select(F.when(F.col("_d") > 0, F.raise_error(F.lit("partial cohort checkpoint is invalid")).cast(rows.schema[cohort].dataType)).otherwise(F.col(cohort)).alias(cohort), F.col("_n").alias("n"))


def stage_inventory(df: DataFrame, *, status: str, name: str) -> DataFrame:
    """(status, place, name, n): the names of each status numbered in order, one row a name."""
    w = Window.partitionBy(status)
    return df.select(status, name).distinct().select(status, F.row_number().over(w.orderBy(name)).alias("place"), name, F.count("*").over(w).alias("n"))


def attempt_history(log: DataFrame, *, run: str, offset: str, fields: list[str]) -> DataFrame:
    """(run, started, resumed, attempts, history): an append-only log of attempts folded by run; history lists all but the
    last, in order. A run has as many attempts as it was started: few."""
    key = F.struct(F.col(offset), *fields)
    folded = log.groupBy(run).agg(F.array_sort(F.collect_list(key)).alias("h"))
    last = F.size("h")
    return folded.select(run, F.col("h")[0][offset].alias("started"), F.element_at("h", -1)[offset].alias("resumed"), last.alias("attempts"), F.slice("h", F.lit(1), last - 1).alias("history"))
