"""Connected components by alternating large-star and small-star steps, as DataFrame joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import Scratch, attach


def _star(scratch: Scratch, edges: DataFrame, large: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
    least = scratch.table(least)
    hung = attach(edges, least, ["u"], "n")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return scratch.table(out.where("u > v").distinct())


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(u, v) edges of any orderable type -> (node, comp): comp is the least node that a node is connected with.

    Nodes without an edge do not appear. Each step keeps connectivity and only shortens paths to the least node; the
    number of rounds grows with the logarithm of the longest path. Hub nodes are joined by `attach`, so a star that
    holds a third of all nodes does not land in one task. No edge reaches the driver: only a count and a hash sum do.
    """
    now = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _star(scratch, _star(scratch, both, True), False)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
