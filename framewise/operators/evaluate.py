"""Signals against human labels; models against models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import ranges

FINITE = "value is not null and not isnan(value) and abs(value) < double('Infinity')"


def long_signals(df: DataFrame, signals: list[str], keep: list[str], deal: str | None = None) -> DataFrame:
    """One row a signal: (keep..., signal, value); absent and non-finite values go.

    deal: a column of `keep` by which the rows are dealt out before they become one a signal; groups that hold it then
    meet without another shuffle (an unpivot forgets how its input was dealt, an explode keeps it).
    """
    if deal is not None:
        each = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals))
        tasks = len(signals) * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows become as many times as many after
        return df.select(*keep, *signals).repartition(tasks, deal).select(*keep, F.explode(each).alias("_x")).select(*keep, "_x.signal", "_x.value").where(FINITE)
    return df.select(*keep, *(F.col(s).cast("double").alias(s) for s in signals)).unpivot(keep, signals, "signal", "value").where(FINITE)


def auc(df: DataFrame, *, by: list[str], value: str = "value", label: str = "label", place: Column | None = None) -> DataFrame:
    """(by, n_pick, n_reject, auc): chance that a pick outscores a reject, ties one half; null without both classes.

    Rows are first counted by distinct value, and counts are summed range by range: neither pairs nor a sort of all rows
    in one task is needed. place: the range of a value, where the groups themselves are many and small.
    """
    counts = df.where(F.col(label).isin("pick", "reject")).groupBy(*by, value).agg(F.count_if(F.col(label) == "pick").alias("p"), F.count_if(F.col(label) == "reject").alias("r"))
    points = ranges.place(F.col(value), ranges.cuts(df, value)) if place is None else place
    below = ranges.running(counts, [value], F.col("r"), "b", points, by).withColumn("b", F.col("b") - F.col("r"))
    won = F.sum(F.col("p").cast("decimal(38,0)") * (2 * F.col("b") + F.col("r")))
    out = below.groupBy(*by).agg(F.sum("p").alias("n_pick"), F.sum("r").alias("n_reject"), won.alias("won"))
    return out.select(*by, "n_pick", "n_reject", F.try_divide(F.col("won").cast("double"), 2.0 * F.col("n_pick") * F.col("n_reject")).alias("auc"))


def signal_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and means of both classes, and rejects below every pick (what can go without a false reject).

    Groups are few (signals): their floors, a row each, are broadcast. Left to Spark's estimate of an aggregate's size, all
    rows would be dealt out by the group first, a quarter of them to a task where there are four signals.
    """
    floor = df.where("label = 'pick'").groupBy(*by).agg(F.min("value").alias("floor"))
    told = df.join(F.broadcast(floor), by, "left")
    is_ = lambda k: F.col("label") == k
    return told.groupBy(*by).agg(
        F.count("*").alias("available"), F.count_if(is_("pick")).alias("picks"), F.count_if(is_("reject")).alias("rejects"),
        F.avg(F.when(is_("pick"), F.col("value"))).alias("pick_mean"), F.avg(F.when(is_("reject"), F.col("value"))).alias("reject_mean"),
        F.count_if(is_("reject") & (F.col("value") < F.col("floor"))).alias("zero_fr_rejects"),
    ).withColumn("zero_fr_coverage", F.col("zero_fr_rejects") / F.col("available"))


def signal_report(df: DataFrame, *, burst: str, name: str, directions: dict[str, int]) -> DataFrame:
    """One row a signal with both classes: counts and means, AUC, pairs and tops within bursts, what can go without a false
    reject. A signal with direction -1 is turned round for all but its means. Rows: (signal, value, label, burst, name)."""
    turn = F.create_map(*(F.lit(x) for k, v in directions.items() for x in (k, float(v))))
    asked = df.where(F.col("label").isin("pick", "reject") & F.col("signal").isin(*directions)).withColumn("_d", turn[F.col("signal")]).withColumn("value", F.col("value") * F.col("_d"))
    each = signal_summary(asked, ["signal"]).where("picks > 0 and rejects > 0")
    for c in ("pick_mean", "reject_mean"):
        each = each.withColumn(c, F.col(c) * turn[F.col("signal")])
    ranks = auc(asked, by=["signal"]).select("signal", "auc")
    within = burst_metrics(asked.where(F.col(burst).isNotNull()), by=["signal"], burst=burst, order=[F.desc("value"), F.lower(name), "label"])
    return each.join(ranks, "signal").join(within, "signal", "left")


def available_signals(df: DataFrame) -> DataFrame:
    return df.where("label in ('pick', 'reject')").groupBy("signal").agg(F.countDistinct("label").alias("n")).where("n = 2").select("signal")


def burst_metrics(df: DataFrame, *, by: list[str], burst: str, order: list) -> DataFrame:
    """Over bursts with both classes: pooled share of pick-reject pairs in order, and how often a pick is first or among
    the first three. Pairs are counted from ranks within each burst: a reject loses as many pairs as the mean of the picks
    from its value up and those above it. `order` begins with the value, descending.

    All windows and sums before the last have the burst in their keys, so rows are dealt out once, or not at all if they come dealt
    by the burst (`long_signals(..., deal=burst)`). The windows share one sort: the one of the longest order comes first.
    """
    both = Window.partitionBy(*by, burst)
    pick, reject = F.col("label") == "pick", F.col("label") == "reject"
    falling = both.orderBy(F.desc("value"))
    upward, level = (F.count(F.when(pick, 1)).over(falling.rangeBetween(a, Window.currentRow)) for a in (Window.unboundedPreceding, Window.currentRow))
    ranked = df.withColumn("_rn", F.row_number().over(both.orderBy(*order))).withColumn("_won", F.when(reject, 2 * upward - level))
    first = lambda k: F.max(F.when((F.col("_rn") <= k) & pick, 1).otherwise(0))
    bursts = ranked.groupBy(*by, burst).agg(F.sum("_won").alias("won"), F.count_if(pick).alias("p"), F.count_if(reject).alias("r"), first(1).alias("t1"), first(3).alias("t3"))
    bursts = bursts.where("p > 0 and r > 0").withColumn("pairs", F.col("p") * F.col("r"))
    return bursts.groupBy(*by).agg(F.count("*").alias("bursts"), (F.sum("won") / (2.0 * F.sum("pairs"))).alias("pairwise"), F.avg("t1").alias("top1"), F.avg("t3").alias("top3"))


def coverage_curve(df: DataFrame, *, order: list, percents: tuple[int, ...] = (5, 10, 20, 30, 40, 50)) -> DataFrame:
    """For each percentage: the lowest max(1, floor(n p / 100)) rows, false rejects among them and precision."""
    total = F.broadcast(df.agg(F.count("*").alias("n")))
    cuts = df.sparkSession.createDataFrame([(p,) for p in percents], "percent int").crossJoin(total).withColumn("count", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("percent") / 100)).cast("bigint"))
    most = ranges.numbered(df, order, "_rn")
    return most.join(F.broadcast(cuts), F.col("_rn") <= F.col("count")).groupBy("percent", "count").agg(
        F.count_if(F.col("label") == "pick").alias("false_rejects"), (F.count_if(F.col("label") == "reject") / F.count("*")).alias("precision"))


def gate_confusion(df: DataFrame, rejected: str = "rejected") -> DataFrame:
    """Coverage, precision, false-reject rate and recall of a reject gate; 0 on empty denominators."""
    no, pick, reject = F.col(rejected), F.col("label") == "pick", F.col("label") == "reject"

    def rate(a, b):
        return F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))

    return df.agg(F.count("*").alias("n"), F.count_if(no).alias("rejected"), rate(no, F.lit(True)).alias("coverage"), rate(no & reject, no).alias("precision"), rate(no & pick, pick).alias("false_reject_rate"), rate(no & reject, reject).alias("recall"))

