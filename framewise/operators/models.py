"""Model runs against labels, and models against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.scalars import ordinal
from framewise.operators import ranges


def confusion(df: DataFrame, *, by: list[str], human: str, predicted: str) -> DataFrame:
    return df.groupBy(*by, human, predicted).agg(F.count("*").alias("n"))


def evaluation(df: DataFrame, *, by: list[str], human: str, predicted: str, seconds: str) -> DataFrame:
    """Coverage, false-reject rate, precision and recall of picks, items a minute. Uncovered items have a null prediction."""
    seen, pick = F.col(predicted).isNotNull(), F.col(human) == "pick"
    says = lambda k: F.coalesce(F.col(predicted) == k, F.lit(False))
    rate = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count("*").alias("items"), F.count_if(seen).alias("covered"), rate(pick & says("reject"), pick & seen).alias("false_reject_rate"),
        rate(pick & says("pick"), says("pick")).alias("pick_precision"), rate(pick & says("pick"), pick).alias("pick_recall"),
        (F.count_if(seen) * 60.0 / F.sum(seconds)).alias("items_per_minute"),
    )


def run_report(log: DataFrame, *, by: list[str], status: str, attempts: str, seconds: str) -> DataFrame:
    """Attempts, seconds, successful batches and the share of them that took one attempt, of a log of batches."""
    ok = F.col(status) == "success"
    first = F.coalesce(F.try_divide(F.count_if(ok & (F.col(attempts) == 1)), F.count_if(ok)), F.lit(0.0))
    return log.groupBy(*by).agg(F.count("*").alias("batches"), F.sum(attempts).alias("attempts"), F.sum(seconds).alias("seconds"), F.count_if(ok).alias("successful"), first.alias("first_pass"))


def prediction_counts(df: DataFrame, *, by: list[str], predicted: str) -> DataFrame:
    """How often each bucket was predicted."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(predicted) == k).alias(f"says_{k}") for k in ("reject", "review", "pick")))


def composite(bucket: str, rating: str) -> F.Column:
    """Ordinal bucket (1 by default) plus a hundredth of the clamped rating."""
    return F.coalesce(ordinal(F.col(bucket)), F.lit(1)) + F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(F.col(rating), F.lit(0)))) / 100.0


def ordinal_accuracy(df: DataFrame, *, by: list[str], human: str, predicted: str) -> DataFrame:
    e = F.abs(ordinal(F.col(predicted)) - ordinal(F.col(human)))
    return df.where(F.col(predicted).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("covered"), F.count_if(e == 0).alias("exact"), F.avg((e == 0).cast("double")).alias("accuracy"), F.avg(e).alias("mean_error"),
        F.count_if((F.col(predicted) == "reject") & (F.col(human) != "reject")).alias("false_rejects"), F.count_if((F.col(human) == "pick") & (F.col(predicted) != "pick")).alias("missed_picks"))


def paired_wins(df: DataFrame, *, item: str, human: str, left: str, right: str) -> DataFrame:
    """Items judged by both: the smaller ordinal error wins."""
    e = {k: F.abs(ordinal(F.col(k)) - ordinal(F.col(human))) for k in (left, right)}
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return both.agg(F.count_if(e[left] < e[right]).alias("left_wins"), F.count_if(e[left] > e[right]).alias("right_wins"), F.count_if(e[left] == e[right]).alias("ties"))


def preference_counts(df: DataFrame, *, choice: str, a: str, b: str) -> DataFrame:
    """Blind choices A, B or tie decoded through each row's assignment; anything else is left out."""
    chosen = F.when(F.col(choice) == "A", F.col(a)).when(F.col(choice) == "B", F.col(b)).when(F.col(choice) == "tie", "tie")
    return df.select(chosen.alias("winner")).where("winner is not null").groupBy("winner").agg(F.count("*").alias("n"))


def field_statistics(df: DataFrame, *, by: list[str], fields: list[str]) -> DataFrame:
    """Mean, population deviation, least, greatest and distinct values of each field."""
    long = df.select(*by, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(by, fields, "field", "value").where("value is not null")
    return long.groupBy(*by, "field").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("value").alias("n_distinct"))


def exact_median(df: DataFrame, *, by: list[str], value: str, to: str) -> DataFrame:
    """(by, to): the median from counts of distinct values, the mean of the middle two where their number is even. No
    group's rows are gathered; nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = ranges.running(counts, [value], F.col("_c"), "_u", F.lit(0), by)
    whole = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    middle = lambda p: F.min(F.when(F.col("_u") >= p, F.col(value)))
    return upto.join(whole, by).groupBy(*by).agg(((middle(F.floor((F.col("_n") + 1) / 2)) + middle(F.floor(F.col("_n") / 2) + 1)) / 2).alias(to))


def diversity(df: DataFrame, *, by: list[str], fields: list[str], seconds: str) -> DataFrame:
    """Distinct vectors, share of repeated ones, all-zero ones, mean and median duration."""
    vector, n = F.struct(*fields), F.count("*")
    zero = F.lit(True)
    for f in fields:
        zero = zero & (F.col(f) == 0)
    told = df.groupBy(*by).agg(n.alias("n"), F.countDistinct(vector).alias("vectors"), (1 - F.countDistinct(vector) / n).alias("repeat_rate"), F.count_if(zero).alias("no_ops"), F.avg(seconds).alias("mean_seconds"))
    return told.join(exact_median(df, by=by, value=seconds, to="median_seconds"), by, "left")


def pairwise_delta(df: DataFrame, *, model: str, item: str, fields: list[str]) -> DataFrame:
    """Mean absolute difference of each field over the items that two models share, for every two models in order."""
    long = df.select(model, item, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot([model, item], fields, "field", "value")
    a, b = (long.select(F.col(model).alias(f"{s}_model"), item, "field", F.col("value").alias(s)) for s in ("left", "right"))
    both = a.join(b, [item, "field"]).where("left_model < right_model")
    return both.groupBy("left_model", "right_model", "field").agg(F.count("*").alias("shared"), F.avg(F.abs(F.col("left") - F.col("right"))).alias("mean_delta"))
