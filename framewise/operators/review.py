"""Answers of a model checked against what was asked, and recipes filled from what is known."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def answer_faults(asked: DataFrame, answers: DataFrame, *, by: list[str], key: str, name: str) -> DataFrame:
    """(by, fault) of every batch whose answers are not one for each key that was asked, under the name that was asked.

    Faults in order of precedence: count, keys, names. Both sides are counted before they meet, so a key that is
    answered often does not multiply.
    """
    a = asked.groupBy(*by, key).agg(F.min(name).alias("_a"), F.count("*").alias("_na"))
    b = answers.groupBy(*by, key).agg(F.min(name).alias("_b"), F.max(name).alias("_c"), F.count("*").alias("_nb"))
    both = a.join(b, [*by, key], "full").groupBy(*by).agg(
        (F.coalesce(F.sum("_na"), F.lit(0)) != F.coalesce(F.sum("_nb"), F.lit(0))).alias("count"), F.bool_or(F.col("_na").isNull() | F.col("_nb").isNull()).alias("keys"),
        F.bool_or(F.coalesce((F.col("_a") != F.col("_b")) | (F.col("_a") != F.col("_c")), F.lit(False))).alias("names"),
    )
    return both.select(*by, F.when(F.col("count"), "count").when(F.col("keys"), "keys").when(F.col("names"), "names").alias("fault")).where("fault is not null")


def checked_answers(asked: DataFrame, answers: DataFrame, *, by: list[str], key: str, name: str) -> DataFrame:
    """The answers; reading a batch that is not complete raises."""
    faults = answer_faults(asked, answers, by=by, key=key, name=name)
    kind = answers.schema[name].dataType
    told = answers.join(faults, by, "left")
    return told.withColumn(name, F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("incomplete batch: "), "fault")).cast(kind)).otherwise(F.col(name))).drop("fault")


def subset_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, shared, subset, disjoint) of two key sets, in one full join of distinct keys."""
    x, y = a.select(key).distinct().withColumn("_x", F.lit(1)), b.select(key).distinct().withColumn("_y", F.lit(1))
    n = x.join(y, key, "full").agg(F.count_if(F.col("_y").isNull()).alias("only_left"), F.count_if(F.col("_x").isNull()).alias("only_right"), F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("shared"))
    return n.withColumn("subset", F.col("only_left") == 0).withColumn("disjoint", F.col("shared") == 0)


def changed_artifacts(recorded: DataFrame, found: DataFrame, *, key: str, digest: str = "sha256", content: str = "content") -> DataFrame:
    """(key, fault): recorded artifacts that are gone or whose content has another SHA-256."""
    now = found.select(key, F.sha2(content, 256).alias("_now"))
    told = recorded.join(now, key, "left")
    return told.select(key, F.when(F.col("_now").isNull(), "missing").when(F.lower(digest) != F.col("_now"), "changed").alias("fault")).where("fault is not null")


def verified(recorded: DataFrame, found: DataFrame, **names: str) -> DataFrame:
    """`found`, once every recorded artifact has proved unchanged; else ValueError. One row reaches the driver."""
    bad = changed_artifacts(recorded, found, **names).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]} is {bad[0]['fault']}")
    return found


def config_mismatches(recorded: dict, current: dict) -> list[str]:
    """Keys whose values differ, or that one side lacks: a run resumes only if there is none."""
    return sorted(k for k in {*recorded, *current} if k not in recorded or k not in current or recorded[k] != current[k])


def flattened(df: DataFrame, *, nested: str, fields: list[str]) -> DataFrame:
    """Fields of a nested recipe beside those of the row: the row's own value stands, equal values agree, others raise. A
    nested recipe that lacks a field raises too."""
    out = {}
    for f in fields:
        top, low, kind = F.col(f), F.col(nested)[f], df.schema[f].dataType
        clash = F.raise_error(F.lit(f"conflicting nested field: {f}")).cast(kind)
        lack = F.raise_error(F.lit(f"nested recipe lacks {f}")).cast(kind)
        out[f] = F.when(F.col(nested).isNull(), top).when(low.isNull(), lack).when(top.isNotNull() & (top != low), clash).otherwise(low)
    return df.withColumns(out).drop(nested)


def filled(df: DataFrame, *, verdict: str, accepted: dict[str, Column], neutral: dict[str, Column]) -> DataFrame:
    """Absent fields of an accepted row come from the current recipe, of a rejected one from the neutral one; a refined row
    is left as it is, as its values are the answer."""
    v = F.col(verdict)
    return df.withColumns({f: F.when(v == "accept", F.coalesce(F.col(f), accepted[f])).when(v == "reject", F.coalesce(F.col(f), neutral[f])).otherwise(F.col(f)) for f in accepted})


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object that a text holds, keys in order; null where there is none. No column function tells where an
    object that stands in other text ends, hence Arrow batches."""
    decoder = json.JSONDecoder()

    def find(text: str | None) -> str | None:
        at = -1 if text is None else text.find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(text, at)[0], sort_keys=True)
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(find)


def served(cohorts: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, *, cohort: str, key: str, name: str) -> DataFrame:
    """Answers of an injected model, one call a cohort, checked: one answer a row that was asked, under its name.

    Rows of a cohort meet in one task (cohorts are batches of a few rows), where `call` gets them as one frame. It is
    shipped to the executors, so it should hold an address, not a connection.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = call(rows.sort_values(key, kind="stable").reset_index(drop=True))
        if len(out) != len(rows) or set(out[key]) != set(rows[key]):
            raise ValueError("the answer does not hold each row of the cohort once")
        if dict(zip(out[key], out[name], strict=True)) != dict(zip(rows[key], rows[name], strict=True)):
            raise ValueError("the answer names other rows")
        return out

    return cohorts.groupBy(cohort).applyInPandas(run, schema)


def model_registry() -> dict[str, Callable]:
    """Extension point: models by name, filled by `register`."""
    return _MODELS


_MODELS: dict[str, Callable] = {}


def register(name: str) -> Callable:
    """Decorator: make a model callable known by name; a name that is taken raises."""

    def add(f: Callable) -> Callable:
        if name in _MODELS:
            raise ValueError(f"a model named {name} is registered")
        _MODELS[name] = f
        return f

    return add


def batches(rows: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Frames of at most `size` rows, for models that bound a request."""
    for frame in rows:
        for at in range(0, len(frame), size):
            yield frame.iloc[at : at + size]
