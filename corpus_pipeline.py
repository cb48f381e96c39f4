"""Corpus pipeline: quality, near duplicates, decontamination, mixing and token files, each stage on what is left."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import decontaminate, mixing, ngram_join, quality, token_file
from framewise.llm.common import Scratch, looked_up, stage_scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all `labels` (there is nothing to hold out here), does not reject.

    All columns are kept as they are. Null and empty texts are scored as empty ones. No labels: nothing is rejected.
    """
    trees = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, trees)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id, null last, then the least text) of each group of near duplicates.

    Rows that share an id but not their text stand for their own groups. Texts without words are one group.
    """
    return ngram_join.representatives(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that repeats a benchmark item.

    Rows that share an id (or have none) and differ in text are judged apart: a match counts for its own text only. Null,
    empty and short texts stay. No items: all stay.
    """
    asked = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("key"), "text")
    found = decontaminate.matches(asked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    bad = found.select(F.col("key.doc_id").alias("id"), F.col("key.text").alias("hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"]) == bad["hash"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, which may be not at all. Rows that share an id share the most.

    Null ids are one id. A null source is a source of its own; texts without words are not taken. Columns keep their
    names, whatever these are.
    """
    taken = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("repeats").cast("int").alias("n"))
    taken = Scratch(spark, "mix").table(taken)
    # how often is a number from 0 to 3, which bits tell: texts are shuffled only where these leave it open
    asked, left = looked_up(docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("id")), taken, "id", "n", 3)
    rest, left = asked.where("_told is null").alias("a"), left.where("n > 0").alias("t")
    rest = rest.join(left, F.col("a.id").eqNullSafe(F.col("t.id"))).select("d", "n")
    every = asked.where("_told > 0").select("d", F.col("_told").alias("n")).unionByName(rest)
    return every.select("d", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("d.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and where each document's ids stand in them. Null texts are empty, null ids come first."""
    return token_file.read_documents(token_file.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_representatives),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix),
    ("tokens", tokens),
]

#: No SQL engine fits the trees or runs the tokenizer; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's rows are written and read again, and what it wrote for itself then goes."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        with stage_scratch():
            docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
