"""Canonical frames over the bound tables. Each view's SQL twin opens the oracle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.tiles import sign_hash


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _label(column: str, pick: str, reject: str) -> F.Column:
    return F.when(F.col(column) == pick, "pick").when(F.col(column) == reject, "reject").otherwise("neutral")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), F.col("user_id").alias("folder"), F.col("ts").alias("mtime"), "value", _label("event_type", "purchase", "error").alias("label"), "event_type")


EVENTS = """ev AS (SELECT event_id AS frame, user_id AS folder, ts AS mtime, value, event_type,
  CASE event_type WHEN 'purchase' THEN 'pick' WHEN 'error' THEN 'reject' ELSE 'neutral' END AS label FROM events)"""


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    return li.select(name.alias("name"), F.col("l_orderkey").alias("burst"), _label("l_returnflag", "A", "R").alias("label"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


LINES = """li AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name, l_orderkey AS burst,
  CASE l_returnflag WHEN 'A' THEN 'pick' WHEN 'R' THEN 'reject' ELSE 'neutral' END AS label,
  l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def doc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    label = F.when(F.col("quality") == 1, "pick").when(F.col("quality") == 0, "reject").otherwise("neutral")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", F.col("n_chars").cast("double").alias("size"), (F.col("doc_id") % 97).cast("double").alias("other"), label.alias("label"), "toxic")


DOCS = """doc AS (SELECT d.doc_id, d.source, d.n_chars::DOUBLE AS size, (d.doc_id % 97)::DOUBLE AS other, toxic,
  CASE quality WHEN 1 THEN 'pick' WHEN 0 THEN 'reject' ELSE 'neutral' END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def tile_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("scene"), tile.alias("tile")).withColumn("hash", sign_hash(F.col("tile")))


TILES = """tile AS (SELECT vec_id, label AS scene, list_transform(embedding, lambda x: x::DOUBLE) AS tile FROM embeddings)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log: two models judge each user's events, mostly several times (the later offset counts)."""
    ev = read(spark, sf_dir, "events")
    bucket = lambda k: F.element_at(F.array(*map(F.lit, ("reject", "review", "pick"))), (F.pmod(F.floor(F.col("value") * 7 + k), F.lit(3)) + 1).cast("int"))
    log = ev.select(F.col("user_id").alias("item"), F.col("event_id").alias("offset"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("model"), bucket(0).alias("bucket"), (F.col("event_id") % 6).cast("int").alias("rating"), (F.col("event_id") % 11 + 1).cast("double").alias("seconds"), "value")
    human = F.element_at(F.array(*map(F.lit, ("reject", "review", "pick"))), (F.col("item") % 3 + 1).cast("int"))
    return log.withColumn("human", human)


VERDICTS = """verdict AS (SELECT user_id AS item, event_id AS "offset", CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS model,
  ['reject', 'review', 'pick'][((floor(value * 7)::BIGINT % 3 + 3) % 3 + 1)] AS bucket, (event_id % 6)::INT AS rating,
  (event_id % 11 + 1)::DOUBLE AS seconds, value, ['reject', 'review', 'pick'][user_id % 3 + 1] AS human
  FROM events),
latest AS (SELECT * FROM verdict QUALIFY row_number() OVER (PARTITION BY item, model ORDER BY "offset" DESC) = 1)"""
