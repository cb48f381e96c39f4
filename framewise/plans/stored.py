"""Registered queries that write what they derive from the tables and scan it back, and streams over the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.operators.lineage import scratch_folder
from framewise.plans.registry import query
from framewise.sources import binding as b
from framewise.sources import commits, files, sinks


def _streamed(d: str, table: str) -> str:
    """A stream reads folders or patterns; a pattern also finds a table that is one file."""
    return f"{d}/{table}.parque[t]"


STEPS = """SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY moment, name ROWS UNBOUNDED PRECEDING)::BIGINT AS scene FROM (
SELECT *, CASE WHEN lag(moment) OVER w IS NULL OR moment - lag(moment) OVER w > 21600000000 OR (sequence != 0 AND lag(sequence) OVER w != 0 AND sequence - lag(sequence) OVER w > 3) THEN 1 ELSE 0 END AS fresh
FROM (SELECT user_id AS folder, epoch_us(ts) AS moment, event_id::VARCHAR AS name, event_id % 7 AS sequence FROM events) WINDOW w AS (PARTITION BY folder ORDER BY moment, name))"""


@query(f"SELECT folder, name, scene, row_number() OVER (PARTITION BY folder, scene ORDER BY moment, name) AS scene_index FROM ({STEPS})")
def streamed_scenes(spark, d):
    """Scenes by time gap and sequence step of a stream of the events, each folder with state of its own. A frame far ahead ends
    the stream, so that the watermark passes all others."""
    from framewise.streaming.stateful import stream_scenes

    place = scratch_folder(spark, "streamed-scenes")
    kind = b.read(spark, d, "events").schema
    pick = lambda df: df.select(F.col("user_id").alias("folder"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("string").alias("name"), (F.col("event_id") % 7).alias("sequence"))
    spark.range(1).select(F.lit(-1).cast(kind["user_id"].dataType).alias("folder"), F.lit("2100-01-01").cast("timestamp").alias("at"), F.lit("end").alias("name"), F.lit(0).cast(kind["event_id"].dataType).alias("sequence")).write.parquet(f"{place}/end")
    frames = pick(spark.readStream.schema(kind).parquet(_streamed(d, "events")))
    last = spark.readStream.schema(frames.schema).parquet(f"{place}/end")
    told = stream_scenes(frames.unionByName(last), folder="folder", time="at", name="name", sequence="sequence", max_gap=21600.0, late="0 seconds")
    told.writeStream.foreachBatch(lambda batch, n: commits.append_batch(batch, f"{place}/log", n) and None).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return commits.read(spark, f"{place}/log").where("folder != -1")


def _judged(unit: pd.DataFrame) -> tuple[str, str]:
    """A unit of work: a user's events, which fail where more are errors than purchases."""
    errors, purchases = (int((unit["event_type"] == t).sum()) for t in ("error", "purchase"))
    if errors > purchases:
        raise ValueError(f"{errors} errors")
    return "ok", str(len(unit))


@query("""SELECT user_id, 1 AS attempt, CASE WHEN e > p THEN 'failed' ELSE 'ok' END AS status, CASE WHEN e > p THEN 'ValueError: ' || e || ' errors' ELSE n::VARCHAR END AS detail
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)""")
def worked_through(spark, d):
    """The log of work on each user's events, a stream with state by user."""
    from framewise.streaming.stateful import work_through

    place = scratch_folder(spark, "worked-through")
    kind = b.read(spark, d, "events").schema
    units = spark.readStream.schema(kind).parquet(_streamed(d, "events")).select("user_id", "event_type")
    work_through(units, key="user_id", log=f"{place}/log", checkpoint=f"{place}/checkpoint", work=_judged).awaitTermination()
    return commits.read(spark, f"{place}/log")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS "offset" FROM customer UNION ALL SELECT s_suppkey, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier""")
def committed_log(spark, d):
    """Two writes to one log, each with offsets of its own range."""
    log = scratch_folder(spark, "committed-log")
    commits.append(b.read(spark, d, "customer").select("c_custkey"), log, order=["c_custkey"])
    commits.append(b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), log, order=["c_custkey"])
    return commits.read(spark, log)


def _assets(spark, d) -> DataFrame:
    s = b.read(spark, d, "supplier")
    suffix = F.element_at(F.array(*map(F.lit, (".ARW", ".jpg", ".txt", ".JPEG"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    folder = F.when(F.col("s_suppkey") % 11 == 0, F.lit("output/")).when(F.col("s_suppkey") % 13 == 0, F.lit(".hidden/")).otherwise(F.concat("s_nationkey", F.lit("/")))
    return s.select(F.concat(folder, F.lit("F"), F.floor(F.col("s_suppkey") / 4).cast("string"), suffix).alias("path"), F.col("s_name").alias("content"))


@query("""WITH f AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'output/' WHEN s_suppkey % 13 = 0 THEN '.hidden/' ELSE s_nationkey || '/' END AS folder, 'F' || (s_suppkey // 4) AS stem, ['.ARW', '.jpg', '.txt', '.JPEG'][s_suppkey % 4 + 1] AS suffix, s_name FROM supplier),
a AS (SELECT * FROM f WHERE folder NOT IN ('output/', '.hidden/')), r AS (SELECT folder, stem, max(folder || stem || suffix) AS raw FROM a WHERE suffix = '.ARW' GROUP BY 1, 2)
SELECT folder || stem || suffix AS path, CASE suffix WHEN '.ARW' THEN 'raw' ELSE 'jpeg' END AS kind, CASE WHEN suffix != '.ARW' THEN raw END AS paired, octet_length(encode(s_name)) AS bytes, sha256(s_name) AS digest, folder || stem || '.xmp' AS sidecar FROM a LEFT JOIN r USING (folder, stem) WHERE suffix != '.txt'""")
def scanned_assets(spark, d):
    """Files written from a table and scanned back: RAW and JPEG by suffix, sizes, digests, sidecar paths and pairs."""
    root = scratch_folder(spark, "assets")
    sinks.put_files(_assets(spark, d), root, path="path", content="content")
    found = {k: files.scan_files(spark, root, s, content=True).select("path", "length", F.sha2("content", 256).alias("digest"), "xmp_path") for k, s in (("raw", files.RAW), ("jpeg", files.JPEG))}
    pairs = files.paired_assets(found["raw"], found["jpeg"])
    told = pairs.join(found["raw"].unionByName(found["jpeg"]), "path")
    below = lambda c: F.regexp_extract(c, "/assets-[0-9a-f]{32}/(.*)", 1)
    return told.select(below("path").alias("path"), "kind", below("paired_raw_path").alias("paired"), F.col("length").alias("bytes"), "digest", below("xmp_path").alias("sidecar"))


ORDER = T.StructType([T.StructField("filename", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("rating", T.IntegerType())])


@query("SELECT o_orderkey::VARCHAR AS filename, CASE WHEN o_totalprice > 100000 THEN 'pick' END AS bucket, (o_orderkey % 5)::INT AS rating FROM orders")
def manifest_round_trip(spark, d):
    """A manifest written over an older one and read back strictly; absent fields are null."""
    path = scratch_folder(spark, "manifest")
    o = b.read(spark, d, "orders")
    sinks.write_manifest(o.select(F.lit("old").alias("filename")), path)
    sinks.write_manifest(o.select(F.col("o_orderkey").cast("string").alias("filename"), F.when(F.col("o_totalprice") > 100000, "pick").alias("bucket"), (F.col("o_orderkey") % 5).cast("int").alias("rating")), path)
    return files.read_json_lines(spark, path, ORDER, strict=True)


@query("SELECT event_id::VARCHAR AS filename, event_type AS bucket, (event_id % 6)::INT AS rating FROM events WHERE event_id % 9 NOT IN (3, 4)")
def lenient_log(spark, d):
    """A log with broken lines and lines without a key: what can be read of it."""
    path = scratch_folder(spark, "log")
    ev = b.read(spark, d, "events")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 9 != 4, F.col("event_id").cast("string")).alias("filename"), F.col("event_type").alias("bucket"), (F.col("event_id") % 6).alias("rating")))
    ev.select(F.when(F.col("event_id") % 9 == 3, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return files.read_json_lines(spark, path, ORDER, key="filename")


@query("""SELECT 'o' || o_orderkey AS raw_path, round(o_totalprice::DOUBLE, 2) AS ev FROM orders WHERE o_orderkey % 4 != 2 UNION ALL SELECT '{"schema":2}', NULL""")
def header_and_records(spark, d):
    """A file of nested, flat and failed records behind a header line."""
    path = scratch_folder(spark, "records")
    o = b.read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("raw_path"), F.round(F.col("o_totalprice").cast("double"), 2).alias("ev"), (F.col("o_orderkey") % 4).alias("k"))
    nested = F.to_json(F.struct("raw_path", F.when(F.col("k") == 2, "failed").when(F.col("k") == 1, "ok").alias("status"), F.struct("ev").alias("suggestion")))
    lines = o.select(F.when(F.col("k") == 3, F.to_json(F.struct("raw_path", "ev"))).otherwise(nested).alias("value"))
    lines.union(spark.range(1).select(F.lit('{"schema":2}'))).write.text(path)
    header, records = files.read_header_and_records(spark, path, T.StructType([T.StructField("ev", T.DoubleType())]))
    return records.select("raw_path", "ev").unionByName(header.select(F.col("value").alias("raw_path"), F.lit(None).cast("double").alias("ev")))


@query("SELECT sha256(text) AS sha256, 'doc ' || doc_id AS name FROM documents")
def checksum_ledger(spark, d):
    """A ledger of digests written as lines and read back."""
    path = scratch_folder(spark, "ledger")
    b.read(spark, d, "documents").select(F.concat(F.sha2("text", 256), F.lit("  doc "), F.col("doc_id").cast("string")).alias("value")).write.text(path)
    return files.read_checksums(spark, path)


@query("SELECT p_name AS filename, p_brand || ', \"' || p_size || '\"' AS scene_id, CASE WHEN p_size % 3 != 0 THEN p_type END AS choice FROM part")
def choices_csv(spark, d):
    """Choices written as CSV, with quotes, commas and nulls, and read back."""
    path = scratch_folder(spark, "choices")
    p = b.read(spark, d, "part")
    sinks.write_csv(p.select(F.col("p_name").alias("filename"), F.concat("p_brand", F.lit(', "'), F.col("p_size").cast("string"), F.lit('"')).alias("scene_id"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("choice")), path)
    return files.read_choices(spark, path)
