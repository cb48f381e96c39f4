"""File, manifest, log and sidecar scans with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.scalars import loose_bool, loose_int, parent, stem
from framewise.operators.ranking import human_label

RAW = (".arw", ".cr2", ".cr3", ".dng", ".nef", ".orf", ".raf", ".rw2")
JPEG = (".jpg", ".jpeg")


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], *, content: bool = False) -> DataFrame:
    """(path, modificationTime, length, xmp_path) below root, by suffix in any case; hidden parts and folders named output
    go. xmp_path is where a sidecar of the file stands; with `content` its bytes are a column too, else they are not read."""
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s[1:]) for s in suffixes) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    found = found if content else found.drop("content")
    below = F.split(F.substring("path", len(_clean(root)) + 2, 1 << 20), "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    found = found.withColumn("_parts", below).withColumn("path", path)
    return found.where(~F.exists("_parts", lambda p: p.startswith(".")) & ~F.exists(F.slice("_parts", 1, F.size("_parts") - 1), lambda p: F.lower(p) == "output")).drop("_parts").withColumn("xmp_path", F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", ".xmp")).orderBy("path")


def _clean(root: str) -> str:
    return "file:" + root.removeprefix("file:").rstrip("/") if root.startswith(("/", "file:")) else root.rstrip("/")


def paired_assets(raw: DataFrame, jpeg: DataFrame, mirror: bool = True) -> DataFrame:
    """RAW and JPEG rows in path order; a JPEG is paired with the last RAW of its folder and stem."""
    key = [parent(F.col("path")), F.lower(stem(F.col("path")))]
    owners = raw.groupBy(*(k.alias(n) for k, n in zip(key, ("_f", "_s"), strict=True))).agg(F.max("path").alias("paired_raw_path"))
    raws = raw.select("path", F.lit("raw").alias("kind"), F.lit(None).cast("string").alias("paired_raw_path"))
    jpegs = jpeg.select("path", F.lit("jpeg").alias("kind"), *(k.alias(n) for k, n in zip(key, ("_f", "_s"), strict=True)))
    jpegs = jpegs.join(owners, ["_f", "_s"], "left") if mirror else jpegs.withColumn("paired_raw_path", F.lit(None).cast("string"))
    return raws.unionByName(jpegs.drop("_f", "_s")).orderBy("path")


DECISION = T.StructType([T.StructField(n, t) for n, t in (("rating", T.IntegerType()), ("label", T.StringType()), ("bucket", T.StringType()), ("keep", T.BooleanType()), ("source", T.StringType()), ("summary", T.StringType()))])
MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("filename", T.StringType()), ("scene_id", T.StringType()), ("status", T.StringType()), ("decision", DECISION), ("signals", T.MapType(T.StringType(), T.DoubleType())))])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = False, key: str | None = None) -> DataFrame:
    """Strict: a malformed line raises. Otherwise malformed lines go, and rows without the key."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.where(F.col(key).isNotNull()) if key else df


def read_guarded_manifest(spark: SparkSession, path: str, schema: T.StructType, *, state: str, sha256: str) -> DataFrame:
    """A manifest of a finished album whose bytes are those that were signed off; else ValueError. The digest is taken
    where the file is read, only its 64 digits reach the driver."""
    if state != "complete":
        raise ValueError(f"the album is {state}")
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()
    if [r.d for r in found] != [sha256.lower()]:
        raise ValueError(f"{path} has changed")
    return read_json_lines(spark, path, schema, strict=True)


def read_header_and_records(spark: SparkSession, path: str, suggestion: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(header lines, records): nested records carry `suggestion` and status null or ok, flat ones raw_path or asset_id;
    nested records of another status go, any other line is a header line."""
    lines = spark.read.text(path).where("trim(value) != ''")
    full = T.StructType([T.StructField("raw_path", T.StringType()), T.StructField("asset_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("suggestion", suggestion), *suggestion.fields])
    parsed = lines.select("value", F.from_json("value", full).alias("r"))
    nested = parsed.where("r.suggestion is not null and (r.status is null or r.status = 'ok')").select("r.raw_path", "r.asset_id", "r.suggestion.*")
    flat = parsed.where("r.suggestion is null and (r.raw_path is not null or r.asset_id is not null)").select("r.raw_path", "r.asset_id", *(F.col("r")[f.name].alias(f.name) for f in suggestion.fields))
    header = parsed.where("r.suggestion is null and r.raw_path is null and r.asset_id is null").select("value")
    return header, nested.unionByName(flat)


def merged_header(header: DataFrame) -> dict:
    """The header lines as one object, later fields win: a file has a handful, so they are merged on the driver. More than a
    thousand are no header, and raise."""
    lines, out = header.limit(1001).collect(), {}
    if len(lines) > 1000:
        raise ValueError("more than a thousand lines are neither header nor record")
    for r in lines:
        out |= json.loads(r.value)
    return out


def read_table(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A relational table through JDBC; non-finite numbers become nulls."""
    df = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return finite_columns(df)


def read_table_by_bounds(spark: SparkSession, url: str, table: str, *, column: str, tasks: int = 64, where: str | None = None, **options: str) -> DataFrame:
    """A relational table through as many connections as there are ranges of a whole-number or time `column`.

    The bounds are asked of the database, with the same predicate as the scan; rows without the column are read with the
    first range. Selected columns, further filters and `where` reach the database. An empty table is one task.
    """
    asked = f"(SELECT * FROM {table}{f' WHERE {where}' if where else ''}) asked"
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = reader.option("query", f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {asked}").load().first()
    if low is None:
        return finite_columns(spark.read.format("jdbc").options(url=url, dbtable=asked, **options).load())
    span = int(high) - int(low) + 1 if not hasattr(low, "isoformat") else tasks
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high if hasattr(high, "isoformat") else int(high) + 1), "numPartitions": str(max(1, min(tasks, span)))}
    return finite_columns(spark.read.format("jdbc").options(url=url, dbtable=asked, **bounds, **options).load())


def finite_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n)) for n, k in df.dtypes if k in ("double", "float")})


def table_signals(df: DataFrame, *, keep: list[str], signals: dict[str, str]) -> DataFrame:
    """(keep..., signal, value) of a score table: its columns under the names of `signals`, absent and non-finite ones gone."""
    renamed = df.select(*keep, *(F.col(c).cast("double").alias(n) for c, n in signals.items()))
    return finite_columns(renamed).unpivot(keep, [*signals.values()], "signal", "value").where("value is not null")


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("filename string, scene_id string, choice string").option("header", True).csv(path)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, name) of `hash  name` lines; a bad hash or a name named twice raises."""
    lines = spark.read.text(path).where("trim(value) != ''")
    parts = lines.select(F.regexp_extract("value", r"^(\S+)\s+(.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^(\S+)\s+(.+)$", 2).alias("name"))
    once = parts.groupBy("name").agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"))
    fault = (F.col("n") > 1) | ~F.col("sha256").rlike("^[0-9a-fA-F]{64}$")
    return once.select(F.when(fault, F.raise_error(F.lit("bad checksum line")).cast("string")).otherwise(F.col("sha256")).alias("sha256"), "name")


def sidecar_attribute(xml: Column, name: str) -> Column:
    """The last attribute of that local name, anywhere in the document."""
    return F.try_element_at(F.xpath(xml, F.lit(f"//@*[local-name()='{name}']")), F.lit(-1))


def sidecar_labels(df: DataFrame, *, path: str, xml: str) -> DataFrame:
    """(path, good, rating, pick, colour, label) of sidecar texts, by the rule of human labels."""
    names = {"good": "good", "rating": "Rating", "pick": "Pick", "colour": "Label"}
    flat = df.select(path, *(sidecar_attribute(F.col(xml), n).alias(k) for k, n in names.items()))
    label = human_label(loose_bool(F.col("good"), wide=False), loose_int(F.col("rating")), loose_int(F.col("pick")))
    return flat.withColumn("label", label)


def embedded_flags(df: DataFrame, flags: dict[str, list[str]]) -> DataFrame:
    """Booleans of a table of extracted metadata: a flag is set where any of its tag columns holds something."""
    held = lambda c: F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False))
    any_ = {k: F.lit(False) for k in flags}
    for k, columns in flags.items():
        for c in columns:
            any_[k] = any_[k] | held(c)
    return df.withColumns(any_)


def signals_of_run(df: DataFrame, names: list[str], *, renamed: dict[str, str] | None = None, key: str = "filename", scene_prefix: str = "cull:") -> DataFrame:
    """(key, burst, signal, value) of a frozen run: the signals named, some renamed; local_gate_reject where the gate left a
    trace and pipeline_reject where a decision has a bucket, as 1 or 0. A row without scene has no burst."""
    renamed = renamed or {}
    wanted = F.map_filter(F.coalesce("signals", F.create_map().cast("map<string,double>")), lambda k, v: k.isin(*names) & v.isNotNull())
    if renamed:
        table = F.create_map(*(F.lit(x) for kv in renamed.items() for x in kv))
        wanted = F.transform_keys(wanted, lambda k, v: F.coalesce(F.element_at(table, k), k))
    flag = lambda c: c.cast("int").cast("double")
    more = F.array(F.struct(F.lit("local_gate_reject").alias("key"), flag(F.col("local_trace.quality_reject")).alias("value")), F.struct(F.lit("pipeline_reject").alias("key"), flag(F.col("decision.bucket") == "reject").alias("value")))
    told = F.map_concat(wanted, F.map_from_entries(F.filter(more, lambda e: e["value"].isNotNull())))
    return df.select(key, F.concat(F.lit(scene_prefix), "scene_id").alias("burst"), F.explode(told).alias("signal", "value"))


def signals_of_manifest(df: DataFrame, names: list[str], scene_prefix: str = "cull:") -> DataFrame:
    """Long signals of a frozen run whose rows may hold legacy decisions: a row without bucket counts by `keep`, and every
    row tells whether the pipeline rejected it; its scenes name the bursts."""
    derived = F.map_from_arrays(F.array(F.lit("pipeline_reject")), F.array(F.when(F.coalesce("decision.bucket", F.when(F.col("decision.keep"), "pick").otherwise("reject")) == "reject", 1.0).otherwise(0.0)))
    wanted = F.map_filter(F.coalesce("signals", F.create_map().cast("map<string,double>")), lambda k, v: k.isin(*names) & v.isNotNull())
    return df.select("filename", F.concat(F.lit(scene_prefix), "scene_id").alias("burst"), F.explode(F.map_concat(wanted, derived)).alias("signal", "value"))


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The greatest run directory name: one listing, no data read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    return max((s.getPath().getName() for s in path.getFileSystem(conf).listStatus(path) if s.isDirectory()), default=None)
