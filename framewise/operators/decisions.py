"""Decision states: gate traces, local rejections, colours, scopes, sidecar states, replays and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.scalars import loose_bool, loose_int, metric
from framewise.operators.ranking import display_label

# Colour names, the four explanations of the gate, and settings of the lens correction.
COLOURS = ("Red", "Yellow", "Green", "Blue", "Purple")
EXPLANATIONS = {
    "rejected": "Rejected by local quality gate: primary sharpness weak and sufficient support signals weak.",
    "unsupported": "Kept for review/model: primary sharpness weak but corroborating support is insufficient, missing, or mixed.",
    "incomplete": "Kept for review/model: primary sharpness evidence is incomplete.",
    "passed": "Passed local quality gate: primary sharpness signals were acceptable.",
}
LENS_CORRECTION = {"LensProfileEnable": "1", "LensProfileSetup": "LensDefaults", "LensProfileDistortionScale": "100", "LensProfileVignettingScale": "100", "LensManualDistortionAmount": "0", "HasSettings": "True"}
VERSIONS = {"Version": "18.3", "ProcessVersion": "15.4"}


def gate_trace(primary: dict[str, tuple[Column, float]], support: dict[str, tuple[Column, float, bool]], required: int, active: set[str]) -> Column:
    """What the voting gate saw and decided, as one struct.

    primary: metric and its floor; support: metric, bound and whether higher is worse. A vote is null where a support
    metric is absent; an absent primary counts as zero for its own vote but never rejects. Only `active` support counts.
    """
    votes = {k: F.coalesce(m, F.lit(0.0)) < bound for k, (m, bound) in primary.items()}
    for k, (m, bound, high) in support.items():
        votes[k] = (m > bound) if high else (m < bound)
    complete, weak = F.lit(True), F.lit(True)
    for k, (m, _) in primary.items():
        complete, weak = complete & m.isNotNull(), weak & votes[k]
    count = sum((F.coalesce(votes[k], F.lit(False)).cast("int") for k in support if k in active), F.lit(0))
    reject = complete & weak & (count >= max(1, required))
    why = F.when(reject, EXPLANATIONS["rejected"]).when(complete & weak, EXPLANATIONS["unsupported"]).when(~complete, EXPLANATIONS["incomplete"]).otherwise(EXPLANATIONS["passed"])
    return F.struct(
        F.struct(*(m.alias(k) for k, (m, *_) in {**primary, **support}.items())).alias("scores"), F.struct(*(v.alias(k) for k, v in votes.items())).alias("votes"),
        F.lit(max(1, required)).alias("required"), count.alias("weak_support"), reject.alias("rejected"), why.alias("explanation"),
    )


def local_rejection(metrics: dict[str, Column], reason: Column | None = None) -> Column:
    """The decision of a locally rejected frame; without a reason its metrics are told, with two decimals or n/a."""
    told = F.concat(F.lit("Rejected locally due to sharpness thresholds ("), F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), metric(m)) for k, m in metrics.items())), F.lit(")"))
    return F.struct(F.lit(-1).alias("rating"), F.lit("Red").alias("label"), F.lit("reject").alias("bucket"), F.lit("local").alias("source"), (told if reason is None else F.coalesce(reason, told)).alias("summary"))


def colour(text: Column) -> Column:
    """A colour name in any case; blank, 'null' and 'none' are no colour, any other text raises."""
    t = F.lower(F.trim(text))
    known = F.element_at(F.create_map(*(F.lit(v) for c in COLOURS for v in (c.lower(), c))), t)
    return F.when(text.isNull() | t.isin("", "null", "none"), F.lit(None).cast("string")).when(known.isNull(), F.raise_error(F.concat(F.lit("unsupported colour "), text)).cast("string")).otherwise(known)


def in_scope(df: DataFrame, scope: str, bucket: str = "bucket") -> DataFrame:
    """Every decided row, or (scope kept) those that are not rejected."""
    if scope not in ("all", "kept"):
        raise ValueError("scope is all or kept")
    return df if scope == "all" else df.where(F.col(bucket) != "reject")


def scope_counts(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(scope, shown, rejected) of both scopes, in one pass."""
    one = df.agg(F.count(bucket).alias("n"), F.count_if(F.col(bucket) == "reject").alias("r"))
    return one.select(F.expr("stack(2, 'all', n, r, 'kept', n - r, r) as (scope, shown, rejected)"))


def is_picked(good: Column, rating: Column, pick: Column) -> Column:
    """Sidecar texts: a readable `good` decides, else a positive rating or pick."""
    above = lambda c: F.coalesce(loose_int(c) > 0, F.lit(False))
    return F.coalesce(loose_bool(good, wide=False), above(rating) | above(pick))


def negative_flag(text: Column) -> Column:
    return F.coalesce(text == "-1", F.lit(False))


def is_rejected(rating: Column, pick: Column) -> Column:
    """Sidecar texts: exactly -1 in either; `good` has no say."""
    return negative_flag(rating) | negative_flag(pick)


def desired_state(bucket: Column, rating: Column, label: Column, source: Column) -> Column:
    """Attributes that a sidecar shall have: null clears one."""
    sure = bucket.isin("reject", "pick")
    return F.struct(
        F.when(sure, rating.cast("string")).alias("rating"), F.when(bucket == "reject", "-1").when(bucket == "pick", "1").alias("pick"),
        F.when(bucket == "reject", "False").when(bucket == "pick", "True").alias("good"), display_label(bucket, label, source).alias("label"),
    )


def tag_commands(state: Column, bucket: Column, tags: dict[str, str]) -> Column:
    """Arguments that write a desired state into an image: `-tag=value`, an empty value clears. A review clears all."""
    value = lambda k: F.when(bucket.isin("reject", "pick"), F.coalesce(state[k], F.lit(""))).otherwise("")
    return F.array(*(F.concat(F.lit(f"-{tag}="), value(k)) for k, tag in tags.items()))


def lens_settings(settings: Column, ai_look: Column) -> Column:
    """A settings map with the lens correction set and versions filled in where absent; the standard camera profile and
    its digest go unless an AI look stands."""
    fixed = F.create_map(*(F.lit(v) for kv in LENS_CORRECTION.items() for v in kv))
    fill = F.create_map(*(F.lit(v) for kv in VERSIONS.items() for v in kv))
    own = F.map_filter(settings, lambda k, v: ~k.isin(*LENS_CORRECTION))
    missing = F.map_filter(fill, lambda k, v: ~F.map_contains_key(settings, k))
    merged = F.map_concat(own, fixed, missing)
    standard = ~ai_look & F.coalesce(F.try_element_at(settings, F.lit("CameraProfile")) == "Adobe Standard", F.lit(False))
    return F.map_filter(merged, lambda k, v: ~(standard & k.isin("CameraProfile", "CameraProfileDigest")))


def no_op(values: list[Column], has_crop: Column) -> Column:
    """All adjustments neutral and no crop."""
    out = ~has_crop
    for v in values:
        out = out & (v == 0)
    return out


def bounded(value: Column, low: float, high: float, name: str) -> Column:
    """The value, 0 where absent; outside its range it raises."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.when(v.between(low, high), v).otherwise(F.raise_error(F.lit(f"{name} must be between {low:g} and {high:g}")).cast("double"))


def bounded_int(value: Column, low: int, high: int, name: str) -> Column:
    """As `bounded`, and a value with a fraction raises too."""
    v = bounded(value, low, high, name)
    return F.when(v == F.floor(v), v.cast("int")).otherwise(F.raise_error(F.lit(f"{name} must be an integer")).cast("int"))


def run_counters(df: DataFrame) -> DataFrame:
    """13 counters of a run in one pass over (kind, mirrored, status, bucket, sidecar, edit).

    mirrored: a JPEG that follows its RAW; a failed row counts as failed only while its sidecar is not written.
    """
    status, bucket = F.col("status"), F.col("bucket")
    n = F.count_if
    return df.agg(
        F.count("*").alias("discovered"), n(F.col("kind") == "jpeg").alias("jpeg"), n(F.col("kind") != "jpeg").alias("raw"), n(F.col("mirrored") & bucket.isNotNull()).alias("mirrored"),
        n(status == "rejected_local").alias("rejected_local"), n(status.isin("ready", "scored")).alias("queued"), n(status == "scored").alias("scored"),
        n(bucket == "reject").alias("rejected"), n(bucket == "review").alias("review"), n(bucket == "pick").alias("picked"),
        n(F.col("sidecar")).alias("sidecars"), n(F.col("edit")).alias("edits"), n((status == "failed") & ~F.col("sidecar")).alias("failed"),
    )


def replay_plan(df: DataFrame, *, preserve: bool) -> DataFrame:
    """Add `destination` to (kind, bucket, picked, embed): skipped without a decision, preserved if picked already, else
    where the decision is written (jpeg, dng or sidecar)."""
    kept = F.col("picked") if preserve else F.lit(False)
    where = F.when(F.col("bucket").isNull(), "skipped").when(kept, "preserved").when(F.col("embed"), "dng").when(F.col("kind") == "jpeg", "jpeg").otherwise("sidecar")
    return df.withColumn("destination", where)


def replay_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("destination").agg(F.count("*").alias("n"))


def verdict_counts(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(photos, accepted, refined, reverted)."""
    n = lambda v: F.count_if(F.col(verdict) == v)
    return df.agg(F.count("*").alias("photos"), n("accept").alias("accepted"), n("refine").alias("refined"), n("reject").alias("reverted"))
