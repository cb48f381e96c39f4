"""Registered queries: decision states, reviews, albums, render checks, runs; and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import scalars, tiles
from framewise.operators import album, decisions, evaluate, logs, models, render, review
from framewise.plans.registry import query
from framewise.plans.registry import rounded as _r
from framewise.sources import binding as b
from framewise.sources import files, sinks

BUCKETS = ("reject", "review", "pick")


def _pick_from(values: tuple, place: F.Column) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (place + 1).cast("int"))


E_ = decisions.EXPLANATIONS
TRACE = f"""WITH {b.LINES}, v AS (SELECT *, coalesce(nullif(quantity, 7.0), 0) < 10 AS a, price < 20000 AS e, nullif(discount, 0.01) < 0.03 AS c, tax > 0.05 AS h, nullif(quantity, 7.0) IS NOT NULL AS full_ FROM li),
g AS (SELECT *, a AND e AND full_ AS weak, coalesce(c, false)::INT + coalesce(h, false)::INT AS votes FROM v)
SELECT name, price, a AS laplacian, e AS tenengrad, c AS musiq, h AS brisque, votes AS weak_support, weak AND votes >= 2 AS rejected,
CASE WHEN weak AND votes >= 2 THEN '{E_["rejected"]}' WHEN weak THEN '{E_["unsupported"]}' WHEN NOT full_ THEN '{E_["incomplete"]}' ELSE '{E_["passed"]}' END AS explanation FROM g"""


@query(TRACE)
def gate_trace(spark, d):
    li, c = b.line_frames(spark, d), F.col
    trace = decisions.gate_trace({"laplacian": (F.nullif(c("quantity"), F.lit(7.0)), 10.0), "tenengrad": (c("price"), 20000.0)}, {"musiq": (F.nullif(c("discount"), F.lit(0.01)), 0.03, False), "brisque": (c("tax"), 0.05, True)}, 2, {"musiq", "brisque"})
    return li.select("name", "price", trace.alias("t")).select("name", "price", "t.votes.*", "t.weak_support", "t.rejected", "t.explanation")


@query("""SELECT p_partkey, -1 AS rating, 'Red' AS label, 'reject' AS bucket, 'local' AS source, CASE WHEN p_size % 5 = 0 THEN 'other reason' ELSE 'Rejected locally due to sharpness thresholds (laplacian=' || printf('%.2f', p_retailprice)
|| ', musiq=' || CASE WHEN p_size > 10 THEN printf('%.2f', p_size::DOUBLE) ELSE 'n/a' END || ')' END AS summary FROM part""")
def local_rejection(spark, d):
    size = F.col("p_size").cast("double")
    told = decisions.local_rejection({"laplacian": F.col("p_retailprice"), "musiq": F.when(size > 10, size)}, F.when(F.col("p_size") % 5 == 0, "other reason"))
    return b.read(spark, d, "part").select("p_partkey", told.alias("x")).select("p_partkey", "x.*")


@query("""SELECT o_orderkey, CASE lower(trim(t)) WHEN 'red' THEN 'Red' WHEN 'green' THEN 'Green' WHEN 'purple' THEN 'Purple' END AS colour
FROM (SELECT o_orderkey, [' RED ', 'none', 'green', '', NULL, 'Null', 'pUrple'][o_orderkey % 7 + 1] AS t FROM orders)""")
def label_colour(spark, d):
    text = _pick_from((" RED ", "none", "green", "", None, "Null", "pUrple"), F.col("o_orderkey") % 7)
    return b.read(spark, d, "orders").select("o_orderkey", decisions.colour(text).alias("colour"))


@query(f"""WITH {b.DOCS} SELECT unnest(['all', 'kept']) AS scope, unnest([count(*), count(*) FILTER (label != 'reject')]) AS shown, count(*) FILTER (label = 'reject') AS rejected FROM doc""")
def scope_counts(spark, d):
    return decisions.scope_counts(b.doc_frames(spark, d), "label")


@query(f"WITH {b.DOCS} SELECT doc_id, label FROM doc WHERE label != 'reject'")
def scope_kept(spark, d):
    return decisions.in_scope(b.doc_frames(spark, d), "kept", "label").select("doc_id", "label")


@query("""SELECT o_orderkey, CASE lower(trim(g)) WHEN 'true' THEN true WHEN 'false' THEN false ELSE coalesce(try_cast(r AS DOUBLE) > 0, false) OR coalesce(try_cast(p AS DOUBLE) > 0, false) END AS picked,
coalesce(r = '-1', false) OR coalesce(p = '-1', false) AS rejected FROM (SELECT o_orderkey, [NULL, ' True', 'false', 'maybe'][o_orderkey % 4 + 1] AS g, ['-1', '3', NULL, 'x', '0'][o_orderkey % 5 + 1] AS r, ['1', '-1', NULL][o_orderkey % 3 + 1] AS p FROM orders)""")
def sidecar_flags(spark, d):
    k = F.col("o_orderkey")
    good, rating, pick = _pick_from((None, " True", "false", "maybe"), k % 4), _pick_from(("-1", "3", None, "x", "0"), k % 5), _pick_from(("1", "-1", None), k % 3)
    return b.read(spark, d, "orders").select("o_orderkey", decisions.is_picked(good, rating, pick).alias("picked"), decisions.is_rejected(rating, pick).alias("rejected"))


@query("""SELECT o_orderkey, CASE WHEN k = 'review' THEN NULL ELSE r::VARCHAR END AS rating, CASE k WHEN 'reject' THEN '-1' WHEN 'pick' THEN '1' END AS pick, CASE k WHEN 'reject' THEN 'False' WHEN 'pick' THEN 'True' END AS good,
CASE WHEN k != 'reject' THEN l WHEN s = 'local' THEN 'Red' ELSE 'Yellow' END AS label, '-R=' || CASE WHEN k = 'review' THEN '' ELSE r::VARCHAR END || ' -L=' || CASE WHEN k = 'review' THEN '' ELSE coalesce(CASE WHEN k != 'reject' THEN l WHEN s = 'local' THEN 'Red' ELSE 'Yellow' END, '') END AS commands
FROM (SELECT o_orderkey, ['reject', 'review', 'pick'][o_orderkey % 3 + 1] AS k, (o_orderkey % 5 - 1)::INT AS r, CASE WHEN o_orderkey % 4 = 0 THEN 'Blue' END AS l, CASE WHEN o_orderkey % 2 = 0 THEN 'local' ELSE 'vision' END AS s FROM orders)""")
def sidecar_state(spark, d):
    o = F.col("o_orderkey")
    bucket = _pick_from(BUCKETS, o % 3)
    state = decisions.desired_state(bucket, (o % 5 - 1).cast("int"), F.when(o % 4 == 0, "Blue"), F.when(o % 2 == 0, "local").otherwise("vision"))
    told = b.read(spark, d, "orders").select("o_orderkey", bucket.alias("bucket"), state.alias("s"))
    return told.select("o_orderkey", "s.*", F.array_join(decisions.tag_commands(F.col("s"), F.col("bucket"), {"rating": "R", "label": "L"}), " ").alias("commands"))


LENS = "".join(f", ('{k}', '{v}')" for k, v in decisions.LENS_CORRECTION.items())


@query(f"""WITH s AS (SELECT p_partkey, p_size % 2 = 0 AS ai, p_size % 3 = 0 AS std FROM part),
kv AS (SELECT p_partkey, k, v FROM s, (VALUES ('Version', '18.3'), ('ProcessVersion', '11.0'){LENS}) t(k, v) UNION ALL SELECT p_partkey, 'CameraProfile', CASE WHEN std THEN 'Adobe Standard' ELSE 'Own' END FROM s WHERE ai OR NOT std
UNION ALL SELECT p_partkey, 'CameraProfileDigest', 'x' FROM s WHERE ai OR NOT std) SELECT p_partkey, string_agg(k || '=' || v, ';' ORDER BY k) AS settings FROM kv GROUP BY 1""")
def lens_defaults(spark, d):
    profile = F.when(F.col("p_size") % 3 == 0, "Adobe Standard").otherwise("Own")
    own = F.create_map(F.lit("ProcessVersion"), F.lit("11.0"), F.lit("CameraProfile"), profile, F.lit("CameraProfileDigest"), F.lit("x"), F.lit("LensProfileEnable"), F.lit("0"))
    out = b.read(spark, d, "part").select("p_partkey", own.alias("m"), (F.col("p_size") % 2 == 0).alias("ai")).select("p_partkey", decisions.lens_settings(F.col("m"), F.col("ai")).alias("m"))
    listed = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("p_partkey", F.array_join(listed, ";").alias("settings"))


@query(f"WITH {b.LINES} SELECT name, price, tax = 0 AND discount = 0 AND NOT (burst % 2 = 0) AS neutral FROM li")
def no_op(spark, d):
    return b.line_frames(spark, d).select("name", "price", decisions.no_op([F.col("tax"), F.col("discount")], F.col("burst") % 2 == 0).alias("neutral"))


@query(f"WITH {b.LINES} SELECT name, price, coalesce(nullif(discount, 0.05), 0) AS share, quantity::INT AS whole FROM li")
def bounded_values(spark, d):
    share, whole = decisions.bounded(F.nullif(F.col("discount"), F.lit(0.05)), 0.0, 1.0, "discount"), decisions.bounded_int(F.col("quantity"), 0, 100, "quantity")
    return b.line_frames(spark, d).select("name", "price", share.alias("share"), whole.alias("whole"))


RUN = """run AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'jpeg' ELSE 'raw' END AS kind, event_id % 8 = 0 AS mirrored, ['failed', 'rejected_local', 'ready', 'scored', 'new'][event_id % 5 + 1] AS status,
CASE WHEN event_id % 7 != 0 THEN ['reject', 'review', 'pick'][event_id % 3 + 1] END AS bucket, event_id % 6 = 0 AS sidecar, event_id % 9 = 0 AS edit, event_id % 10 = 0 AS picked, event_id % 11 = 0 AS embed FROM events)"""


def _run(spark, d) -> DataFrame:
    e = F.col("event_id")
    return b.read(spark, d, "events").select(
        "event_id", F.when(e % 4 == 0, "jpeg").otherwise("raw").alias("kind"), (e % 8 == 0).alias("mirrored"), _pick_from(("failed", "rejected_local", "ready", "scored", "new"), e % 5).alias("status"),
        F.when(e % 7 != 0, _pick_from(BUCKETS, e % 3)).alias("bucket"), (e % 6 == 0).alias("sidecar"), (e % 9 == 0).alias("edit"), (e % 10 == 0).alias("picked"), (e % 11 == 0).alias("embed"),
    )


@query(f"""WITH {RUN} SELECT count(*) AS discovered, count(*) FILTER (kind = 'jpeg') AS jpeg, count(*) FILTER (kind = 'raw') AS raw, count(*) FILTER (mirrored AND bucket IS NOT NULL) AS mirrored, count(*) FILTER (status = 'rejected_local') AS rejected_local,
count(*) FILTER (status IN ('ready', 'scored')) AS queued, count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (bucket = 'reject') AS rejected, count(*) FILTER (bucket = 'review') AS review, count(*) FILTER (bucket = 'pick') AS picked,
count(*) FILTER (sidecar) AS sidecars, count(*) FILTER (edit) AS edits, count(*) FILTER (status = 'failed' AND NOT sidecar) AS failed FROM run""")
def run_counters(spark, d):
    return decisions.run_counters(_run(spark, d))


@query(f"""WITH {RUN} SELECT CASE WHEN bucket IS NULL THEN 'skipped' WHEN picked THEN 'preserved' WHEN embed THEN 'dng' WHEN kind = 'jpeg' THEN 'jpeg' ELSE 'sidecar' END AS destination, count(*) AS n FROM run GROUP BY 1""")
def replay_counts(spark, d):
    return decisions.replay_counts(decisions.replay_plan(_run(spark, d), preserve=True))


@query("SELECT count(*) AS photos, count(*) FILTER (v = 'accept') AS accepted, count(*) FILTER (v = 'refine') AS refined, count(*) FILTER (v = 'reject') AS reverted FROM (SELECT ['accept', 'refine', 'reject', 'accept'][event_id % 4 + 1] AS v FROM events)")
def verdict_counts(spark, d):
    return decisions.verdict_counts(b.read(spark, d, "events").select(_pick_from(("accept", "refine", "reject", "accept"), F.col("event_id") % 4).alias("verdict")))


SELECT_ = """r AS (SELECT o_orderkey, 'P' || o_orderkey AS name, ['reject', 'review', 'pick'][o_orderkey % 3 + 1] AS bucket, o_orderkey % 4 = 0 AS held FROM orders) """


def _select(spark, d) -> tuple[DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    run = b.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("P"), o.cast("string")).alias("name"), _pick_from(BUCKETS, o % 3).alias("bucket"))
    return run, run.where(o % 4 == 0).select(F.lower("name").alias("name"))


@query(f"WITH {SELECT_} SELECT o_orderkey, bucket FROM r WHERE bucket = 'pick' OR held")
def selection_union(spark, d):
    return album.union_selection(*_select(spark, d), key="name", mode="union").select("o_orderkey", "bucket")


@query(f"WITH {SELECT_} SELECT o_orderkey, bucket FROM r WHERE bucket = 'pick' AND NOT held")
def selection_machine(spark, d):
    return album.union_selection(*_select(spark, d), key="name").select("o_orderkey", "bucket")


@query("""SELECT user_id, n, min(event_id) AS least FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id) AS n, count(*) FILTER (user_id % 3 = 0) OVER (PARTITION BY user_id) AS done, event_id FROM events) WHERE done < n GROUP BY 1, 2""")
def open_cohorts(spark, d):
    ev = b.read(spark, d, "events").select("user_id", "event_id")
    left = album.open_cohorts(ev, ev.where("user_id % 3 = 0").select("event_id"), cohort="user_id", key="event_id")
    return left.join(ev.groupBy("user_id").agg(F.min("event_id").alias("least")), "user_id").select("user_id", "n", "least")


@query("""SELECT user_id, min(event_id) AS started, max(event_id) AS resumed, count(*)::INT AS attempts, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (event_id != last_), '') AS history
FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last_ FROM events) GROUP BY 1""")
def attempt_history(spark, d):
    out = album.attempt_history(b.read(spark, d, "events"), run="user_id", offset="event_id", fields=["event_type"])
    return out.select("user_id", "started", "resumed", "attempts", F.array_join(F.transform("history", lambda h: h["event_type"]), ",").alias("history"))


ANSWERS = """q AS (SELECT l_orderkey AS k, l_linenumber AS id, l_partkey::VARCHAR AS name FROM lineitem),
a AS (SELECT k, CASE WHEN k % 7 = 0 AND id = 1 THEN 99 ELSE id END AS id, CASE WHEN k % 5 = 0 THEN name || 'x' ELSE name END AS name FROM q WHERE NOT (k % 11 = 0 AND id = 2)) """


def _answers(spark, d) -> tuple[DataFrame, DataFrame]:
    q = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("id"), F.col("l_partkey").cast("string").alias("name"))
    k = F.col("k")
    a = q.where(~((k % 11 == 0) & (F.col("id") == 2))).select("k", F.when((k % 7 == 0) & (F.col("id") == 1), 99).otherwise(F.col("id")).alias("id"), F.when(k % 5 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"))
    return q, a


@query(f"""WITH {ANSWERS}, n AS (SELECT k, (SELECT count(*) FROM a WHERE a.k = q.k) != count(*) AS c FROM q GROUP BY 1), f AS (SELECT coalesce(q.k, a.k) AS k, bool_or(q.id IS NULL OR a.id IS NULL) AS i, bool_or(coalesce(q.name != a.name, false)) AS m FROM q FULL JOIN a ON q.k = a.k AND q.id = a.id GROUP BY 1)
SELECT k, CASE WHEN c THEN 'count' WHEN i THEN 'keys' ELSE 'names' END AS fault FROM n JOIN f USING (k) WHERE c OR i OR m""")
def answer_faults(spark, d):
    return review.answer_faults(*_answers(spark, d), by=["k"], key="id", name="name")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), z AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 != 1) SELECT count(*) FILTER (z.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right, count(*) FILTER (a.k = z.k) AS shared,
count(*) FILTER (z.k IS NULL) = 0 AS subset, count(*) FILTER (a.k = z.k) = 0 AS disjoint FROM a FULL JOIN z ON a.k = z.k""")
def subset_relations(spark, d):
    c = b.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return review.subset_relations(b.read(spark, d, "orders").select(F.col("o_custkey").alias("k")), c.where("k % 3 != 1"), "k")


@query("SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'changed' END AS fault FROM documents WHERE doc_id % 13 = 0 OR doc_id % 7 = 0")
def changed_artifacts(spark, d):
    docs, k = b.read(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    ledger = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    now = docs.where(k % 13 != 0).select("doc_id", F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return review.changed_artifacts(ledger, now, key="doc_id")


@query(f"""WITH {b.LINES} SELECT name, price, CASE label WHEN 'pick' THEN coalesce(nullif(discount, 0.05), 0.5) WHEN 'reject' THEN coalesce(nullif(discount, 0.05), 0.0) ELSE nullif(discount, 0.05) END AS exposure FROM li""")
def filled_recipe(spark, d):
    verdict = F.when(F.col("label") == "pick", "accept").when(F.col("label") == "reject", "reject").otherwise("refine")
    rows = b.line_frames(spark, d).select("name", "price", verdict.alias("verdict"), F.nullif(F.col("discount"), F.lit(0.05)).alias("exposure"))
    return review.filled(rows, verdict="verdict", accepted={"exposure": F.lit(0.5)}, neutral={"exposure": F.lit(0.0)}).select("name", "price", "exposure")


@query(f"""WITH {b.LINES} SELECT name, price, CASE WHEN burst % 2 = 0 THEN tax ELSE nullif(discount, 0.05) END AS tint FROM li""")
def flattened_recipe(spark, d):
    even = F.col("burst") % 2 == 0
    nested = F.when(even, F.struct(F.col("tax").alias("tint")))
    rows = b.line_frames(spark, d).select("name", "price", F.when(~even, F.nullif(F.col("discount"), F.lit(0.05))).alias("tint"), nested.alias("n"))
    return review.flattened(rows, nested="n", fields=["tint"]).select("name", "price", "tint")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS k FROM events""")
def first_object(spark, d):
    e = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.lit("no { object")).otherwise(F.concat(F.lit('so: {bad} {"k": '), e, F.lit(', "s": "a } b"} and {"k": 0}')))
    return b.read(spark, d, "events").select("event_id", F.get_json_object(review.first_object(text), "$.k").cast("bigint").alias("k"))


@query("""WITH c AS (SELECT p_partkey, n::INT AS n, round(ln((p_size + n * 10 + 8) / 30.0) ** 2 + (n % 2) * 0.01, 9) AS cost FROM part, range(4) t(n)), m AS (SELECT p_partkey, arg_min(n, struct_pack(c := cost, n := n)) AS n, min(cost) AS cost, min(cost) FILTER (n = 0) AS base FROM c GROUP BY 1)
SELECT p_partkey, CASE WHEN base - cost >= 0.03 THEN n ELSE 0 END AS n, round(CASE WHEN base - cost >= 0.03 THEN cost ELSE base END, 6) AS cost FROM m""")
def best_candidate(spark, d):
    n = F.col("n")
    cost = F.round(F.pow(F.ln((F.col("p_size") + n * 10 + 8) / 30.0), 2) + (n % 2) * 0.01, 9)
    tried = b.read(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).select("p_partkey", "n", cost.alias("cost"))
    return render.best_candidate(tried, by=["p_partkey"], cost="cost", order="n").select("p_partkey", "n", _r("cost", "cost"))


@query(f"""WITH {b.LINES} SELECT name, price, round((abs(ln((quantity + 8) / 28)) + 3 * abs(ln((quantity * 2 + 8) / 68)) + abs(ln((quantity * 3 + 8) / 128))) / 5 + 4 * greatest(0, tax - 0.04), 6) AS cost FROM li""")
def tone_cost(spark, d):
    q = F.col("quantity")
    return b.line_frames(spark, d).select("name", "price", _r(render.tone_cost([q, q * 2, q * 3], [F.lit(20.0), F.lit(60.0), F.lit(120.0)], F.col("tax"), F.lit(0.04)), "cost"))


@query("""SELECT p_partkey, (w * h) / 800000.0 >= 0.5 * CASE WHEN c THEN 0.4 ELSE 1 END AS plausible, CASE WHEN w * h <= 4000000 AND greatest(w, h) <= 2560 THEN w ELSE greatest(1, floor(w * s)) END::INT AS width, CASE WHEN w * h <= 4000000 AND greatest(w, h) <= 2560 THEN h ELSE greatest(1, floor(h * s)) END::INT AS height
FROM (SELECT *, least(1, 2560.0 / greatest(w, h), sqrt(4000000.0 / (w * h))) AS s FROM (SELECT p_partkey, p_size * 100 + 100 AS w, p_partkey % 37 * 90 + 100 AS h, p_partkey % 2 = 0 AS c FROM part))""")
def render_sizes(spark, d):
    w, h = F.col("p_size") * 100 + 100, (F.col("p_partkey") % 37 * 90 + 100).cast("int")
    width, height = render.transport_size(w, h, F.lit(1000))
    ok = render.plausible_size(w, h, F.lit(1000), F.lit(800), F.col("p_partkey") % 2 == 0, F.lit(0.4))
    return b.read(spark, d, "part").select("p_partkey", ok.alias("plausible"), width.alias("width"), height.alias("height"))


@query("""SELECT p_partkey, round(l * w, 2) AS x, round(t * h, 2) AS y, round((r - l) * w, 2) AS width, round((b - t) * h, 2) AS height FROM (SELECT *, CASE WHEN a = 0 THEN 0.05 ELSE greatest(0.05, (1 - s) / 2) END AS l, CASE WHEN a = 0 THEN 0.0 ELSE greatest(0.0, (1 - s) / 2) END AS t,
CASE WHEN a = 0 THEN 1.0 ELSE least(1.0, (1 + s) / 2) END AS r, CASE WHEN a = 0 THEN 0.9 ELSE least(0.9, (1 + s) / 2) END AS b FROM (SELECT *, least(1.0, w / (w * cos(a) + h * sin(a)), h / (w * sin(a) + h * cos(a))) AS s
FROM (SELECT p_partkey, 1000.0 + p_size * 10 AS w, 800.0 AS h, radians(abs(p_partkey % 11 - 5)) AS a FROM part)))""")
def crop_plan(spark, d):
    w, h, lit = 1000.0 + F.col("p_size") * 10, F.lit(800.0), F.lit
    plan = render.crop_plan(w, h, lit(0.05), lit(0.0), lit(1.0), lit(0.9), (F.col("p_partkey") % 11 - 5).cast("double"))
    return b.read(spark, d, "part").select("p_partkey", plan.alias("p")).select("p_partkey", *(_r(F.col("p")[k], k, 2) for k in ("x", "y", "width", "height")))


@query("""WITH l AS (SELECT o_custkey, (o_orderkey % 23 - 11)::DOUBLE AS angle, (1 + o_orderkey % 5)::DOUBLE AS weight, o_orderkey FROM orders), s AS (SELECT * FROM l WHERE abs(angle) <= 10),
u AS (SELECT *, sum(weight) OVER (PARTITION BY o_custkey ORDER BY angle, o_orderkey ROWS UNBOUNDED PRECEDING) AS u, sum(weight) OVER (PARTITION BY o_custkey) AS t FROM s), m AS (SELECT o_custkey, min(angle) FILTER (u >= t / 2) AS m FROM u GROUP BY 1)
SELECT o_custkey, count(*) AS lines, CASE WHEN count(*) >= 3 THEN round(m, 2) END AS slope, CASE WHEN count(*) >= 3 THEN round(coalesce(sum(weight) FILTER (abs(angle - m) < 0.6), 0) / sum(weight), 3) END AS agreement FROM s JOIN m USING (o_custkey) GROUP BY o_custkey, m""")
def level_evidence(spark, d):
    o = F.col("o_orderkey")
    lines = b.read(spark, d, "orders").select("o_custkey", (o % 23 - 11).cast("double").alias("angle"), (1 + o % 5).cast("double").alias("weight"))
    return render.level_evidence(lines, by=["o_custkey"], angle="angle", weight="weight")


@query(f"""WITH {b.TILES} SELECT vec_id, round(list_aggregate(tile, 'avg'), 3) AS mean_luma, round(len(list_filter(tile, lambda x: x <= -0.2)) / 64, 6) AS shadow_clip, round(len(list_filter(tile, lambda x: x >= 0.2)) / 64, 6) AS highlight_clip,
round(tile[1], 2) AS tl, round(tile[8], 2) AS tr, round(tile[57], 2) AS bl, round(tile[64], 2) AS br FROM tile""")
def histogram_metrics(spark, d):
    t = b.tile_frames(spark, d).select("vec_id", render.histogram_metrics(F.col("tile"), -0.2, 0.2).alias("h"), render.corners(F.col("tile"), 8).alias("c"))
    return t.select("vec_id", "h.*", *(F.col("c")[i].alias(k) for i, k in enumerate(("tl", "tr", "bl", "br"))))


@query(f"""WITH {b.TILES}, e AS (SELECT vec_id, round(len(list_filter(tile[1:8], lambda x: x <= 0)) / 8, 4) AS top, round(len(list_filter(tile[57:64], lambda x: x <= 0)) / 8, 4) AS bottom, round(len(list_filter(range(8), lambda i: tile[i * 8 + 1] <= 0)) / 8, 4) AS "left",
round(len(list_filter(range(8), lambda i: tile[i * 8 + 8] <= 0)) / 8, 4) AS "right" FROM tile) SELECT *, greatest(top, bottom, "left", "right") >= 0.8 AS solid FROM e""")
def edge_shares(spark, d):
    return b.tile_frames(spark, d).select("vec_id", render.edges(F.col("tile"), 8, dark=0.0, solid=0.8).alias("e")).select("vec_id", "e.*")


@query(f"""WITH {b.TILES} SELECT vec_id, round(list_aggregate(tile, 'avg'), 6) AS brightness, round(list_aggregate(tile, 'stddev_pop'), 6) AS contrast, CASE WHEN vec_id % 3 != 0 THEN (vec_id % 10)::DOUBLE END AS brisque, round(greatest(0, least(10, tile[1] * 50)), 6) AS topiq FROM tile""")
def metric_bundle(spark, d):
    odd = F.when(F.col("vec_id") % 3 != 0, (F.col("vec_id") % 10).cast("double")).when(F.col("vec_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    t = b.tile_frames(spark, d).select("vec_id", render.metric_bundle(F.col("tile"), 8, {"brisque": odd, "topiq": render.learned_score(F.element_at("tile", 1) * 5)}).alias("m"))
    return t.select("vec_id", *(_r(F.col("m")[k], k) for k in ("brightness", "contrast", "brisque", "topiq")))


@query("""SELECT c_custkey, regexp_replace(c_name || '/é ' || c_mktsegment, '[^A-Za-z0-9._-]+', '-', 'g') AS safe, replace(replace(replace('<' || c_name || '&"', '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS html,
regexp_replace(printf('%.6f', c_custkey / 8.0), '\\.?0+$', '') AS short, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), c_mktsegment) AS first_name FROM customer""")
def text_functions(spark, d):
    c = b.read(spark, d, "customer")
    name = F.col("c_name")
    return c.select("c_custkey", scalars.safe_stem(F.concat(name, F.lit("/é "), "c_mktsegment")).alias("safe"), sinks.escaped(F.concat(F.lit("<"), name, F.lit('&"'))).alias("html"), scalars.short_number(F.col("c_custkey") / 8.0).alias("short"), scalars.first_non_empty(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(name), F.col("c_mktsegment")).alias("first_name"))


@query("SELECT lower(c_mktsegment) AS k, max(c_acctbal) FILTER (s = 'a') AS a, max(c_acctbal) FILTER (s = 'b') AS b FROM (SELECT c_mktsegment, 'a' AS s, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'b', min(c_acctbal) FROM customer WHERE c_mktsegment != 'BUILDING' GROUP BY 1) GROUP BY 1")
def wide_scores(spark, d):
    c = b.read(spark, d, "customer").select(F.lower("c_mktsegment").alias("k"), "c_acctbal")
    a = c.groupBy("k").agg(F.max("c_acctbal").alias("value")).withColumn("signal", F.lit("a"))
    z = c.where("k != 'building'").groupBy("k").agg(F.min("c_acctbal").alias("value")).withColumn("signal", F.lit("b"))
    return sinks.wide_scores(c.select("k").distinct(), a.unionByName(z), ["a", "b"], key="k")


@query("""SELECT o_orderkey, 'out/' || o_orderkey || '.arw' AS "copy", 'out/' || o_orderkey || '.arw.rrdata' AS sidecar, 'out/' || o_orderkey || '.jpg' AS output, 92 AS quality FROM orders""")
def render_plan(spark, d):
    o = b.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".arw")).alias("source"))
    return sinks.render_plan(o, source="source", folder="out", quality=92).drop("source")


@query("""SELECT event_type AS status, row_number() OVER (PARTITION BY event_type ORDER BY user_id)::INT AS place, user_id AS name, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT DISTINCT event_type, user_id FROM events)""")
def stage_inventory(spark, d):
    return album.stage_inventory(b.read(spark, d, "events").select(F.col("event_type").alias("status"), F.col("user_id").alias("name")), status="status", name="name")


@query(f"""WITH s AS (SELECT doc_id, source, n_chars, CASE WHEN quality = 0 THEN 'reject' WHEN quality = 1 THEN 'pick' END AS bucket, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT * FROM (SELECT doc_id, 'cull:' || source AS burst, unnest(['size', 'toxic', 'local_gate_reject', 'pipeline_reject']) AS signal, unnest([n_chars::DOUBLE, toxic::DOUBLE, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 3 = 0)::INT::DOUBLE END, (bucket = 'reject')::INT::DOUBLE]) AS value FROM s) WHERE value IS NOT NULL""")
def manifest_signals(spark, d):
    docs = b.read(spark, d, "documents").select("doc_id", "source", "n_chars").join(b.read(spark, d, "labels"), "doc_id", "left")
    bucket = F.when(F.col("quality") == 0, "reject").when(F.col("quality") == 1, "pick")
    decision = F.when(bucket.isNotNull(), F.struct(bucket.alias("bucket")))
    run = docs.select("doc_id", F.col("source").alias("scene_id"), decision.alias("decision"), F.when(F.col("doc_id") % 2 == 0, F.struct((F.col("doc_id") % 3 == 0).alias("quality_reject"))).alias("local_trace"), F.map_filter(F.create_map(F.lit("n_chars"), F.col("n_chars").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")), lambda k, v: v.isNotNull()).alias("signals"))
    return files.signals_of_run(run, ["n_chars", "toxic"], renamed={"n_chars": "size"}, key="doc_id").select("doc_id", "burst", "signal", "value")


#: One album of numbered frames with a few bits of hash and a preview in grey levels, so that neighbours do repeat each other.
#: Best first by (score, name); a frame repeats the first retained one that is near.
ALBUM = f"""WITH RECURSIVE {b.TILES}, r AS (SELECT vec_id, 'F' || vec_id AS name, round(tile[64], 3) AS score, list_transform(tile, lambda x: x * 60) AS preview, [x > 0 FOR x IN tile[1:5]] AS bits, CASE WHEN vec_id % 2 = 0 THEN 'review' ELSE 'pick' END AS before, CASE WHEN tile[3] > -0.1 THEN 'pick' ELSE 'review' END AS bucket FROM tile),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, name DESC) AS rn FROM r WHERE bucket = 'pick'),
p AS (SELECT a.rn, z.vec_id AS near FROM o a JOIN o z ON abs(a.vec_id - z.vec_id) <= 3 AND a.rn > z.rn AND list_sum([(x[1] != x[2])::INT FOR x IN list_zip(a.bits, z.bits)]) <= 2 AND list_avg([abs(x[1] - x[2]) FOR x IN list_zip(a.preview, z.preview)]) <= 8),
n AS (SELECT o.rn, o.vec_id, coalesce(list(near) FILTER (near IS NOT NULL), []) AS near FROM o LEFT JOIN p USING (rn) GROUP BY ALL),
w(rn, kept, vec_id, anchor) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT n.rn, CASE WHEN list_has_any(w.kept, n.near) THEN w.kept ELSE list_append(w.kept, n.vec_id) END, n.vec_id, list_filter(w.kept, lambda k: list_contains(n.near, k))[1] FROM w JOIN n ON n.rn = w.rn + 1),
told AS (SELECT r.*, 'F' || w.anchor AS represented_by FROM r LEFT JOIN w USING (vec_id)), done AS (SELECT * REPLACE (CASE WHEN represented_by IS NULL THEN bucket ELSE 'reject' END AS bucket) FROM told)
"""


def _album(spark, d):
    four = F.concat(F.lit("0" * 15), F.lower(F.hex(sum((F.when(F.element_at("tile", i + 1) > 0, 1 << i).otherwise(0) for i in range(4)), F.lit(0)))))
    fifth = F.concat(F.substring(four, 1, 14), F.when(F.element_at("tile", 5) > 0, "1").otherwise("0"), F.substring(four, 16, 1))
    before = F.when(F.col("vec_id") % 2 == 0, "review").otherwise("pick")
    bucket = F.when(F.element_at("tile", 3) > -0.1, "pick").otherwise("review")
    t = b.tile_frames(spark, d).select("vec_id", F.concat(F.lit("F"), F.col("vec_id").cast("string")).alias("name"), F.transform("tile", lambda x: x * 60).alias("preview"), fifth.alias("hash"), F.round(F.element_at("tile", 64), 3).alias("score"), bucket.alias("bucket"), before.alias("before"))
    return album.suppress(t, name="name", score="score", stem=F.col("name"), hash_="hash", preview="preview", fold=0, first=128)


@query(ALBUM + "SELECT name, bucket, represented_by FROM done")
def album_selection(spark, d):
    """Selected frames and what repeats them, by the rule for albums: close numbers, close hashes, close previews."""
    return _album(spark, d).select("name", "bucket", "represented_by")


@query(ALBUM + """SELECT count(*) AS photos, count(*) FILTER (bucket = 'pick') AS selected, count(represented_by) AS represented, count(*) FILTER (bucket = 'pick' AND before = 'reject') AS from_reject,
count(*) FILTER (bucket = 'pick' AND before = 'review') AS from_review, count(*) FILTER (bucket = 'pick' AND before = 'pick') AS from_pick FROM done""")
def album_summary(spark, d):
    return album.album_summary(_album(spark, d), before="before")


LONG = f"WITH {b.LINES}, lg AS (SELECT signal, label, burst, name, value * CASE signal WHEN 'tax' THEN -1 ELSE 1 END AS value FROM (UNPIVOT li ON quantity, tax INTO NAME signal VALUE value) WHERE label != 'neutral')"


@query(LONG + """, m AS (SELECT signal, min(value) FILTER (label = 'pick') AS floor_ FROM lg GROUP BY 1), s AS (SELECT signal, count(*) AS available, count(*) FILTER (label = 'pick') AS picks, avg(value) FILTER (label = 'pick') * CASE signal WHEN 'tax' THEN -1 ELSE 1 END AS pick_mean, count(*) FILTER (label = 'reject' AND value < floor_) AS zero FROM lg JOIN m USING (signal) GROUP BY signal),
rk AS (SELECT signal, label, rank() OVER (PARTITION BY signal ORDER BY value) + (count(*) OVER (PARTITION BY signal, value) - 1) / 2.0 AS r FROM lg), a AS (SELECT signal, (sum(r) FILTER (label = 'pick') - count(*) FILTER (label = 'pick') * (count(*) FILTER (label = 'pick') + 1) / 2.0) / (count(*) FILTER (label = 'pick')::DOUBLE * count(*) FILTER (label = 'reject')) AS auc FROM rk GROUP BY 1),
bp AS (SELECT x.signal, count(DISTINCT x.burst) AS bursts, avg(CASE WHEN x.value > z.value THEN 1 WHEN x.value = z.value THEN 0.5 ELSE 0 END) AS pairwise FROM lg x JOIN lg z ON x.signal = z.signal AND x.burst = z.burst AND x.label = 'pick' AND z.label = 'reject' GROUP BY 1)
SELECT signal, available, picks, round(pick_mean, 4) AS pick_mean, zero AS zero_fr_rejects, round(auc, 6) AS auc, bursts, round(pairwise, 6) AS pairwise FROM s JOIN a USING (signal) JOIN bp USING (signal)""")
def signal_report(spark, d):
    long = evaluate.long_signals(b.line_frames(spark, d), ["quantity", "tax"], ["name", "burst", "label"])
    out = evaluate.signal_report(long, burst="burst", name="name", directions={"quantity": 1, "tax": -1})
    return out.select("signal", "available", "picks", _r("pick_mean", "pick_mean", 4), "zero_fr_rejects", _r("auc", "auc"), "bursts", _r("pairwise", "pairwise"))


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS model, count(*) AS batches, sum(event_id % 3 + 1)::BIGINT AS attempts, sum(event_id % 11)::DOUBLE AS seconds, count(*) FILTER (event_id % 5 != 0) AS successful,
round(count(*) FILTER (event_id % 5 != 0 AND event_id % 3 = 0) / count(*) FILTER (event_id % 5 != 0), 6) AS first_pass FROM events GROUP BY 1""")
def run_report(spark, d):
    e = F.col("event_id")
    log = b.read(spark, d, "events").select(F.when(e % 2 == 0, "A").otherwise("B").alias("model"), F.when(e % 5 != 0, "success").otherwise("failed").alias("status"), (e % 3 + 1).alias("attempts"), (e % 11).cast("double").alias("seconds"))
    out = models.run_report(log, by=["model"], status="status", attempts="attempts", seconds="seconds")
    return out.select("model", "batches", "attempts", "seconds", "successful", _r("first_pass", "first_pass"))


@query(f"""WITH {b.VERDICTS} SELECT model, count(*) FILTER (bucket = 'reject') AS says_reject, count(*) FILTER (bucket = 'review') AS says_review, count(*) FILTER (bucket = 'pick') AS says_pick FROM latest GROUP BY 1""")
def prediction_counts(spark, d):
    latest = logs.latest(b.verdicts(spark, d), key=["item", "model"], offset="offset")
    return models.prediction_counts(latest, by=["model"], predicted="bucket")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS burst FROM orders)
SELECT c_custkey, coalesce(arg_max(o_totalprice, o_orderkey), -1) AS price, c_acctbal AS balance, count(o_orderkey) AS matched, coalesce(arg_max(burst, o_orderkey) FILTER (burst IS NOT NULL), c_mktsegment) AS burst FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal, c_mktsegment""")
def merge_records(spark, d):
    own = F.create_map(F.lit("price"), F.lit(-1.0), F.lit("balance"), F.col("c_acctbal"))
    base = b.read(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"), "c_custkey", own.alias("signals"), F.col("c_mktsegment").alias("burst"))
    o = F.col("o_orderkey")
    rows = b.read(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), o.alias("rank"), F.lit("price").alias("signal"), F.col("o_totalprice").alias("value"), F.when(o % 3 == 0, F.col("o_orderpriority")).alias("burst"))
    out = logs.merge_records(base, rows, key="name", rank="rank", fields=["burst"])
    return out.select("c_custkey", F.col("signals")["price"].alias("price"), F.col("signals")["balance"].alias("balance"), "matched", "burst")


@query(f"""WITH {b.TILES}, s AS (SELECT vec_id, list_transform(range(72), lambda k: list_sum(list_transform(range(8), lambda i: tile[8 * (k // 9) + i + 1] * greatest(0.0, least(i + 1, (k % 9 + 1) * 8 / 9.0) - greatest(i, (k % 9) * 8 / 9.0))))) AS s FROM tile),
t AS (SELECT vec_id, list_transform(list_filter(range(72), lambda i: i % 9 < 8), lambda i: CASE WHEN s[i + 2] > s[i + 1] THEN 1 ELSE 0 END) AS v FROM s)
SELECT vec_id, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', v[4 * i + 1] * 8 + v[4 * i + 2] * 4 + v[4 * i + 3] * 2 + v[4 * i + 4] + 1, 1)), '') AS hash FROM t""")
def tile_dhash_area(spark, d):
    """The difference hash of tiles averaged over 9 x 8 boxes: 64 bits."""
    return b.tile_frames(spark, d).select("vec_id", tiles.difference_hash(F.col("tile"), 8, 8).alias("hash"))


@query(f"""WITH {b.TILES}, g AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 THEN abs(tile[i + 8] + 2 * tile[i + 9] + tile[i + 10] - tile[i - 8] - 2 * tile[i - 7] - tile[i - 6]) ELSE 0 END) AS g FROM tile),
e AS (SELECT vec_id, i % 8 AS x, i // 8 AS y FROM g, range(8, 56) t(i) WHERE g[i + 1] >= 0.3 AND g[i + 1] > g[i - 7] AND g[i + 1] >= g[i + 9]),
v AS (SELECT vec_id, a, round((y - 4) * cos(radians(a / 10)) - (x - 4) * sin(radians(a / 10)))::INT AS rho, count(*) AS v FROM e, range(-100, 101) t(a) GROUP BY ALL HAVING v >= 2),
k AS (SELECT vec_id, rho, max(v) AS v, arg_max(a, v) AS a FROM (SELECT vec_id, rho, v, avg(a) AS a FROM v GROUP BY vec_id, rho, v) GROUP BY vec_id, rho),
p AS (SELECT *, coalesce(max(v) OVER (PARTITION BY vec_id ORDER BY rho RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(max(v) OVER (PARTITION BY vec_id ORDER BY rho RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS after FROM k)
SELECT vec_id, round(a / 10, 4) AS angle, v::DOUBLE AS weight FROM p WHERE v > before AND v >= after""")
def level_lines(spark, d):
    """Near-level straight edges of the tiles by Hough voting."""
    found = render.near_level_lines(b.tile_frames(spark, d), by=["vec_id"], tile="tile", width=8, height=8, edge=0.3, votes=2)
    return found.select("vec_id", F.round("angle", 4).alias("angle"), "weight")


@query(f"""WITH {b.TILES}, t AS (SELECT vec_id, list_transform(list_filter(range(64), lambda i: i % 8 < 7), lambda i: CASE WHEN tile[i + 2] > tile[i + 1] THEN 1 ELSE 0 END) AS v FROM tile)
SELECT vec_id, array_to_string(list_transform(range(14), lambda i: substr('0123456789abcdef', v[4 * i + 1] * 8 + v[4 * i + 2] * 4 + v[4 * i + 3] * 2 + v[4 * i + 4] + 1, 1)), '') AS hash FROM t""")
def tile_dhash_hex(spark, d):
    return b.tile_frames(spark, d).select("vec_id", tiles.bits_hex(tiles.difference_bits(F.col("tile"), 8)).alias("hash"))
