"""Registered queries over the bound tables, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import scalars, tiles
from framewise.operators import bootstrap, dedup, evaluate, logs, models, ranges, ranking, sampling, scenes, suppression
from framewise.operators.lineage import settled
from framewise.plans.registry import ORACLES, QUERIES, query
from framewise.plans.registry import rounded as _r
from framewise.sources import binding as b
from framewise.sources import files

__all__ = ["ORACLES", "QUERIES"]

GAP = 21600.0
SCENES = f"""WITH {b.EVENTS}, cut AS (SELECT *, CASE WHEN lag(mtime) OVER f IS NULL OR
  epoch_us(mtime) - epoch_us(lag(mtime) OVER f) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW f AS (PARTITION BY folder ORDER BY mtime, frame)),
numbered AS (SELECT *, sum(fresh) OVER (ORDER BY folder, mtime, frame ROWS UNBOUNDED PRECEDING)::BIGINT AS scene_number FROM cut),
sc AS (SELECT *, printf('scene-%04d', scene_number) AS scene_id, row_number() OVER (PARTITION BY scene_number ORDER BY mtime, frame)::INT AS scene_index FROM numbered)
"""


def _scenes(spark, d) -> DataFrame:
    return scenes.assign_scenes(b.event_frames(spark, d), folder="folder", time="mtime", order=["frame"], max_gap=GAP)


@query(SCENES + "SELECT frame, scene_id, scene_index FROM sc")
def scene_sessionize(spark, d):
    return _scenes(spark, d).select("frame", "scene_id", "scene_index")


@query(SCENES + "SELECT frame, scene_id FROM sc WHERE scene_id IN (SELECT DISTINCT scene_id FROM sc ORDER BY 1 LIMIT 40)")
def scene_limit(spark, d):
    return scenes.limit_scenes(_scenes(spark, d), 40).select("frame", "scene_id")


@query(SCENES + """, ch AS (SELECT *, (row_number() OVER (PARTITION BY scene_number ORDER BY scene_index) - 1) // 3 AS chunk FROM sc)
SELECT frame, printf('scene-cohort-%03d', dense_rank() OVER (ORDER BY scene_number, chunk)) AS cohort_id FROM ch""")
def scene_cohorts(spark, d):
    return scenes.cohorts(_scenes(spark, d), 3, scene="scene_number", order=["scene_index"]).select("frame", "cohort_id")


@query(SCENES + """, ch AS (SELECT *, (row_number() OVER (PARTITION BY scene_number ORDER BY scene_index, frame) - 1) // 4 AS chunk FROM sc)
SELECT frame, printf('scene-blind-%03d', dense_rank() OVER (ORDER BY scene_number, chunk)) AS cohort_id FROM ch""")
def blind_cohorts(spark, d):
    return scenes.cohorts(_scenes(spark, d), 4, scene="scene_number", order=["scene_index", "frame"], prefix="scene-blind-").select("frame", "cohort_id")


@query(SCENES + "SELECT frame, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY value DESC, scene_index, frame)::INT AS rank_in_scene FROM sc QUALIFY rank_in_scene <= 2")
def topk_per_scene(spark, d):
    return scenes.top_per_scene(_scenes(spark, d), 2, scene="scene_id", order=[F.desc("value"), "scene_index", "frame"]).select("frame", "scene_id", "rank_in_scene")


@query(SCENES + "SELECT frame, row_number() OVER (ORDER BY scene_number, value DESC, scene_index, frame) AS place FROM sc")
def candidate_order(spark, d):
    sc = _scenes(spark, d).withColumn("_low", -F.col("value"))
    return ranges.numbered(sc, ["scene_number", "_low", "scene_index", "frame"], "place", ranges.block("scene_number")).select("frame", "place")


@query(SCENES + """, m AS (SELECT *, bool_or(label = 'pick') OVER (PARTITION BY scene_id) AS any_pick, row_number() OVER (PARTITION BY scene_id ORDER BY value DESC, frame DESC) AS rn FROM sc)
SELECT scene_id, frame FROM m WHERE NOT any_pick AND rn = 1 AND value >= 0.75 * 60""")
def scene_rescue(spark, d):
    ready = _scenes(spark, d).withColumn("ready", F.col("label") == "pick")
    return scenes.rescue(ready, scene="scene_id", ready="ready", order=[F.desc("value"), F.desc("frame")], floors={"value": 60.0}).select("scene_id", "frame")


@query(SCENES + """, m AS (SELECT scene_id, count(*) AS n, arg_max(frame::VARCHAR, struct_pack(v := value, k := lower(frame::VARCHAR))) AS a, arg_max(frame::VARCHAR, struct_pack(v := frame % 13, k := lower(frame::VARCHAR))) AS b FROM sc GROUP BY 1)
SELECT scene_id, n, a AS value_winner, b AS other_winner FROM m WHERE n >= 2 AND a != b""")
def winner_disagreement(spark, d):
    df = _scenes(spark, d).withColumn("name", F.col("frame").cast("string")).withColumn("other", F.col("frame") % 13)
    return scenes.winner_disagreement(df, scene="scene_id", left="value", right="other", name="name")


@query(f"WITH {b.LINES} SELECT name, price, round((rank() OVER (ORDER BY quantity) - 1 + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0) / (count(*) OVER () - 1), 6) AS pct FROM li")
def percentile_avg_ties(spark, d):
    return ranking.average_percentile(b.line_frames(spark, d), "quantity", "pct").select("name", "price", _r("pct", "pct"))


@query(f"WITH {b.DOCS} SELECT doc_id, round((row_number() OVER (ORDER BY size, lower(doc_id::VARCHAR), doc_id::VARCHAR) - 1) / (count(*) OVER () - 1), 6) AS pct FROM doc")
def percentile_positional(spark, d):
    docs = b.doc_frames(spark, d).withColumn("name", F.col("doc_id").cast("string"))
    return ranking.positional_percentile(docs, "size", "name", "pct").select("doc_id", _r("pct", "pct"))


@query(f"""WITH {b.DOCS}, p AS (SELECT doc_id, (rank() OVER (ORDER BY size) - 1 + (count(*) OVER (PARTITION BY size) - 1) / 2.0) / (count(*) OVER () - 1) AS a,
  (rank() OVER (ORDER BY other) - 1 + (count(*) OVER (PARTITION BY other) - 1) / 2.0) / (count(*) OVER () - 1) AS b FROM doc) SELECT doc_id, round(0.75 * a + 0.25 * b, 6) AS score FROM p""")
def rank_blend(spark, d):
    return ranking.blend(b.doc_frames(spark, d), "size", "other", 0.25, "score").select("doc_id", _r("score", "score"))


@query(f"""WITH {b.LINES} SELECT name, price, round(quantity + 4 * coalesce(nullif(discount, 0.0), 0) + 0.5 * tax + 3 * coalesce(nullif(quantity, 7.0), 0) + 25 * discount + 60 * tax - 0.8 * quantity
  - 0.15 * abs(coalesce(nullif(nullif(quantity, 9.0), 0), 118) - 118), 6) AS score FROM li""")
def local_rank_score(spark, d):
    c = F.col
    score = ranking.local_score(c("quantity"), c("discount"), c("tax"), F.nullif(c("quantity"), F.lit(7.0)), c("discount"), c("tax"), c("quantity"), F.nullif(c("quantity"), F.lit(9.0)))
    return b.line_frames(spark, d).select("name", "price", _r(score, "score"))


GATE = f"""WITH {b.LINES}, v AS (SELECT *, nullif(quantity, 7.0) < 10 AS a, price < 20000 AS b, (nullif(discount, 0.01) < 0.03) AS c, tax < 0.03 AS e FROM li),
g AS (SELECT *, coalesce(a, false) AND coalesce(b, false) AS weak, coalesce(c, false)::INT + coalesce(e, false)::INT AS votes FROM v), gr AS (SELECT *, weak AND votes >= 2 AS rejected FROM g)
"""


def _gate(spark, d) -> DataFrame:
    c, li = F.col, b.line_frames(spark, d)
    weak, votes, rejected = ranking.gate([F.nullif(c("quantity"), F.lit(7.0)) < 10, c("price") < 20000], [F.nullif(c("discount"), F.lit(0.01)) < 0.03, c("tax") < 0.03], 2)
    return li.withColumns({"weak": weak, "votes": votes, "rejected": rejected})


@query(GATE + "SELECT name, price, weak, votes, rejected FROM gr")
def quality_gate(spark, d):
    return _gate(spark, d).select("name", "price", "weak", "votes", "rejected")


@query(GATE + """SELECT count(*) AS n, count(*) FILTER (rejected) AS rejected, round(count(*) FILTER (rejected) / count(*), 6) AS coverage,
  round(count(*) FILTER (rejected AND label = 'reject') / count(*) FILTER (rejected), 6) AS precision, round(count(*) FILTER (rejected AND label = 'pick') / count(*) FILTER (label = 'pick'), 6) AS false_reject_rate,
  round(count(*) FILTER (rejected AND label = 'reject') / count(*) FILTER (label = 'reject'), 6) AS recall FROM gr""")
def gate_confusion(spark, d):
    out = evaluate.gate_confusion(_gate(spark, d))
    return out.select("n", "rejected", *(_r(c, c) for c in ("coverage", "precision", "false_reject_rate", "recall")))


SIGNALS = ["quantity", "price", "discount", "tax"]
LONG = f"WITH {b.LINES}, lg AS (SELECT * FROM (UNPIVOT li ON quantity, price, discount, tax INTO NAME signal VALUE value)) "


def _long(spark, d, deal: str | None = None) -> DataFrame:
    return evaluate.long_signals(b.line_frames(spark, d), SIGNALS, ["name", "burst", "label"], deal)


@query(LONG + """, rk AS (SELECT signal, label, rank() OVER w + (count(*) OVER (PARTITION BY signal, value) - 1) / 2.0 AS r FROM lg WHERE label != 'neutral' WINDOW w AS (PARTITION BY signal ORDER BY value)),
s AS (SELECT signal, count(*) FILTER (label = 'pick') AS p, count(*) FILTER (label = 'reject') AS q, sum(r) FILTER (label = 'pick') AS t FROM rk GROUP BY 1)
SELECT signal, p AS n_pick, q AS n_reject, round((t - p * (p + 1) / 2.0) / (p::DOUBLE * q), 6) AS auc FROM s""")
def signal_auc(spark, d):
    return evaluate.auc(_long(spark, d), by=["signal"]).select("signal", "n_pick", "n_reject", _r("auc", "auc"))


@query(LONG + """, m AS (SELECT signal, min(value) FILTER (label = 'pick') AS floor FROM lg GROUP BY 1)
SELECT signal, count(*) AS available, count(*) FILTER (label = 'pick') AS picks, count(*) FILTER (label = 'reject') AS rejects, round(avg(value) FILTER (label = 'pick'), 4) AS pick_mean,
round(avg(value) FILTER (label = 'reject'), 4) AS reject_mean, count(*) FILTER (label = 'reject' AND value < floor) AS zero_fr_rejects, round(count(*) FILTER (label = 'reject' AND value < floor) / count(*), 6) AS zero_fr_coverage
FROM lg JOIN m USING (signal) GROUP BY 1""")
def signal_eval(spark, d):
    s = evaluate.signal_summary(_long(spark, d), ["signal"])
    return s.select("signal", "available", "picks", "rejects", _r("pick_mean", "pick_mean", 4), _r("reject_mean", "reject_mean", 4), "zero_fr_rejects", _r("zero_fr_coverage", "zero_fr_coverage"))


@query(LONG + "SELECT signal FROM lg WHERE label != 'neutral' AND (signal != 'tax' OR label = 'pick') GROUP BY 1 HAVING count(DISTINCT label) = 2")
def available_signals(spark, d):
    return evaluate.available_signals(_long(spark, d).where("signal != 'tax' or label = 'pick'"))


@query(LONG + """, b2 AS (SELECT *, count(*) FILTER (label = 'pick') OVER g AS np, count(*) FILTER (label = 'reject') OVER g AS nr FROM lg WINDOW g AS (PARTITION BY signal, burst)),
c AS (SELECT * FROM b2 WHERE np > 0 AND nr > 0), r AS (SELECT *, row_number() OVER (PARTITION BY signal, burst ORDER BY value DESC, lower(name), label) AS rn FROM c),
t AS (SELECT signal, burst, max((rn = 1 AND label = 'pick')::INT) AS t1, max((rn <= 3 AND label = 'pick')::INT) AS t3 FROM r GROUP BY 1, 2),
pr AS (SELECT a.signal, count(*) AS n, sum(CASE WHEN a.value > z.value THEN 2 WHEN a.value = z.value THEN 1 ELSE 0 END) AS won FROM c a JOIN c z ON a.signal = z.signal AND a.burst = z.burst AND a.label = 'pick' AND z.label = 'reject' GROUP BY 1),
ts AS (SELECT signal, count(*) AS bursts, avg(t1) AS top1, avg(t3) AS top3 FROM t GROUP BY 1)
SELECT signal, bursts, round(won / (2.0 * n), 6) AS pairwise, round(top1, 6) AS top1, round(top3, 6) AS top3 FROM ts JOIN pr USING (signal)""")
def burst_metrics(spark, d):
    out = evaluate.burst_metrics(_long(spark, d, "burst"), by=["signal"], burst="burst", order=[F.desc("value"), F.lower("name"), "label"])
    return out.select("signal", "bursts", _r("pairwise", "pairwise"), _r("top1", "top1"), _r("top3", "top3"))


@query(f"""WITH {b.DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY size, doc_id) AS rn, count(*) OVER () AS n FROM doc WHERE label != 'neutral'),
p AS (SELECT unnest([5, 10, 20, 30, 40, 50])::INT AS percent) SELECT percent, greatest(1, n * percent // 100)::BIGINT AS "count", count(*) FILTER (label = 'pick') AS false_rejects,
round(count(*) FILTER (label = 'reject') / count(*), 6) AS precision FROM r JOIN p ON rn <= greatest(1, n * percent // 100) GROUP BY 1, 2""")
def coverage_curve(spark, d):
    return evaluate.coverage_curve(b.doc_frames(spark, d).where("label != 'neutral'"), order=["size", "doc_id"]).select("percent", "count", "false_rejects", _r("precision", "precision"))


_FIFTH = "((a * a % 2147483647) * (a * a % 2147483647) % 2147483647 * a % 2147483647)"


@query(f"""WITH {b.DOCS}, num AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM doc WHERE label != 'neutral'),
sl AS (SELECT label, n, t, i, (t * 2 + (label = 'reject')::INT + ('0x' || substr(md5('seed'), 1, 8))::BIGINT % 2147483647) % 2147483647 AS y FROM (SELECT label, n, unnest(range(n + 1)) AS i FROM num GROUP BY label, n), range(2000) x(t)),
h1 AS (SELECT *, (i + 1 + y) % 2147483647 AS a FROM sl), h2 AS (SELECT * REPLACE (({_FIFTH} + y * 48271) % 2147483647 AS a) FROM h1), h3 AS (SELECT * REPLACE (({_FIFTH} + y * 16807) % 2147483647 AS a) FROM h2),
ex AS (SELECT label, n, t, i, -ln(({_FIFTH} + 0.5) / 2147483647) AS e FROM h3), ps AS (SELECT *, sum(e) OVER (PARTITION BY label, t ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, sum(e) OVER (PARTITION BY label, t) AS total FROM ex),
tk AS (SELECT t AS iteration, label, size AS l, other AS r FROM (SELECT label, t, floor(n * s / total)::BIGINT AS rn FROM ps WHERE i < n) JOIN num USING (label, rn) UNION ALL SELECT -1, label, size, other FROM num),
lg AS (SELECT iteration, label, 'l' AS side, l AS value FROM tk UNION ALL SELECT iteration, label, 'r', r FROM tk),
rk AS (SELECT iteration, side, label, rank() OVER (PARTITION BY iteration, side ORDER BY value) + (count(*) OVER (PARTITION BY iteration, side, value) - 1) / 2.0 AS k FROM lg),
au AS (SELECT iteration, side, (sum(k) FILTER (label = 'pick') - count(*) FILTER (label = 'pick') * (count(*) FILTER (label = 'pick') + 1) / 2.0) / (count(*) FILTER (label = 'pick')::DOUBLE * count(*) FILTER (label = 'reject')) AS a FROM rk GROUP BY 1, 2),
de AS (SELECT iteration, max(a) FILTER (side = 'l') - max(a) FILTER (side = 'r') AS delta FROM au GROUP BY 1), so AS (SELECT delta, row_number() OVER (ORDER BY delta, iteration) - 1 AS rn FROM de WHERE iteration >= 0)
SELECT round((SELECT delta FROM de WHERE iteration = -1), 6) AS observed, round(max(delta) FILTER (rn = 49), 6) AS low, round(max(delta) FILTER (rn = 1949), 6) AS high FROM so""")
def bootstrap_auc_delta(spark, d):
    """Interval of the difference of two AUCs from 2000 paired bootstrap samples."""
    return bootstrap.bootstrap_delta(b.doc_frames(spark, d), key="doc_id", left="size", right="other").select(_r("observed", "observed"), _r("low", "low"), _r("high", "high"))


@query("""SELECT o_orderkey, CASE WHEN good IS NOT NULL THEN CASE WHEN good THEN 'pick' ELSE 'reject' END WHEN coalesce(rating, 0) = -1 THEN 'reject' WHEN coalesce(rating, 0) > 0 THEN 'pick' ELSE 'neutral' END AS label
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN NULL ELSE false END AS good, (o_orderkey % 7 - 1)::INT AS rating FROM orders)""")
def label_rule(spark, d):
    good = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") != "O", False)
    rating = (F.col("o_orderkey") % 7 - 1).cast("int")
    return b.read(spark, d, "orders").select("o_orderkey", ranking.human_label(good, rating, F.lit(0)).alias("label"))


@query("""SELECT o_orderkey, CASE k WHEN 'reject' THEN -1 WHEN 'review' THEN 0 ELSE CASE WHEN r < 1 THEN 4 ELSE r END END::INT AS rating, CASE k WHEN 'reject' THEN 'Yellow' WHEN 'review' THEN NULL ELSE coalesce(l, 'Green') END AS label,
CASE WHEN k IN ('pick', 'review') THEN l WHEN o_orderkey % 2 = 0 THEN 'Red' ELSE 'Yellow' END AS shown FROM (SELECT o_orderkey, ['reject', 'review', 'pick'][o_orderkey % 3 + 1] AS k, (o_orderkey % 5)::INT AS r, CASE WHEN o_orderkey % 4 = 0 THEN 'Blue' END AS l FROM orders)""")
def normalize_decision(spark, d):
    o = F.col("o_orderkey")
    bucket = F.element_at(F.array(*map(F.lit, ("reject", "review", "pick"))), (o % 3 + 1).cast("int"))
    label = F.when(o % 4 == 0, "Blue")
    rating, color = ranking.normalised_decision(bucket, (o % 5).cast("int"), label)
    source = F.when(o % 2 == 0, "local").otherwise("vision")
    return b.read(spark, d, "orders").select("o_orderkey", rating.alias("rating"), color.alias("label"), ranking.display_label(bucket, label, source).alias("shown"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'review' END, CASE WHEN o_totalprice > 100000 THEN 'pick' ELSE 'reject' END) AS bucket FROM orders")
def legacy_decision(spark, d):
    return b.read(spark, d, "orders").select("o_orderkey", ranking.legacy_bucket(F.when(F.col("o_orderkey") % 3 == 0, "review"), F.col("o_totalprice") > 100000).alias("bucket"))


@query(f"""WITH {b.LINES} SELECT name, price, round(least(100, greatest(-100, least(quantity - 25 + 30, greatest(quantity - 25 - 30, price / 500 - 100)))), 6) AS v FROM li""")
def clamp_refinement(spark, d):
    return b.line_frames(spark, d).select("name", "price", _r(ranking.clamped(F.col("price") / 500 - 100, F.col("quantity") - 25, 30, -100.0, 100.0), "v"))


@query("""SELECT p_partkey, round(w * s, 4) AS width, round(h * s, 4) AS height FROM (SELECT *, least(1.0, w / (w * cos(a) + h * sin(a)), h / (w * sin(a) + h * cos(a))) AS s
FROM (SELECT p_partkey, 1000.0 + p_size * 10 AS w, 800.0 AS h, radians(abs(p_partkey % 11 - 5)) AS a FROM part))""")
def crop_geometry(spark, d):
    w, h = ranking.safe_inset(1000.0 + F.col("p_size") * 10, F.lit(800.0), (F.col("p_partkey") % 11 - 5).cast("double"))
    return b.read(spark, d, "part").select("p_partkey", _r(w, "width", 4), _r(h, "height", 4))


@query("""SELECT p_partkey, e AND NOT (l <= 0 AND l + s >= 1) AS has_crop, round(CASE WHEN e AND NOT (l <= 0 AND l + s >= 1) THEN s * s ELSE 1.0 END::DOUBLE, 6) AS area
FROM (SELECT p_partkey, (p_partkey % 4)::DOUBLE / 10 AS l, 0.5 + (p_partkey % 2) * 0.5 AS s, p_partkey % 3 != 0 AS e FROM part)""")
def crop_rectangle(spark, d):
    p = F.col("p_partkey")
    low, side = (p % 4).cast("double") / 10, 0.5 + (p % 2) * 0.5
    has, area = ranking.crop_rectangle(low, low, low + side, low + side, p % 3 != 0)
    return b.read(spark, d, "part").select("p_partkey", has.alias("has_crop"), _r(area, "area"))


@query("""SELECT c_custkey, signal, round(value, 6) AS value FROM (SELECT c_custkey, signal, arg_max(struct_pack(x := value), k).x AS value FROM (
SELECT c_custkey, 'bal' AS signal, c_acctbal AS value, 0 AS k FROM customer UNION ALL SELECT c_custkey, 'bal', CASE WHEN c_custkey % 5 != 0 THEN c_acctbal * 2 END, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL
SELECT c_custkey, 'nation', c_nationkey::DOUBLE, 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1, 2)""")
def merge_sources(spark, d):
    c = b.read(spark, d, "customer")
    key = F.col("c_custkey")
    one = c.select("c_custkey", F.lit("bal").alias("signal"), F.col("c_acctbal").alias("value"))
    two = c.where(key % 2 == 0).select("c_custkey", F.lit("bal").alias("signal"), F.when(key % 5 != 0, F.col("c_acctbal") * 2).alias("value"))
    three = c.where(key % 3 == 0).select("c_custkey", F.lit("nation").alias("signal"), F.col("c_nationkey").cast("double").alias("value"))
    return logs.merge_signals(c, [one, two.union(three)], "c_custkey").select("c_custkey", "signal", _r("value", "value"))


@query("""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - 1 END AS p, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 THEN o_orderstatus END AS st FROM orders)
SELECT a.k, coalesce(a.st, z.st) AS st FROM a LEFT JOIN a z ON a.p = z.k""")
def pair_mirror(spark, d):
    k = F.col("o_orderkey")
    a = b.read(spark, d, "orders").select(k.alias("k"), F.when(k % 2 == 1, k - 1).alias("p"), F.when((k % 2 == 0) | (k % 5 == 0), F.col("o_orderstatus")).alias("st"))
    return logs.mirror_pairs(a, key="k", partner="p", columns=["st"]).select("k", "st")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labelled(spark, d):
    return b.read(spark, d, "documents").select("doc_id", "source").join(b.read(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_excluded(spark, d):
    return b.read(spark, d, "documents").select("doc_id", "source").join(b.read(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT k, CASE WHEN b IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM (SELECT coalesce(c_custkey, o_custkey) AS k, c_custkey AS a, o_custkey AS b
FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey) WHERE a IS NULL OR b IS NULL""")
def set_check(spark, d):
    return logs.set_difference(b.read(spark, d, "customer").select(F.col("c_custkey").alias("k")), b.read(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT n_name AS name FROM nation INTERSECT SELECT r_name FROM region UNION ALL (SELECT n_name FROM nation EXCEPT SELECT r_name FROM region)")
def set_operations(spark, d):
    n, r = b.read(spark, d, "nation").select(F.col("n_name").alias("name")), b.read(spark, d, "region").select(F.col("r_name").alias("name"))
    return n.intersect(r).unionByName(n.exceptAll(r).distinct())


@query(f"WITH {b.VERDICTS} SELECT item, model, bucket, rating, \"offset\" FROM latest")
def log_latest(spark, d):
    return logs.latest(b.verdicts(spark, d), key=["item", "model"], offset="offset").select("item", "model", "bucket", "rating", "offset")


def _latest(spark, d) -> DataFrame:
    return logs.latest(b.verdicts(spark, d).withColumn("at", F.col("offset")), key=["item", "model"], offset="offset")


@query(f"WITH {b.VERDICTS} SELECT model, human, bucket, count(*) AS n FROM latest GROUP BY 1, 2, 3")
def confusion_matrix(spark, d):
    return models.confusion(_latest(spark, d), by=["model"], human="human", predicted="bucket")


@query(f"""WITH {b.VERDICTS}, v AS (SELECT *, CASE WHEN item % 7 != 0 THEN bucket END AS p FROM latest) SELECT model, count(*) AS items, count(p) AS covered,
round(coalesce(count(*) FILTER (human = 'pick' AND p = 'reject') / nullif(count(*) FILTER (human = 'pick' AND p IS NOT NULL), 0), 0), 6) AS false_reject_rate,
round(coalesce(count(*) FILTER (human = 'pick' AND p = 'pick') / nullif(count(*) FILTER (p = 'pick'), 0), 0), 6) AS pick_precision,
round(coalesce(count(*) FILTER (human = 'pick' AND p = 'pick') / nullif(count(*) FILTER (human = 'pick'), 0), 0), 6) AS pick_recall, round(count(p) * 60.0 / sum(seconds), 6) AS items_per_minute FROM v GROUP BY 1""")
def model_eval(spark, d):
    out = models.evaluation(_latest(spark, d).withColumn("p", F.when(F.col("item") % 7 != 0, F.col("bucket"))), by=["model"], human="human", predicted="p", seconds="seconds")
    return out.select("model", "items", "covered", *(_r(c, c) for c in ("false_reject_rate", "pick_precision", "pick_recall", "items_per_minute")))


@query(f"""WITH {b.VERDICTS} SELECT item, model, round(CASE bucket WHEN 'reject' THEN 0 WHEN 'pick' THEN 2 ELSE 1 END + greatest(0, least(5, rating)) / 100.0, 6) AS score FROM latest""")
def composite_score(spark, d):
    return _latest(spark, d).select("item", "model", _r(models.composite("bucket", "rating"), "score"))


@query(f"""WITH {b.VERDICTS}, o AS (SELECT *, abs((CASE bucket WHEN 'reject' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) - (CASE human WHEN 'reject' THEN 0 WHEN 'review' THEN 1 ELSE 2 END)) AS e FROM latest)
SELECT model, count(*) AS covered, count(*) FILTER (e = 0) AS exact, round(avg((e = 0)::INT), 6) AS accuracy, round(avg(e), 6) AS mean_error, count(*) FILTER (bucket = 'reject' AND human != 'reject') AS false_rejects,
count(*) FILTER (human = 'pick' AND bucket != 'pick') AS missed_picks FROM o GROUP BY 1""")
def ordinal_accuracy(spark, d):
    out = models.ordinal_accuracy(_latest(spark, d), by=["model"], human="human", predicted="bucket")
    return out.select("model", "covered", "exact", _r("accuracy", "accuracy"), _r("mean_error", "mean_error"), "false_rejects", "missed_picks")


@query(f"""WITH {b.VERDICTS}, w AS (SELECT item, max(human) AS h, max(bucket) FILTER (model = 'A') AS a, max(bucket) FILTER (model = 'B') AS b FROM latest GROUP BY 1),
n AS (SELECT list_position(['reject', 'review', 'pick'], h) AS h, list_position(['reject', 'review', 'pick'], a) AS a, list_position(['reject', 'review', 'pick'], b) AS b FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) FILTER (abs(a - h) < abs(b - h)) AS left_wins, count(*) FILTER (abs(a - h) > abs(b - h)) AS right_wins, count(*) FILTER (abs(a - h) = abs(b - h)) AS ties FROM n""")
def paired_wins(spark, d):
    wide = _latest(spark, d).groupBy("item", "human").pivot("model", ["A", "B"]).agg(F.max("bucket"))
    return models.paired_wins(wide, item="item", human="human", left="A", right="B")


@query("""SELECT CASE c WHEN 'A' THEN 'm1' WHEN 'B' THEN 'm2' ELSE 'tie' END AS winner, count(*) AS n FROM (SELECT ['A', 'B', 'tie', 'x'][event_id % 4 + 1] AS c FROM events) WHERE c != 'x' GROUP BY 1""")
def preference_counts(spark, d):
    choice = F.element_at(F.array(*map(F.lit, ("A", "B", "tie", "x"))), (F.col("event_id") % 4 + 1).cast("int"))
    return models.preference_counts(b.read(spark, d, "events").select(choice.alias("c"), F.lit("m1").alias("a"), F.lit("m2").alias("b")), choice="c", a="a", b="b")


@query(LONG + "SELECT label, signal AS field, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation, min(value) AS low, max(value) AS high, count(DISTINCT value) AS n_distinct FROM lg GROUP BY 1, 2")
def slider_stats(spark, d):
    out = models.field_statistics(b.line_frames(spark, d), by=["label"], fields=SIGNALS)
    return out.select("label", "field", _r("mean", "mean", 4), _r("deviation", "deviation", 4), "low", "high", "n_distinct")


@query(f"""WITH {b.LINES} SELECT label, count(*) AS n, count(DISTINCT (discount, tax)) AS vectors, round(1 - count(DISTINCT (discount, tax)) / count(*), 6) AS repeat_rate, count(*) FILTER (discount = 0 AND tax = 0) AS no_ops,
round(avg(quantity), 4) AS mean_seconds, median(quantity) AS median_seconds FROM li GROUP BY 1""")
def vector_diversity(spark, d):
    out = models.diversity(b.line_frames(spark, d), by=["label"], fields=["discount", "tax"], seconds="quantity")
    return out.select("label", "n", "vectors", _r("repeat_rate", "repeat_rate"), "no_ops", _r("mean_seconds", "mean_seconds", 4), "median_seconds")


@query(f"""WITH {b.VERDICTS}, f AS (SELECT model, item, 'rating' AS field, rating::DOUBLE AS x FROM latest UNION ALL SELECT model, item, 'seconds', seconds FROM latest)
SELECT a.model AS left_model, z.model AS right_model, a.field, count(*) AS shared, round(avg(abs(a.x - z.x)), 6) AS mean_delta FROM f a JOIN f z ON a.item = z.item AND a.field = z.field AND a.model < z.model GROUP BY 1, 2, 3""")
def slider_delta(spark, d):
    return models.pairwise_delta(_latest(spark, d), model="model", item="item", fields=["rating", "seconds"]).select("left_model", "right_model", "field", "shared", _r("mean_delta", "mean_delta"))


@query("""SELECT c_custkey, s AS sample FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) JOIN range(20) t(s) ON i = floor((s + 0.5) * n / 20)""")
def evenly_spaced(spark, d):
    return sampling.evenly_spaced(b.read(spark, d, "customer"), 20, order=["c_custkey"]).select("c_custkey", "sample")


MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(f"""WITH f AS (SELECT source, row_number() OVER (ORDER BY {MD5.format("'s|' || source")}, source) AS place FROM (SELECT DISTINCT source FROM documents)),
r AS (SELECT doc_id, source, place, row_number() OVER (PARTITION BY source ORDER BY {MD5.format("'s|' || source || '|' || doc_id")}, doc_id) AS rn FROM documents JOIN f USING (source) WHERE place <= 6)
SELECT doc_id, source, place::INT AS place FROM r WHERE rn <= 25 // 6 + (CASE WHEN place <= 25 % 6 THEN 1 ELSE 0 END)""")
def balanced_sample(spark, d):
    return sampling.balanced(b.read(spark, d, "documents").select("doc_id", "source"), folder="source", name="doc_id", folders=6, total=25, seed="s").select("doc_id", "source", "place")


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {MD5.format("'g|' || event_id")}, event_id) AS rn FROM events),
w(user_id, rn, kept) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[] FROM r UNION ALL
SELECT w.user_id, r.rn, CASE WHEN len(list_filter(kept, lambda k: abs(k - event_id) < 400)) = 0 THEN list_append(kept, event_id) ELSE kept END FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT user_id, unnest(arg_max(kept, rn)) AS event_id FROM w GROUP BY 1""")
def gap_sample(spark, d):
    ev = b.read(spark, d, "events").select("user_id", "event_id")
    return dedup.gap_sample(ev, group="user_id", name="event_id", sequence="event_id", order=scalars.draw(F.lit("g"), "event_id"), gap=400)


@query(f"""WITH {b.DOCS}, r AS (SELECT doc_id, label, CASE label WHEN 'pick' THEN 0 WHEN 'reject' THEN 1 ELSE 2 END AS p, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM doc) SELECT doc_id, label FROM r ORDER BY rn, p, doc_id LIMIT 30""")
def canary_round_robin(spark, d):
    df = b.doc_frames(spark, d).withColumn("p", F.when(F.col("label") == "pick", 0).when(F.col("label") == "reject", 1).otherwise(2))
    return sampling.round_robin(df, 30, stratum="label", priority="p", order=["doc_id"]).select("doc_id", "label")


@query(f"""WITH {b.DOCS}, c AS (SELECT doc_id, 'a' AS cat FROM doc WHERE label = 'pick' UNION ALL SELECT doc_id, 'b' FROM doc WHERE size > 2000 UNION ALL SELECT doc_id, 'c' FROM doc WHERE doc_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY doc_id)::INT AS rn FROM c), f AS (SELECT doc_id, min(struct_pack(rn := rn, cat := cat)) AS spot, string_agg(cat, ',' ORDER BY cat) AS reasons FROM r GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY spot, doc_id)::INT AS position, reasons FROM f ORDER BY spot, doc_id LIMIT 50""")
def interleave_review(spark, d):
    docs = b.doc_frames(spark, d)
    cats = [docs.where(c).select("doc_id", F.lit(k).alias("cat")) for k, c in (("a", "label = 'pick'"), ("b", "size > 2000"), ("c", "doc_id % 3 = 0"))]
    return sampling.interleaved(cats[0].union(cats[1]).union(cats[2]), category="cat", item="doc_id", order=["doc_id"], cap=50)


@query(f"SELECT doc_id, CASE WHEN {MD5.format("'ab|' || doc_id")} % 2 = 0 THEN 'A' ELSE 'B' END AS first_model FROM documents")
def ab_assignment(spark, d):
    return sampling.ab_assignment(b.read(spark, d, "documents").select("doc_id"), "doc_id", "ab")


@query("SELECT user_id, event_id, rn::INT AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn IN (1, n // 2 + 1, n)")
def first_middle_last(spark, d):
    return sampling.first_middle_last(b.read(spark, d, "events"), partition="user_id", order=["event_id"]).select("user_id", "event_id", "place")


@query(SCENES + """, z AS (SELECT *, CASE WHEN label = 'reject' THEN 'rejected_local' WHEN value > 80 THEN 'scored' ELSE 'ready' END AS status FROM sc)
SELECT count(*) AS total, count(*) FILTER (status = 'rejected_local') AS rejected_local, count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status = 'ready') AS ready, count(DISTINCT scene_id) AS scenes, count(*) FILTER (label = 'pick') AS picks FROM z""")
def pipeline_summary(spark, d):
    status = F.when(F.col("label") == "reject", "rejected_local").when(F.col("value") > 80, "scored").otherwise("ready")
    z = _scenes(spark, d).withColumn("status", status)
    is_ = lambda k: F.count_if(F.col("status") == k).alias(k)
    return z.agg(F.count("*").alias("total"), is_("rejected_local"), is_("scored"), is_("ready"), F.countDistinct("scene_id").alias("scenes"), F.count_if(F.col("label") == "pick").alias("picks"))


@query(f"WITH {b.DOCS} SELECT source, count(*) FILTER (label = 'pick') AS pick, count(*) FILTER (label = 'reject') AS reject, count(*) FILTER (label = 'neutral') AS neutral FROM doc GROUP BY 1")
def label_totals(spark, d):
    is_ = lambda k: F.count_if(F.col("label") == k).alias(k)
    return b.doc_frames(spark, d).groupBy("source").agg(is_("pick"), is_("reject"), is_("neutral"))


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return logs.duplicate_names(b.read(spark, d, "part"), "p_name")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY lower(p_brand || p_size)) > 1 THEN p_partkey || '-' || p_brand || p_size ELSE p_brand || p_size END AS output FROM part")
def output_naming(spark, d):
    df = b.read(spark, d, "part").withColumn("name", F.concat("p_brand", F.col("p_size").cast("string")))
    return logs.output_name(df, name="name", key="p_partkey").select("p_partkey", "output")


@query("SELECT lower(p_brand || '/' || p_size || '.xmp') AS target, count(DISTINCT p_partkey) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def unique_targets(spark, d):
    df = b.read(spark, d, "part").withColumn("target", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".xmp")))
    return logs.shared_targets(df, target="target", owner="p_partkey")


@query("""SELECT c_custkey, coalesce(try_cast(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT), 0) AS seq, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug, try_cast(try_cast(c_acctbal::VARCHAR AS DOUBLE) AS BIGINT) IS NOT NULL AS number FROM customer""")
def scalar_functions(spark, d):
    c = b.read(spark, d, "customer")
    return c.select("c_custkey", scalars.sequence_suffix(F.col("c_name")).alias("seq"), scalars.slug(F.col("c_name")).alias("slug"), scalars.loose_int(F.col("c_acctbal").cast("string")).isNotNull().alias("number"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, d):
    return b.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


BITS = "list_aggregate(list_transform(range(1, 65), lambda i: CASE WHEN (a.tile[i] > 0) != (z.tile[i] > 0) THEN 1 ELSE 0 END), 'sum')"


@query(f"WITH {b.TILES}, p AS (SELECT a.vec_id AS a, z.vec_id AS b, {BITS}::INT AS distance FROM tile a JOIN tile z ON a.scene = z.scene AND a.vec_id < z.vec_id) SELECT * FROM p WHERE distance <= 20")
def hamming_pairs(spark, d):
    t = b.tile_frames(spark, d).where("scene is not null")  # null scenes are equal to none in SQL
    return suppression.hash_pairs(t, group="scene", name="vec_id", hash_="hash", radius=20)


def _fold(near: str, scene: str = "scene", columns: str = "scene, vec_id, anchor") -> str:
    return f"""WITH RECURSIVE {b.TILES}, album AS (SELECT * REPLACE ({scene} AS scene) FROM tile), r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY tile[1] DESC, vec_id DESC) AS rn FROM album),
w(scene, rn, kept, vec_id, anchor) AS (SELECT DISTINCT scene, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM r UNION ALL
SELECT w.scene, r.rn, CASE WHEN x.anchor IS NULL THEN list_append(w.kept, r.vec_id) ELSE w.kept END, r.vec_id, x.anchor FROM w JOIN r ON r.scene = w.scene AND r.rn = w.rn + 1,
LATERAL (SELECT arg_min(z.vec_id, list_position(w.kept, z.vec_id)) AS anchor FROM album z, (SELECT r.tile AS tile, r.vec_id AS vec_id) a WHERE z.scene = r.scene AND list_contains(w.kept, z.vec_id) AND {near}) x)
SELECT {columns} FROM w WHERE vec_id IS NOT NULL"""


def _alike(bits: int):
    return {"near": lambda r, k: scalars.hamming(r["hash"], k["hash"]) <= bits, "keys": lambda f: suppression.block_keys(f["hash"], bits, 500)}


@query(_fold(f"{BITS} <= 20"))
def greedy_dedup(spark, d):
    t = b.tile_frames(spark, d).withColumn("score", F.element_at("tile", 1))
    return suppression.suppress_near(t, group="scene", name="vec_id", order=[F.col("score")], fields=["hash"], **_alike(20))


@query(_fold(f"{BITS} <= 20", "0", "vec_id, anchor"))
def corpus_dedup(spark, d):
    """The greedy fold over all vectors as one group, which goes by rounds of joins in batches of doubling size."""
    t = b.tile_frames(spark, d).withColumns({"score": F.element_at("tile", 1), "scene": F.lit(0)})
    return suppression.suppress_near(t, group="scene", name="vec_id", order=[F.col("score")], fields=["hash"], **_alike(20), first=64, fold=0).select("vec_id", "anchor")


@query(_fold(f"abs(a.vec_id - z.vec_id) <= 300 AND {BITS} <= 24 AND list_aggregate(list_transform(range(1, 65), lambda i: abs(a.tile[i] - z.tile[i])), 'avg') <= 0.2"))
def album_dedup(spark, d):
    t = b.tile_frames(spark, d).withColumn("score", F.element_at("tile", 1)).withColumn("seq", F.col("vec_id"))
    near = lambda r, k: (F.abs(r["seq"] - k["seq"]) <= 300) & (scalars.hamming(r["hash"], k["hash"]) <= 24) & (tiles.mean_difference(r["tile"], k["tile"]) <= 0.2)
    return suppression.suppress_near(t, group="scene", name="vec_id", order=[F.col("score")], fields=["hash", "seq", "tile"], near=near, keys=lambda f: suppression.step_keys(f["seq"], 300))


def _px(y: str, x: str) -> str:
    """A pixel of the 8x8 tile with the border mirrored."""
    m = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
    return f"tile[({m.format(y)}) * 8 + ({m.format(x)}) + 1]"


def _kernel(terms: dict[tuple[int, int], int]) -> str:
    return " + ".join(f"({w}) * {_px(f'(i // 8 + {dy})', f'(i % 8 + {dx})')}" for (dy, dx), w in terms.items())


LAPLACE = _kernel({(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1, (0, 0): -4})
GX = _kernel({(-1, 1): 1, (0, 1): 2, (1, 1): 1, (-1, -1): -1, (0, -1): -2, (1, -1): -1})
GY = _kernel({(1, -1): 1, (1, 0): 2, (1, 1): 1, (-1, -1): -1, (-1, 0): -2, (-1, 1): -1})


@query(f"WITH {b.TILES}, l AS (SELECT vec_id, list_transform(range(64), lambda i: {LAPLACE}) AS v FROM tile) SELECT vec_id, round(list_aggregate(v, 'var_pop'), 6) AS variance FROM l")
def tile_laplacian(spark, d):
    return b.tile_frames(spark, d).select("vec_id", tiles.laplacian(F.col("tile"), 8).alias("v")).select("vec_id", _r(F.pow(tiles.contrast(F.col("v")), 2), "variance"))


@query(f"WITH {b.TILES} SELECT vec_id, round(list_aggregate(list_transform(range(64), lambda i: sqrt(({GX}) ** 2 + ({GY}) ** 2)), 'avg'), 6) AS sharpness FROM tile")
def tile_tenengrad(spark, d):
    return b.tile_frames(spark, d).select("vec_id", _r(tiles.mean(tiles.gradient(F.col("tile"), 8)), "sharpness"))


@query(f"WITH {b.TILES} SELECT vec_id, round(list_aggregate(tile, 'avg'), 6) AS brightness, round(list_aggregate(tile, 'stddev_pop'), 6) AS contrast FROM tile")
def tile_contrast(spark, d):
    return b.tile_frames(spark, d).select("vec_id", _r(tiles.mean(F.col("tile")), "brightness"), _r(tiles.contrast(F.col("tile")), "contrast"))


@query(f"WITH {b.TILES} SELECT vec_id, array_to_string(list_transform(list_filter(range(64), lambda i: i % 8 < 7), lambda i: CASE WHEN tile[i + 2] > tile[i + 1] THEN '1' ELSE '0' END), '') AS bits FROM tile")
def tile_dhash(spark, d):
    return b.tile_frames(spark, d).select("vec_id", tiles.difference_bits(F.col("tile"), 8).alias("bits"))


@query(f"""WITH {b.TILES} SELECT vec_id, round(list_aggregate(tile, 'quantile_cont', 0.1), 6) AS p10, round(list_aggregate(tile, 'quantile_cont', 0.5), 6) AS p50, round(list_aggregate(tile, 'quantile_cont', 0.9), 6) AS p90,
len(list_filter(tile, lambda x: x > 0.2)) / 64 AS near_white, len(list_filter(tile, lambda x: x < -0.2)) / 64 AS near_black FROM tile""")
def luma_diagnostics(spark, d):
    t = F.col("tile")
    return b.tile_frames(spark, d).select("vec_id", *(_r(tiles.quantile(t, q / 100), f"p{q}") for q in (10, 50, 90)), tiles.share(t, lambda x: x > 0.2).alias("near_white"), tiles.share(t, lambda x: x < -0.2).alias("near_black"))


@query(f"""WITH {b.TILES}, s AS (SELECT vec_id, len(list_filter(tile[1:8], lambda x: x < 0)) / 8 AS top, len(list_filter(tile[57:64], lambda x: x < 0)) / 8 AS bottom FROM tile) SELECT *, top >= 0.75 AS solid_top FROM s""")
def edge_facts(spark, d):
    def edge(a: int) -> F.Column:
        return tiles.share(F.slice("tile", a, 8), lambda x: x < 0)

    return b.tile_frames(spark, d).select("vec_id", edge(1).alias("top"), edge(57).alias("bottom")).withColumn("solid_top", F.col("top") >= 0.75)


@query(f"WITH {b.TILES}, x AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: abs(a.tile[i] - z.tile[i])) AS v FROM tile a JOIN tile z ON z.vec_id = a.vec_id + 1) SELECT vec_id, round(list_aggregate(v, 'avg'), 6) AS difference, list_aggregate(v, 'avg') <= 0.15 AND list_aggregate(v, 'quantile_cont', 0.95) <= 0.4 AS same FROM x")
def pixel_equivalence(spark, d):
    t = b.tile_frames(spark, d).select("vec_id", "tile")
    z = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("tile").alias("z"))
    v = t.join(z, "vec_id").select("vec_id", F.zip_with("tile", "z", lambda x, y: F.abs(x - y)).alias("v"))
    return v.select("vec_id", _r(tiles.mean(F.col("v")), "difference"), ((tiles.mean(F.col("v")) <= 0.15) & (tiles.quantile(F.col("v"), 0.95) <= 0.4)).alias("same"))


@query("""SELECT o_orderkey, o_orderpriority || '/' || o_orderkey || '.jpg' AS path, p.path AS paired_raw_path FROM orders LEFT JOIN (SELECT o_orderpriority || '/' || o_orderkey || '.arw' AS path, o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0) p ON p.k = o_orderkey""")
def jpeg_pairing(spark, d):
    o = b.read(spark, d, "orders")
    name = lambda s: F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(s))
    raw, jpeg = o.where("o_orderkey % 3 = 0").select(name(".arw").alias("path")), o.select(name(".jpg").alias("path"))
    out = files.paired_assets(raw, jpeg).where("kind = 'jpeg'")
    return out.select(scalars.stem(F.col("path")).cast("bigint").alias("o_orderkey"), "path", "paired_raw_path")


@query("""SELECT user_id AS folder, min(ts) AS first, max(ts) AS last, count(*) AS frames FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_window_scenes(spark, d):
    from framewise.streaming.scenes import session_scenes

    ev = b.event_frames(spark, d).withColumn("at", F.col("mtime").cast("timestamp"))
    out = session_scenes(ev, folder="folder", time="at", gap="21600 seconds")
    return out.select("folder", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "frames")


CULL = SCENES.replace("WITH ev", "WITH RECURSIVE ev") + """, raw AS (SELECT *, (frame % 17)::DOUBLE AS learned FROM sc WHERE frame % 10 != 9),
p AS (SELECT *, (rank() OVER (ORDER BY value) - 1 + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / (count(*) OVER () - 1) AS a, (rank() OVER (ORDER BY learned) - 1 + (count(*) OVER (PARTITION BY learned) - 1) / 2.0) / (count(*) OVER () - 1) AS b FROM raw),
g AS (SELECT *, round(0.75 * a + 0.25 * b, 9) AS score, value < 20 AND learned < 6 AS gated, (learned < 6)::INT AS weak_votes FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, frame DESC) AS rn FROM g WHERE NOT gated),
w(scene_id, rn, kept, frame, dup) AS (SELECT DISTINCT scene_id, 0::BIGINT, []::DOUBLE[], NULL::BIGINT, NULL::BOOLEAN FROM r UNION ALL
SELECT w.scene_id, r.rn, CASE WHEN len(list_filter(w.kept, lambda k: abs(k - r.value) <= 2)) > 0 THEN w.kept ELSE list_append(w.kept, r.value) END, r.frame, len(list_filter(w.kept, lambda k: abs(k - r.value) <= 2)) > 0 FROM w JOIN r ON r.scene_id = w.scene_id AND r.rn = w.rn + 1),
c AS (SELECT g.*, coalesce(w.dup, false) AS dup FROM g LEFT JOIN w ON g.frame = w.frame), c2 AS (SELECT *, row_number() OVER (PARTITION BY scene_id, gated, dup ORDER BY score DESC, scene_index, frame) AS place FROM c),
c3 AS (SELECT *, NOT gated AND NOT dup AND place <= 3 AS ready FROM c2), c4 AS (SELECT *, bool_or(ready) OVER (PARTITION BY scene_id) AS some_ready, row_number() OVER (PARTITION BY scene_id ORDER BY value DESC, frame DESC) AS best FROM c3),
s AS (SELECT *, CASE WHEN ready THEN 'ready' WHEN NOT some_ready AND best = 1 AND value >= 15 THEN 'rescued' ELSE 'rejected_local' END AS status, (row_number() OVER (PARTITION BY scene_number ORDER BY score DESC, scene_index, frame) - 1) // 6 AS chunk FROM c4),
b AS (SELECT *, CASE WHEN status = 'rejected_local' THEN 'reject' WHEN score >= 0.6 THEN 'pick' ELSE 'review' END AS bucket, printf('scene-cohort-%03d', dense_rank() OVER (ORDER BY scene_number, chunk)) AS cohort_id FROM s)
SELECT frame, scene_id, scene_index, cohort_id, round(score, 6) AS score, weak_votes, dup AS duplicate, status, bucket, CASE bucket WHEN 'reject' THEN -1 WHEN 'review' THEN 0 ELSE 4 END AS rating, CASE bucket WHEN 'reject' THEN 'Yellow' WHEN 'pick' THEN 'Green' END AS color FROM b
UNION ALL SELECT j.frame, j.scene_id, j.scene_index, NULL, NULL, NULL, NULL, CASE WHEN b.frame IS NULL THEN 'unpaired' ELSE 'mirrored' END, b.bucket, CASE b.bucket WHEN 'reject' THEN -1 WHEN 'review' THEN 0 WHEN 'pick' THEN 4 END, CASE b.bucket WHEN 'reject' THEN 'Yellow' WHEN 'pick' THEN 'Green' END
FROM sc j LEFT JOIN b ON b.frame = j.frame - 1 WHERE j.frame % 10 = 9"""


@query(CULL)
def pipeline_cull(spark, d):
    """Frames to decisions, one row a frame: scenes, gate, percentile blend, greedy de-duplication, cap, rescue, cohorts,
    and the decisions of originals mirrored to the copies beside them (every tenth frame). Scenes, scores and duplicates
    are each read by several later steps, so they are written once."""
    sc = settled(_scenes(spark, d))
    raw = sc.where("frame % 10 != 9").withColumn("learned", (F.col("frame") % 17).cast("double"))
    weak, votes, rejected = ranking.gate([F.col("value") < 20], [F.col("learned") < 6], 1)
    scored = ranking.blend(raw.withColumns({"weak_votes": votes, "gated": rejected}), "value", "learned", 0.25, "score").withColumn("score", F.round("score", 9))
    scored = settled(scored)
    folded = suppression.suppress_near(scored.where("not gated"), group="scene_id", name="frame", order=[F.col("score")], fields=["value"], near=lambda r, k: F.abs(r["value"] - k["value"]) <= 2, keys=lambda f: suppression.step_keys(f["value"], 2))
    told = settled(scored.join(folded.select("frame", "anchor"), "frame", "left").withColumn("duplicate", F.col("anchor").isNotNull()))
    capped = scenes.top_per_scene(told.where("not gated and not duplicate"), 3, scene="scene_id", order=[F.desc("score"), "scene_index", "frame"]).select("frame", F.lit(True).alias("ready"))
    told = told.join(capped, "frame", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    saved = scenes.rescue(told, scene="scene_id", ready="ready", order=[F.desc("value"), F.desc("frame")], floors={"value": 20.0}).select("frame", F.lit(True).alias("saved"))
    told = told.join(saved, "frame", "left")
    status = F.when(F.col("ready"), "ready").when(F.col("saved"), "rescued").otherwise("rejected_local")
    bucket = F.when(F.col("status") == "rejected_local", "reject").when(F.col("score") >= 0.6, "pick").otherwise("review")
    rating, label = ranking.normalised_decision(F.col("bucket"), F.lit(0), F.lit(None).cast("string"))
    out = told.withColumn("status", status).withColumn("bucket", bucket).withColumns({"rating": rating, "color": label})
    out = scenes.cohorts(out, 6, scene="scene_number", order=[F.desc("score"), "scene_index", "frame"])
    columns = ["frame", "scene_id", "scene_index", "cohort_id", "score", "weak_votes", "duplicate", "status", "bucket", "rating", "color"]
    copies = sc.where("frame % 10 = 9").select("frame", "scene_id", "scene_index", (F.col("frame") - 1).alias("partner"))
    both = out.select(*columns).unionByName(copies, allowMissingColumns=True)
    both = logs.mirror_pairs(both, key="frame", partner="partner", columns=["bucket", "rating", "color"])
    mirrored = F.when(F.col("partner").isNull(), F.col("status")).when(F.col("bucket").isNull(), "unpaired").otherwise("mirrored")
    return both.withColumn("status", mirrored).withColumn("score", F.round("score", 6)).select(*columns)


from framewise.plans import decisions as _decisions  # noqa: E402, F401  its queries register themselves
from framewise.plans import stored as _stored  # noqa: E402, F401
