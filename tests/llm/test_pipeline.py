import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_decontaminate import brute as leaks
from test_decontaminate import split
from test_ngram_join import brute as classes
from tokenizers import Tokenizer

import corpus_pipeline
from framewise.llm import mixing
from framewise.llm.common import Scratch, looked_up

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in at.collect()]
        at = spark.createDataFrame(rows, at.schema) if (rows := stage(spark, at, SF).collect()) and name != "tokens" else stage(spark, at, SF)
        after = [r.asDict() for r in at.collect()]
        seen[name] = (before, after)
        if name != "tokens":
            assert at.columns == docs.columns and {tuple(r.values()) for r in after} <= {tuple(r.values()) for r in before}
    before, after = seen["quality"]
    kept = {r["doc_id"] for r in after}
    assert np.mean([(r["doc_id"] in kept) == labels[r["doc_id"]] for r in before if r["doc_id"] in labels]) > 0.9
    before, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in after} == {k for k, c, _ in classes([(r["doc_id"], r["text"]) for r in before]) if k == c}
    before, after = seen["decontamination"]
    bad = {d for d, _ in leaks(split(before, "doc_id"), split(bench, "item_id"))}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
    before, after = seen["mixing"]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(after) - words(before)) < 0.02 * words(before)
    before, after = seen["tokens"]
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(before, key=lambda r: (r["doc_id"], r["text"])):
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r.values()) for r in after) == sorted(want)
    assert corpus_pipeline.run(spark, SF).count() == len(want)


def test_stages_with_odd_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 500 and 900").limit(12).collect()
    columns = "doc_id long, text string, lang string, source string, n_chars long, _repeats long, id long, n string, d string, t long, _text string, _node binary, key string"
    rest = (1, 7, 2, "x", "y", 3, "z", bytearray(b"q"), "k")
    rows = [(r.doc_id, r.text, r.lang, r.source, *rest) for r in prose]
    rows += [(None, None, None, None, *rest), (None, prose[0].text + " more", "en", None, *rest), (5, "", "en", "a", *rest), (5, "q r s t u v", "en", "a", *rest), (5, "w x y z aa bb", "en", "a", *rest)]
    rows += [(9, f"before {item} behind", "en", "a", *rest), (9, "clean words that no item holds at all", "en", "a", *rest), (9, None, "en", "a", *rest), (8, "long text " * 20000, "en", "b", *rest)]
    docs = spark.createDataFrame([*rows, rows[0]], columns)
    kept = corpus_pipeline.keep_representatives(spark, docs, SF)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert {(5, "q r s t u v"), (5, "w x y z aa bb"), (9, "clean words that no item holds at all")} <= {*texts} and len(texts) == len({*texts})
    assert sum(not (t or "").strip() for _, t in texts) == 1
    left = corpus_pipeline.keep_uncontaminated(spark, docs, SF)
    gone = {str(r) for r in docs.collect()} - {str(r) for r in left.collect()}
    assert len(gone) == 1 and item[:20] in next(iter(gone)) and left.columns == docs.columns
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and {str(r) for r in mixed.collect()} <= {str(r) for r in docs.collect()}
    assert corpus_pipeline.keep_good(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.tokens(spark, docs, SF).count() == len(rows) + 1
    nothing = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name


def test_bits_tell_a_key_its_own_value_or_nothing(spark):
    kept = [(None, 2), *((k, k * 7 % 5 % 4) for k in range(-300, 700)), (1000, 9), (1001, -1), (1002, None)]
    book = spark.createDataFrame(kept, "id long, n int")
    rows = spark.createDataFrame([(k, i) for k, _ in kept for i in range(1 + (k or 0) % 2)], "id long, i int")
    known = dict(kept)
    for slots, least, most in ((64, 0, 0), (1024, 300, 900), (1 << 24, 1001, 1001)):
        asked, left = looked_up(rows, book, "id", "n", 3, slots=slots)
        told = [tuple(r) for r in asked.select("id", "i", "_told").collect()]
        assert len(told) == rows.count() and all(n is None or n == known[k] for k, _, n in told)
        open_ = {k for k, _, n in told if n is None}
        assert sorted((tuple(r) for r in left.collect()), key=str) == sorted(((k, known[k]) for k in open_), key=str)
        assert least <= len(known) - len(open_) <= most and {1000, 1001, 1002} <= open_


def test_the_mix_shuffles_no_texts(spark):
    drawn = np.random.default_rng(5)
    texts = [" ".join(f"{w:x}" for w in drawn.integers(1 << 40, size=1500)) for _ in range(400)]
    rows = [(None if k % 50 == 0 else k // 2 * 2 if k % 9 == 0 else k, t, "en", "abc"[k % 7 % 3], len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = Scratch(spark, "test").table(docs)
    sc, old = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    taken = {r.id: r.n for r in mixing.mix_sources(docs).groupBy("doc_id").agg({"repeats": "max"}).toDF("id", "n").collect()}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table of counts were large
        before = written()
        got = Counter(r.text for r in corpus_pipeline.mix(spark, docs, SF).collect())
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == Counter({t: n for k, t, *_ in rows if (n := taken[k])})
    assert moved < sum(map(len, texts)) / 10
