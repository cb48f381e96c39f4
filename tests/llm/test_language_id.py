import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = queries.op1_language_id(spark, SF).join(docs, "doc_id").where("held_out and n_chars > 40")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_reruns_agree_and_odd_rows(spark):
    rows = [(i, w * 30, l, "x") for i, (w, l) in enumerate([("the house ", "en"), ("das Haus ", "de")] * 20)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 !?", None, "x"), (103, "das Haus ist " * 20000, None, "x"), (None, "the house", None, None), (103, "das Haus", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    network = language_id.fit_languages(docs)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, network).where("doc_id is null or doc_id >= 100").collect()}
    assert got == {(100, "und"), (101, "und"), (102, "und"), (103, "de"), (None, "en")}
    again = language_id.fit_languages(docs)
    assert (again.weights == network.weights).all()
    nothing = docs.where("false")
    assert language_id.fit_languages(nothing) is None and language_id.identify(nothing, network).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_rows_and_held_out(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    seen = []
    fit = language_id.fit_languages
    monkeypatch.setattr(language_id, "fit_languages", lambda df, **k: seen.append({r.doc_id for r in df.select("doc_id").collect()}) or fit(df, **k))
    got = queries.op1_language_id(spark, SF).collect()
    held = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert {(r.doc_id, r.held_out) for r in got} == {(r.doc_id, r.doc_id in held) for r in docs} and len(got) == len(docs)
    assert seen == [{r.doc_id for r in docs} - held]


@pytest.mark.parametrize("part", [1 << 20, 512])
def test_network_against_a_plain_loop(monkeypatch, part):
    monkeypatch.setattr(language_id, "PART", part)
    network = language_id.Network(["a", "b", "c"])
    network.fuse()
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (3, 256, 700, 0, 2000)]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    best, score = network.classify(buf, off)
    for k, text in enumerate(texts):
        sums, n = np.zeros(3), max(1, -(-len(text) // language_id.WINDOW))
        for at in range(0, len(text), language_id.WINDOW):
            x = text[at : at + language_id.WINDOW].ljust(language_id.WINDOW + 3, b"\0")
            pooled = [max(sum(taps[j, x[i + j], f] for j in range(w)) for i in range(language_id.WINDOW)) for w, taps in network.taps.items() for f in range(language_id.FILTERS)]
            sums += np.maximum(pooled, 0) @ network.weights + network.bias
        p = np.exp(sums / n - (sums / n).max())
        p /= p.sum()
        assert p.argmax() == best[k] and abs(p.max() - score[k]) < 1e-4


def test_a_repeated_id_does_not_swell_the_fit(spark):
    rows = [(1, "the house of the day", "en")] * 500 + [(2, "das Haus und der Tag", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = []
    fit = language_id.Network.fit
    language_id.Network.fit = lambda self, x, y, **k: asked.append(len(x)) or fit(self, x, y, **k)
    try:
        language_id.fit_languages(docs)
    finally:
        language_id.Network.fit = fit
    assert asked == [4]
