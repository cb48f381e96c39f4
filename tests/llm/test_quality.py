import zlib

import numpy as np

from framewise.llm import quality, queries

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_auc(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op8_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.9
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_statistics():
    texts = [b"One two two.\nOne two two.\n", b"", b"A!! B!!", b" \n"]
    x = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    got = [dict(zip(quality.STATISTICS, r, strict=True)) for r in x]
    assert got[0]["distinct_lines"] == 0.5 and got[0]["distinct_words"] == 0.5 and got[0]["newline"] == 2 / 26
    assert not any(got[1].values()) and got[2]["shouted"] == 1 and got[3]["words"] == 0


def test_trees_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.Trees().fit(x, y)
    assert ((trees.predict(x) > 0.5) == (y > 0.5)).mean() > 0.9
    rows = [(1, "plain words here.", 9), (1, "plain words here.", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (4, "LOUD!! " * 20000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.fit_quality(docs, labels.where("false")) is None
    assert quality.score_quality(docs.where("false"), None).count() == 0


def test_rows_and_held_out(spark, monkeypatch):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    held = {k for k in docs if zlib.crc32(str(k).encode()) % 5 == 0}
    seen, fit = [], quality.fit_quality
    monkeypatch.setattr(quality, "fit_quality", lambda d, labels, **k: seen.append({r.doc_id for r in labels.collect()}) or fit(d, labels, **k))
    got = queries.op8_quality(spark, SF).collect()
    assert len(got) == len(docs) and {(r.doc_id, r.held_out) for r in got} == {(k, k in held) for k in docs}
    assert seen and not seen[0] & held


def test_trees_against_a_walk_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    trees = quality.Trees().fit(x, (x[:, 0] + x[:, 1] ** 2 > 1).astype(float))

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] >= 0:
                at = trees.left[at] + (row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.predict(x), [walk(r) for r in x])


def test_a_repeated_id_does_not_swell_the_fit(spark):
    docs = spark.createDataFrame([(1, "plain words")] * 500 + [(2, "LOUD!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    asked, fit = [], quality.Trees.fit
    quality.Trees.fit = lambda self, x, y, **k: asked.append(len(x)) or fit(self, x, y, **k)
    try:
        quality.fit_quality(docs, labels)
    finally:
        quality.Trees.fit = fit
    assert asked == [2]
