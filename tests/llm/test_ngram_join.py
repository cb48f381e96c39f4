import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewise.llm import graph
from framewise.llm.common import Scratch
from framewise.llm.ngram_join import choose_bands, jaccard_join, representatives

SF = "/root/testdata/sf0.01"


def brute(rows):
    sets = []
    for _, text in rows:
        words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    owners = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            owners.setdefault(x, []).append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s or {()} for j in owners[x] if j > i}:
            t = sets[j]
            if s == t or len(s & t) >= 0.8 * len(s | t):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, least[find(i)], links[i]) for i, (k, _) in enumerate(rows))


def test_bands():
    bands, rows = choose_bands(0.8, 0.99999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= 256


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, jaccard_join(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(n for _, _, n in got)


def test_large_group_of_near_copies_and_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"]), "a") for i in range(400)] + [(1000 + i, " ".join(base), "b") for i in range(50)]
    rows += [(2000, None, "c"), (2001, "", "c"), (2002, "  \n", None), (2003, "One two", "c"), (2004, "one  TWO", "c"), (2005, "one", "c"), (2006, "y " * 30000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(map(tuple, jaccard_join(docs).collect()))
    assert got == brute([r[:2] for r in rows])
    assert {r.doc_id for r in representatives(docs).collect()} == {k for k, c, _ in got if k == c}
    assert jaccard_join(docs.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "q r s"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join(docs).collect()), key=str)
    assert got == sorted([(None, 1, 1), (1, 1, 1), (1, 1, 0), (None, None, 0), (None, None, 0)], key=str)


def test_many_rows_without_an_id(spark):
    rows = [(None, " ".join([f"w{i // 2}x{j}" for j in range(40)] + [f"end{i}"])) for i in range(6000)] + [(None, "a b c d e f g h")] * 3000 + [(7, "a b c d e f g h i")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.monotonic()
    got = Counter(map(tuple, jaccard_join(docs).collect()))
    assert got == {(None, None, 1): 6000, (None, 7, 3001): 3000, (7, 7, 3001): 2}
    assert time.monotonic() - start < 120  # every text would meet every member if ids alone joined them


def test_representatives_of_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e f", 0), (1, "q r s", 0), (1, "Q r s", 1), (2, "q r  s", 0), (None, "z", 0), (None, "y", 0), (None, "Y", 2), (None, None, 0), (None, " ", 0), (3, "m n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    want = [(1, "a b c d e f", 0), (1, "Q r s", 1), (None, "z", 0), (None, "Y", 2), (None, None, 0), (3, "m n", 0)]
    assert sorted(map(tuple, representatives(docs).collect()), key=str) == sorted(want, key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500)]
    got = graph.components(Scratch(spark, "test"), spark.createDataFrame(chain, "u long, v long"))
    assert {r.node: r.comp for r in got.collect()} == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}, 500: 500, 501: 500}
    assert got.groupBy("node").count().where(F.col("count") > 1).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_other_thresholds_run(spark, threshold):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")], "doc_id long, text string")
    assert {r.class_id for r in jaccard_join(docs, threshold=threshold).collect()} == ({1} if threshold == 0.5 else {1, 2})


def test_buckets_are_stars_after_one_shuffle(spark, tmp_path):
    """Keys met their buckets in a second shuffle, as large as the first; hot buckets are cut, and stay connected."""
    from framewise.llm import ngram_join
    from framewise.llm.common import Scratch

    rows = [(i, [7, i // 2, i]) for i in range(5000)]  # all share the first band, neighbours the second
    nodes = spark.createDataFrame(rows, "num long, bands array<bigint>")
    stars = ngram_join._stars(Scratch(spark, "stars"), nodes)
    edges = [tuple(r) for r in stars.collect()]
    assert all(v < u for u, v in edges) and {u for u, _ in edges} == set(range(1, 5000))
    heads = {v for _, v in edges}
    up = {u: min(b for a, b in edges if a == u) for u in {u for u, _ in edges if u in heads}}
    assert up and all(any(b == 0 for a, b in edges if a == h) for h in heads - {0} if h >= 0 and (h, 0) in edges)
    sizes = {}
    for u, v in edges:
        sizes[v] = sizes.get(v, 0) + 1
    assert max(sizes.values()) < 1000  # no head holds the hot bucket


def test_a_sieve_loses_no_key(spark):
    from framewise.llm.common import sieve

    rows, keys = spark.range(-3000, 3000).selectExpr("xxhash64(id) as key", "id"), spark.range(0, 500).selectExpr("xxhash64(id) as key")
    got = {r.id: r._hit for r in sieve(rows, keys, "key").collect()}
    assert len(got) == 6000 and all(got[i] for i in range(500)) and sum(got.values()) < 520
    assert not any(r._hit for r in sieve(rows, keys.where("false"), "key").collect())


def test_rows_alone_in_their_class_are_kept_as_they_are(spark):
    rows = [(i, f"alone {i} word{i} more{i} text{i} end{i}", None) for i in range(200)] + [(900, "same text here for all of them", "x"), (900, "same text here for all of them", "x"), (901, "Same text here for all of them", "y"), (None, "null id text of its own here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, representatives(df).collect()), key=str)
    assert got == sorted([r for r in dict.fromkeys(rows) if r[0] != 901], key=str)
