import hashlib
import random
import re

import numpy as np

from framewise.llm import substring_dedup
from framewise.llm.fm_index import FMIndex, WaveletMatrix
from framewise.llm.substring_dedup import repeated_words


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1 if k is not None else 0):
            s = tuple(w[i : i + window])
            least[s] = min(k, least.get(s, k))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1 if k is not None else 0) if least[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **options):
    return sorted(map(tuple, repeated_words(docs, **options).drop("spans").collect()), key=str)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2), (64, 3), (1000, 200), (4097, 1000)):
        x = rng.integers(0, top, n)
        w = WaveletMatrix(x, max(1, int(top - 1).bit_length()))
        c, at = rng.integers(0, top, 300), rng.integers(0, n + 1, 300)
        assert w.rank(c, at).tolist() == [int((x[:i] == s).sum()) for s, i in zip(c, at, strict=True)]


def test_backward_search_counts_and_ids():
    rng = random.Random(2)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(5, 30))] for _ in range(80)]
    ids = np.array([rng.randint(-5, 50) for _ in strings])
    index = FMIndex(np.array(sum(strings, [])), np.array([len(s) for s in strings]), ids, 7)
    query = np.array([rng.randint(1, 3) for _ in range(400)])
    ends = np.arange(6, 400)
    matched, low, high = index.search(query, ends, 7)
    places = {}
    for i, s in zip(ids.tolist(), strings, strict=True):
        for n in range(1, 8):
            for j in range(len(s) - n + 1):
                places.setdefault(tuple(s[j : j + n]), []).append(i)
    for e, m, a, b in zip(ends, matched, low, high, strict=True):
        want = max(n for n in range(8) if n == 0 or tuple(query[e - n + 1 : e + 1].tolist()) in places)
        assert m == want and b - a == len(places[tuple(query[e - m + 1 : e + 1].tolist())])
    full = matched == 7
    assert full.any() and index.least_ids(low[full], high[full]).tolist() == [min(places[tuple(query[e - 6 : e + 1].tolist())]) for e in ends[full]]


def documents(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ü", "…", "a.b,"]
    make = lambda k: rng.choices(vocabulary, k=k)
    passages = [make(rng.randint(10, 80)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = make(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        if rng.random() < 0.2 and rows:
            w = re.findall(r"\S+", rng.choice(rows)[1] or "")
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edited"
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, None), (5, rows[3][1]), (5, rows[3][1]), (9000, None), (9001, ""), (9002, " \n"), (9003, "x " * 40_000), (9004, "x " * 13), (9005, "y x " * 30), (-7, "x " * 12)]
    return rows


def test_against_brute_force(spark):
    rows = documents(1)
    docs = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, k int, chunk string")
    assert run(docs) == brute(rows)
    assert run(docs, window=4) == brute(rows, 4)
    assert run(docs.where("false")) == []


def test_hot_anchors_and_small_blocks(spark, monkeypatch):
    rows = documents(2, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(substring_dedup, "HOT", 3)  # read on the driver, sent with the tasks
    assert run(docs) == brute(rows)


def test_blocks_carry_a_key_that_goes_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "BLOCK", 5)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    drawn = [(rng.choice([1, 1, 1, 2]), rng.randint(1, 30)) for _ in range(60)]  # equal windows have equal keys
    rows = sorted((k, i, " ".join(rng.choices(words[2 * k - 2 : 2 * k], k=rng.randint(3, 5))).encode()) for k, i in drawn)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), pa.array([0] * len(rows)), pa.array(range(len(rows)), pa.int32())], ["k", "id", "top", "ctx", "chunk", "ref"])
    got = {}
    for out in substring_dedup._searcher(3)(iter([batch])):
        for r in out.to_pylist():
            got |= {(r["ref"], r["a"] + i): r["least"] for i in range(r["n"])}
    for ref, (k, own, ctx) in enumerate(rows):
        w = ctx.split()
        for a in range(len(w) - 2):
            least = min(i for q, i, c in rows if q == k and any(c.split()[j : j + 3] == w[a : a + 3] for j in range(len(c.split()) - 2)))
            assert got.get((ref, a), own) == least, (ref, a)
