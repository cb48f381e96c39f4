import hashlib

import numpy as np

from framewise.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, length=50):
    first, out = {}, []
    for k, text in rows:
        raw = (text or "").encode()
        if k is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                first[s] = min(k, first.get(s, k))
    for k, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if k is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < k:
                    gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if raw else 0
        out.append((k, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_difference_cover():
    assert {(a - b) % suffix_dedup.MODULUS for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.MODULUS))


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, queries.op6_suffix_dedup(spark, SF).collect()), key=str) == want
    assert sum(r[2] for r in want) > 100_000


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 7)
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    rng = np.random.default_rng(2)
    noise = lambda n: "".join(rng.choice(list("abcdeé "), n))
    passage, line = noise(130), noise(50)
    rows = [(i, noise(40) + (passage if i % 2 else line) + noise(30), "x") for i in range(60)]
    rows += [(100, "a" * 400, "x"), (101, "b" + "a" * 300 + "c", "x"), (102, "ab" * 200, "x"), (103, "zab" + "ab" * 100, "x"), (None, passage, "x"), (104, None, "x"), (105, "", "x"), (106, line, "x"), (106, line + "!", "x"), (106, passage, "x"), (106, passage, "x")]
    rows += [(200 + i, passage[::-1], "x") for i in range(40)] + [(300, passage[::-1] + line, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = suffix_dedup.repeated_spans(docs).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in rows])
    assert suffix_dedup.repeated_spans(docs.where("false")).count() == 0


def test_anchors_of_segments(monkeypatch):
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 100, 2000).astype(np.uint8)
    buf[500:800] = 97
    ok = np.ones(2000, bool)
    ok[400:450] = False

    def strings(found):
        return {s: (int(p), int(h)) for p, h, a, b in zip(*found, strict=True) for s in range(a, b + 1)}

    h = suffix_dedup._gram_hashes(buf)
    grams = [buf[i : i + suffix_dedup.ANCHOR].tobytes() for i in range(len(h))]
    assert len({*zip(grams, h.tolist(), strict=True)}) == len({*grams}) == len({*h.tolist()})
    want = {s: (p := s + int((h[s : s + 33] >> np.uint64(16)).argmin()), int(h[p])) for s in np.flatnonzero(ok[:1951]).tolist()}
    assert strings(suffix_dedup.anchors(buf, 50, ok)) == want
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    assert strings(suffix_dedup.anchors(buf, 50, ok)) == want
