import random
from collections import Counter

from framewise.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def shingled(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def likeness(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items):
    """Best weighted Jaccard of every passage within two words of an item's length, at every place that shares a shingle."""
    out, index, sets = {}, {}, {k: shingled(v) for k, v in items.items()}
    for k, s in sets.items():
        for x in s:
            index.setdefault(x, set()).add(k)
    for d, w in docs.items():
        for k in {k for i in range(len(w) - 4) for k in index.get(tuple(w[i : i + 5]), ())}:
            n = len(items[k])
            best = max((likeness(shingled(w[i : i + n + e]), sets[k]) for i in range(max(1, len(w) - 4)) for e in (-1, 0, 1) if len(w[i : i + n + e]) >= 5), default=0)
            if best >= 0.8:
                out[d, k] = round(best, 9)
    return out


def split(rows, key):
    return {r[key]: (r["text"] or "").lower().split() for r in rows}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = brute(split(docs, "doc_id"), split(items, "item_id"))
    got = queries.op5_decontaminate(spark, SF).collect()
    assert len(got) == len(docs) and {(r.doc_id, k) for r in got for k in r["items"]} == set(want) and len(want) > 5
    assert all(r.contaminated == bool(r["items"]) for r in got)


def test_edited_passages_of_all_sizes(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([5, 6, 8, 11, 14, 15, 19, 22, 30, 38, 49, 59, 80, 200] * 2)}
    docs, want = {}, set()
    for i, w in items.items():
        for phase in range(4):
            d, p = len(docs), list(w)
            if len(w) >= 49:
                p[rng.randrange(len(p))] = word()
            elif len(w) >= 15:
                p[-1] = word()
            docs[d] = [word() for _ in range(20 + phase)] + p + [word() for _ in range(9)]
            want.add((d, i))
    frame = spark.createDataFrame([(k, " ".join(v).upper(), "x") for k, v in docs.items()], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item) for r in decontaminate.matches(frame, bench).collect()} == want == set(brute(docs, items))


def test_long_items_with_several_edits_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([100, 200, 200, 300, 60, 60, 13, 25])}
    items[8] = [f"of{k % 2} the{k % 3} same{k % 7}" for k in range(70)]
    items[8] = " ".join(items[8]).split()
    docs = {}
    for i, w in items.items():
        n = len(w)
        for phase in range(4):
            new, less, more, turned = list(w), list(w), list(w), w[n // 3 :] + w[: n // 3]
            for at in (8, n - 9) if n >= 100 else (2,) if n > 50 else (n - 1,):
                new[at] = word()
            for at in [n - 9, n // 2, 8][: max(1, n // 50)]:
                del less[at]
                more.insert(at, word())
            for p in (new, less, more, turned):
                docs[len(docs)] = [word() for _ in range(20 + phase)] + p + [word() for _ in range(9)]
    three = list(items[1])
    for at in (9, 100, 190):
        three[at] = word()
    docs[len(docs)] = ["x"] + three
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item): round(r.similarity, 9) for r in decontaminate.matches(frame, bench).collect()}
    assert got == want and len(want) > 80


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, item, 1), (1, None, 1), (2, "", 1), (3, "one two", 1), (4, f"x {item}", 1), (4, f"x {item}", 1), (5, "a " * 50000 + item, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items long")
    bench = spark.createDataFrame([(1, item), (1, item), (2, "one two"), (3, None), (None, "")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in got) == sorted([("None", True), ("1", False), ("2", False), ("3", False), ("4", True), ("4", True), ("5", True)])
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.where("false")).collect())
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0


def test_items_without_id(spark):
    first, other = ([f"{c}{i}" for i in range(20)] for c in "ab")
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([first, ["x", *other], ["x"] * 9])], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(first)), (None, " ".join(other)), (7, " ".join(other))], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {0: (True, [None]), 1: (True, [7, None]), 2: (False, [])}


def test_edits_near_both_ends_and_inside_by_item_size(spark):
    """Recall against brute force is 1 for every size of item and every place of an edit."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([5, 9, 13, 17, 23, 27, 38, 52, 59, 80, 120, 200, 400] * 3)}
    docs = {}
    for w in items.values():
        n = len(w)
        for places in ((6, n - 7), (n // 2,), (6, n // 2, n - 7), (0,), (n - 1,), (0, n - 1)):
            p = list(w)
            for at in places:
                if 0 <= at < n:
                    p[at] = word()
            docs[len(docs)] = [word() for _ in range(rng.randrange(40))] + p + [word() for _ in range(rng.randrange(9))]
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item) for r in decontaminate.matches(frame, bench).collect()}
    sizes = {len(items[i]) for _, i in want}
    assert got == set(want) and len(sizes) >= 10 and max(sizes) == 400


def test_fingerprints_against_a_plain_simhash(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    hashes = [rng.getrandbits(63) for _ in range(130)]
    sizes = tuple(sorted({*decontaminate.SIZES, *decontaminate.LADDER}))
    rows = spark.createDataFrame([(hashes,)], "s array<long>")
    got = {(r["pos"], r["size"]): r.f for r in decontaminate.windows(rows.select(F.lit(1).alias("k"), "s"), sizes).collect()}
    assert {k for k in got if k[1] > 1} == {(p, s) for s in sizes if s > 1 for p in range(0, 131 - s, 4)}
    for (p, s), f in got.items():
        assert f == sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in hashes[p : p + s]) > s)
