import re

from framewise.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    got = mixing.targets([100, 1, 0], [1, 2, 3])
    assert got == [98, 3, 0]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    got = queries.op7_mixing(spark, SF).collect()
    assert {r.doc_id: r.size for r in got} == size
    by = {}
    source = {r.doc_id: r.source for r in docs}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    total = sum(size.values())
    assert abs(sum(rows[0].target for rows in by.values()) - total) < 1e-6 * total
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.02 * rows[0].target
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_mixing(spark, SF).collect()))


def test_blocks_land_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    rows = [(i, "w " * (1 + i % 37), "a" if i % 3 else None) for i in range(1500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for name in ("a", None):
        part = [r for r in got if r.source == name]
        assert len(part) == sum((s == name) for _, _, s in rows)
        assert abs(sum(r.taken for r in part) - part[0].target) < 40
        share = part[0].target / part[0].source_size
        assert abs(sum(r.repeats for r in part) - share * len(part)) < 3


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "", "a", 1), (1, "one two", "a", 1), (1, "one two", "a", 1), (2, "x " * 50000, "", 1), (3, "y", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert {r.target for r in mixing.mix_sources(docs.where("text is null")).collect()} == {0.0}


def test_plan_of_many_sources_against_plain_targets(spark):
    import random

    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abé𝄞Z", k=rng.randint(1, 6))) for _ in range(300)}, key=lambda s: s.encode())
    sizes = [rng.choice([0, 1, 5, 40, 1000, 30000]) for _ in range(len(names) + 1)]
    rows = [(i, "w " * (z if z < 100 else z // 10), n) for i, (n, z) in enumerate(zip([*names, None], sizes, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = [len((t or "").split()) for _, t, _ in rows]
    want = mixing.targets(words, [1 + i % 3 for i in range(len(rows))])
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert all(abs(got[i].target - w) <= 1e-9 * max(1, w) for i, w in enumerate(want))


def test_flight_keeps_both_balances():
    import random

    units = sorted(((float(random.Random(i).randint(1, 500)), 0.37) for i in range(400)), reverse=True)
    p, left = mixing.flight(units, random.Random(1))
    assert len(left) <= 2 and all(v in (0.0, 1.0) for i, v in enumerate(p) if i not in left)
    assert abs(sum(p) - 0.37 * 400) < 1e-6 and abs(sum(v * u[0] for v, u in zip(p, units, strict=True)) - 0.37 * sum(u[0] for u in units)) < 1e-3
