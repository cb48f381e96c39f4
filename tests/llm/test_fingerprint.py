import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from framewise.llm import fingerprint, queries

SF = "/root/testdata/sf0.01"


def plain(text):
    t = unicodedata.normalize("NFKC", text).upper().lower()
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip()


HARD = ["é café", "ẹ́ ẹ́ ẹ́", "ﬁＡ²… x", "한 한 한", "Straße STRASSE", "ΑΣ ας", "à֮̀̕b", "Å Å Å", "\U0001d400\U0001f600", "", "  a\t\nb ", "İI", "ố ố", "Ǆ ̈́"]


def test_canonical_against_the_unicode_database(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    got = {r.t: r.c for r in fingerprint.with_canonical(df, "t", "c").collect()}
    for t in HARD:
        assert got[t] == plain(t), (t, got[t], plain(t))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op3_fingerprint(spark, SF).collect()}
    assert len(got) == len(docs)
    prints = {}
    for i, r in enumerate(docs):
        text, after = r.text or "", docs[(i + 1) % len(docs)].text or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(g.fingerprint, plain(text)) == plain(text)
        assert prints.setdefault(g.edited_fingerprint, plain(edited)) == plain(edited)
        assert g.near_edited == (plain(text) == plain(edited)) and g.near_next == (plain(text) == plain(after))
    assert len(prints) == len(set(prints.values()))


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (2, "One  two", 1), (2, "one TWO", 1), (2, "one TWO", 1), (3, "y " * 50000, 1)] + [(10 + i, "copy", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.copies) for r in got} >= {(2, 3), (1, 2), (10, 300)}
    assert fingerprint.edited_fingerprints(docs).count() == len(rows)
    assert fingerprint.edited_fingerprints(docs.where("false")).count() == 0 and fingerprint.fingerprints(docs.where("false")).count() == 0
    (one,) = fingerprint.edited_fingerprints(docs.where("doc_id = 3")).collect()
    assert one.near_next == 1 and one.n_chars == 100000


def test_bucket_clash(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: (F.lit(1).cast("bigint") + F.length(c), F.lit(2).cast("bigint")))
    docs = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "AB"), (4, "abc")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.copies) for r in fingerprint.fingerprints(docs).collect()}
    assert got[1] == got[3] != got[2] and got[1][1] == 2 and got[2][1] == 1 == got[4][1]
