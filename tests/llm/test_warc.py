import base64
import hashlib
import io

import pytest

from framewise.llm import queries, warc

SF = "/root/testdata/sf0.01"


def want(rows):
    first, out = {}, []
    for page, html in rows:
        k = (html or "").encode()
        first[k] = min((page, first[k]) if k in first else (page,), key=lambda p: (p is None, p or 0))
    for page, html in rows:
        k = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(k).digest()).decode()
        out.append((page, len(k), d, "response", None) if first[k] == page else (page, len(k), d, "revisit", first[k]))
    return sorted(out, key=str)


def test_whole_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op9_warc(spark, SF).collect()), key=str) == want(rows)


def test_odd_rows_copies_and_payloads(spark):
    rows = [(i, "http://a/é b\r\n", "same é page", 1) for i in range(900)] + [(1000, None, None, 1), (1001, "", "", 1), (None, "u", "same é page", 1), (5, "u", "same é page", 1), (1002, "u", "x" * 3_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want([(r[0], r[2]) for r in rows])
    assert {r.url for r in got} == {r[1] for r in rows}
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {"same é page", "", "x" * 3_000_000}
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, least=10**9)).collect()} == {"response"}


def test_reader_refuses_damage():
    one = warc.record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z")
    two = warc.record(2, "u", b"payload", 1, True, "2024-01-01T00:00:00Z")
    assert [h["WARC-Type"] for h, _ in warc.read_records(io.BytesIO(one + two))] == ["response", "revisit"]
    import zlib

    raw = zlib.decompress(one, 31)
    for bad in (raw.replace(b"payload", b"paybad!"), raw[:-4], raw + b"x"):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(z.compress(bad) + z.flush())))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(one[:-20])))


def test_reader_takes_records_of_other_writers():
    import zlib

    block = b"HTTP/1.0 200 OK\r\ncontent-type: text/plain\r\n\r\nhi"
    text = b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Target-URI: http://a/\r\nWARC-Block-Digest: md5:x\r\nContent-Length:  %d\r\n\r\n" % len(block)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (head, got), = warc.read_records(io.BytesIO(z.compress(text + block + b"\r\n\r\n") + z.flush()))
    assert head["WARC-Type"] == "response" and got == block


def test_rows_that_share_the_least_id(spark):
    rows = [(1, "a", "same", 1), (1, "b", "same", 2), (2, "c", "same", 3), (None, None, "same", 4), (1, "d", "other", 5)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, uri int"))).collect()
    assert sorted((str(r.page_id), str(r.url), r.record_type, r.refers_to) for r in got) == [("1", "a", "response", None), ("1", "b", "response", None), ("1", "d", "response", None), ("2", "c", "revisit", 1), ("None", "None", "revisit", 1)]


def test_scratch_needs_a_shared_folder_off_local_mode():
    from framewise.operators.lineage import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, other: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    def getCheckpointDir(self):
                        return self

                    isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
