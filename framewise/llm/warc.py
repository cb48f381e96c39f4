"""WARC archives: a writer of one gzip member a record, and a sequential reader (operator 9)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm import files
from framewise.llm.common import Scratch, attach

#: Compressed bytes after which a task begins another archive; bytes a reader takes at a time.
ARCHIVE, PIECE = 32 << 20, 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One record as one gzip member. A revisit has the HTTP header only; its payload digest is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
        if head["WARC-Target-URI"] != url:  # not a URI as it stands
            head["X-URL"] = quote(url, safe="")
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(first)}
        if first is not None:
            head["X-Refers-To-Page-ID"] = str(first)
    head |= {"WARC-Payload-Digest": f"sha1:{sha1(payload)}", "WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


class _Member:
    """The bytes of one gzip member, inflated piece by piece."""

    def __init__(self, stream, left: bytes):
        self.stream, self.z, self.raw, self.out = stream, zlib.decompressobj(31), left, b""

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.raw or self.stream.read(PIECE)
        self.raw = b""
        if not data:
            raise ValueError("archive ends within a record")
        self.out += self.z.decompress(data, 4 * PIECE)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.out:
            if not self._more():
                raise ValueError("record without a header")
        head, _, self.out = self.out.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise ValueError("record is shorter than its Content-Length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            if part:
                yield part

    def end(self) -> bytes:
        while self._more():
            pass
        if self.out != b"\r\n\r\n":
            raise ValueError("record is longer than its Content-Length")
        return self.raw


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, in order. Raises ValueError on bad framing or a wrong digest; digests
    are optional, and those of other kinds than SHA-1 are not checked.

    At most one record's block is held at a time, and one piece of the compressed stream.
    """
    left = stream.read(PIECE)
    while left:
        member = _Member(stream, left)
        lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = b"".join(member.take(int(head["Content-Length"])))
        left = member.end() or stream.read(PIECE)
        payload = block.partition(b"\r\n\r\n")[2] if head.get("WARC-Type") == "response" else None
        for name, data in (("Block", block), ("Payload", payload)):
            kind, _, digest = head.get(f"WARC-{name}-Digest", "").partition(":")
            if data is not None and kind == "sha1" and digest.upper() != sha1(data):
                raise ValueError(f"{name.lower()} digest differs")
        yield head, block


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, made, held, size = TaskContext.get().partitionId(), uuid.uuid4().hex, [], [], 0

        def flush() -> None:
            nonlocal held, size
            made.append(f"{folder}/{part:06d}-{len(made):06d}-{run}.warc.gz")
            files.write(made[-1], b"".join(held))
            held, size = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    held.append(record(page, url, (html or "").encode(), first, revisit, date))
                    size += len(held[-1])
                    if size >= ARCHIVE:
                        flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["uri"])

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row; returns the committed table of archives (uri).

    Of rows with equal payloads (html in UTF-8, a null is empty) of at least `least` bytes, those with the least id are
    responses (null ids only if there is no other), all others revisit them. Groups are found by a pre-aggregated
    groupBy on SHA-256 and attached skew-safely, so a payload that a third of all pages share does not land in one task.
    Archives of lost or repeated tasks are not in the table and so are never read. Null ids and urls are left out of the
    record. Empty table: archives without records.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("d"))
    groups = base.where(F.octet_length("html") >= least).groupBy("d").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = attach(base, scratch.table(groups), ["d"], "n", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    out = told.select("page", "url", "html", "first", revisit.alias("revisit"))
    return scratch.table(out.mapInArrow(_writer(scratch.folder(), date), "uri string"))


def read_archives(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the archives.

    payload is null for revisits, whose bytes and digest are those of the full payload; url is as it was given. Records of
    other types are passed over. Archives are dealt out by uri. No archives, or none with records: no rows.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            names = (id_col, "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.open_stream(uri) as stream:
                    for head, block in read_records(stream):
                        if head.get("WARC-Type") not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = head["WARC-Type"] == "response"
                        length = len(payload) if response else next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"), None)
                        digest = sha1(payload) if response else head.get("WARC-Payload-Digest", "").rpartition(":")[2] or None
                        url = unquote(head["X-URL"]) if "X-URL" in head else head.get("WARC-Target-URI")
                        page, first = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), url, head["WARC-Type"], length, digest, first and int(first), payload if response else None))
                        size += len(block)
                        if size > 4 << 20:
                            yield told(rows)
                            rows, size = [], 0
                if rows:
                    yield told(rows)

    return archives.repartition(max(1, archives.count()), "uri").mapInArrow(load, f"`{id_col}` bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")
