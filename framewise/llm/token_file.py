"""Token ids as directly addressable codes: any id can be read without decoding a block (operator 10)."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm import files
from framewise.llm.common import SPACE, Scratch, slices, text_buffer

MAGIC = b"DACODES1"
#: Bits a chunk, bits a rank directory entry covers, ids a file (a document is never split).
CHUNK, RANK, FILE_IDS = 8, 512, 1_000_000
#: Pieces of text whose ids a worker remembers, in each of two generations, and code points of the longest of them.
CACHE, SHORT = 150_000, 64
#: Files that one task reads.
FILES = 8
#: Bytes of text that are encoded at a time: equal pieces among them are encoded once.
SLICE = 4 << 20


def encode(ids: np.ndarray, starts: np.ndarray, names: list[int | None]) -> bytes:
    """File bytes: header, chunk levels with continuation bitmaps and rank directories, document directory.

    Level k holds the k-th lowest 8-bit chunk of every id that has one. Bit i of its bitmap tells whether entry i goes
    on in the next level, at the place that the count of set bits before i gives.
    """
    body, levels, left = [], [], ids.astype(np.uint32)
    while len(left):
        more = left >> np.uint32(CHUNK)
        go = more > 0
        bits = np.packbits(go, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(go.astype(np.int64), np.arange(0, len(go), RANK)))]).astype("<u8")
        parts = [(left & np.uint32((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        levels.append({"n": len(left), "bytes": [len(p) for p in parts]})
        body += parts
        left = more[go]
    docs = starts.astype("<u8").tobytes()
    head = json.dumps({"n": len(ids), "levels": levels, "docs": len(names), "names": names}).encode()
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(body) + docs


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<Q", data, 8)
        head = json.loads(data[16 : 16 + size])
        self.n, self.names, at = head["n"], head["names"], 16 + size
        self.levels = []
        for level in head["levels"]:
            a, b, c = level["bytes"]
            chunks = np.frombuffer(data, np.uint8, a, at)
            bits = np.frombuffer(data, np.uint8, b, at + a)
            ranks = np.frombuffer(data, "<u8", c // 8, at + a + b)
            self.levels.append((chunks, bits, ranks))
            at += a + b + c
        self.starts = np.frombuffer(data, "<u8", head["docs"] + 1, at).astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i: one directory entry and at most RANK bits."""
        _, bits, ranks = self.levels[level]
        begin = i // RANK * RANK
        return int(ranks[i // RANK]) + int(np.unpackbits(bits[begin // 8 : -(-i // 8)], bitorder="little")[: i - begin].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return out

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive); only their own entries are read on each level."""
        out, where = np.zeros(b - a, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            if b <= a:
                break
            more = chunks[a:b].astype(np.uint32) << np.uint32(CHUNK * k)
            if where is None:
                out |= more
            else:
                out[where] |= more
            go = np.flatnonzero(np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a])
            where, a = go if where is None else where[go], self._rank(k, a)
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.starts[k], self.starts[k + 1])


#: Byte classes: white, ASCII letter, ASCII digit, other printable ASCII but the apostrophe (which may begin a word).
WHITE, LETTER, DIGIT, SIGN = 1, 2, 3, 4
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = SIGN
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[39] = 0
CLASS[np.flatnonzero(SPACE)] = WHITE


def _cuts(buf: np.ndarray) -> np.ndarray:
    """Places (a byte of each true) before which the byte-level pre-tokenizer cuts whatever else stands around.

    No match of its pattern goes on from a character that is not white to a white one, nor from one class (letter, digit,
    sign) to another, but for white before a word and the apostrophe. Characters of more than one byte have a class only
    where the first byte tells it: others are cut less, never wrongly.
    """
    kind = CLASS[buf]
    if len(buf) and buf.max() >= 128:
        # two bytes: U+0100 to U+024F are letters, and so are U+00C0 to U+00FF but for two signs; any class suffices before white
        kind[1:][(buf[:-1] >= 0xC4) & (buf[:-1] <= 0xC8)] = LETTER
        kind[1:][(buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)] = LETTER
        ends = np.zeros(len(buf), bool)
        ends[1:] = (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)
        ends[2:] |= (buf[:-2] == 0xE0) | ((buf[:-2] >= 0xE4) & (buf[:-2] <= 0xEF))
        ends[3:] |= buf[:-3] >= 0xF0
    else:
        ends = np.zeros(len(buf), bool)
    out = np.zeros(len(buf), bool)
    before, after = kind[:-1], kind[1:]
    out[1:] = (after == WHITE) & ((before > WHITE) | (buf[:-1] == 39) | ends[:-1])
    out[1:] |= (before > WHITE) & (after > WHITE) & (before != after) & (buf[1:] < 128)
    return out


class Encoder:
    """Ids of whole texts. They are cut where the byte-level pre-tokenizer surely cuts, equal pieces of a batch are found
    by Arrow's dictionary encoding, and each is encoded once and remembered. A file with another pre-tokenizer, or texts
    with an added token, are encoded whole.

    Memory holds two generations of at most CACHE short pieces: what is used moves to the young one, the old one goes.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.young, self.old = {}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from memory where it has them."""
        if len(self.young) + len(pieces) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [young.get(p) for p in pieces]
        missing = []
        for k, x in enumerate(out):
            if x is None:
                if (x := old.get(pieces[k])) is None:
                    missing.append(k)
                else:
                    out[k] = young[pieces[k]] = x
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            for k, x in zip(some, self._encode([pieces[k] for k in some]), strict=True):
                out[k] = x
                if len(pieces[k]) <= SHORT:
                    young[pieces[k]] = x
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string array (null: empty), one after the other, and the offsets of each text."""
        whole = not self.cut or any(pc.any(pc.match_substring(texts, a)).as_py() for a in self.added)
        buf, off = text_buffer(texts)
        if whole:
            first = off[:-1][np.diff(off) > 0]
        else:
            cut = _cuts(buf)
            cut[off[:-1][np.diff(off) > 0]] = True
            first = np.flatnonzero(cut)
        at = np.append(first, len(buf)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(buf)).dictionary_encode()
        ids = self._ids(found.dictionary.to_pylist()) if len(first) else []
        which = found.indices.to_numpy()
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        begin, n = np.cumsum(size) - size, size[which]
        ends = np.cumsum(n)
        out = flat[np.repeat(begin[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.append(0, ends)[np.searchsorted(first, off)]


#: A worker keeps its encoder from one task to the next.
_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def _writer(folder: str, tokenizer: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), uuid.uuid4().hex
        ids_of, made, names, held, sizes, n = encoder(tokenizer), [], [], [], [], 0

        def flush() -> None:
            nonlocal names, held, sizes, n
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            uri = f"{folder}/{part:06d}-{len(made):06d}-{run}.dac"
            files.write(uri, encode(np.concatenate(held), starts, names))
            made.append((part, len(made), uri, n, len(names)))
            names, held, sizes, n = [], [], [], 0

        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(text_buffer(texts)[1], SLICE):
                ids, at = ids_of(texts.slice(i, j - i))
                names += batch.column("id").slice(i, j - i).to_pylist()
                held.append(np.insert(ids, at[1:], end).astype("<u4"))
                sizes.append(np.diff(at) + 1)
                n += len(held[-1])
                if n >= FILE_IDS:
                    flush()
        if names:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "uri", "ids", "docs"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending id order; returns (uri, start, ids, docs): the files, and the ids in all files
    before each.

    Every task writes files under names of its own and names them in a committed table, so files of lost or repeated
    tasks are never read. That table holds one row a file (about a million ids) and stays a table; starts are sums within
    a task's files and over the tasks before. Nulls count as empty texts, null ids come first, rows of one id are ordered
    by text, equal rows follow each other. The end id follows each document. A text is never split, however long. Empty
    table: no files. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "token-file")
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = base.repartitionByRange("id").sortWithinPartitions("id", "text")
    made = scratch.table(ordered.mapInArrow(_writer(scratch.folder(), tokenizer, end), "part int, seq int, uri string, ids bigint, docs bigint"))
    ahead = F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")
    tasks = made.groupBy("part").agg(F.sum("ids").alias("all"))  # a row a task
    tasks = tasks.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("begin"))
    return made.withColumn("ahead", ahead).join(tasks, "part").select("uri", (F.col("begin") + F.col("ahead")).alias("start"), "ids", "docs")


def read_documents(written: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the files of `write_tokens`; a task reads about
    FILES files, one at a time. No files: no rows."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f = TokenFile(files.read(uri))
                ids = f.ids(0, f.n).astype("<u4")
                s = f.starts
                crcs = [zlib.crc32(ids[s[i] : s[i + 1]].tobytes()) for i in range(len(f.names))]
                yield pa.RecordBatch.from_arrays([pa.array(f.names, pa.int64()), pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(crcs, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return written.select("uri", "start").repartition(max(1, -(-written.count() // FILES))).mapInArrow(load, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
