"""Removal of long repeated byte strings by blockwise suffix sorting with difference-cover samples (operator 6)."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm import files
from framewise.llm.common import Scratch, mix, text_buffer

#: A perfect difference cover modulo 31: every residue is a difference of two members.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of an anchor; contexts that one sort holds at most (a larger group goes on in the next sort).
ANCHOR, BLOCK = 18, 40_000
#: Bytes of text in a chunk file (one text may be larger), and bytes whose anchors are found at a time (their places take 16 bits).
CHUNK, SEGMENT, PLACE = 8 << 20, 60_000, np.uint64(0xFFFF)
#: Odd multipliers of the hash.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Bytes of text whose anchors' hashes meet in one group, and groups at most.
GROUP, GROUPS = 32 << 20, 20_000
#: Contexts of one anchor beyond which its suffix bucket is split by distance (SPLIT to a part) and the bytes around it.
HOT, SPLIT = 8000, 17


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes at every place that has them, from the 8-byte words that cover them."""
    n, out = len(buf) - ANCHOR + 1, None
    for k, at in enumerate((*range(0, ANCHOR - 7, 8), ANCHOR - 8)):
        word = np.ndarray((n,), "<u8", buf.data, at, (1,)) * np.uint64(ODD[k])
        out = word if out is None else np.add(out, word, out=out)
    out ^= out >> np.uint64(29)
    out *= np.uint64(ODD[-1])
    return mix(out)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of w values."""
    have, y = 1, x
    while have < w:
        step = min(have, w - have)
        y = pick(y[: len(y) - step], y[step:])
        have += step
    return y


def anchors(buf: np.ndarray, length: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last): the anchors of the strings of `length` bytes that start where `ok`.

    The anchor of a string is the leftmost of its ANCHOR-byte grams of least hash (48 bits); it depends on the string alone,
    so equal strings have equal anchors at the same distance. first and last bound the (adjacent) starts of the strings
    that have this anchor. Buffers are searched by overlapping segments: an anchor may appear once in each.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for low in range(0, len(buf) - length + 1, SEGMENT):
        part = np.flatnonzero(ok[low : min(low + SEGMENT, len(buf) - length + 1)])
        if not len(part):
            continue
        h = _gram_hashes(buf[low : low + SEGMENT + length - 1])
        placed = h & ~PLACE
        placed |= np.arange(len(h), dtype=np.uint64)
        place = (_sliding(placed, length - ANCHOR + 1, np.minimum)[part] & PLACE).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1] + 1)]))
        last = np.concatenate([cut[1:], [len(place)]]) - 1
        found.append((place[cut] + low, h[place[cut]], part[cut] + low, part[last] + low))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _chunks(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write the rows to files of about CHUNK bytes under names of their own; those that are returned are read."""
        part, run, held, size, made = TaskContext.get().partitionId(), uuid.uuid4().hex, [], 0, []

        def flush() -> None:
            nonlocal held, size
            out = io.BytesIO()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                for b in held:
                    f.write_batch(b)
            files.write(uri := f"{folder}/{part:06d}-{len(made):06d}-{run}", out.getvalue())
            made.append((uri, size))
            held, size = [], 0

        for batch in batches:
            off = text_buffer(batch.column("text"))[1]
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK - size, "right")) - 1)
                held.append(batch.slice(i, j - i))
                size += int(off[j] - off[i])
                i = j
                if size >= CHUNK or i < batch.num_rows:
                    flush()
        if held:
            flush()
        numbers = pa.array([(part << 24) + k for k in range(len(made))], pa.int64())
        yield pa.RecordBatch.from_arrays([numbers, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["chunk", "uri", "bytes"])

    return write


class Chunk:
    """The rows of a chunk file: ids, the bytes of all texts and where each begins, and whether a row is live: it has an id,
    and its text is no whole copy of a smaller id's (as its file of copies says)."""

    def __init__(self, uri: str, copies: bool = True):
        table = pa.ipc.open_stream(files.read(uri)).read_all().combine_chunks()
        ids = table.column("id")
        self.column, self.live = ids.combine_chunks(), ~ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.buf, self.off = text_buffer(table.column("text"))
        self.copy = np.frombuffer(files.read(f"{uri}.copies"), bool) if copies else np.zeros(len(self.ids), bool)
        self.live &= ~self.copy

    def digests(self, length: int, groups: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Rows with an id and a text of `length` bytes or more, the digests of these texts, and each digest's group."""
        rows = np.flatnonzero(self.live & (np.diff(self.off) >= length))
        out = [hashlib.blake2b(self.buf[a:b], digest_size=16).digest() for a, b in zip(self.off[rows].tolist(), self.off[rows + 1].tolist(), strict=True)]
        return rows, out, np.frombuffer(b"".join(out), "<u4")[::4] % groups

    def anchors(self, length: int, groups: int):
        """Anchors of all strings within the texts of live rows: row, place, key, first, last. The key is the anchor's
        group and 32 bits of its hash."""
        n = np.where(self.live, np.maximum(np.diff(self.off) - length + 1, 0), 0)
        ok = np.zeros(len(self.buf) + 1, np.int8)
        ok[self.off[:-1][n > 0]] = 1
        ok[(self.off[:-1] + n)[n > 0]] = -1
        place, h, first, last = anchors(self.buf, length, np.cumsum(ok, dtype=np.int8).view(bool))
        group = (h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        return np.searchsorted(self.off, first, "right") - 1, place, group << np.uint64(32) | h & np.uint64(0xFFFFFFFF), first, last


def _digests(length: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(p, chunk, uri, hashes, ids): for each group the 128-bit digests of a chunk's whole texts, and their ids."""
        for batch in batches:
            for number, uri in zip(batch.column("chunk").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                chunk = Chunk(uri, copies=False)
                rows, digest, group = chunk.digests(length, groups)
                for p in np.unique(group):
                    here = np.flatnonzero(group == p)
                    yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([number], pa.int64()), pa.array([uri]), pa.array([b"".join(digest[i] for i in here)], pa.binary()), pa.array([chunk.ids[rows[here]].astype("<i8").tobytes()], pa.binary())], ["p", "chunk", "uri", "hashes", "ids"])

    return run


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, uri, p, state): for each digest whether a smaller id has the same."""
    for table in _by(batches, "p"):
        hashes, ids = (table.column(c).to_pylist() for c in ("hashes", "ids"))
        _, which = np.unique(np.frombuffer(b"".join(hashes), "V16"), return_inverse=True)
        own = np.frombuffer(b"".join(ids), "<i8")
        least = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, which, own)
        yield _answers(table, (own > least[which]).astype(np.uint8), [len(x) // 8 for x in ids])


def _answers(table: pa.Table, state: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
    at = np.cumsum([0, *sizes])
    return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("chunk", "uri", "p")), pa.array([state[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["chunk", "uri", "p", "state"])


def _hashes(length: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(p, chunk, uri, hashes, rows): for each group the distinct hashes of a chunk in order, and the rows (255 at most)
        that hold each. Which texts are copies is written beside the chunk and these have no part in it."""
        for table in _by(batches, "chunk"):
            number, uri = table.column("chunk")[0].as_py(), table.column("uri")[0].as_py()
            chunk = Chunk(uri, copies=False)
            rows, _, group = chunk.digests(length, groups)
            copy = np.zeros(len(chunk.ids), bool)
            copy[rows[np.argsort(group, kind="stable")]] = np.frombuffer(b"".join(table.column("state").to_pylist()), bool)
            files.write_once(f"{uri}.copies", copy.tobytes())
            chunk.live &= ~copy
            row, _, key, _, _ = chunk.anchors(length, groups)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            fresh = new.copy()
            fresh[1:] |= row[1:] != row[:-1]
            cut = np.flatnonzero(new)
            n = np.minimum(np.add.reduceat(fresh.astype(np.int64), cut) if len(cut) else cut, 255).astype(np.uint8)
            u = key[cut]
            at = np.searchsorted(u, np.arange(groups + 1, dtype=np.uint64) << np.uint64(32))
            some = np.flatnonzero(np.diff(at))
            low = (u & np.uint64(0xFFFFFFFF)).astype("<u4")
            parts = [pa.array([x[at[p] : at[p + 1]].tobytes() for p in some], pa.binary()) for x in (low, n)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([number] * len(some), pa.int64()), pa.array([uri] * len(some), pa.string()), *parts], ["p", "chunk", "uri", "hashes", "rows"])

    return run


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of the leading sort key, as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key)
        at = 0
        while at < batch.num_rows:
            value = keys[at]
            end = at + 1
            while end < batch.num_rows and keys[end] == value:
                end += 1
            if held and held[-1].column(key)[0] != value:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _states(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, uri, p, state): for each hash of a chunk 0 if no other row has it, 2 if more than `hot` rows have it, else 1."""
        for table in _by(batches, "p"):
            hashes = [np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()]
            rows = [np.frombuffer(x, np.uint8) for x in table.column("rows").to_pylist()]
            _, which = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(which, np.concatenate(rows))
            state = ((n > 1).astype(np.uint8) + (n > hot)).astype(np.uint8)[which]
            yield _answers(table, state, [*map(len, hashes)])

    return run


CONTEXTS = "k bigint, id bigint, top bigint, before int, ctx binary, chunk bigint, ref int"


def _contexts(length: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut the bytes of the strings of each shared anchor: from the first start to the last one's end. Equal contexts
        of a chunk are one row (least and greatest id); where they stand is written beside the chunk."""
        for table in _by(batches, "chunk"):
            number, uri = table.column("chunk")[0].as_py(), table.column("uri")[0].as_py()
            chunk = Chunk(uri)
            row, place, key, first, last = chunk.anchors(length, groups)
            state = np.frombuffer(b"".join(table.column("state").to_pylist()), np.uint8)[np.unique(key, return_inverse=True)[1]]
            raw, refs, out, where = chunk.buf.tobytes(), {}, [], []
            for r, at, k, a, b, hot in zip(*(x[state > 0].tolist() for x in (row, place, key, first, last)), (state[state > 0] > 1).tolist(), strict=True):
                if hot:
                    parts = []
                    for g in range((at - b) // SPLIT, (at - a) // SPLIT + 1):
                        core = raw[at - SPLIT * g : at - SPLIT * g + length - SPLIT + 1]  # in every string of these distances
                        sub = hashlib.blake2b(core, digest_size=8, key=b"%d/%d" % (k, g)).digest()
                        parts.append((int.from_bytes(sub, "big", signed=True), max(a, at - SPLIT * g - SPLIT + 1), min(b, at - SPLIT * g)))
                else:
                    parts = [(k, a, b)]
                for sub, x, y in parts:
                    ctx = (at - x, raw[x : y + length])
                    if (ref := refs.get(ctx)) is None:
                        ref = refs[ctx] = len(out)
                        out.append([sub, chunk.ids[r], chunk.ids[r], ref])
                    else:
                        out[ref][1] = min(out[ref][1], chunk.ids[r])
                        out[ref][2] = max(out[ref][2], chunk.ids[r])
                    where.append((ref, r, x))
            files.write_once(f"{uri}.places", np.array(where, "<i4").tobytes())
            for i in range(0, len(out), 20_000):
                some, ctx = out[i : i + 20_000], [*refs][i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in some], pa.int64()), *(pa.array([x[c] for x in some], pa.int64()) for c in (1, 2)), pa.array([c[0] for c in ctx], pa.int32()), pa.array([c[1] for c in ctx], pa.binary()), pa.array([number] * len(some), pa.int64()), pa.array([x[3] for x in some], pa.int32())], ["k", "id", "top", "before", "ctx", "chunk", "ref"])

    return run


class Bucket:
    """Suffixes of a block of anchored contexts, sorted one bucket (distance to the anchor) at a time.

    Contexts are laid out so that every anchor falls on a multiple of MODULUS. Cover samples (places whose residue is in
    COVER) are ranked once, with the length of the common prefix of neighbours. Suffixes at the same distance before
    their anchors have the same residue, so the same shift of less than MODULUS leads each to a sample: they are sorted
    by the few bytes before it, and ties by the sample's rank, whatever their length.
    """

    def __init__(self, before: np.ndarray, contexts: list[bytes], length: int):
        self.length = length
        room = -(-(length + ANCHOR) // MODULUS) * MODULUS
        sizes = np.array([len(c) for c in contexts])
        wide = -(-(sizes - before) // MODULUS) * MODULUS + room + MODULUS
        end = np.cumsum(wide)
        self.anchor = end - wide + room
        self.start = self.anchor - before
        self.text = np.zeros(int(end[-1]) + 64, np.uint8)
        flat = np.frombuffer(b"".join(contexts), np.uint8)
        where = np.repeat(self.start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(flat))
        self.text[where] = flat
        inside = np.zeros(len(self.text), bool)
        inside[where] = True
        sample = np.flatnonzero(inside & np.isin(np.arange(len(self.text)) % MODULUS, COVER))
        words = self._words(sample)
        order = np.lexsort(words[::-1])
        self.rank = np.zeros(len(self.text), np.int64)
        sorted_ = [w[order] for w in words]
        self.common = self._common(sorted_)
        self.rank[sample[order]] = np.arange(len(order))
        self.classes: dict[int, np.ndarray] = {}

    def _words(self, at: np.ndarray) -> list[np.ndarray]:
        """The `length` bytes at each place as big-endian 8-byte words."""
        pad = self.text
        return [np.lib.stride_tricks.sliding_window_view(pad, 8)[np.minimum(at + k, len(pad) - 8)].view(">u8")[:, 0].astype(np.uint64) for k in range(0, self.length, 8)]

    def _common(self, words: list[np.ndarray]) -> np.ndarray:
        """Bytes that each sorted sample has in common with the one before it, up to the words compared."""
        n = len(words[0])
        out, equal = np.zeros(n, np.int64), np.ones(n, bool)
        equal[:1] = False
        for w in words:
            x = np.zeros(n, np.uint64)
            x[1:] = w[1:] ^ w[:-1]
            lead = sum((x >> np.uint64(56 - 8 * i) == 0).astype(np.int64) for i in range(8))
            out += np.where(equal, lead, 0)
            equal &= lead == 8
        return out

    def strings(self, rows: np.ndarray, distance: int) -> np.ndarray:
        """Class of the string of `length` bytes that starts `distance` before each row's anchor: equal if and only if
        the bytes are."""
        at = self.anchor[rows] - distance
        shift = next(s for s in range(MODULUS) if (at[0] + s) % MODULUS in COVER)
        depth = self.length - shift
        if depth not in self.classes:
            self.classes[depth] = np.cumsum(self.common < depth)
        keys = [self.classes[depth][self.rank[at + shift]]]
        for k in range(0, shift, 8):
            word = np.lib.stride_tricks.sliding_window_view(self.text, 8)[at + k].view(">u8")[:, 0].astype(np.uint64)
            keys.append(word >> np.uint64(8 * max(0, k + 8 - shift)))
        order = np.lexsort(keys)
        new = np.zeros(len(rows), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        out = np.empty(len(rows), np.int64)
        out[order] = np.cumsum(new)
        return out


def covered(ids: np.ndarray, before: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """(row, distance) -> least id with that string, as an array [rows, distances]; the greatest int64 where none starts."""
    bucket = Bucket(before, contexts, length)
    after = np.array([len(c) for c in contexts]) - length  # starts a context holds, less one
    none = np.iinfo(np.int64).max
    out = np.full((len(ids), length - ANCHOR + 1), none)
    for distance in range(length - ANCHOR + 1):
        rows = np.flatnonzero((distance <= before) & (before - distance <= after))
        if len(rows):
            cls = bucket.strings(rows, distance)
            least = np.full(cls.max() + 1, none)
            np.minimum.at(least, cls, ids[rows])
            out[rows, distance] = least[cls]
    return out


def least_ids(k: np.ndarray, ids: np.ndarray, before: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """`covered` of distinct contexts in order of k, which equal strings share: only buckets of several are sorted."""
    after, distance = np.array([len(c) for c in contexts]) - length, np.arange(length - ANCHOR + 1)
    starts = (distance <= before[:, None]) & (before[:, None] - distance <= after[:, None])
    out = np.where(starts, ids[:, None], np.iinfo(np.int64).max)
    several = np.zeros(len(k), bool)
    several[1:] = k[1:] == k[:-1]
    several[:-1] |= several[1:]
    if len(some := np.flatnonzero(several)):
        out[some] = covered(ids[some], before[some], [contexts[i] for i in some], length)
    return out


RUNS = "chunk bigint, ref int, a int, n int, least bigint"


def _sorter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (k, id). (chunk, ref, a, n, least): the n strings from byte a of a context on start in
        document `least` first, which is smaller than the greatest id that holds the context.

        A bucket that goes on after a block carries its distinct contexts with it (each with its least id), so later,
        larger ids meet all earlier strings.
        """
        held: list[pa.RecordBatch] = []
        carried: list[tuple] = []

        def sort(last: bool) -> pa.RecordBatch:
            nonlocal held, carried
            table = pa.Table.from_batches(held)
            old = len(carried)
            k, ids = (np.concatenate([np.array([r[c] for r in carried], np.int64), table.column(n).to_numpy()]) for c, n in ((0, "k"), (1, "id")))
            before = np.concatenate([np.array([r[2] for r in carried], np.int64), table.column("before").to_numpy()])
            contexts = [r[3] for r in carried] + table.column("ctx").to_pylist()
            index: dict[tuple[int, bytes], int] = {}  # equal contexts are sorted once; ids ascend, so the first has the least
            which = np.array([index.setdefault((n, c), len(index)) for n, c in zip(before.tolist(), contexts, strict=True)])
            one = np.unique(which, return_index=True)[1]
            found = least_ids(k[one], ids[one], before[one], [c for _, c in index], length)
            least = found[which[old:]]
            r, d = np.nonzero(least < table.column("top").to_numpy()[:, None])
            a, least = before[old:][r] - d, least[r, d]
            order = np.lexsort((a, r))
            r, a, least = r[order], a[order], least[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1) | (least[1:] != least[:-1])])[: len(r)]
            cut = np.flatnonzero(new)
            n = np.diff(np.append(cut, len(r)))
            take = pa.array(r[cut])
            if last:
                carried = []
            else:
                keep = np.flatnonzero((k[one] == k[-1]) & (found == ids[one][:, None]).any(axis=1))
                keys = [*index]
                carried = [(int(k[one[i]]), int(ids[one[i]]), *keys[i]) for i in keep]
            held = []
            return pa.RecordBatch.from_arrays([table.column("chunk").combine_chunks().take(take), table.column("ref").combine_chunks().take(take), pa.array(a[cut].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least[cut])], ["chunk", "ref", "a", "n", "least"])

        size = 0
        for batch in batches:
            while batch.num_rows:
                if size >= BLOCK:
                    yield sort(held[-1].column("k")[-1] != batch.column("k")[0])
                    size = 0
                held.append(batch.slice(0, BLOCK - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
        if held:
            yield sort(True)

    return run


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a chunk mark the bytes that go from its texts; its first row has the uri and no run."""
        for table in _by(batches, "chunk"):
            uri = table.column("uri")[0].as_py()
            chunk = Chunk(uri)
            places = np.frombuffer(files.read(f"{uri}.places"), "<i4").reshape(-1, 3).astype(np.int64)
            places = places[np.argsort(places[:, 0], kind="stable")]
            ref, a, n, least = (table.column(c).to_numpy()[table.column("ref").to_numpy() >= 0].astype(np.int64) for c in ("ref", "a", "n", "least"))
            low, high = np.searchsorted(places[:, 0], ref), np.searchsorted(places[:, 0], ref, "right")
            run_ = np.repeat(np.arange(len(ref)), high - low)
            at = places[np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(len(run_))]
            hit = chunk.ids[at[:, 1]] > least[run_]
            begin, size = at[hit, 2] + a[run_[hit]], n[run_[hit]] - 1 + length
            steps = np.zeros(len(chunk.buf) + 1, np.int32)
            np.add.at(steps, begin, 1)
            np.subtract.at(steps, begin + size, 1)
            gone = np.cumsum(steps, dtype=np.int32)[:-1] > 0
            for k in np.flatnonzero(chunk.copy):
                gone[chunk.off[k] : chunk.off[k + 1]] = True
            total = np.zeros(len(chunk.buf) + 1, np.int32)
            np.cumsum(gone, out=total[1:])
            removed = (total[chunk.off[1:]] - total[chunk.off[:-1]]).astype(np.int64)
            n_spans, kept, spans = [], [], []
            for k, (x, y) in enumerate(zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist(), strict=True)):
                if removed[k]:
                    part = gone[x:y]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                    spans.append([{"a": i, "b": j} for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    kept.append(hashlib.sha256(chunk.buf[x:y][~part]).hexdigest())
                else:
                    spans.append([])
                    kept.append(hashlib.sha256(chunk.buf[x:y]).hexdigest())
                n_spans.append(len(spans[-1]))
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([chunk.column, pa.array(np.diff(chunk.off)), pa.array(removed), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row: the bytes of its text (UTF-8, a null is empty)
    that lie in a string of `length` bytes which also starts in a document of smaller id, and what is left without them.

    Strings are judged on the input and never cross documents. Rows without an id are compared with nothing and keep all.
    Rows of one id are one document as to whom they take bytes from (never from each other). Texts shorter than `length`
    keep all. Empty table: no rows. Extra columns are not read.

    Every string has an anchor (see `anchors`) that equal strings share: the strings of one anchor, one distance to it at
    a time, are the suffix buckets that `Bucket` sorts. Texts are written once, to chunk files in the shared folder, and
    never shuffled. What is shuffled: digests of whole texts (a copy of a smaller id's text goes whole and takes no part
    in the rest); 32 bits of each anchor's hash, by groups that answer which are shared; contexts of shared anchors (equal
    ones of a chunk once), by anchor; and the runs that are covered, by chunk. A hot anchor's contexts are split by distance, and by the bytes that all strings of such distances hold. Memory is bounded by a chunk,
    a group of anchors and BLOCK contexts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = scratch.table(base.mapInArrow(_chunks(scratch.folder()), "chunk bigint, uri string, bytes bigint"))
    n, size = chunks.agg(F.count("*"), F.sum("bytes")).first()
    groups = min(max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // GROUP)), GROUPS)
    each, state = chunks.select("chunk", "uri"), "chunk bigint, uri string, p int, state binary"
    none = each.select("chunk", "uri", F.lit(-1).alias("p"), F.lit(b"").alias("state"))

    def by_chunk(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition(max(1, n), "chunk").sortWithinPartitions("chunk", *order)

    told = each.repartition(max(1, n)).mapInArrow(_digests(length, groups), "p int, chunk bigint, uri string, hashes binary, ids binary")
    copies = told.repartition("p").sortWithinPartitions("p", "chunk").mapInArrow(_copies, state).unionByName(none)
    asked = by_chunk(copies, "p").mapInArrow(_hashes(length, groups), "p int, chunk bigint, uri string, hashes binary, rows binary")
    states = asked.repartition("p").sortWithinPartitions("p", "chunk").mapInArrow(_states(HOT), state).unionByName(none)
    contexts = by_chunk(states, "p").mapInArrow(_contexts(length, groups), CONTEXTS)
    runs = contexts.repartition("k").sortWithinPartitions("k", "id", "chunk", "ref").mapInArrow(_sorter(length), RUNS).withColumn("uri", F.lit(None).cast("string"))
    runs = runs.unionByName(each.select("chunk", *(F.lit(v).cast(t).alias(c) for c, v, t in (("ref", -1, "int"), ("a", 0, "int"), ("n", 0, "int"), ("least", 0, "bigint"))), "uri"))
    out = by_chunk(runs, "ref").mapInArrow(_cutter(length), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:int,b:int>>")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
