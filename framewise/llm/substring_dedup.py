"""Removal of word windows that earlier documents hold, through a compressed FM-index for each shard (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm import files
from framewise.llm.common import Scratch, mix, slices, span_hashes, word_spans
from framewise.llm.fm_index import FMIndex
from framewise.llm.suffix_dedup import GROUP, ODD, PLACE, SEGMENT, Chunk, _answers, _by, _chunks, _copies, _digests, _sliding

#: Words of an anchor; contexts that one index holds at most; contexts of one anchor beyond which they are cut to windows.
ANCHOR, BLOCK, HOT = 4, 40_000, 4000
#: Partitions of the steps that read chunk files; a task takes several files, one at a time.
TASKS = 20_000


def anchors(h: np.ndarray, window: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last): the anchors of the windows that start at the words where `ok`; h are the words' hashes.

    A window's anchor is the leftmost of its ANCHOR-word grams of least hash (48 bits). It depends on the window's words
    alone, so equal windows meet in one anchor. first and last bound the adjacent windows that share an anchor.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for low in range(0, len(h) - window + 1, SEGMENT):
        part = np.flatnonzero(ok[low : min(low + SEGMENT, len(h) - window + 1)])
        if not len(part):
            continue
        words = h[low : low + SEGMENT + window - 1]
        n = len(words) - ANCHOR + 1
        gram = mix(sum((words[k : k + n] * np.uint64(ODD[k]) for k in range(1, ANCHOR)), words[:n] * np.uint64(ODD[0])))
        placed = gram & ~PLACE | np.arange(n, dtype=np.uint64)
        place = (_sliding(placed, window - ANCHOR + 1, np.minimum)[part] & PLACE).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1] + 1)]))
        last = np.concatenate([cut[1:], [len(place)]]) - 1
        found.append((place[cut] + low, gram[place[cut]], part[cut] + low, part[last] + low))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Words:
    """The words of a chunk file: bounds in bytes, row and hash of each, and the first word of every row."""

    def __init__(self, chunk: Chunk):
        got = []
        for i, j in slices(chunk.off):
            a = chunk.off[i]
            part = chunk.buf[a : chunk.off[j]]
            s, e, row = word_spans(part, chunk.off[i : j + 1] - a)
            got.append((s + a, e + a, row + i, span_hashes(part, s, e) if len(s) else np.zeros(0, np.uint64)))
        none = np.zeros(0, np.int64)
        self.start, self.end, self.row, self.hash = (np.concatenate(c) for c in zip((none, none, none, np.zeros(0, np.uint64)), *got, strict=True))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.row.astype(np.int64), minlength=len(chunk.ids)))])

    def anchors(self, live: np.ndarray, window: int, groups: int):
        """row, key, first, last of each anchor's windows in live rows; the key is the anchor's group and 32 bits of its hash."""
        n = len(self.row)
        ok = np.zeros(n, bool)
        if n >= window:
            ok[: n - window + 1] = (self.row[window - 1 :] == self.row[: n - window + 1]) & live[self.row[: n - window + 1]]
        _, h, first, last = anchors(self.hash, window, ok)
        group = (h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        return self.row[first], group << np.uint64(32) | h & np.uint64(0xFFFFFFFF), first, last


def _hashes(least: int, window: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(p, chunk, uri, hashes, rows): for each group the distinct anchors of a chunk in order, and for each how often it
        stands there (twice that, plus 1 if in several rows). Copies of whole texts are noted beside the chunk and have no part."""
        for table in _by(batches, "chunk"):
            number, uri = table.column("chunk")[0].as_py(), table.column("uri")[0].as_py()
            chunk = Chunk(uri, copies=False)
            rows, _, group = chunk.digests(least, groups)
            copy = np.zeros(len(chunk.ids), bool)
            copy[rows[np.argsort(group, kind="stable")]] = np.frombuffer(b"".join(table.column("state").to_pylist()), bool)
            files.write_once(f"{uri}.copies", copy.tobytes())
            row, key, _, _ = Words(chunk).anchors(chunk.live & ~copy, window, groups)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            end = np.append(cut[1:], len(key))[: len(cut)]
            several = row[cut] != row[end - 1] if len(cut) else cut
            u = key[cut]
            at = np.searchsorted(u, np.arange(groups + 1, dtype=np.uint64) << np.uint64(32))
            some = np.flatnonzero(np.diff(at))
            both = (u & np.uint64(0xFFFFFFFF)).astype("<u4"), (np.minimum(end - cut, 30_000) * 2 + several).astype("<u2")
            parts = [pa.array([x[at[p] : at[p + 1]].tobytes() for p in some], pa.binary()) for x in both]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([number] * len(some), pa.int64()), pa.array([uri] * len(some), pa.string()), *parts], ["p", "chunk", "uri", "hashes", "rows"])

    return run


def _states(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, uri, p, state): for each anchor of a chunk 0 if one row alone has it, 2 if it stands at more than `hot`
        places, else 1."""
        for table in _by(batches, "p"):
            hashes = [np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()]
            told = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("rows").to_pylist()]).astype(np.int64)
            _, which = np.unique(np.concatenate(hashes), return_inverse=True)
            shared = (np.bincount(which) > 1) | (np.bincount(which, told & 1) > 0)
            state = (shared.astype(np.uint8) + (shared & (np.bincount(which, told >> 1) > hot)))[which].astype(np.uint8)
            yield _answers(table, state, [*map(len, hashes)])

    return run


def _contexts(window: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the windows of each shared anchor, joined by one space; of a hot anchor each window by itself, dealt by
        its own words. Equal contexts of a chunk are one row (least and greatest id); where they stand is written beside it."""
        for table in _by(batches, "chunk"):
            number, uri = table.column("chunk")[0].as_py(), table.column("uri")[0].as_py()
            chunk = Chunk(uri)
            words = Words(chunk)
            row, key, first, last = words.anchors(chunk.live, window, groups)
            state = np.frombuffer(b"".join(table.column("state").to_pylist()), np.uint8)[np.unique(key, return_inverse=True)[1]]
            raw, start, end, refs, out, where = chunk.buf.tobytes(), words.start, words.end, {}, [], []
            for r, k, a, b, hot in zip(*(x[state > 0].tolist() for x in (row, key, first, last)), (state[state > 0] > 1).tolist(), strict=True):
                for x, y in [(x, x) for x in range(a, b + 1)] if hot else [(a, b)]:
                    ctx = b" ".join(raw[start[x] : end[y + window - 1]].split())
                    if (ref := refs.get(ctx)) is None:
                        ref = refs[ctx] = len(out)
                        sub = int.from_bytes(hashlib.blake2b(ctx, digest_size=8).digest(), "big", signed=True) if hot else k
                        out.append([sub, chunk.ids[r], chunk.ids[r], ref])
                    else:
                        out[ref][1] = min(out[ref][1], chunk.ids[r])
                        out[ref][2] = max(out[ref][2], chunk.ids[r])
                    where.append((ref, r, x))
            files.write_once(f"{uri}.places", np.array(where, "<i4").tobytes())
            ctx = [*refs]
            for i in range(0, len(out), 20_000):
                some = out[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([*(pa.array([int(x[c]) for x in some], pa.int64()) for c in range(3)), pa.array(ctx[i : i + 20_000], pa.binary()), pa.array([number] * len(some), pa.int64()), pa.array([x[3] for x in some], pa.int32())], ["k", "id", "top", "ctx", "chunk", "ref"])

    return run


def shard(contexts: list[bytes], ids: np.ndarray, window: int) -> tuple[FMIndex, np.ndarray, np.ndarray]:
    """The index of contexts, whose symbols are numbers of their words, and these symbols and the number in each context."""
    number: dict[bytes, int] = {}
    split = [c.split(b" ") for c in contexts]
    sizes = np.array([len(w) for w in split], np.int64)
    symbols = np.array([number.setdefault(w, len(number) + 1) for ws in split for w in ws], np.int64)
    return FMIndex(symbols, sizes, ids, window), symbols, sizes


def least_ids(k: np.ndarray, ids: np.ndarray, contexts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, least id of those with the same words) of every window of distinct contexts, which come by k.

    Contexts whose k no other has are their windows' only owners. The others make up a shard: they are indexed, and each
    is streamed through the index again: a backward search from every window's last word gives its matching statistic
    among places other than its own. Where it reaches the window's length, its range holds all owners.
    """
    count = np.array([c.count(b" ") + 1 for c in contexts], np.int64) - window + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    out = ids[owner]
    several = np.zeros(len(k), bool)
    several[1:] = k[1:] == k[:-1]
    several[:-1] |= several[1:]
    if len(some := np.flatnonzero(several)):
        index, symbols, sizes = shard([contexts[i] for i in some], ids[some], window)
        begin = np.cumsum(sizes) - sizes
        n = sizes - window + 1
        ends = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum()) + window - 1
        matched, low, high = index.search(symbols, ends, window, least=2)
        hit = matched == window
        own = np.flatnonzero(several[owner])
        out[own[hit]] = index.least_ids(low[hit], high[hit])
    return owner, out


RUNS = "chunk bigint, ref int, a int, n int, least bigint"


def _searcher(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (k, id). (chunk, ref, a, n, least): the n windows from word a of a context on start in document `least`
        first, which is smaller than the greatest id that holds the context. A k that goes on after a block carries its
        distinct contexts with it: one for a window dealt by itself, HOT at most for an anchor."""
        held: list[pa.RecordBatch] = []
        carried: dict[bytes, int] = {}

        def search(last: bool) -> pa.RecordBatch:
            nonlocal held, carried
            table = pa.Table.from_batches(held)
            k, ids = (table.column(c).to_numpy() for c in ("k", "id"))
            index = {c: (int(k[0]), i) for c, i in carried.items()}
            which = np.empty(len(k), np.int64)
            number = {c: i for i, c in enumerate(index)}
            for i, (key, own, c) in enumerate(zip(k.tolist(), ids.tolist(), table.column("ctx").to_pylist(), strict=True)):
                if c not in number:
                    number[c], index[c] = len(number), (key, own)
                which[i] = number[c]
            keys, owners = (np.array([v[x] for v in index.values()], np.int64) for x in (0, 1))
            owner, least = least_ids(keys, owners, [*index], window)
            at = np.searchsorted(owner, np.arange(len(keys) + 1))
            size = (at[1:] - at[:-1])[which]
            r = np.repeat(np.arange(len(which)), size)
            a = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
            least = least[at[which][r] + a]
            hit = least < table.column("top").to_numpy()[r]
            r, a, least = r[hit], a[hit], least[hit]
            cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1) | (least[1:] != least[:-1])])[: len(r)])
            carried = {} if last else {c: i for c, (key, i) in index.items() if key == k[-1]}
            held = []
            take = pa.array(r[cut])
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(take) for c in ("chunk", "ref")), pa.array(a[cut].astype(np.int32)), pa.array(np.diff(np.append(cut, len(r))).astype(np.int32)), pa.array(least[cut])], ["chunk", "ref", "a", "n", "least"])

        size = 0
        for batch in batches:
            while batch.num_rows:
                if size >= BLOCK:
                    yield search(held[-1].column("k")[-1] != batch.column("k")[0])
                    size = 0
                held.append(batch.slice(0, BLOCK - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
        if held:
            yield search(True)

    return run


def _cutter(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a chunk mark the words that go from its texts; its first row has the uri and no run."""
        for table in _by(batches, "chunk"):
            uri = table.column("uri")[0].as_py()
            chunk = Chunk(uri)
            words = Words(chunk)
            places = np.frombuffer(files.read(f"{uri}.places"), "<i4").reshape(-1, 3).astype(np.int64)
            places = places[np.argsort(places[:, 0], kind="stable")]
            ref, a, n, least = (table.column(c).to_numpy()[table.column("ref").to_numpy() >= 0].astype(np.int64) for c in ("ref", "a", "n", "least"))
            low, high = np.searchsorted(places[:, 0], ref), np.searchsorted(places[:, 0], ref, "right")
            run_ = np.repeat(np.arange(len(ref)), high - low)
            at = places[np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(len(run_))]
            hit = chunk.ids[at[:, 1]] > least[run_]
            begin = at[hit, 2] + a[run_[hit]]
            steps = np.zeros(len(words.row) + 1, np.int32)
            np.add.at(steps, begin, 1)
            np.subtract.at(steps, begin + n[run_[hit]] - 1 + window, 1)
            gone = np.cumsum(steps, dtype=np.int32)[:-1] > 0
            size = np.diff(words.first)
            for k in np.flatnonzero(chunk.copy & (size >= window)):
                gone[words.first[k] : words.first[k + 1]] = True
            raw, removed, kept, spans = chunk.buf.tobytes(), [], [], []
            for k in range(len(size)):
                part = gone[words.first[k] : words.first[k + 1]]
                text = raw[chunk.off[k] : chunk.off[k + 1]].split()
                if part.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                    spans.append([{"a": i, "b": j} for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    text = [w for w, g in zip(text, part.tolist(), strict=True) if not g]
                else:
                    spans.append([])
                removed.append(int(part.sum()))
                kept.append(hashlib.sha256(b" ".join(text)).hexdigest())
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([chunk.column, pa.array(size), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["id", "n_words", "n_removed", "kept_sha256", "spans"])

    return run


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of every row: the words (runs of non-white bytes, unchanged) of its text
    that lie in a window of `window` words which also starts in a document of smaller id, what is left without them, and the
    maximal runs of removed words (end exclusive).

    Windows are judged on the input and never cross documents. Rows without an id are compared with nothing and keep all.
    Rows of one id take nothing from each other. A null text has no words; shorter texts than a window keep all. Ids are
    whole numbers (others fail their cast). Empty table: no rows. Extra columns are not read.

    Every window has an anchor (see `anchors`) that equal windows share; a shard holds the windows of some anchors, so a document
    is searched in the shards of its own anchors only, and each shard is read once whatever the number of documents. Texts are
    written once, to chunk files in the shared folder, and never shuffled. What is shuffled: digests of whole texts (a copy of
    a smaller id's text goes whole and has no part in the rest); 32 bits of each anchor's hash, by groups that answer which are
    shared by rows; the words around shared anchors (equal ones of a chunk once), by anchor; and the covered runs, by chunk.
    The windows of a hot anchor are dealt each by its own words, and equal ones of a chunk are one row. Memory is bounded by a
    chunk, a group of anchors and an index of BLOCK contexts.
    """
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = scratch.table(base.mapInArrow(_chunks(scratch.folder()), "chunk bigint, uri string, bytes bigint"))
    n, size = chunks.agg(F.count("*"), F.sum("bytes")).first()
    groups = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // GROUP))
    least = 2 * window - 1  # bytes of a text that has a window
    each, state = chunks.select("chunk", "uri"), "chunk bigint, uri string, p int, state binary"
    none = each.select("chunk", "uri", F.lit(-1).alias("p"), F.lit(b"").alias("state"))
    tasks = min(max(1, n), TASKS)

    def by_chunk(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", *order)

    told = each.repartition(tasks).mapInArrow(_digests(least, groups), "p int, chunk bigint, uri string, hashes binary, ids binary")
    copies = told.repartition("p").sortWithinPartitions("p", "chunk").mapInArrow(_copies, state).unionByName(none)
    asked = by_chunk(copies, "p").mapInArrow(_hashes(least, window, groups), "p int, chunk bigint, uri string, hashes binary, rows binary")
    states = asked.repartition("p").sortWithinPartitions("p", "chunk").mapInArrow(_states(HOT), state).unionByName(none)
    contexts = by_chunk(states, "p").mapInArrow(_contexts(window, groups), "k bigint, id bigint, top bigint, ctx binary, chunk bigint, ref int")
    runs = contexts.repartition("k").sortWithinPartitions("k", "id", "chunk", "ref").mapInArrow(_searcher(window), RUNS).withColumn("uri", F.lit(None).cast("string"))
    runs = runs.unionByName(each.select("chunk", *(F.lit(v).cast(t).alias(c) for c, v, t in (("ref", -1, "int"), ("a", 0, "int"), ("n", 0, "int"), ("least", 0, "bigint"))), "uri"))
    out = by_chunk(runs, "ref").mapInArrow(_cutter(window), "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<a:int,b:int>>")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "spans")
