"""Repair of conversation structure by a dynamic programme over a trie of role and fault signatures (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import Scratch, attach

WHITE = " \t\n\x0b\x0c\r"
#: Costs of the edits; an undeleted truncated row costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Roles that an edit can give.
USER, ASSISTANT = "user", "assistant"

# States by what stands last: nothing, a system row, a user row, an assistant row. A conversation may end in the first and last.
_NEXT = (2, 2, 3, 2)  # where the row that an edit gives a role leads
_MOVES = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
_FAR = 1 << 60


def _closed(row: list[int]) -> tuple[int, ...]:
    """Least costs when rows may be inserted first: two in a row at most are worth it."""
    h = list(row)
    for _ in range(2):
        h = [min(h[q], INSERT + h[_NEXT[q]]) for q in range(4)]
    return tuple(h)


END = _closed([0, _FAR, _FAR, 0])


def _choices(letter: str, after: tuple[int, ...], q: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost to the end, state after it) of a row, in ASCII order of the edits."""
    yield "D", DELETE + after[q], q
    if letter != "d":
        faulty = TRUNCATED if letter.isupper() else 0
        if (to := _MOVES[letter.lower()][q]) is not None:
            yield "K", KEEP + faulty + after[to], to
        yield "R", REROLE + faulty + after[_NEXT[q]], _NEXT[q]


@cache
def _layer(letter: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost from each state before a row, given those after it; both are relative to the least of `after`."""
    return _closed([min(c for _, c, _ in _choices(letter, after, q)) for q in range(4)])


@cache
def _step(letter: str, after: tuple[int, ...], q: int) -> tuple[str, int]:
    """ASCII-least edits of cheapest cost up to and with the row's own, and the state they lead to."""
    here, out = _layer(letter, after), ""
    while True:
        found = {edit: to for edit, cost, to in _choices(letter, after, q) if cost == here[q]}
        if INSERT + here[_NEXT[q]] == here[q]:
            found["I"] = _NEXT[q]
        edit = min(found)
        out, q = out + edit, found[edit]
        if edit != "I":
            return out, q


class SuffixTrie:
    """Layers of the programme along one path of the trie of signatures, which are read from their last row.

    Signatures come sorted by their reverse. What a signature shares with the one before is a prefix of the path, whose
    layers stay; only the layers below are computed. The root is the end of every conversation, so a terminal node knows
    the least cost of its whole conversation, and the edits are read by walking up to the root. Memory: one path.
    """

    def __init__(self):
        self.path, self.layers, self.cost, self.made = "", [END], [0], 0

    def solve(self, reverse: str) -> tuple[int, str]:
        """(least cost, ASCII-least cheapest edits) of the signature that reads `reverse` from its end."""
        low, high = 0, min(len(self.path), len(reverse))
        while low < high:  # length of the shared prefix
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.path[low:mid] == reverse[low:mid] else (low, mid - 1)
        del self.layers[low + 1 :], self.cost[low + 1 :]
        for letter in reverse[low:]:
            layer = _layer(letter, self.layers[-1])
            least = min(layer)
            self.layers.append(tuple(x - least for x in layer))
            self.cost.append(self.cost[-1] + least)
            self.made += 1
        self.path, q, audit = reverse, 0, []
        for i in range(len(reverse) - 1, -1, -1):
            edits, q = _step(reverse[i], self.layers[i], q)
            audit.append(edits)
        audit.append("I" * (END[q] // INSERT))
        return self.cost[-1] + self.layers[-1][0], "".join(audit)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): the rows as faults of known kind change them, by crc32 of `conv:turn` modulo 20.

    0 drops the row (copies 0), 1 empties its text, 2 takes its sentence marks, 3 repeats it (copies 2), 4 sets its role to
    user; others stay. Nulls are one space. Other columns go.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    kind = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    edited = F.when(kind == 1, "").when(kind == 2, F.translate(filled[3], ".!?", "")).otherwise(filled[3])
    return rows.select(
        F.col(conv), F.col(turn), F.when(kind == 4, USER).otherwise(filled[2]).alias(role), edited.alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """conv, turn, role, text, copies under names of their own, nulls filled, and a digest of role and text."""
    conv, turn, role, text = names
    copies = F.col("copies").cast("bigint") if "copies" in rows.columns else F.lit(1).cast("bigint")
    fill = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)]
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).try_cast("bigint").alias("turn"), fill[0].alias("role"), fill[1].alias("text"), copies.alias("copies"))
    return base.withColumn("same", F.unhex(F.md5(F.concat(F.md5("role"), F.col("text")))))


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, turn): one row of counts, and the reversed signature, for each conversation."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "reverse"]
    now: list = []
    out: list[list] = []

    def close() -> None:
        turns = [t for t in (now[1], now[2]) if t is not None]
        gaps = min(turns[1] - turns[0] + 1 - now[3], 2**63 - 1) if turns else 0
        out.append([now[0], gaps, *now[4:7], now[7], now[8][::-1].decode()])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, turn, initial, blank, cut, copies, fresh in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "blank", "cut", "copies", "fresh")), strict=True):
            if not now or now[0] != conv:
                if now:
                    close()
                now = [conv, None, None, 0, 0, 0, 0, 0, bytearray(), None]  # least, greatest and number of turns; faults; signature; last initial
            if not copies:
                continue
            if turn is not None and turn != now[2]:
                now[1], now[2], now[3] = turn if now[1] is None else now[1], turn, now[3] + 1
            letter = initial if initial and initial in "sua" else "x"
            for k in range(copies):
                if blank:
                    now[4] += 1
                elif k or not fresh:
                    now[5] += 1
                elif cut:
                    now[6] += 1
                now[8] += (b"d" if blank or k or not fresh else letter.upper().encode() if cut else letter.encode())
                now[7] += now[9] is not None and now[9] + letter not in ("su", "ua", "au")
                now[9] = letter
        if len(out) >= 5000:
            yield _batch(out, names, kind)
            out = []
    if now:
        close()
        yield _batch(out, names, kind)


def _batch(rows: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [kind, *[pa.int64()] * (len(names) - 2), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = SuffixTrie()
    for batch in batches:
        got = [trie.solve(r) for r in batch.column("reverse").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("form"), pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string()), batch.column("n")], ["form", "cost", "audit", "n"])


def plan_repairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    A conversation's rows are taken by turn (nulls first, rows of one turn by role and then by a digest); a column
    `copies`, where there is one, says how often each counts (0: not at all, but its conversation is still reported).
    A row's first fault counts: blank (white only), duplicate (role and text stood earlier), truncated (does not end in a
    sentence mark). gaps: missing turns between the least and the greatest; illegal: neighbours that do not follow each
    other. audit: the edits of least total cost, least in ASCII among equals, that make the role initials `(s?(ua)+)?`:
    D deletes a row, I inserts an empty one, K keeps it, R gives it the role that must follow. Null roles and texts are one
    space, a turn that is no integer is null. A null conversation id is one conversation. No rows: no result.

    What is shuffled is a digest and a few flags a row. Duplicates are found by (conversation, digest), so a long
    conversation is spread over tasks; then its rows stream through one task, which keeps one byte a row. Equal signatures
    are solved once, in order of their reverse (`SuffixTrie`); answers go back by the skew-safe `attach`.
    """
    scratch = Scratch(rows.sparkSession, "conversation-repair")
    base = _rows(rows, (conv, turn, role, text))
    ink = F.rtrim("text", F.lit(WHITE))
    small = base.select("conv", "turn", "role", "same", "copies", F.left("role", F.lit(1)).alias("initial"), (F.length(ink) == 0).alias("blank"), (~F.right(ink, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    small = small.groupBy("conv", "turn", "role", "same", "initial", "blank", "cut").agg(F.sum("copies").alias("copies"))
    earlier = Window.partitionBy("conv", "same", F.col("copies") > 0).orderBy(F.col("turn").asc_nulls_first())
    marked = small.withColumn("fresh", F.row_number().over(earlier) == 1)
    kind = base.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    sorted_ = marked.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "same")
    shapes = scratch.table(sorted_.mapInArrow(_shape, f"conv {kind}, {counts}, reverse string").withColumn("form", F.unhex(F.sha2("reverse", 256))))
    forms = shapes.groupBy("form").agg(F.first("reverse").alias("reverse"), F.count("*").alias("n"))
    solved = scratch.table(forms.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(_solve, "form binary, cost bigint, audit string, n bigint"))
    told = attach(shapes.drop("reverse"), solved, ["form"], "n")
    return told.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's plan comes before its rows: rows of the repaired conversation, in order."""
    names = ["conv", "position", "edit", "role", "text"]
    out: list[list] = []
    conv, audit, at, q, n, kind, size = None, "", 0, 0, 0, None, 0

    def put(edit: str, role: str, text: str) -> None:
        nonlocal n, size
        out.append([conv, n, edit, role, text])
        n, size = n + 1, size + len(text)

    def insert() -> None:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            q, at = _NEXT[q], at + 1
            put("I", USER if q == 2 else ASSISTANT, "")

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        columns = list(zip(*out, strict=True))
        out, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for c, plan, role, text, copies in zip(*(batch.column(x).to_pylist() for x in ("conv", "audit", "role", "text", "copies")), strict=True):
            if plan is not None:
                insert()
                conv, audit, at, q, n = c, plan, 0, 0, 0
                continue
            for _ in range(copies):
                insert()
                edit, at = audit[at], at + 1
                if edit != "D":
                    if edit == "R":
                        q = _NEXT[q]
                        role = USER if q == 2 else ASSISTANT
                    else:
                        q = _MOVES[role[:1]][q]
                    put(edit, role, text)
            if size > 1 << 22 or len(out) >= 5000:
                yield flush()
    insert()
    if out:
        yield flush()


def apply_repairs(rows: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, edit, role, text): the repaired conversations of `rows`, whose `plans` are those of `plan_repairs`.

    Rows of one conversation are adjacent and in order. A conversation that keeps nothing has no row. Texts are shuffled
    once, by conversation, each led by its plan, and stream through: no conversation is held in memory.
    """
    base = _rows(rows, (conv, turn, role, text)).where("copies > 0").withColumn("audit", F.lit(None).cast("string"))
    heads = plans.select(F.col(conv).alias("conv"), F.lit(0).alias("copies"), "audit")
    both = base.unionByName(heads, allowMissingColumns=True)
    sorted_ = both.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "same")
    kind = base.schema["conv"].dataType.simpleString()
    return sorted_.select("conv", "audit", "role", "text", "copies").mapInArrow(_apply, f"conv {kind}, position bigint, edit string, role string, text string").withColumnRenamed("conv", conv)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, out, kind = None, None, [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for c, position, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if position == 0:
                if state:
                    out.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], ["digested", "repaired_sha256"])
            out = []
    if state:
        out.append((conv, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], ["digested", "repaired_sha256"])


def digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(digested, repaired_sha256): of the rows that `apply_repairs` gives, in their order, `role:text` joined by newlines."""
    kind = repaired.schema[conv].dataType.simpleString()
    return repaired.select(conv, "position", "role", "text").mapInArrow(_digest, f"digested {kind}, repaired_sha256 string")


def with_digests(plans: DataFrame, repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """`plans` with the digest of each repaired conversation (of nothing, where it keeps nothing)."""
    told = digests(repaired, conv)
    none: Column = F.lit(hashlib.sha256().hexdigest())
    return plans.join(told, plans[conv].eqNullSafe(told["digested"]), "left").select(*(plans[c] for c in plans.columns), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
