import hashlib
import heapq
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from framewise.llm.conversation_repair import SuffixTrie, apply_repairs, damage, plan_repairs, with_digests

EMPTY = hashlib.sha256().hexdigest()


def letters(rows):
    """Signature and counts of (turn, role, text) rows in order."""
    seen, out, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        c = role[:1] if role[:1] in tuple("sua") else "x"
        out += "d" if fault in ("blank", "duplicate") else c.upper() if fault else c
    return out, counts


def cheapest(signature):
    """Every edit is a step of a graph of (row, roles so far as the grammar needs them); least (cost, edits) first."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    todo, done = [(0, "", 0, "")], set()
    while todo:
        cost, edits, i, last = heapq.heappop(todo)
        if i == len(signature) and last in ("", "a"):
            return cost, edits
        if (i, last) in done:
            continue
        done.add((i, last))
        heapq.heappush(todo, (cost + 3, edits + "I", i, after[last]))
        if i < len(signature):
            c = signature[i]
            heapq.heappush(todo, (cost + 4, edits + "D", i + 1, last))
            if c != "d":
                faulty = 3 if c.isupper() else 0
                if c.lower() == after[last] or (c.lower() == "s" and last == ""):
                    heapq.heappush(todo, (cost + faulty, edits + "K", i + 1, c.lower()))
                heapq.heappush(todo, (cost + faulty + 3, edits + "R", i + 1, after[last]))


def repaired(rows, edits):
    out, i, last = [], 0, ""
    for e in edits:
        want = "assistant" if last == "u" else "user"
        if e == "I":
            out.append(f"{want}:")
            last = want[0]
            continue
        _, role, text = rows[i]
        i += 1
        if e != "D":
            role = want if e == "R" else role
            out.append(f"{role}:{text}")
            last = role[0]
    return "\n".join(out)


def test_trie_against_every_path():
    signatures = sorted({"".join(s) for n in range(5) for s in itertools.product("suaxdUA", repeat=n)} | {"".join(random.Random(n).choices("suaxdSUAX", k=n)) for n in range(5, 60)}, key=lambda s: s[::-1])
    trie = SuffixTrie()
    for s in signatures:
        assert trie.solve(s[::-1]) == cheapest(s), s
    assert trie.made < sum(map(len, signatures)) * 0.6


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        signature, counts = letters(kept)
        turns = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, edits = cheapest(signature)
        sha = hashlib.sha256(repaired(kept, edits).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, edits, sha))
    return sorted(out, key=str)


def run(rows):
    rows = damage(rows)
    plans = plan_repairs(rows)
    return sorted(map(tuple, with_digests(plans, apply_repairs(rows, plans)).collect()), key=str)


def test_odd_rows_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Yes.", "no", "", None, "  \n", "What? ", "Fine!\t", "…", "Ü.", "a. b"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "", "tool", "User"]), rng.choice(words)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (100, 5, "user", "x " * 100_000 + "."), (101, -3, "system", "S."), (101, 2**40, "user", "U.")]
    rows += [(200, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(3000)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, copies_ int, conv string")
    assert run(docs) == expected(rows)


def test_a_row_that_always_goes_and_an_empty_table(spark):
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert run(docs) == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert run(docs.where("false")) == []


def test_undamaged_rows_and_their_texts(spark):
    rows = [("a", 0, "assistant", "Hello."), ("a", 1, "user", "Hm"), ("a", 1, "user", "Hm"), ("b", 0, "user", "Q?"), ("b", 1, "assistant", "A.")] + [(f"c{i}", j, "ua"[j] + "x", f"{i}.") for i in range(500) for j in range(2)]
    docs = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    plans = plan_repairs(docs)
    got = {r.conv_id: r.audit for r in plans.collect()}
    assert got["a"] == cheapest("aUd")[1] and got["b"] == "KK" and got["c7"] == "KK"
    texts = apply_repairs(docs, plans).where(F.col("conv_id") == "a").orderBy("position").collect()
    assert [(r.edit, r.role, r.text) for r in texts][:2] == [("I", "user", ""), ("K", "assistant", "Hello.")]
