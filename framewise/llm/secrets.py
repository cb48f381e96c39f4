"""Secret scan: base patterns, and formats inferred from labelled credentials as probabilistic automata (operator 2)."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("passw", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Documents drawn (by hash of id and text) to label credentials and ordinary runs, strings of each sort kept from them, and
#: characters of the longest that are learnt from (longer ones are left out of the fit, not cut).
DOCUMENTS, STRINGS, LONGEST = 20000, 4000, 256


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind number, end) of the base patterns, and all runs of 12 or more token characters."""
    spans, runs = [], [m.span() for m in RUN.finditer(text)]
    if not runs:
        return spans, runs
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for a, b in runs:  # what the other two patterns match lies within one run
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 18]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 16]
    return sorted(spans), runs


SYMBOLS = {**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U")}
WEIGHT = {"9": math.log(1 / 10), "h": math.log(1 / 6), "l": math.log(1 / 20), "U": math.log(1 / 26)}
_EVEN = {"9": math.log(1 / 10), "l": math.log(1 / 26), "U": math.log(1 / 26)}
SORT = {c: "l" if k == "h" else k for c, k in SYMBOLS.items()}
#: Character steps of an ordinary identifier: new sort (digit to letter or back, lower to upper case), separator, the same.
IDENTIFIER = {"n": 0.016, ".": 0.15, "s": 0.834}
#: What a credential's steps are mixed with, at this share, so that no step is impossible.
STEPS, SHARE = {"n": 0.2, ".": 0.6, "s": 0.2}, 0.05
#: Strings that a state of the prefix tree needs to be told apart from others as deep; sparser ones of a depth are one state.
SPARSE = 32


def steps(s: str) -> list[tuple[str, float]]:
    """(step, log odds of the character given its step) for every character after the first.

    A step is n (the sort of letter or digit changes within a word), s (it stays; a lower-case letter after an upper-case
    one stays too) or . (a separator follows). The character after a separator starts a word and has no step.
    """
    out, before = [], SORT.get(s[0], ".")
    for c in s[1:]:
        now = SORT.get(c, ".")
        if now == ".":
            out.append((".", -math.log(6)))
        elif before == ".":
            out.append(("", -math.log(3) + _EVEN[now]))
        elif now == before or (before, now) == ("U", "l"):
            out.append(("s", _EVEN[now] - (math.log(2) if before == "U" else 0.0)))
        else:
            out.append(("n", _EVEN[now] - (0.0 if before == "U" else math.log(2))))
        before = now
    return out


def mixed(s: str) -> bool:
    """Whether letters and digits, or letters of both cases, are mixed."""
    return len({SORT[c] for c in s if c in SORT}) > 1


class Automaton:
    """A deterministic probabilistic automaton inferred by state merging.

    The prefix tree keeps the states that SPARSE strings or more reach; the sparser ones of a depth are one state, so
    deep states hold enough strings to be told apart, by the length that is left for instance. States that the Hoeffding
    test finds compatible, with all their followers, are merged.
    """

    def __init__(self, words: list[list[str]], alpha: float = 0.05, ends: bool = True):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{"": 0}]  # '' counts ends
        now, depth = [(0, words)], 0
        while now:
            pooled, later = None, []
            for at, group in now:
                by: dict[str, list[list[str]]] = defaultdict(list)
                for w in group:
                    if depth < len(w):
                        by[w[depth]].append(w)
                self.count[at] = {"": (len(group) - sum(map(len, by.values()))) if ends else 0, **{c: len(g) for c, g in sorted(by.items())}}
                for c, g in sorted(by.items()):
                    if len(g) >= SPARSE:
                        later.append((self._new(), g))
                        self.next[at][c] = later[-1][0]
                    else:
                        pooled = pooled or (self._new(), [])
                        pooled[1].extend(g)
                        self.next[at][c] = pooled[0]
            now, depth = later + ([pooled] if pooled else []), depth + 1
        self.total = [sum(c.values()) for c in self.count]
        self.into = list(range(len(self.next)))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.states = self.reached
        #: state -> (class -> (log probability of a character, next state), the same of an unseen class, of the end)
        self.table = {q: self._logs(q) for q in self.states}

    def _new(self) -> int:
        self.next.append({})
        self.count.append({"": 0})
        return len(self.next) - 1

    def _find(self, x: int) -> int:
        while self.into[x] != x:
            self.into[x] = self.into[self.into[x]]
            x = self.into[x]
        return x

    def _differ(self, a: int, b: int, c: str) -> bool:
        """Hoeffding test on the frequency of one symbol in two states."""
        n, m = self.total[a], self.total[b]
        return n > 0 < m and abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if any(self._differ(a, b, c) for c in {*self.count[a], *self.count[b]}):
                return False
            todo += [(self._find(y), self._find(self.next[b][c])) for c, y in self.next[a].items() if c in self.next[b]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Make a and b, and all that follows both by equal symbols, one state each."""
        todo = [(a, b)]
        while todo:
            a, b = sorted(map(self._find, todo.pop()))  # the start stays state 0
            if a == b:
                continue
            self.into[b] = a
            self.total[a] += self.total[b]
            for c, k in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + k
            for c, y in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], y))
                else:
                    self.next[a][c] = y

    def _merge(self) -> None:
        red = [0]
        while blue := [q for r in red for _, y in sorted(self.next[r].items()) if (q := self._find(y)) not in red]:
            q = blue[0]
            for r in red:
                if self._compatible(r, q):
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            red = sorted({self._find(x) for x in red})  # a fold may join settled states too
        self.reached = red

    def after(self, q: int, c: str) -> int:
        """The state after symbol c; an unseen symbol keeps the state."""
        return self._find(self.next[q].get(c, q))

    def _logs(self, q: int) -> tuple[dict[str, tuple[float, int]], float, float]:
        def smooth(c: str) -> float:
            return math.log((self.count[q].get(c, 0) + 0.1) / (self.total[q] + 7))

        return {c: (smooth(c) + WEIGHT.get(c, 0.0), self._find(y)) for c, y in self.next[q].items()}, smooth("unseen"), smooth("")

    def likelihood(self, s: str) -> float:
        """log P(s) of a string of characters; unseen symbols are smoothed over 70 classes and keep the state."""
        at, out = 0, 0.0
        for ch in s:
            c = SYMBOLS.get(ch, ch)
            seen = self.table[at][0].get(c)
            if seen is None:
                out += self.table[at][1] + WEIGHT.get(c, 0.0)
            else:
                out, at = out + seen[0], seen[1]
        return out + self.table[at][2]


class Formats:
    """Automata of labelled credentials against those of ordinary runs; a candidate gains the best log likelihood ratio.

    Labelled strings of one sort of character (numbers, words) teach nothing: a format is a mix. Each kind has an automaton
    over character classes, which tells its lengths and prefixes, and all kinds share one over character steps (`steps`),
    which tells formats that no label has by how often letters and digits change. An ordinary run is as likely as the mean
    of two models makes it: the automaton of unlabelled runs, and identifiers (IDENTIFIER), whose sorts of character change
    rarely, so words, dates, order and version numbers are ordinary though the sample may lack them.

    A run that the ordinary model makes gains log(models / error) or more with probability `error` at most, as no
    likelihood ratio has an expectation over 1. So the threshold rests on no sample's extremes. The ordinary sample is not
    labelled: the runs that reach the threshold are left out of it, and its automaton is inferred again.
    """

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], error: float = 1e-4):
        labelled = {k: [s for s in v if mixed(s)] for k, v in labelled.items()}
        self.kinds = {k: Automaton([[SYMBOLS.get(c, c) for c in s] for s in v]) for k, v in sorted(labelled.items()) if len(v) >= 5}
        taught = sorted({s for k in self.kinds for s in labelled[k]})
        self.shape = Automaton([[t for t, _ in steps(s) if t] for s in taught], ends=False) if taught else None
        self.rates = {}
        if self.shape:
            for q in self.shape.states:
                n = self.shape.total[q]
                for t, p in STEPS.items():
                    seen = self.shape.count[q].get(t, 0) / n if n else p
                    self.rates[q, t] = math.log((1 - SHARE) * seen + SHARE * p), self.shape.after(q, t), math.log(IDENTIFIER[t])
        self.threshold = math.log((len(self.kinds) + 1) / error)
        self.plain = None
        kept, left = [s for s in ordinary if not self.kinds or self.gain(s) < self.threshold], len(ordinary)
        while self.kinds and kept and len(kept) < left:  # it ends: each turn leaves out one run at least
            self.plain, left = Automaton([[SYMBOLS.get(c, c) for c in s] for s in kept]), len(kept)
            kept = [s for s in kept if self.gain(s) < self.threshold]
        if self.plain is None and ordinary and self.kinds:
            self.plain = Automaton([[SYMBOLS.get(c, c) for c in s] for s in ordinary])

    def gain(self, s: str) -> float:
        """The best log likelihood ratio of a string of two characters or more."""
        at = 0
        shape = ident = _EVEN.get(SORT.get(s[0]), -math.log(6)) - math.log(3)
        for t, odds in steps(s):
            shape, ident = shape + odds, ident + odds
            if t:
                rate, at, usual = self.rates[at, t]
                shape, ident = shape + rate, ident + usual
        ends = -math.log(50)  # both: any length alike
        plain = ident + ends
        if self.plain:
            learnt = self.plain.likelihood(s)
            top = max(plain, learnt)
            plain = top + math.log(0.5 * math.exp(plain - top) + 0.5 * math.exp(learnt - top))
        return max(shape + ends, *(a.likelihood(s) for a in self.kinds.values())) - plain

    def found(self, text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]], gain: Callable[[str], float] | None = None) -> list[tuple[int, int, int]]:
        """Runs that reach the threshold as a whole, but those that one base span holds."""
        if not self.kinds:
            return []
        return [(a, 3, b) for a, b in runs if not any(s <= a and b <= e for s, _, e in base) and (gain or self.gain)(text[a:b]) >= self.threshold]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = set()
        for text in batch.column(0).to_pylist():
            spans, runs = base_spans(text or "")
            for a, k, b in spans:
                got.add((KINDS[k], ASSIGN.match(text, a)[2] if k == 0 else text[a:b]))
            got |= {("", text[a:b]) for a, b in runs if not any(s < b and a < e for s, _, e in spans)}
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], ["kind", "value"])


def fit_formats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, strings: int = STRINGS, longest: int = LONGEST) -> Formats:
    """Label credentials by the base patterns in about `documents` documents drawn by hash; infer their automata.

    At most `strings` strings of each kind (those of least hash, up to `longest` characters) and as many ordinary runs
    reach the driver. Null and empty texts teach nothing; repeated rows count once; an empty table gives no formats.
    """
    n = docs.count()
    base = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    drawn = base.where(F.pmod(F.xxhash64("id", "text", F.lit(2)), F.lit(1_000_000)) < min(1.0, documents / max(n, 1)) * 1_000_000)
    found = drawn.select("text").mapInArrow(_label, "kind string, value string").where(F.length("value") <= longest).distinct()
    labelled = {k: [r.value for r in found.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(strings).collect()] for k in ("", *KINDS[:3])}
    return Formats({k: v for k, v in labelled.items() if k}, labelled[""])


def scan_secrets(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of (kind, start, end, score)) of every row, over its whole text; a null text counts as empty.

    Base spans (assign, access, hex) are leftmost and non-overlapping for each kind and may overlap across kinds. A
    'format' span is a run of 12 or more token characters, as a whole, that an inferred automaton finds likelier than
    ordinary text; a run that one base span holds is reported as that alone. score is the log likelihood ratio of the run,
    or of what a base span holds (of an assignment: the value); it judges no base span, and is null where nothing was
    learnt. Offsets count code points, ends are exclusive, order is by start and then kind as listed. Repeated rows get
    equal spans. Empty table: no rows. Extra columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = lru_cache(1 << 16)(formats.gain)  # copies and common words come again
        for batch in batches:
            sizes, kinds, starts, ends, scores = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                spans, runs = base_spans(text or "")
                if runs:
                    spans = sorted(spans + formats.found(text, runs, spans, gain))
                sizes.append(len(spans))
                for a, k, b in spans:
                    kinds.append(KINDS[k])
                    starts.append(a)
                    ends.append(b)
                    scores.append(gain(ASSIGN.match(text, a)[2] if k == 0 else text[a:b]) if formats.kinds else None)
            structs = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64())], ["kind", "start", "end", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), structs)], [id_col, "spans"])

    return base.mapInArrow(scan, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


