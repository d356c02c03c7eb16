"""Secret scans: one deterministic automaton for all rules, run over the bytes of many texts at a time.

A rule is a head and a run: a regular expression, then one or more bytes of a class. Its matches are the
leftmost non-overlapping ones, as long as they go; those with fewer than ``least`` bytes in the run are
dropped, but the text they took stays taken.

Compilation. Heads are parsed into a nondeterministic automaton. For each rule the subset construction
keeps threads in the order of their starts: when one reaches the run, all later ones go; while it is in
the run it stays, and the first byte beyond the run starts the search anew. The rules' automata are
combined state by state, bytes that no rule tells apart share a class, and partition refinement merges
states that give equal labels on all continuations. What is left is one transition array and one label
for each state: the set of rules that are in their run.

Scan. Texts are cut behind bytes that lead every state to the first one; the pieces go through the
array side by side, one byte of each at a step. Where a rule's bit rises its run begins, where it falls
the match ends. The match's start is found from the run's begin backwards, by the automaton of the
reversed head, for those matches that are long enough.

A rule is refused (ValueError) if a later start could reach its run while an earlier one is still open,
as one pass can't tell then which is leftmost; none of ``RULES`` is of that kind.

Defined cases: a null text is empty and has no spans; matches never cross texts; offsets are code
points, ends exclusive; rows that agree in id and text get equal spans; an empty table gives an empty
one; a long text without a byte that resets is one piece and is walked alone. Other columns, whatever
their names, come through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, map_batches, packed, table

PIECE, FEW = 256, 24
GAP = ord("\n")


class Rule(NamedTuple):
    kind: str
    head: str
    run: str
    least: int


def either_case(text: str) -> str:
    """A literal that matches ASCII letters in both cases."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in text)


#: The first three are the base rules; then formats that common services publish for their keys.
RULES = (
    Rule("assign", "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r")[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 16),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)?PRIVATE\x20KEY", "-", 5),
)


class Expression:
    """A regular expression over bytes as a nondeterministic automaton: literals, escapes, classes, groups, | ? * +."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.free: list[list[int]] = []  # moves without a byte, most wanted first
        self.byte: list[list[tuple[frozenset, int]]] = []
        self.first, self.last = self._choice()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} of {pattern!r}")

    def _state(self) -> int:
        self.free.append([])
        self.byte.append([])
        return len(self.free) - 1

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _next(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def _choice(self) -> tuple[int, int]:
        arms = [self._sequence()]
        while self._peek() == "|":
            self._next()
            arms.append(self._sequence())
        if len(arms) == 1:
            return arms[0]
        a, b = self._state(), self._state()
        for x, y in arms:
            self.free[a].append(x)
            self.free[y].append(b)
        return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self._state()
        while self._peek() not in ("", "|", ")"):
            x, y = self._repeated()
            self.free[b].append(x)
            b = y
        return a, b

    def _repeated(self) -> tuple[int, int]:
        x, y = self._atom()
        sign = self._peek()
        if sign not in ("?", "*", "+") or not sign:
            return x, y
        self._next()
        a, b = self._state(), self._state()
        self.free[a].append(x)
        if sign != "?":
            self.free[y].append(x)
        self.free[y].append(b)
        if sign != "+":
            self.free[a].append(b)
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self._next()
        if c == "(":
            found = self._choice()
            if self._next() != ")":
                raise ValueError(f"a group of {self.text!r} is not closed")
            return found
        if c in "?*+)":
            raise ValueError(f"nothing to repeat at {self.at - 1} of {self.text!r}")
        accepted = self._class() if c == "[" else frozenset([self._escape() if c == "\\" else ord(c)])
        a, b = self._state(), self._state()
        self.byte[a].append((accepted, b))
        return a, b

    def _escape(self) -> int:
        c = self._next()
        return int(self._next() + self._next(), 16) if c == "x" else ord(c)

    def _class(self) -> frozenset:
        out: set[int] = set()
        while (c := self._next()) != "]":
            lo = self._escape() if c == "\\" else ord(c)
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self._next()
                c = self._next()
                out.update(range(lo, (self._escape() if c == "\\" else ord(c)) + 1))
            else:
                out.add(lo)
        return frozenset(out)

    def reach(self, states: list[int]) -> tuple[int, ...]:
        """All states that moves without a byte lead to, in order of preference."""
        seen: dict[int, None] = {}
        todo = list(reversed(states))
        while todo:
            s = todo.pop()
            if s not in seen:
                seen[s] = None
                todo.extend(reversed(self.free[s]))
        return tuple(seen)

    def step(self, states: tuple[int, ...], b: int) -> list[int]:
        return [t for s in states for accepted, t in self.byte[s] if b in accepted]

    def reversed(self) -> Expression:
        out = object.__new__(Expression)
        out.text, out.at, n = self.text, self.at, len(self.free)
        out.free, out.byte = [[] for _ in range(n)], [[] for _ in range(n)]
        for s in range(n):
            for t in self.free[s]:
                out.free[t].append(s)
            for accepted, t in self.byte[s]:
                out.byte[t].append((accepted, s))
        out.first, out.last = self.last, self.first
        return out


class Search:
    """One rule's search, determinised as it is asked: states are tuples of threads in order of their starts."""

    RUN = ("run",)

    def __init__(self, rule: Rule):
        self.head, self.rule = Expression(rule.head), rule
        self.run = frozenset().union(*(x for moves in Expression(rule.run).byte for x, _ in moves))
        self.origin = self.head.reach([self.head.first])
        self.start: tuple = ()

    def step(self, state: tuple, b: int) -> tuple:
        if state == self.RUN:
            if b in self.run:
                return state
            state = self.start
        # One thread for each start that is open, earliest first; the newest begins at this byte.
        out: list[tuple[int, ...]] = []
        met: set[int] = set()
        for thread in (*state, self.origin):
            if self.head.last in thread and b in self.run:
                if out:
                    raise ValueError(f"rule {self.rule.kind}: a later start may reach the run first")
                return self.RUN
            now = tuple(s for s in self.head.reach(self.head.step(thread, b)) if s not in met)
            if now:
                met.update(now)
                out.append(now)
        return tuple(out)


def minimal(table: np.ndarray, label: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and labels with equal states merged, the start state first."""
    _, part = np.unique(label, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    order[part[start]] = 0
    rest = [p for p in range(len(order)) if order[p] < 0]
    order[rest] = np.arange(1, len(order))
    part = order[part]
    _, one = np.unique(part, return_index=True)
    return part[table[one]], label[one]


class Automaton:
    """Byte classes, transitions and labels of all rules together, and the reversed heads."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        searches = [Search(r) for r in rules]
        sets = [x for s in searches for moves in s.head.byte for x, _ in moves] + [s.run for s in searches]
        sign = [tuple(b in x for x in sets) for b in range(256)]
        names = {s: i for i, s in enumerate(dict.fromkeys(sign))}
        self.cls = np.array([names[s] for s in sign], np.uint8)
        sample = [sign.index(s) for s in names]
        memo: dict = {}

        def one(k: int, state: tuple, c: int) -> tuple:
            key = k, state, c
            if key not in memo:
                memo[key] = searches[k].step(state, sample[c])
            return memo[key]

        start = tuple(s.start for s in searches)
        index, todo, rows = {start: 0}, [start], []
        for state in todo:  # grows as it goes
            row = []
            for c in range(len(sample)):
                now = tuple(one(k, s, c) for k, s in enumerate(state))
                if now not in index:
                    index[now] = len(index)
                    todo.append(now)
                row.append(index[now])
            rows.append(row)
        label = np.array([sum(1 << k for k, s in enumerate(state) if s == Search.RUN) for state in index])
        self.n_subsets = len(index)
        self.table, self.label = minimal(np.array(rows), label)
        self.width = len(sample)
        self.resets = np.flatnonzero((self.table == 0).all(axis=0)[self.cls])
        if GAP not in self.resets:
            raise ValueError("a rule may match across lines; texts could not be told apart")
        self.step = (self.table * self.width).astype(np.int32).ravel()
        self.back = [self._reverse(s.head.reversed()) for s in searches]

    def _reverse(self, head: Expression) -> tuple[np.ndarray, np.ndarray]:
        """Transitions (state, byte) and acceptance of the reversed head, read from its end; the last state is dead."""
        start = tuple(sorted(head.reach([head.first])))
        index, todo, rows = {start: 0}, [start], []
        for state in todo:
            row = []
            for b in range(256):
                now = tuple(sorted(head.reach(head.step(state, b))))
                if now not in index:
                    index[now] = len(index)
                    todo.append(now)
                row.append(index[now])
            rows.append(row)
        if () not in index:
            index[()] = len(index)
            rows.append([index[()]] * 256)
        # The label tells dead from alive too, so that a scan knows when to end.
        table, label = minimal(np.array(rows), np.array([2 * (not s) + (head.last in s) for s in index]))
        return table, label

    def labels(self, data: np.ndarray) -> np.ndarray:
        """The label after each byte; ``data`` ends with a byte that resets."""
        cls = self.cls[data]
        cut = np.zeros(256, bool)
        cut[self.resets] = True
        cuts = np.flatnonzero(cut[data]) + 1
        # Pieces of about PIECE bytes, each ended by a byte that resets.
        want = np.searchsorted(cuts, np.arange(PIECE, len(data) + PIECE, PIECE))
        ends = cuts[np.unique(np.minimum(want, len(cuts) - 1))]
        begins = np.concatenate([[0], ends[:-1]])
        size = ends - begins
        order = np.argsort(-size, kind="stable")
        at, size = begins[order], size[order]
        out = np.zeros(len(data), np.int32)
        state = np.zeros(len(at), np.int32)
        live_at = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # pieces longer than i
        i, longest = 0, int(size[0])
        while i < longest and (live := int(live_at[i])) > FEW:
            place = at[:live] + i
            state = self.step[state[:live] + cls[place]]
            out[place] = state
            i += 1
        if i < longest:
            step = self.step.tolist()
            for k in range(int(live_at[i])):
                s, found = int(state[k]), []
                for c in cls[at[k] + i : at[k] + size[k]].tolist():
                    s = step[s + c]
                    found.append(s)
                out[at[k] + i : at[k] + size[k]] = found
        return self.label[out // self.width]

    def starts(self, k: int, data: np.ndarray, heads_end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Leftmost start, at ``bound`` or after, of a head of rule k that ends at each place."""
        table, label = self.back[k]
        state = np.zeros(len(heads_end), np.int64)
        best = np.where(label[state] & 1, heads_end, -1)
        at, rows = heads_end.copy(), np.arange(len(heads_end))
        while len(rows):
            rows = rows[at[rows] > bound[rows]]
            at[rows] -= 1
            state[rows] = table[state[rows], data[at[rows]]]
            found = label[state[rows]]
            best[rows[(found & 1) > 0]] = at[rows[(found & 1) > 0]]
            rows = rows[found < 2]
        return best


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


def scan(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, rule, start, end) of all spans, by text, start and rule; offsets in code points of the text."""
    n = len(offsets) - 1
    # A byte that resets stands behind each text.
    room = np.full(len(data) + n, GAP, np.uint8)
    room[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    begin = offsets[:-1] + np.arange(n)
    label = automaton.labels(room).astype(np.int32) if len(room) else np.zeros(0, np.int32)
    change = label.copy()
    change[1:] ^= label[:-1]
    edges = np.flatnonzero(change)
    found = []
    for k, rule in enumerate(automaton.rules):
        mine = edges[(change[edges] >> k & 1) > 0]
        run, end = mine[0::2], mine[1::2]  # a run begins, and the byte behind it
        good = end - run >= rule.least
        if not good.any():
            continue
        before = np.concatenate([[0], end[:-1]])[good]
        run, end = run[good], end[good]
        text = np.searchsorted(begin, run, side="right") - 1
        start = automaton.starts(k, room, run, np.maximum(before, begin[text]))
        found.append((text, np.full(len(run), k), start, end))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    text, kind, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    chars = np.concatenate([[0], np.cumsum((room & 0xC0) != 0x80)])
    order = np.lexsort((kind, start, text))
    text, kind, start, end = (x[order] for x in (text, kind, start, end))
    first = chars[begin[text]]
    return text, kind, chars[start] - first, chars[end] - first


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: row (all its columns), and spans (kind, start, end) by start, then by the order of the rules."""
    # Compiled here: bad rules are refused before any task, and the arrays' size depends on the rules alone.
    shared = docs.sparkSession.sparkContext.broadcast(compiled(rules))
    rows = packed(docs).select("row")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = shared.value, pa.array([r.kind for r in rules])
        for part in parts:
            row = part.column("row")
            for i, j, data, offsets in batches(pc.struct_field(row, "text")):
                text, kind, start, end = scan(automaton, data, offsets)
                cuts = pa.array(np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32))
                spans = pa.StructArray.from_arrays([names.take(pa.array(kind)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([row.slice(i, j - i), pa.ListArray.from_arrays(cuts, spans)], ["row", "spans"])

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return map_batches(rows, run, T.StructType([rows.schema["row"], T.StructField("spans", spans)]))


BASE = ("assign", "access", "hex")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    named = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "row.doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(named(of(*BASE)), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """Positions from what a split leaves between matches; the run's length from the run as a group."""
    quoted = lambda x: x.replace("'", "''")
    parts = []
    for k, r in enumerate(RULES):
        head = quoted(r.head.replace("(", "(?:").replace('\\"', '"'))
        parts.append(
            f"SELECT rn, {k} AS k, '{r.kind}' AS kind, regexp_extract_all(text, '{head}(?:{r.run})+') AS m, regexp_extract_all(text, '{head}((?:{r.run})+)', 1) AS g, string_split_regex(text, '{head}(?:{r.run})+') AS s, {r.least} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
p AS ({" UNION ALL ".join(parts)}),
x AS (SELECT rn, k, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(s[1 : len(m)]) AS s, unnest(generate_series(1, len(m))) AS i FROM p WHERE len(m) > 0),
y AS (SELECT rn, k, kind, i, length(g) >= least AS good, length(m) AS n, sum(length(s) + length(m)) OVER (PARTITION BY rn, k ORDER BY i) - length(m) AS start FROM x),
z AS (SELECT rn, k, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM y WHERE good),
a AS (SELECT rn, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
      string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM z GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.rn = d.rn
"""


OP11_SQL = _sql()
