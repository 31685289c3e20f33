"""Secret scans: one minimised automaton over bytes for all rules.

The rules' expressions become one non-deterministic automaton, that a deterministic one by subset construction, and
that the smallest one by partition refinement. A text is read once, byte by byte, through rows of the transition table.

A rule that has matched must go on from the end of its match, as leftmost non-overlapping search does. Where the end of
a match may hold the beginning of another (a key as the value of a key), each state also has the state in which this
rule alone starts anew; the construction and the refinement treat that as a further symbol. Match ends come from the
forward pass; a start is found by the rule's reversed automaton, run back from an end, which is rare. Lengths are
checked at the end of a match: counting in the automaton would multiply its states.

Rules: the three base kinds, and spans that the method adds (tokens of a fixed prefix, private key blocks). Base spans are never changed by the added ones.

Defined cases: null is empty and has no spans; offsets are code points; repeated documents each give a row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from harborscan.llm.common import documents, map_arrow, small_batches

import pyarrow as pa

# Expressions are nested tuples: ("set", bytes), ("seq", ...), ("or", ...), ("star", x), ("plus", x), ("opt", x), ("rep", x, n)
UPPER, LOWER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
ALNUM = UPPER + LOWER + DIGIT


def one(chars: bytes):
    return ("set", frozenset(chars))


def text(word: str, fold: bool = False):
    return ("seq", *(one((c.lower() + c.upper()).encode() if fold else c.encode()) for c in word))


def at_least(x, n: int):
    return ("seq", ("rep", x, n), ("star", x))


@dataclass(frozen=True)
class Rule:
    kind: str
    expression: tuple
    #: The matched bytes of a failing match are consumed, and the match dropped.
    passes: object = None
    #: A match's tail may begin another match.
    restarts: bool = False


def _value_is_long(found: bytes) -> bool:
    """At least six characters after key, quotes, spaces and the first : or =."""
    cut = min(k for k in (found.find(b":"), found.find(b"=")) if k >= 0)
    value = found[cut + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 6


_QUOTE, _SPACES = ("opt", one(b"\"'")), ("star", one(b" "))
BASE = (
    Rule(
        "assign",
        (
            "seq",
            ("or", text("password", True), text("passwd", True), text("secret", True), text("token", True), ("seq", text("api", True), ("opt", one(b"_")), text("key", True))),
            _QUOTE, _SPACES, one(b":="), _SPACES, _QUOTE,
            ("plus", one(ALNUM + b"+/_.=-")),
        ),
        _value_is_long,
        True,
    ),
    Rule("access", ("seq", text("AKIA"), ("plus", one(UPPER + DIGIT))), lambda x: len(x) >= 20),
    Rule("hex", at_least(one(DIGIT + b"abcdef"), 8), lambda x: len(x) >= 24),
)
ADDED = (
    Rule("forge_token", ("seq", text("gh"), one(b"pousr"), text("_"), ("plus", one(ALNUM))), lambda x: len(x) >= 40),
    Rule("key_block", ("seq", text("-----BEGIN "), ("star", one(UPPER + b" ")), text("PRIVATE KEY-----"))),
)
RULES = BASE + ADDED


def reverse(x):
    kind, *rest = x
    if kind == "set":
        return x
    if kind == "rep":
        return (kind, reverse(rest[0]), rest[1])
    return (kind, *(map(reverse, reversed(rest)) if kind == "seq" else map(reverse, rest)))


class Nfa:
    """Thompson's construction: edges by byte set and empty edges."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, x, start: int) -> int:
        """Build x from start on; the state where it ends."""
        kind, *rest = x
        if kind == "set":
            end = self.state()
            self.edges[start].append((rest[0], end))
            return end
        if kind == "seq":
            for part in rest:
                start = self.add(part, start)
            return start
        if kind == "rep":
            for _ in range(rest[1]):
                start = self.add(rest[0], start)
            return start
        end = self.state()
        if kind == "or":
            for part in rest:
                self.empty[self.add(part, start)].append(end)
            return end
        inner = self.state()
        self.empty[start].append(inner)
        last = self.add(rest[0], inner)
        self.empty[last].append(end)
        if kind != "opt":
            self.empty[last].append(inner)
        if kind != "plus":
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton of the rules; unanchored ones may start at any byte.

    rows[s][c]: the next state for byte class c. classes: byte -> class. accepts[s]: bits of the rules that match here.
    again[k][s]: s with rule k started anew, for the rules of restarts.
    """

    def __init__(self, expressions: list, unanchored: bool = True, restarts: tuple[int, ...] = ()):
        nfa, starts, ends, owned = Nfa(), [], {}, []
        for k, x in enumerate(expressions):
            first = nfa.state()
            starts.append(first)
            ends[nfa.add(x, first)] = k
            owned += [k] * (len(nfa.empty) - len(owned))
        sets = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {s: c for c, s in enumerate(dict.fromkeys(signature))}
        self.classes = bytes(kinds[s] for s in signature)
        sample = [signature.index(s) for s in kinds]
        begin = nfa.closure(starts) & (frozenset(s for s, edges in enumerate(nfa.edges) if edges) | ends.keys())
        fresh = [nfa.closure([s]) for s in starts]
        numbers, order, moves = {begin: 0}, [begin], []
        always = begin if unanchored else frozenset()
        step = [[frozenset().union(*(nfa.closure([t]) for chars, t in edges if byte in chars)) for byte in sample] for edges in nfa.edges]
        moving = [s for s, edges in enumerate(nfa.edges) if edges]
        matters = frozenset(moving) | ends.keys()
        while len(moves) < len(order):  # subset construction; states without edges or ends tell nothing
            now, row = order[len(moves)], []
            live = [step[s] for s in now if nfa.edges[s]]
            targets = [(always.union(*(x[c] for x in live))) & matters for c in range(len(sample))]
            targets += [(frozenset(s for s in now if owned[s] != k) | fresh[k]) & matters for k in restarts]
            for t in targets:
                if t not in numbers:
                    numbers[t] = len(order)
                    order.append(t)
                row.append(numbers[t])
            moves.append(row)
        bits = [sum(1 << ends[s] for s in states if s in ends) for states in order]
        part = {b: i for i, b in enumerate(sorted(set(bits)))}
        block = [part[b] for b in bits]
        while True:  # refine until states of a block go to the same blocks
            keys = [(block[s], *(block[t] for t in moves[s])) for s in range(len(order))]
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            refined = [names[k] for k in keys]
            if len(names) == len(set(block)):
                break
            block = refined
        n, c = len(set(block)), len(sample)
        self.rows, self.accepts = [None] * n, [0] * n
        self.again = {k: [0] * n for k in restarts}
        self.start = block[0]
        for s, b in enumerate(block):
            self.rows[b] = [block[t] for t in moves[s][:c]]
            self.accepts[b] = bits[s]
            for i, k in enumerate(restarts):
                self.again[k][b] = block[moves[s][c + i]]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.forward = Automaton([r.expression for r in rules], restarts=tuple(k for k, r in enumerate(rules) if r.restarts))
        self.backward = [Automaton([reverse(r.expression)], unanchored=False) for r in rules]
        # Transition arrays for one loop: a state is its row, a list whose entries are rows; the last holds the number.
        a = self.forward
        self.table = [[None] * len(row) + [s] for s, row in enumerate(a.rows)]
        for s, row in enumerate(a.rows):
            for c, t in enumerate(row):
                self.table[s][c] = self.table[t]
        self.hot = [bool(x) for x in a.accepts]
        #: Each row's next rows are marked hot when they accept: only then does the loop leave its fast path.
        for s, row in enumerate(self.table):
            row.append(self.hot[s])

    def _start(self, k: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start, from least on, of a match of rule k that ends at end; -1 if none."""
        a = self.backward[k]
        rows, classes, state, best = a.rows, a.classes, a.start, -1
        dead = [not acc and all(t == s for t in row) for s, (row, acc) in enumerate(zip(rows, a.accepts, strict=True))]
        for i in range(end - 1, least - 1, -1):
            state = rows[state][classes[data[i]]]
            if a.accepts[state]:
                best = i
            elif dead[state]:
                break
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, of the matches that pass, by start and then by rule."""
        a, found = self.forward, []
        classed = data.translate(a.classes)
        table, accepts, again = self.table, a.accepts, a.again
        last_end = [0] * len(self.rules)
        row, active, i = table[a.start], 0, 0
        for c in classed:
            after = row[c]
            if active or after[-1]:
                now = accepts[after[-2]]
                ended = active & ~now
                if ended:
                    k, state = 0, row[-2]
                    while ended >> k:
                        if ended >> k & 1:
                            self._close(k, data, i, last_end, found)
                            state = again[k][state] if k in again else state
                        k += 1
                    after = table[state][c]
                    now = accepts[after[-2]]
                active = now
            row = after
            i += 1
        k = 0
        while active >> k:
            if active >> k & 1:
                self._close(k, data, i, last_end, found)
            k += 1
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _close(self, k: int, data: bytes, end: int, last_end: list[int], found: list) -> None:
        start = self._start(k, data, end, last_end[k])
        last_end[k] = end
        if start >= 0 and (self.rules[k].passes is None or self.rules[k].passes(data[start:end])):
            found.append((start, end, k))

    def spans(self, data: bytes | None) -> list[tuple[int, int, int]]:
        """As scan, in code points."""
        if not data:
            return []
        found = self.scan(data)
        if found and not data.isascii():
            cuts, at, points = {}, 0, 0
            for x in sorted({x for s in found for x in s[:2]}):
                points += len(data[at:x].decode())
                at = x
                cuts[x] = points
            found = [(cuts[s], cuts[e], k) for s, e, k in found]
        return found


_built: dict[int, Scanner] = {}


def scanner() -> Scanner:
    """Compiled once for each Python worker."""
    return _built.setdefault(0, _built.get(0) or Scanner())


def _joined(spans, rules=RULES) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, e, k in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def each(batches):
        scan = scanner()
        for b in batches:
            out = defaultdict(list)
            for data in b.column(1).to_pylist():
                found = scan.spans(data)
                base = [x for x in found if x[2] < len(BASE)]
                for k, rule in enumerate(BASE):
                    out[f"n_{rule.kind}"].append(sum(x[2] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(found))
            yield {"doc_id": b.column(0), **{n: out[n] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}}

    return map_arrow(documents(docs), each, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(data: bytes | None, found: list[tuple[int, int, int]], rules=RULES) -> bytes | None:
    """data with each group of overlapping byte spans replaced by <kind> of its first span."""
    out, at = [], 0
    for start, end, k in found:
        if start >= at:
            out += [data[at:start], f"<{rules[k].kind}>".encode()]
        at = max(at, end)
    return b"".join(out) + data[at:] if found else data


def masked_documents(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, with secrets in text masked; n_chars, where present, follows the text."""
    small_batches(docs.sparkSession)

    def run(batches):
        scan = scanner()
        for b in batches:
            names = b.schema.names
            old = b.column(names.index("text")).cast(pa.binary()).to_pylist()
            new = [mask(x, scan.scan(x)) if x else x for x in old]
            columns = list(b.columns)
            kind = b.schema.field("text").type
            columns[names.index("text")] = pa.array(new, pa.binary()).cast(kind)
            if "n_chars" in names:
                f = b.schema.field("n_chars")
                was = b.column(names.index("n_chars")).to_pylist()
                columns[names.index("n_chars")] = pa.array([w if x is y or x == y else len(x.decode()) for w, x, y in zip(was, new, old, strict=True)], f.type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
