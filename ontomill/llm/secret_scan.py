"""Secrets found by one deterministic automaton that holds all rules.

Every rule is a regular expression over bytes. It is read into a nondeterministic
automaton; subset construction makes a deterministic one that looks for the leftmost
match, takes the longest, and starts again behind it. The rules' automata are run side
by side as one product automaton, which is minimised and laid out as a flat transition
array over byte classes. A text is scanned once, byte by byte, for all rules together.

The array tells where matches end. A match's start is found by walking the rule's
reversed automaton back from its first accepting byte; that is done for matches only.

The scan never looks back, so a rule must allow this; ``compile_rules`` refuses others:

* a match that can end goes on with bytes that can end it as well (``[a-z]+`` as the
  last part, or a fixed last part), so its end is known at the first byte that does not fit;
* no match that began earlier is still open when a later one can end;
* a match has two bytes or more.

The tables depend on the rules alone; they are built once and sent with the tasks. The
product grows with each rule that counts or restarts, so lists of many rules are best
scanned in groups; the seven rules here take some 2,800 states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.common import slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of ``pattern`` with fewer than ``least`` bytes from the
    first byte that can end them are dropped, but use up their text all the same."""

    kind: str
    pattern: str
    least: int = 1
    either_case: bool = False


BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        least=6,
        either_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE + (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=10),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=36),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=10),
)


# ---- patterns to nondeterministic automata ----


class _Nfa:
    """States with moves on sets of bytes and moves without a byte."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, states, byte: int) -> frozenset:
        return self.closure({to for s in states for on, to in self.moves[s] if byte in on})

    def reversed(self) -> _Nfa:
        back = _Nfa()
        for _ in self.moves:
            back.state()
        for s, moves in enumerate(self.moves):
            for on, to in moves:
                back.moves[to].append((on, s))
            for to in self.free[s]:
                back.free[to].append(s)
        return back


class _Reader:
    """Reads literals, ``\\xNN``, classes, groups, ``|`` and ``? * + {m} {m,} {m,n}``."""

    def __init__(self, rule: Rule):
        self.text, self.at, self.either_case = rule.pattern, 0, rule.either_case
        self.nfa = _Nfa()

    def whole(self) -> tuple[_Nfa, int, int]:
        first, last = self._choice()()
        if self.at < len(self.text):
            raise ValueError(f"unread pattern: {self.text[self.at :]!r}")
        return self.nfa, first, last

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    # Each part is a function that adds a new copy of itself and returns its two ends.
    def _choice(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._take()
            parts.append(self._sequence())

        def build():
            first, last = self.nfa.state(), self.nfa.state()
            for part in parts:
                a, b = part()
                self.nfa.free[first].append(a)
                self.nfa.free[b].append(last)
            return first, last

        return parts[0] if len(parts) == 1 else build

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated(self._single()))

        def build():
            first = last = self.nfa.state()
            for part in parts:
                a, b = part()
                self.nfa.free[last].append(a)
                last = b
            return first, last

        return build

    def _repeated(self, part):
        sign = self._peek()
        if sign not in ("?", "*", "+", "{") or not sign:
            return part
        self._take()
        if sign == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at : end].partition(",")
            self.at = end + 1
            least, most = int(low), int(high) if high else (None if comma else int(low))
        else:
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]

        def build():
            nfa = self.nfa
            first = last = nfa.state()
            for i in range(max(least, most or 0, 1)):
                a, b = part()
                nfa.free[last].append(a)
                if i >= least:
                    nfa.free[last].append(b)
                last = b
            if most is None:
                nfa.free[last].append(a)
            return first, last

        return build

    def _single(self):
        sign = self._take()
        if sign == "(":
            part = self._choice()
            if self._peek() != ")":
                raise ValueError("a group is not closed")
            self._take()
            return part
        if sign == "[":
            on = self._class()
        else:
            on = {self._byte(sign)}
        if self.either_case:
            on = on | {ord(c) for b in on if b < 128 for c in (chr(b).lower(), chr(b).upper())}
        on = frozenset(on)

        def build():
            first, last = self.nfa.state(), self.nfa.state()
            self.nfa.moves[first].append((on, last))
            return first, last

        return build

    def _class(self) -> set[int]:
        negated = self._peek() == "^"
        if negated:
            self._take()
        on: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte(self._take())
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self._take()
                high = self._byte(self._take())
            on.update(range(low, high + 1))
        self._take()
        return set(range(256)) - on if negated else on

    def _byte(self, sign: str) -> int:
        if sign == "\\":
            sign = self._take()
            if sign == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(sign) > 127:
            raise ValueError("patterns are ASCII; name other bytes by \\xNN")
        return ord(sign)


# ---- deterministic automata ----


class _Search:
    """One rule as a deterministic search.

    A state is the tuple of the sets of states that matches begun at different places
    have reached, the earliest first. A place's set leaves out what an earlier one has
    reached, as the two end together and the earlier is the match.
    """

    def __init__(self, rule: Rule):
        self.rule = rule
        self.nfa, first, self.last = _Reader(rule).whole()
        self.begin = self.nfa.closure({first})
        if self.last in self.begin or any(
            self.last in self.nfa.step(self.begin, b) for b in range(256)
        ):
            raise ValueError(f"{rule.kind}: a match needs two bytes or more")
        back = self.nfa.reversed()
        self.back, self.back_first, self.back_last = back, back.closure({self.last}), first

    def accepts(self, state: tuple) -> bool:
        return bool(state) and self.last in state[0]

    def next(self, state: tuple, byte: int) -> tuple:
        if self.accepts(state):
            onward = self.nfa.step(state[0], byte)
            if onward:
                if self.last not in onward:
                    raise ValueError(f"{self.rule.kind}: a match goes on behind a possible end")
                return (onward,)
            state = ()
        seen: set[int] = set()
        groups = []
        for group in (*state, self.begin):
            group = self.nfa.step(group, byte) - seen
            if group:
                seen |= group
                groups.append(group)
        ended = [i for i, group in enumerate(groups) if self.last in group]
        if ended and ended[0] > 0:
            raise ValueError(f"{self.rule.kind}: an earlier match is open when one ends")
        return (groups[0],) if ended else tuple(groups)


def _byte_classes(searches: list[_Search]) -> tuple[bytes, list[int]]:
    """The class of each byte, and one byte of each class; no rule tells these apart."""
    sets = {on for s in searches for moves in s.nfa.moves for on, _ in moves}
    sets = sorted(sets, key=sorted)
    kinds: dict[tuple, int] = {}
    members, classes = [], bytearray(256)
    for byte in range(256):
        kind = tuple(byte in on for on in sets)
        if kind not in kinds:
            kinds[kind] = len(kinds)
            members.append(byte)
        classes[byte] = kinds[kind]
    return bytes(classes), members


def _subsets(begin, step, members: list[int]) -> tuple[list, np.ndarray]:
    """All states reached from ``begin`` and the table of their moves."""
    number, states, table = {begin: 0}, [begin], []
    for state in states:  # grows while it is read
        row = []
        for byte in members:
            to = step(state, byte)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        table.append(row)
    return states, np.array(table)


def _minimise(table: np.ndarray, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart: split by output, then by moves, to the end."""
    block = np.unique(outputs, return_inverse=True)[1].ravel()
    while True:
        signs = np.column_stack([block, block[table]])
        _, first, finer = np.unique(signs, axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            return finer[table[first]], first
        block = finer


@dataclass(frozen=True)
class Automaton:
    """The compiled rules. States are numbered by steps of the number of byte classes, so
    ``table[state + class]`` is the next one; those from ``hits`` on end some match."""

    rules: tuple[Rule, ...]
    classes: bytes
    table: list[int]
    start: int
    hits: int
    ends: dict[int, int]
    back: tuple[tuple[list[int], int, frozenset], ...]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in bytes of every match that is long enough, in order."""
        table, hits, ends = self.table, self.hits, self.ends
        coded = data.translate(self.classes)
        state, open_, found = self.start, 0, []
        since = [0] * len(self.rules)  # where the open match can first end, by rule
        free = [0] * len(self.rules)  # the end of the last match, by rule
        steps = enumerate(coded)
        for at, sign in steps:
            state = table[state + sign]
            if state < hits:
                continue
            while True:  # from here until no rule is at a possible end
                now = ends.get(state, 0)
                if now != open_:
                    for rule in range(len(self.rules)):
                        if (now & ~open_) >> rule & 1:
                            since[rule] = at
                        elif (open_ & ~now) >> rule & 1:
                            self._close(coded, rule, since, free, at, found)
                    open_ = now
                if not now:
                    break
                at, sign = next(steps, (len(coded), None))
                if sign is None:
                    for rule in range(len(self.rules)):
                        if open_ >> rule & 1:
                            self._close(coded, rule, since, free, at, found)
                    break
                state = table[state + sign]
        found.sort()
        return found

    def _close(self, coded, rule, since, free, end, found) -> None:
        if end - since[rule] >= self.rules[rule].least:
            found.append((self._begin(coded, rule, free[rule], since[rule]), rule, end))
        free[rule] = end

    def _begin(self, coded: bytes, rule: int, floor: int, at: int) -> int:
        """The earliest start, not before ``floor``, of a match that ends with byte ``at``."""
        table, dead, accepting = self.back[rule]
        state, begin = 0, at
        while at >= floor:
            state = table[state + coded[at]]
            if state == dead:
                break
            if state in accepting:
                begin = at
            at -= 1
        return begin


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """One automaton for all ``rules``; raises ValueError for a rule it cannot scan."""
    searches = [_Search(rule) for rule in rules]
    classes, members = _byte_classes(searches)
    width = len(members)
    parts, begin = [], []
    for search in searches:
        states, table = _subsets((), search.next, members)
        table, first = _minimise(table, np.array([search.accepts(s) for s in states]))
        parts.append(([row.tolist() for row in table], [search.accepts(states[i]) for i in first]))
        begin.append(_block_of_start(first))

    column = {byte: n for n, byte in enumerate(members)}

    def step(state: tuple, byte: int) -> tuple:
        at = column[byte]
        return tuple(part[0][s][at] for part, s in zip(parts, state))

    states, table = _subsets(tuple(begin), step, members)
    outputs = np.array(
        [sum(part[1][s] << n for n, (part, s) in enumerate(zip(parts, state))) for state in states]
    )
    table, first = _minimise(table, outputs)
    outputs = outputs[first]
    order = np.argsort(outputs != 0, kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    start = _block_of_start(first)
    return Automaton(
        rules,
        classes,
        (place[table[order]] * width).ravel().tolist(),
        int(place[start]) * width,
        int((outputs == 0).sum()) * width,
        {int(place[n]) * width: int(o) for n, o in enumerate(outputs) if o},
        tuple(_backward(search, members) for search in searches),
    )


def _block_of_start(first: np.ndarray) -> int:
    """The block of state 0, where the search begins, among those ``_minimise`` gives."""
    return int(np.flatnonzero(first == 0)[0])


def _backward(search: _Search, members: list[int]) -> tuple[list[int], int, frozenset]:
    """The reversed rule as ``(table, dead state, states at which a match may begin)``."""
    states, table = _subsets(search.back_first, search.back.step, members)
    width = len(members)
    dead = next((n * width for n, s in enumerate(states) if not s), -1)
    begins = frozenset(n * width for n, s in enumerate(states) if search.back_last in s)
    return (table * width).ravel().tolist(), dead, begins


# ---- texts ----


def _characters(data: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each of the byte places."""
    if data.isascii():
        return {p: p for p in places}
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += len(data[at:place].decode("utf-8", "replace"))
        out[place], at = n, place
    return out


def find_spans(automaton: Automaton, data: bytes | None) -> list[dict]:
    """All secrets of a UTF-8 text in code points, by start, then in the order of the rules."""
    found = automaton.scan(data) if data else []
    if not found:
        return []
    at = _characters(data, [p for start, _, end in found for p in (start, end)])
    return [
        {"kind": automaton.rules[rule].kind, "start": at[start], "end": at[end]}
        for start, rule, end in found
    ]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, with_text: bool = False
) -> DataFrame:
    """``(doc_id, spans)``: every row of ``docs`` with the secrets of its whole text.

    ``spans`` holds ``kind``, ``start`` and ``end`` (code points, end exclusive) by start,
    then in the order of ``rules``; spans of one kind never overlap, those of different
    kinds may. A null or empty text has none. ``with_text`` adds ``text`` as it is. Null and
    repeated ids are rows like any other; nothing is shuffled. Other columns are ignored.
    """
    automaton = compile_rules(rules)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "text"] if with_text else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            coded = part.column(1).cast(pa.binary())
            spans = pa.array([find_spans(automaton, value.as_py()) for value in coded], _SPANS)
            yield pa.record_batch([*part.columns[: len(names)], spans], names=[*names, "spans"])

    types = [f"{name} {source.schema[name].dataType.simpleString()}" for name in names]
    spans = "spans array<struct<kind: string, start: bigint, end: bigint>>"
    return source.mapInArrow(run, ", ".join([*types, spans]))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, text)``: the texts with each secret replaced by ``[kind]``.

    Where spans overlap, the part that no earlier span covers goes without a mark. A null
    text stays null.
    """
    masked = F.expr(
        """aggregate(spans, struct('' as done, 0L as at),
             (a, s) -> struct(
               concat(a.done,
                      substring(text, cast(a.at + 1 as int), cast(greatest(s.start - a.at, 0) as int)),
                      if(s.start >= a.at, concat('[', s.kind, ']'), '')) as done,
               greatest(a.at, s.end) as at),
             a -> concat(a.done, substring(text, cast(a.at + 1 as int))))"""
    )
    return scan(docs, rules, with_text=True).select("doc_id", masked.alias("text"))
