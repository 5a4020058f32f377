"""Rule patterns compiled to one deterministic byte automaton: parsing, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A parsed pattern: ("set", frozenset of bytes) | ("cat", [p]) | ("or", [p]) | ("rep", p, least, most or None)


class _Parser:
    """Literals, \\xNN and escaped characters, [classes], (groups), (?i:groups), |, ?, *, + and {m}, {m,}, {m,n}; bytes only."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            p = self.atom()
            while (q := self.peek()) and q in "?*+{":
                self.take()
                if q == "{":
                    body = self.s[self.i : self.s.index("}", self.i)]
                    self.i += len(body) + 1
                    low, comma, high = body.partition(",")
                    p = ("rep", p, int(low), int(high) if high else None if comma else int(low))
                else:
                    p = ("rep", p, int(q == "+"), 1 if q == "?" else None)
            parts.append(p)
        return ("cat", parts)

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def case(self, found: set[int]) -> frozenset:
        if self.fold:
            found |= {b ^ 0x20 for b in found if 65 <= (b & ~0x20) <= 90}
        return frozenset(found)

    def atom(self):
        if self.peek() == "(":
            self.take()
            fold = self.fold
            if self.s.startswith("?i:", self.i):
                self.i += 3
                self.fold = True
            p = self.either()
            self.take()
            self.fold = fold
            return p
        if self.peek() == "[":
            self.take()
            negate = self.peek() == "^"
            self.i += negate
            found: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.take()
                    found |= set(range(low, self.char() + 1))
                else:
                    found.add(low)
            self.take()
            found = set(self.case(found))
            return ("set", frozenset(set(range(256)) - found if negate else found))
        return ("set", self.case({self.char()}))


def parse(pattern: str):
    return _Parser(pattern).either()


def reverse(p):
    if p[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(p[1])])
    if p[0] == "or":
        return ("or", [reverse(x) for x in p[1]])
    return ("rep", reverse(p[1]), *p[2:]) if p[0] == "rep" else p


def shortest(p):
    """p with its last repetition cut to the fewest: it first accepts where p first accepts, from the same starts."""
    if p[0] == "cat" and p[1]:
        return ("cat", [*p[1][:-1], shortest(p[1][-1])])
    return ("rep", p[1], p[2], p[2]) if p[0] == "rep" and p[2] else p


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.by: list[list[tuple[frozenset, int]]] = []

    def new(self) -> int:
        self.free.append([])
        self.by.append([])
        return len(self.free) - 1

    def add(self, p, at: int) -> int:
        """Build p from state `at`; its end state."""
        if p[0] == "set":
            end = self.new()
            self.by[at].append((p[1], end))
            return end
        if p[0] == "cat":
            for x in p[1]:
                at = self.add(x, at)
            return at
        if p[0] == "or":
            end = self.new()
            for x in p[1]:
                start = self.new()
                self.free[at].append(start)
                self.free[self.add(x, start)].append(end)
            return end
        _, x, least, most = p
        for _ in range(least):
            at = self.add(x, at)
        end = self.new()
        self.free[at].append(end)
        if most is None:
            loop = self.new()
            self.free[at].append(loop)
            back = self.add(x, loop)
            self.free[back] += [loop, end]
        for _ in range((most or 0) - least):
            at = self.add(x, at)
            self.free[at].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """next[state * classes + class_of[byte]]; state 0 is the start, states from `accepting` on accept `accepts[state]` (bits of rules)."""

    next: np.ndarray
    class_of: np.ndarray
    classes: int
    accepting: int
    accepts: list[int]
    dead: int  # the state that nothing leaves and that accepts nothing, or -1


def compile_rules(patterns: list, anywhere: bool) -> Automaton:
    """One minimal automaton for all parsed patterns; with `anywhere`, matches may start at any byte."""
    nfa = _Nfa()
    root = nfa.new()
    ends = {}
    for bit, p in enumerate(patterns):
        start = nfa.new()
        nfa.free[root].append(start)
        ends[nfa.add(p, start)] = 1 << bit
    # bytes that no pattern tells apart share a class
    sets = list({s for by in nfa.by for s, _ in by})
    signature: dict[tuple, int] = {}
    class_of = np.zeros(256, np.uint8)
    for b in range(256):
        class_of[b] = signature.setdefault(tuple(b in s for s in sets), len(signature))
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(signature))]
    # subset construction
    begin = nfa.closure([root])
    number, order, rows = {begin: 0}, [begin], []
    for states in order:
        row = []
        for b in sample:
            to = nfa.closure([t for s in states for on, t in nfa.by[s] if b in on])
            to = to | begin if anywhere else to
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    mark = [sum({ends[s] for s in states if s in ends}) for states in order]
    # minimisation: split classes of states until their transitions agree
    table = np.array(rows)
    part = np.unique(mark, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack((part, part[table])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    first = [int(np.flatnonzero(part == k)[0]) for k in range(part.max() + 1)]
    # the start comes first, accepting states last
    ranked = sorted(range(len(first)), key=lambda k: (k != part[0], mark[first[k]] > 0, k)) if not mark[0] else list(range(len(first)))
    rank = {k: n for n, k in enumerate(ranked)}
    to = [[rank[part[t]] for t in rows[first[k]]] for k in ranked]
    accepts = [mark[first[k]] for k in ranked]
    dead = next((n for n, row in enumerate(to) if set(row) == {n} and not accepts[n]), -1)
    return Automaton(np.array(to, np.int32).ravel(), class_of, len(sample), next((n for n, a in enumerate(accepts) if a), len(accepts)), accepts, dead)


def scan(a: Automaton, data: np.ndarray, off: np.ndarray, alone: int = 8):
    """One pass over each row's bytes, many rows in step: (row, end of the byte, state) of each accepting step.

    The rows' transitions are looked up together, from the longest row down; the last `alone` rows go byte by byte.
    """
    lens = np.diff(off)
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    kind = a.class_of[data].astype(np.int32)
    at, state, n, t = off[:-1][order].copy(), np.zeros(len(order), np.int32), len(order), 0
    rows, ends, states = [], [], []
    while True:
        n = int(np.searchsorted(-lens[:n], -t, "left"))  # rows longer than t
        if n <= alone:
            break
        until = int(lens[n - 1])
        s, p = state[:n], at[:n]
        for t in range(t + 1, until + 1):
            s = a.next[s * a.classes + kind[p]]
            p += 1
            hit = s >= a.accepting
            if hit.any():
                k = np.flatnonzero(hit)
                rows.append(order[k])
                ends.append(np.full(len(k), t))
                states.append(s[k])
        state[:n] = s
        t = until
    step = a.next.tolist()
    for k in range(n):
        s, found = int(state[k]), []
        for e, c in enumerate(kind[at[k] : at[k] + lens[k] - t].tolist(), t + 1):
            s = step[s * a.classes + c]
            if s >= a.accepting:
                found.append((e, s))
        if found:
            rows.append(np.full(len(found), order[k]))
            ends.append(np.array([e for e, _ in found]))
            states.append(np.array([x for _, x in found]))
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    r, e, s = np.concatenate(rows), np.concatenate(ends), np.concatenate(states)
    k = np.lexsort((e, r))
    return r[k], e[k], s[k]
