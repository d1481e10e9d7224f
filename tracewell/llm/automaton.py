"""Rule expressions compiled into one minimal deterministic automaton over bytes.

Expressions know literals, ``\\xHH`` and ``\\`` escapes, classes ``[...]`` with ranges
and ``^``, groups, ``|``, and the repeats ``? * + {m} {m,} {m,n}``. They are turned
into a non-deterministic automaton, by subset construction into a deterministic one, and
minimised by refining the partition of its states.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Nfa:
    """Transitions ``state -> [(bytes, state)]``, with None for a free move."""

    moves: list[list[tuple[frozenset[int] | None, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def add(self, a: int, on: frozenset[int] | None, b: int) -> None:
        self.moves[a].append((on, b))


class _Reader:
    """Recursive descent over an expression, which yields a small tree."""

    def __init__(self, text: str, either_case: bool):
        self.text, self.at, self.either = text, 0, either_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def bytes_of(self, low: int, high: int) -> set[int]:
        found = set(range(low, high + 1))
        if self.either:
            for x in list(found):
                if chr(x).isalpha() and x < 128:
                    found |= {ord(chr(x).lower()), ord(chr(x).upper())}
        return found

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def any_of(self):
        parts = [self.run()]
        while self.peek() == "|":
            self.take()
            parts.append(self.run())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def run(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat())
        return ("then", parts)

    def repeat(self):
        one = self.single()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                one = ("times", one, int(low), (int(high) if high else None) if comma else int(low))
            else:
                one = ("times", one, {"?": 0, "*": 0, "+": 1}[c], 1 if c == "?" else None)
        return one

    def single(self):
        c = self.take()
        if c == "(":
            one = self.any_of()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text}")
            return one
        if c == "[":
            return ("on", frozenset(self.in_class()))
        x = self.escaped() if c == "\\" else ord(c)
        if x > 255:
            raise ValueError("rules are over bytes")
        return ("on", frozenset(self.bytes_of(x, x)))

    def in_class(self) -> set[int]:
        out: set[int] = set()
        negated = self.peek() == "^"
        if negated:
            self.take()
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            out |= self.bytes_of(low, high)
        self.take()
        return set(range(256)) - out if negated else out


def parse(text: str, either_case: bool = False):
    reader = _Reader(text, either_case)
    tree = reader.any_of()
    if reader.at != len(text):
        raise ValueError(f"unexpected {reader.peek()!r} in {text}")
    return tree


def reverse(tree):
    """The tree of all its words spelled backwards."""
    if tree[0] == "then":
        return ("then", [reverse(x) for x in tree[1][::-1]])
    if tree[0] == "or":
        return ("or", [reverse(x) for x in tree[1]])
    if tree[0] == "times":
        return ("times", reverse(tree[1]), *tree[2:])
    return tree


def _build(nfa: Nfa, tree, a: int) -> int:
    """Add ``tree`` after state ``a``; its end state."""
    if tree[0] == "on":
        b = nfa.state()
        nfa.add(a, tree[1], b)
        return b
    if tree[0] == "then":
        for x in tree[1]:
            a = _build(nfa, x, a)
        return a
    if tree[0] == "or":
        end = nfa.state()
        for x in tree[1]:
            start = nfa.state()
            nfa.add(a, None, start)
            nfa.add(_build(nfa, x, start), None, end)
        return end
    _, one, low, high = tree
    for _ in range(low):
        a = _build(nfa, one, a)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.add(a, None, loop)
        nfa.add(_build(nfa, one, loop), None, loop)
        nfa.add(loop, None, end)
        return end
    end = nfa.state()
    nfa.add(a, None, end)
    for _ in range(high - low):
        a = _build(nfa, one, a)
        nfa.add(a, None, end)
    return end


@dataclass
class Dfa:
    """``moves[state * 256 + byte]`` is the next state times 256; 0 is a dead state.

    States that accept come last, from ``accepting`` on; ``accepts`` names their rules.
    """

    moves: list[int]
    start: int
    accepting: int
    accepts: dict[int, tuple[int, ...]]

    @property
    def states(self) -> int:
        return len(self.moves) // 256


def compile_rules(trees: list, anywhere: bool) -> Dfa:
    """One automaton for all ``trees``; with ``anywhere`` a match may begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    finals: dict[int, int] = {}
    for i, tree in enumerate(trees):
        start = nfa.state()
        nfa.add(root, None, start)
        finals[_build(nfa, tree, start)] = i

    def close(states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for on, b in nfa.moves[todo.pop()]:
                if on is None and b not in states:
                    states.add(b)
                    todo.append(b)
        return frozenset(states)

    first = close({root})
    found = {frozenset(): 0, first: 1}
    table: list[list[int]] = [[0] * 256, []]
    todo = [first]
    while todo:
        s = todo.pop()
        goes: dict[int, set[int]] = {}
        for a in s:
            for on, b in nfa.moves[a]:
                for x in on or ():
                    goes.setdefault(x, set()).add(b)
        row = [0] * 256
        for x in range(256):
            to = goes.get(x, set())
            if to or anywhere:
                t = close(to | ({root} if anywhere else set()))
                if t not in found:
                    found[t] = len(table)
                    table.append([])
                    todo.append(t)
                row[x] = found[t]
        table[found[s]] = row
    if anywhere:
        table[0] = list(table[1])
    marks = {n: tuple(sorted({finals[a] for a in s if a in finals})) for s, n in found.items()}
    return _minimal(table, 1, marks)


def _minimal(table: list[list[int]], start: int, marks: dict[int, tuple[int, ...]]) -> Dfa:
    block = [0] * len(table)
    names: dict = {}
    for i in range(len(table)):
        block[i] = names.setdefault(marks[i], len(names))
    while True:
        names = {}
        new = [names.setdefault((block[i], *(block[x] for x in row)), len(names)) for i, row in enumerate(table)]
        if len(names) == len(set(block)):
            break
        block = new
    of = {b: marks[i] for i, b in enumerate(block)}
    dead = block[0]
    order = sorted(of, key=lambda b: (bool(of[b]), b != dead, b))
    number = {b: n for n, b in enumerate(order)}
    moves = [0] * (256 * len(order))
    for i, row in enumerate(table):
        n = number[block[i]] * 256
        moves[n : n + 256] = [number[block[x]] * 256 for x in row]
    plain = sum(not of[b] for b in order)
    return Dfa(moves, number[block[start]] * 256, plain * 256, {number[b] * 256: of[b] for b in order if of[b]})
