"""Regular expressions over bytes as deterministic automata: subset construction, minimisation, transition arrays.

The patterns are of literals, escapes (\\xHH and \\ before a character), classes, groups, alternatives, and the repeats
? * + {n}. Matches are leftmost and longest.
"""

from __future__ import annotations

from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np

STEP = 1 << 20


def _single(byte: int) -> int:
    return 1 << byte


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def fold(self, mask: int) -> int:
        if self.any_case:
            for b in range(65, 91):
                if mask >> b & 1 or mask >> (b + 32) & 1:
                    mask |= _single(b) | _single(b + 32)
        return mask

    def alternatives(self):
        found = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            found.append(self.sequence())
        return ("alt", found) if len(found) > 1 else found[0]

    def sequence(self):
        items = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            items.append(self.repeat(self.atom()))
        return ("cat", items)

    def repeat(self, node):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                node = ("cat", [node] * int(self.p[self.i : end]))
                self.i = end + 1
            else:
                node = {"?": ("opt", node), "*": ("star", node), "+": ("cat", [node, ("star", node)])}[c]
        return node

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if c != "[":
            return ("set", self.fold(_single(self.byte())))
        self.i += 1
        negated = self.p[self.i] == "^"
        self.i += negated
        mask = 0
        while self.p[self.i] != "]":
            low = high = self.byte()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.byte()
            for b in range(low, high + 1):
                mask |= _single(b)
        self.i += 1
        mask = self.fold(mask)
        return ("set", (1 << 256) - 1 & ~mask if negated else mask)


def parse(pattern: str, any_case: bool = False):
    return _Parser(pattern, any_case).alternatives()


def backwards(node):
    """The expression of the reversed strings."""
    kind, x = node
    if kind == "cat":
        return kind, [backwards(y) for y in reversed(x)]
    if kind == "alt":
        return kind, [backwards(y) for y in x]
    return node if kind == "set" else (kind, backwards(x))


class Automaton:
    """Minimal transition arrays of some expressions; floating: a match may begin at any byte."""

    def __init__(self, expressions: list, floating: bool):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []
        accepting: dict[int, int] = {}
        starts = []
        for k, x in enumerate(expressions):
            a, b = self._build(x)
            starts.append(a)
            accepting[b] = k
        self._classes()
        start = self._closure(starts)
        ids, todo, table, accepts = {start: 0}, [start], [], []
        while todo:
            now = todo.pop(0)
            accepts.append(tuple(sorted({accepting[s] for s in now if s in accepting})))
            row = []
            for c in self.representative:
                to = {t for s in now for mask, t in self.moves[s] if mask >> c & 1}
                to = self._closure([*to, *starts] if floating else to)
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
            table.append(row)
        self._minimise(np.array(table), accepts)

    def _state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def _build(self, node) -> tuple[int, int]:
        kind, x = node
        a = self._state()
        if kind == "cat":
            b = a
            for y in x:
                c, d = self._build(y)
                self.empty[b].append(c)
                b = d
            return a, b
        b = self._state()
        if kind == "set":
            self.moves[a].append((x, b))
        elif kind == "alt":
            for y in x:
                c, d = self._build(y)
                self.empty[a].append(c)
                self.empty[d].append(b)
        else:
            c, d = self._build(x)
            self.empty[a] += [c, b]
            self.empty[d] += [c, b] if kind == "star" else [b]
        return a, b

    def _classes(self) -> None:
        """Bytes that every set treats alike are one column."""
        masks = {mask for moves in self.moves for mask, _ in moves}
        signs = [tuple(mask >> b & 1 for mask in masks) for b in range(256)]
        kinds = {sign: i for i, sign in enumerate(dict.fromkeys(signs))}
        self.column = np.array([kinds[s] for s in signs])
        self.representative = [signs.index(s) for s in kinds]

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _minimise(self, table: np.ndarray, accepts: list[tuple]) -> None:
        """Split blocks of states until all of a block go to the same blocks."""
        kinds = {x: i for i, x in enumerate(dict.fromkeys(accepts))}
        block = np.array([kinds[x] for x in accepts])
        while True:
            _, first, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, first = np.unique(block, return_index=True)
        self.start = int(block[0])
        self.table = block[table[first]][:, self.column]
        self.accepts = [accepts[i] for i in first]
        self.dead = [not a and bool((row == i).all()) for i, (a, row) in enumerate(zip(self.accepts, self.table, strict=True))]
        sets = list(dict.fromkeys([(), *self.accepts]))
        assert len(sets) <= 256
        self.sets = sets
        rows: list[list] = [[] for _ in self.table]
        for row, to, a in zip(rows, self.table.tolist(), self.accepts, strict=True):
            row.extend(rows[t] for t in to)
            row.append(sets.index(a))
        self.rows, self._lists = rows[self.start], self.table.tolist()

    def hits(self, data: bytes):
        """(end - 1, expressions) wherever some expression ends, in one pass over the bytes."""
        row = self.rows
        for at in range(0, len(data), STEP):
            part = data[at : at + STEP]
            rows = list(accumulate(part, getitem, initial=row))
            marks, row = np.frombuffer(bytes(map(itemgetter(256), rows)), np.uint8), rows[-1]
            for i in np.flatnonzero(marks[1:]).tolist():
                yield at + i, self.sets[marks[i + 1]]

    def longest(self, data) -> int:
        """Length of the longest match that begins with the first byte of an iterable, or -1."""
        state, best = self.start, 0 if self.accepts[self.start] else -1
        for n, c in enumerate(data, 1):
            state = self._lists[state][c]
            if self.accepts[state]:
                best = n
            elif self.dead[state]:
                break
        return best
