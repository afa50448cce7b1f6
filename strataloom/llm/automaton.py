"""Regular expressions over bytes, compiled together into one minimal deterministic automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_ALL = (1 << 256) - 1


def _bit(*codes: int) -> int:
    return sum(1 << c for c in set(codes))


class _Parser:
    """A regex of literals, ``\\xHH``, classes, groups, ``|`` and ``? * + {m} {m,} {m,n}`` -> a syntax tree."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def parse(self):
        tree = self._either()
        if self.at != len(self.text):
            raise ValueError(f"{self.text!r}: unexpected {self.text[self.at]!r} at {self.at}")
        return tree

    def _next(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self):
        options = [self._row()]
        while self._next() == "|":
            self.at += 1
            options.append(self._row())
        return options[0] if len(options) == 1 else ("or", options)

    def _row(self):
        items = []
        while self._next() not in ("", "|", ")"):
            items.append(self._repeat())
        return ("row", items)

    def _repeat(self):
        item = self._atom()
        while (c := self._next()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : end].partition(",")
                self.at = end + 1
                low, high = int(least), int(most) if most else None if comma else int(least)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            item = ("times", item, low, high)
        return item

    def _code(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"{self.text!r}: \\{c} is not supported")
        return ord(c)

    def _atom(self):
        if self._next() == "(":
            self.at += 1
            inside = self._either()
            if self._next() != ")":
                raise ValueError(f"{self.text!r}: a group is open")
            self.at += 1
            return inside
        if self._next() != "[":
            return ("set", self._folded(_bit(self._code())))
        self.at += 1
        inverse = self._next() == "^"
        self.at += inverse
        codes = 0
        while self._next() != "]":
            low = self._code()
            high = low
            if self._next() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._code()
            codes |= _bit(*range(low, high + 1))
        self.at += 1
        codes = self._folded(codes)
        return ("set", _ALL & ~codes if inverse else codes)

    def _folded(self, codes: int) -> int:
        if self.fold:
            for k in range(26):
                if codes >> (65 + k) & 1 or codes >> (97 + k) & 1:
                    codes |= _bit(65 + k, 97 + k)
        return codes


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree, begin: int, back: bool) -> int:
        """States for ``tree`` from ``begin`` on, its rows reversed if ``back``; the end state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[begin] = tree[1], end
            return self._after(end)
        if kind == "row":
            for item in reversed(tree[1]) if back else tree[1]:
                begin = self.add(item, begin, back)
            return begin
        if kind == "or":
            end = self.state()
            for option in tree[1]:
                start = self.state()
                self.free[begin].append(start)
                self.free[self.add(option, start, back)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            begin = self.add(item, begin, back)
        end = self.state()
        if high is None:
            loop = self.state()
            self.free[begin].append(loop)
            inner = self.state()
            self.free[loop] += [inner, end]
            self.free[self.add(item, inner, back)].append(loop)
            return end
        self.free[begin].append(end)
        for _ in range(high - low):
            inner = self.state()
            self.free[begin].append(inner)
            begin = self.add(item, inner, back)
            self.free[begin].append(end)
        return end

    def _after(self, end: int) -> int:
        nxt = self.state()
        self.free[end].append(nxt)
        return nxt

    def closure(self, states: int) -> int:
        todo, seen = states, 0
        while todo:
            low = todo & -todo
            todo ^= low
            if not seen & low:
                seen |= low
                for k in self.free[low.bit_length() - 1]:
                    todo |= (1 << k) & ~seen
        return seen


@dataclass
class Automaton:
    """``move[state, class_of[byte]]`` and, for each state, the bit mask of the rules it accepts; state 0 is the start."""

    class_of: np.ndarray
    move: np.ndarray
    accept: list[int]

    def rows(self) -> list[list]:
        """The same as linked rows: row[byte] is the next row, row[256] the mask, row[257] whether no match can follow."""
        rows: list[list] = [[] for _ in self.accept]
        classes = self.class_of.tolist()
        for k, (row, to, mask) in enumerate(zip(rows, self.move.tolist(), self.accept, strict=True)):
            targets = [rows[t] for t in to]
            row += [targets[c] for c in classes]
            row += [mask, not mask and set(to) == {k}]
        return rows


def compile_rules(rules: list[tuple[str, bool]], search: bool, back: bool = False) -> Automaton:
    """Subset construction over all ``(regex, fold case)`` rules at once, then minimisation.

    With ``search`` a match may begin at every byte. ``back`` compiles the reversed languages.
    """
    nfa = _Nfa()
    start, ends = 0, []
    for text, fold in rules:
        begin = nfa.state()
        start |= 1 << begin
        ends.append(nfa.add(_Parser(text, fold).parse(), begin, back))
    sets = sorted({m[0] for m in nfa.moves if m})
    signature = [tuple(s >> b & 1 for s in sets) for b in range(256)]
    kinds = {s: k for k, s in enumerate(dict.fromkeys(signature))}
    class_of = np.array([kinds[s] for s in signature], np.int32)
    sample = [signature.index(s) for s in kinds]
    start = nfa.closure(start)
    closed = {}

    def step(states: int, byte: int) -> int:
        out = 0
        rest = states
        while rest:
            low = rest & -rest
            rest ^= low
            move = nfa.moves[low.bit_length() - 1]
            if move and move[0] >> byte & 1:
                to = move[1]
                if to not in closed:
                    closed[to] = nfa.closure(1 << to)
                out |= closed[to]
        return out | start if search else out

    # only states with a move, and the ends, tell two sets apart
    useful = sum(1 << k for k, m in enumerate(nfa.moves) if m) | sum(1 << e for e in set(ends))
    start &= useful
    number, todo, table = {start: 0}, [start], []
    while len(table) < len(todo):
        row = []
        for byte in sample:
            to = step(todo[len(table)], byte) & useful
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    accept = [sum((s >> e & 1) << r for r, e in enumerate(ends)) for s in todo]
    return _minimise(class_of, np.array(table, np.int64), np.array(accept, np.int64))


def _minimise(class_of: np.ndarray, table: np.ndarray, accept: np.ndarray) -> Automaton:
    """Refine blocks of states until no byte leads states of one block to different blocks."""
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    count = block.max() + 1
    while True:
        block = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)[1].reshape(-1)
        if block.max() + 1 == count:
            break
        count = block.max() + 1
    # number the blocks as they are met, so that the start is 0
    _, first = np.unique(block, return_index=True)
    order = np.argsort(np.argsort(first))
    states = np.sort(first)
    return Automaton(class_of, order[block[table[states]]].astype(np.int32), accept[states].tolist())


class Scanner:
    """Leftmost, longest, non-overlapping matches of each rule, all rules in one pass over the bytes.

    The one pass finds where matches end. A reversed automaton of the rule then gives the leftmost
    start after the rule's last match, and its own forward automaton the longest end from there.
    This is what a backtracking engine finds for rules in which, as in those here, all matches
    from one start that go on are parts of the longest one.
    """

    def __init__(self, rules: list[tuple[str, bool]]):
        self.rules = rules
        self.together = compile_rules(rules, search=True)
        self.back = [compile_rules([r], search=False, back=True) for r in rules]
        self.ahead = [compile_rules([r], search=False) for r in rules]
        self._rows: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def _linked(self) -> tuple:
        if self._rows is None:
            self._rows = self.together.rows()[0], [a.rows()[0] for a in self.back], [a.rows()[0] for a in self.ahead]
        return self._rows

    def scan(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """``(rule, start, end)`` in bytes, by rule's end."""
        row, back, ahead = self._linked()
        ends: list[tuple[int, int]] = []
        at = 0
        for byte in data:
            row = row[byte]
            at += 1
            if row[256]:
                ends.append((at, row[256]))
        if not ends:
            return
        view = memoryview(data)  # parts of a long text are never copied
        for rule in range(len(self.rules)):
            own = [e for e, mask in ends if mask >> rule & 1]
            last, blocked = 0, False
            for k, end in enumerate(own):
                goes_on = k + 1 < len(own) and own[k + 1] == end + 1
                if end <= last or blocked and goes_on:
                    continue
                begin = self._reach(back[rule], reversed(view[last:end]))
                # of a stretch of ends that only a start inside the last match leads to, just the final one is tried again
                blocked = not begin and goes_on
                if begin:
                    start = end - begin
                    last = start + self._reach(ahead[rule], view[start:])
                    yield rule, start, last

    @staticmethod
    def _reach(row: list, data) -> int:
        """The most bytes of ``data`` after which the automaton accepts."""
        most = 0
        for at, byte in enumerate(data, 1):
            row = row[byte]
            if row[256]:
                most = at
            elif row[257]:
                break
        return most
