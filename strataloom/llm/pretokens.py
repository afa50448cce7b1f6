"""Splitting by a tokenizer's pattern, with a bounded memory of what the pieces encode to.

A piece between two single spaces is encoded once and remembered. This is exact because no
match of the pattern holds a space except as its first character or inside a run of white
space, so a single space that a non-blank follows always begins a match. A text where a piece
is empty or begins with white space is split as a whole instead.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pattern of the rank files, as the vocabulary package states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Marks that are one match when they end a piece of letters.
_MARKS = frozenset(",.;:!?")


class PieceEncoder:
    """Texts -> packed little-endian unsigned 32-bit ids, through ``encode_words`` on distinct words."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], pattern: str = PATTERN, most: int = 300_000):
        self.encode_words, self.most = encode_words, most
        self.find = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}  # matches but for those of a space and letters, which are in rest
        self.first: dict[str, bytes] = {}  # pieces at a text's start
        self.rest: dict[str, bytes | None] = {}  # pieces after a space; None: the text is split as a whole

    def _spaced(self, words: list[str]) -> list[bytes]:
        return self.encode_words([" " + w for w in words])

    def _learn(self, matches: list[str]) -> None:
        """Encode what is new among distinct matches."""
        spaced = {w[1:] for w in matches if w[0] == " " and w[1:].isalpha()}
        other = [w for w in matches if w not in self.words and not (w[0] == " " and w[1:].isalpha())]
        spaced = [*spaced.difference(self.rest)]
        self.rest.update(zip(spaced, self._spaced(spaced), strict=True))
        self.words.update(zip(other, self.encode_words(other), strict=True))

    def _joined(self, matches: list[str]) -> bytes:
        words, rest = self.words, self.rest
        return b"".join([words[w] if w in words else rest[w[1:]] for w in matches])

    def encode(self, texts: list[str]) -> list[bytes]:
        for memory in (self.words, self.first, self.rest):
            if len(memory) > self.most:
                for old in [*itertools.islice(memory, len(memory) - self.most // 2)]:
                    del memory[old]
        pieces = [t.split(" ") for t in texts]
        new = {*itertools.chain.from_iterable(pieces)}.difference(self.rest)
        letters = {p for p in new if p.isalpha()}  # one match, with the space before
        ended = [p for p in new if p[-1:] in _MARKS and p[:-1].isalpha()]  # two
        need = letters.union([p[:-1] for p in ended]).difference(self.rest)
        self.rest.update(zip(need, self._spaced([*need]), strict=True))
        for mark in _MARKS.difference(self.words):
            self.words[mark] = self.encode_words([mark])[0]
        rest, words = self.rest, self.words
        rest.update([(p, rest[p[:-1]] + words[p[-1]]) for p in ended])
        several = {p: self.find(" " + p) if p and not p[0].isspace() else None for p in new.difference(letters, ended)}
        first = {p[0]: self.find(p[0]) for p in pieces if p[0] not in self.first}
        self._learn([*{w for ws in (*several.values(), *first.values()) if ws for w in ws}])
        for p, ws in several.items():
            self.rest[p] = None if ws is None else self._joined(ws)
        for p, ws in first.items():
            self.first[p] = self._joined(ws)
        out = []
        for t, p in zip(texts, pieces, strict=True):
            try:
                out.append(self.first[p[0]] + b"".join(map(self.rest.__getitem__, p[1:])))
            except TypeError:
                matches = self.find(t)
                self._learn([*set(matches)])
                out.append(self._joined(matches))
        return out


class PieceMemory:
    """Texts -> ids through ``encode_pieces`` on distinct pieces, by Arrow's hash tables and numpy gathers.

    A line feed is put before each text and a space before each line feed, and the text is cut at
    its spaces. So every piece but a text's empty first one stands after a space, which becomes
    part of it, or begins with its line feed. A line feed between non-blanks is one match, as is a
    single one next to a single space or the end, so such pieces are independent. A text with an
    empty piece, two bare line feeds in a row, or a piece with other blanks at its ends is unsafe.
    """

    _PLAIN, _BARE, _UNSAFE = 0, 1, 2

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        """``encode_pieces`` gives the ids of pieces, each with its blank, one after the other, and their numbers; a line feed is one id."""
        self.encode_pieces, self.most = encode_pieces, most
        self.known = pa.array([], pa.string())
        self.kind, self.count, self.ids = np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _kind(self, piece: str) -> int:
        if piece == "\n":
            return self._BARE
        own = piece[1:] if piece[:1] == "\n" else piece
        return self._UNSAFE if not own or own[0].isspace() or own[-1].isspace() else self._PLAIN

    def _learn(self, new: list[str]) -> None:
        kind = np.array([*map(self._kind, new)], np.int8)
        count = np.zeros(len(new), np.int64)
        safe = np.flatnonzero(kind != self._UNSAFE)
        if len(safe):
            ids, count[safe] = self.encode_pieces([p if p[0] == "\n" else " " + p for p in (new[k] for k in safe.tolist())])
            self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
        self.kind, self.count = np.concatenate((self.kind, kind)), np.concatenate((self.count, count))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each distinct piece is remembered, after learning what is new."""
        if len(self.known) > self.most:  # the older half goes
            gone = len(self.known) - self.most // 2
            self.ids = self.ids[self.count[:gone].sum() :].copy()
            self.known = pa.concat_arrays([self.known[gone:]])
            self.kind, self.count = self.kind[gone:].copy(), self.count[gone:].copy()
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            self._learn(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
        return at

    def encode(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the end of each text among them, and which texts are unsafe: their ids are to be made otherwise."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n"), column, pa.scalar("")), "\n", " \n"), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values[ends[0] : ends[-1]].dictionary_encode()
        begins, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        kind, size = self.kind[at], self.count[at]
        size[begins] = 0  # the empty piece before each text's own line feed
        bad = kind == self._UNSAFE
        bad[1:] |= (kind[1:] == self._BARE) & (kind[:-1] == self._BARE)
        bad[begins] = False
        unsafe = np.add.reduceat(bad, begins) > 0
        size[begins + 1] -= np.where(kind[begins + 1] == self._UNSAFE, 0, 1)  # without the id of the line feed put before
        first = np.cumsum(self.count) - self.count
        first = first[at]
        first[begins + 1] += 1
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(first - (stop - size), size) + np.arange(stop[-1])]
        return ids, stop[ends - 1], unsafe
