"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

Encoding rests on two facts about BPE by ranks: dropping the last token of a prefix's encoding
leaves the encoding of a shorter prefix, and tokens follow each other in an encoding just if
each neighbouring pair encodes to itself (Berglund and van der Merwe, "Formalizing BPE
Tokenization", 2023). So, for every prefix read, there is exactly one last token: the suffix of
the prefix that is a token and is compatible with the last token before it.

The nondeterministic machine guesses token boundaries; its live guesses are the prefixes after
which what was read since can still grow into a token that is compatible with the guess's last
one. A determinised state is what was read since the earliest live guess, the last token that all live guesses share, and each guess's tokens since. States and
transitions are made when first met and kept. A transition emits the tokens on which all live
guesses agree, so a token leaves after a lookahead of less than the longest token's length
times the guesses that still differ; at a word's end the longest guess is emitted. When
``most`` states are held, the tables are begun anew, which changes no result.

Decoding looks ids up as bytes and passes them through a UTF-8 state machine that holds back an
unfinished character between chunks and replaces ill-formed bytes with U+FFFD.

Defined results: null text encodes like an empty one (no ids); text with blanks only, very long
texts, repeated rows and texts with the strings of special tokens are ordinary text; an empty
table gives no rows; a null doc_id stays null; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import gc
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.common import map_texts, texts
from strataloom.llm.pretokens import PATTERN, PieceEncoder


_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes single words (matches of the pattern) by ranks."""

    def __init__(self, ranks: dict[bytes, int], most: int = 600_000):
        self.ranks, self.most = ranks, most
        self.token = {r: t for t, r in ranks.items()}
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}  # what can still grow into a token
        self.sorted = sorted(ranks)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.histories: dict[int, tuple] = {}
        self.alive: dict[tuple[int, bytes], bool] = {}
        self.states = {}
        self._begin()

    def _begin(self) -> None:
        self.grown: dict[bytes, tuple[list[tuple[int, int]], bytes]] = {}
        for own in self.states.values():  # states lead to each other, and frozen cycles would stay for ever
            own.clear()
        self.states: dict[tuple, dict] = {}
        self.initial = self._state((b"", -1, ((),)))

    def _state(self, state: tuple) -> dict:
        """The transitions of a state: byte -> (transitions of the next state, emitted tokens); at -1 the state itself."""
        if (own := self.states.get(state)) is None:
            own = self.states[state] = {-1: state}
        return own

    def _joins(self, parts: list[bytes]):
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined.

        Changes ``parts`` in place and yields the rank of each join after it is made.
        """
        get = self.ranks.get
        joins = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = _NEVER, -1
            for k, r in enumerate(joins):
                if r is not None and r < best:
                    best, at = r, k
            if at < 0:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(joins):
                joins[at] = get(parts[at] + parts[at + 1])
            yield best

    def merge(self, piece: bytes) -> list[int]:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        for _ in self._joins(parts):
            pass
        return [self.ranks[p] for p in parts]

    def _history(self, token: int) -> tuple[list[int], list[bytes], list[bytes], bool]:
        """How a token is built: the rank of each join, its first and last part before each and at the end, and whether it is whole then."""
        if (known := self.histories.get(token)) is None:
            piece = self.token[token]
            parts = [piece[k : k + 1] for k in range(len(piece))]
            ranks, first, last = [], [parts[0]], [parts[-1]]
            for rank in self._joins(parts):
                ranks.append(rank)
                first.append(parts[0])
                last.append(parts[-1])
            ranks.append(_NEVER)
            known = self.histories[token] = ranks, first, last, len(parts) == 1
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Do two tokens, written one after the other, encode to themselves? -1 stands for a word's start.

        Their joins happen in order of rank, those of the left one first where ranks are equal;
        they stay apart unless a join across the border comes before the next one inside.
        """
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 4 * self.most:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        inside_b, first, _, whole_b = self._history(b)
        if a < 0 or not whole_b:
            return whole_b
        inside_a, _, last, whole_a = self._history(a)
        if not whole_a:
            return False
        i = j = 0
        get = self.ranks.get
        while True:
            next_a, next_b = inside_a[i], inside_b[j]
            across = get(last[i] + first[j], _NEVER)
            if across < next_a and across <= next_b:
                return False
            if next_a <= next_b:
                if next_a == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _grow(self, grown: bytes) -> tuple[list[tuple[int, int]], bytes]:
        """Of a suffix that grew by a byte: the tokens it ends in, longest first, and its longest end that can grow on."""
        if (known := self.grown.get(grown)) is None:
            ends = [grown[k:] for k in range(len(grown))]
            candidates = [(len(e), self.ranks[e]) for e in ends if e in self.ranks]
            known = self.grown[grown] = candidates, next((e for e in ends if e in self.starts), b"")
        return known

    def _can_grow(self, last: int, part: bytes) -> bool:
        """Does any token that begins with ``part`` and is longer follow ``last`` in an encoding?"""
        if (known := self.alive.get((last, part))) is None:
            if len(self.alive) > 4 * self.most:
                self.alive.clear()
            begin = bisect.bisect_right(self.sorted, part)
            after = part.rstrip(b"\xff")
            end = bisect.bisect_left(self.sorted, after[:-1] + bytes((after[-1] + 1,)), begin) if after else len(self.sorted)
            # short parts begin so many tokens that one of them surely fits; a guess kept in vain costs a state, not a result
            known = end - begin > 32 or any(self._apart(last, self.ranks[t]) for t in self.sorted[begin:end])
            self.alive[last, part] = known
        return known

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        suffix, base, guesses = state[-1]
        candidates, suffix = self._grow(suffix + bytes((byte,)))
        for length, token in candidates:
            if length <= len(guesses) and (before := guesses[length - 1]) is not None:
                last = before[-1] if before else base
                known = self.pairs.get((last, token))
                if known or known is None and self.compatible(last, token):
                    break
        else:
            raise ValueError(f"the ranks have no token for byte {byte}")
        newest = (*before, token)
        live, longest, agreed = [newest], 0, len(newest)
        for length, guess in enumerate(guesses[: len(suffix)], 1):
            if guess is not None and self._can_grow(guess[-1] if guess else base, suffix[-length:]):
                longest = length
                agreed = min(agreed, len(guess))
                while guess[:agreed] != newest[:agreed]:
                    agreed -= 1
                live.append(guess)
            else:
                live.append(None)
        suffix, live = suffix[len(suffix) - longest :], live[: longest + 1]
        emitted = newest[:agreed]
        if agreed:
            base, live = emitted[-1], [g and g[agreed:] for g in live]
        nxt = self._state((suffix, base, tuple(live)))
        step = state[byte] = nxt, emitted
        return step

    def encode(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        if len(self.states) > self.most:
            self._begin()
        state, out = self.initial, []
        for byte in word:
            state, emitted = state.get(byte) or self._step(state, byte)
            if emitted:
                out += emitted
        out += state[-1][2][0]
        return out


def _utf8_machine() -> list[list]:
    """Rows of a deterministic machine over bytes; row 0 is between characters, None is an error."""
    # The well-formed byte sequences of the Unicode Standard, table 3-7 (first byte; second byte; further bytes).
    forms = [
        ((0x00, 0x7F), None, 0),
        ((0xC2, 0xDF), (0x80, 0xBF), 0),
        ((0xE0, 0xE0), (0xA0, 0xBF), 1),
        ((0xE1, 0xEC), (0x80, 0xBF), 1),
        ((0xED, 0xED), (0x80, 0x9F), 1),
        ((0xEE, 0xEF), (0x80, 0xBF), 1),
        ((0xF0, 0xF0), (0x90, 0xBF), 2),
        ((0xF1, 0xF3), (0x80, 0xBF), 2),
        ((0xF4, 0xF4), (0x80, 0x8F), 2),
    ]
    start = [None] * 256
    tails = [start]
    for _ in range(2):
        row = [None] * 256
        row[0x80:0xC0] = [tails[-1]] * 0x40
        tails.append(row)
    for first, second, more in forms:
        row = start
        if second:
            row = [None] * 256
            row[second[0] : second[1] + 1] = [tails[more]] * (second[1] - second[0] + 1)
        start[first[0] : first[1] + 1] = [row] * (first[1] - first[0] + 1)
    return start


_BETWEEN = _utf8_machine()


#: Between characters a byte below 0x80 leads back to between characters, so only the stretches of others need steps.
_HIGH = re.compile(rb"[\x80-\xff]+").finditer


class Utf8Stream:
    """Bytes in chunks -> text in chunks; an unfinished character waits, an ill-formed part becomes U+FFFD."""

    def __init__(self):
        self.held, self.errors = b"", 0

    def feed(self, chunk: bytes, last: bool = False) -> str:
        data = self.held + chunk
        self.held = b""
        for run in _HIGH(data):
            row = _BETWEEN
            for byte in run[0]:
                row = row[byte]
                if row is None:
                    break
            if row is not _BETWEEN:  # ill-formed, or unfinished where the chunk ends
                break
        else:
            return data.decode("utf-8")
        out, begin, at, row = [], 0, 0, _BETWEEN
        k, size = 0, len(data)
        while k < size:
            for byte in data[k:] if k else data:
                nxt = row[byte]
                if nxt is None:
                    break
                k += 1
                row = nxt
                if row is _BETWEEN:
                    at = k
            else:
                break
            # ill-formed: what was read of the character, or the one byte that begins none, is replaced
            out += [data[begin:at].decode("utf-8"), "�"]
            self.errors += 1
            k = begin = at = max(k, at + 1)
            row = _BETWEEN
        out.append(data[begin:at].decode("utf-8"))
        self.held = data[at:]
        if last and self.held:
            out.append("�")
            self.errors += 1
            self.held = b""
        return "".join(out)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, states: int = 600_000, words: int = 500_000, pattern: str = PATTERN):
        self.ranks = read_ranks(path)
        self.machine = Transducer(self.ranks, states)
        self.pieces = PieceEncoder(self._words, pattern, words)
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.decimal = [b"%d" % k for k in range(size)]

    def _words(self, words: list[str]) -> list[bytes]:
        encode = self.machine.encode
        gc.disable()  # the tables only grow, and walking them again and again finds nothing
        try:
            return [array("I", encode(w.encode("utf-8", "surrogatepass"))).tobytes() for w in words]
        finally:
            gc.freeze()
            gc.enable()

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.pieces.encode(batch)]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, chunks) -> tuple[str, int]:
        """Text of a stream of id chunks, and the number of its ill-formed parts."""
        stream = Utf8Stream()
        out = [stream.feed(self.decode_bytes(ids)) for ids in chunks]
        out.append(stream.feed(b"", last=True))
        return "".join(out), stream.errors


@functools.lru_cache(maxsize=4)
def codec(path: str, states: int = 600_000, words: int = 500_000) -> Codec:
    """The codec of a rank file, made once in each process; at most so many states and words are kept, which changes no result."""
    return Codec(path, states, words)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``."""

    def work(batch: pa.RecordBatch) -> dict:
        found = codec(path).encode(texts(batch.column(1)))
        return {"doc_id": batch.column(0), "ids": pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], text_col, f"doc_id {kind}, ids array<int>", work, 1 << 20)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text, n_errors)``; null ids are an empty text."""

    def run(batches):
        for batch in batches:
            found = [codec(path).decode([x or ()]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "text", "n_errors"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string, n_errors bigint")


def digests(docs: DataFrame, path: str, states: int = 600_000, words: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_errors)``: encode, decode the ids, and digest both."""

    def work(batch: pa.RecordBatch) -> dict:
        own = codec(path, states, words)
        counts, shas, decoded, errors = [], [], [], []
        for found in own.encode(texts(batch.column(1))):
            ids = found.tolist()
            counts.append(len(ids))
            shas.append(hashlib.sha256(b" ".join(map(own.decimal.__getitem__, ids))).hexdigest())
            data = own.decode_bytes(ids)
            decoded.append(hashlib.sha256(data).hexdigest())
            stream = Utf8Stream()
            stream.feed(data, last=True)
            errors.append(stream.errors)
        return {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "n_errors": pa.array(errors, pa.int64())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], text_col, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_errors bigint", work)
