"""Secret scans: all rules compiled into one automaton, one pass over each text's bytes.

Spans are leftmost and non-overlapping within a kind, in code points, the end exclusive. A
match that is too short is dropped but still takes up its text, as with a backtracking engine.

Defined results: a null or empty text has no spans; a text without UTF-8 validity is scanned as
bytes; spans of different kinds may overlap; very long texts are read whole; of rules that match at one place
each gives its span, in their order; repeated rows repeat; an empty table gives no
rows; other columns of the input are not read, but ``redact`` returns them as they are.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.automaton import Scanner
from strataloom.llm.common import bounded_batches, map_texts, raw, slices


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    fold: bool = False
    least: int = 1
    #: what of a match the least length holds for: all of it, or the value after the first : or =
    value: bool = False


#: The three base kinds; the further ones are public forms of credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", fold=True, least=6, value=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


@functools.lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The automata of ``rules``, made once in each process."""
    return Scanner([(r.regex, r.fold) for r in rules])


def _size(rule: Rule, match: bytes) -> int:
    if not rule.value:
        return len(match)
    rest = match[re.search(b"[:=]", match).end() :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def find(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of one text in code points, by start, then kind as listed."""
    found = [(start, rule, end) for rule, start, end in scanner(rules).scan(data) if _size(rules[rule], data[start:end]) >= rules[rule].least]
    if not found:
        return []
    if not data.isascii():
        extra = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)))
        found = [(start - int(extra[start]), rule, end - int(extra[end])) for start, rule, end in found]
    return [(start, end, rules[rule].kind) for start, rule, end in sorted(found)]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found array<struct<kind, start, end>>)``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> dict:
        found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(x, rules)] for x in raw(batch.column(1))]
        return {"doc_id": batch.column(0), "found": pa.array(found, shape)}

    return map_texts(docs, [id_col, text_col], text_col, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>", work)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        found = [find(x) for x in raw(batch.column(1))]
        out = {"doc_id": batch.column(0)}
        for k in BASE:
            out[f"n_{k}"] = pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64())
        out["base_sha256"] = pa.array([hashlib.sha256(_joined([s for s in spans if s[2] in BASE]).encode()).hexdigest() for spans in found], pa.string())
        out["spans"] = pa.array([_joined(spans) for spans in found], pa.string())
        return out

    return map_texts(docs, [id_col, text_col], text_col, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", work)


def redacted(data: bytes, rules: tuple[Rule, ...] = RULES) -> str | None:
    """The text with each stretch of spans replaced by its first kind in angle brackets; None if there is none."""
    spans = find(data, rules)
    if not spans:
        return None
    text, out, at = data.decode("utf-8", "replace"), [], 0
    k = 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with secrets in ``text_col`` replaced and ``length_col``, if there is one, set to match."""
    names = docs.columns
    at = names.index(text_col)
    sized = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            changed = [redacted(x) for x in raw(batch.column(at))]
            columns = list(batch.columns)
            if any(x is not None for x in changed):
                old = columns[at].to_pylist()
                columns[at] = pa.array([o if c is None else c for o, c in zip(old, changed, strict=True)], batch.schema.field(at).type)
                if sized is not None:
                    columns[sized] = pa.array([n if c is None else len(c) for n, c in zip(columns[sized].to_pylist(), changed, strict=True)], batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return bounded_batches(docs).mapInArrow(run, docs.schema)
