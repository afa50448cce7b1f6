"""Tokenizers that keep state across characters, in Arrow batches."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import PAIR_OPERATORS, tokens

_PAIRS = frozenset(PAIR_OPERATORS)
_MARKS = "+-*/%=<>!&|^~()[]{}.,:;@?"


def script_tokens(text: str) -> list[str]:
    """Tokens of script source: # comments and string contents are dropped, two-character operators and exponents stay whole."""
    out, k, n = [], 0, len(text)
    while k < n:
        c = text[k]
        if c == "#":
            end = text.find("\n", k)
            k = n if end < 0 else end
        elif c in "\"'`":
            mark = c * 3 if text.startswith(c * 3, k) else c
            end = k + len(mark)
            while end < n and not text.startswith(mark, end) and not (len(mark) == 1 and text[end] == "\n"):
                end += 2 if text[end] == "\\" else 1
            out.append(mark)
            k = min(end, n) + len(mark)
        elif c.isdigit():
            end = k
            while end < n and (text[end].isalnum() or text[end] in "._" or text[end] in "+-" and text[end - 1] in "eE" and not text.startswith("0x", k)):
                end += 1
            out.append(text[k:end])
            k = end
        elif c.isalpha() or c == "_":
            end = k
            while end < n and (text[end].isalnum() or text[end] == "_"):
                end += 1
            out.append(text[k:end])
            k = end
        elif c in _MARKS:
            size = 2 if text[k : k + 2] in _PAIRS else 1
            out.append(text[k : k + size])
            k += size
        else:
            k += 1
    return out


def tokenise_scripts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, tok)`` by ``script_tokens``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = [script_tokens(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(toks, pa.list_(pa.string()))], ["id", "toks"])

    arrays = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, toks array<string>")
    return arrays.select("id", F.posexplode("toks").alias("pos", "tok"))


#: The languages that are lexed, with the names of their lexers.
LEXERS = {
    "ada": "ada",
    "asm": "nasm",
    "c": "c",
    "c++": "cpp",
    "erlang": "erlang",
    "fortran": "fortran",
    "haskell": "haskell",
    "java": "java",
    "lisp": "common-lisp",
    "lua": "lua",
    "matlab": "matlab",
    "newlisp": "newlisp",
    "octave": "octave",
    "pl": "perl",
    "py": "python",
    "rb": "ruby",
    "php": "php",
    "sml": "sml",
}


def can_lex() -> bool:
    """Is the lexer library there?"""
    return importlib.util.find_spec("pygments") is not None


def columnar(tokens: Iterable[tuple], names: dict) -> pa.ListArray:
    """One list of ``(tok_class, tok)`` from tokens of a lexer, blank ones dropped; built by columns, without an object for each token. ``names`` keeps the classes' names."""
    classes, toks = [], []
    for kind, tok in tokens:
        if tok.strip():
            if kind not in names:
                names[kind] = str(kind)
            classes.append(names[kind])
            toks.append(tok)
    rows = pa.StructArray.from_arrays([pa.array(classes, pa.string()), pa.array(toks, pa.string())], ["tok_class", "tok"])
    return pa.ListArray.from_arrays(pa.array([0, len(toks)], pa.int32()), rows)


def lexed(docs: DataFrame, id_col: str, text_col: str, language_col: str) -> DataFrame:
    """``(id, language, pos, tok_class, tok)`` by syntax class, each row by its own language's lexer.

    Blank tokens are dropped; rows of a language without a lexer give none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pygments.lexers import get_lexer_by_name

        lexers: dict = {}
        names: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: its tokens may be many
                language, text = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                if language not in lexers:
                    lexers[language] = get_lexer_by_name(LEXERS[language])
                toks = columnar(lexers[language].get_tokens(text or ""), names)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), toks], ["id", "language", "toks"])

    known = docs.select(id_col, language_col, text_col).where(F.col(language_col).isin(*LEXERS))
    arrays = known.mapInArrow(run, f"id {kind}, language string, toks array<struct<tok_class:string,tok:string>>")
    return arrays.select("id", "language", F.posexplode("toks").alias("pos", "t")).select("id", "language", "pos", "t.tok_class", "t.tok")


def resplit(toks: DataFrame) -> DataFrame:
    """``lexed`` rows cut again by the naive tokenizer, each part with its token's class."""
    return toks.select("id", "language", "tok_class", F.explode(tokens(F.col("tok"))).alias("tok"))


#: Named groups of syntax classes by what their names begin with; ``all`` takes any.
CLASS_GROUPS = {
    "all": ("Token",),
    "comment": ("Token.Comment",),
    "literal": ("Token.Literal",),
    "program": ("Token.Keyword", "Token.Name"),
    "program_operator": ("Token.Keyword", "Token.Name", "Token.Operator"),
}


def class_group_counts(parts: DataFrame) -> DataFrame:
    """``(language, group, uniq, total)`` of ``resplit`` rows: different tokens of each group of classes, and all of them."""
    counted = parts.groupBy("language", "tok_class", "tok").agg(F.count("*").alias("n"))
    inside = [F.when(F.col("tok_class").rlike("^(" + "|".join(p.replace(".", "[.]") for p in prefixes) + ")"), F.lit(name)) for name, prefixes in CLASS_GROUPS.items()]
    grouped = counted.select("language", "tok", "n", F.explode(F.array_compact(F.array(*inside))).alias("group"))
    return grouped.groupBy("language", "group", "tok").agg(F.sum("n").alias("n")).groupBy("language", "group").agg(F.count("*").alias("uniq"), F.sum("n").alias("total"))
