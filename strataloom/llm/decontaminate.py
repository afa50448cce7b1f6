"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and underscores, lower-cased. A mask keeps some positions of
a window of words and ignores the others, so a substituted word on an ignored position changes
no hash. Windows of the test items and of the documents that share a mask's hash are hits; each
hit fixes an alignment of item and document, along which the longest segment with matches in
four fifths of its words at least is sought. A document is contaminated by an item if the
matches of such a segment reach ``least_words`` or four fifths of the item, whichever is less.
The masks of each length of item find every such segment (shorter items have masks that keep fewer words).

Items of equal text are one row before anything else, and equal word sequences in a block one
class. The benchmark's words are numbered and its hashes sorted; both go to all executors in blocks of
``block_bytes`` of item text at most (one longer item is a block of its own), ``at_once`` of them in one
pass over the documents. So what is sent has a fixed bound and every item meets every document,
at any size of either table; further passes read a written table. Alignments are checked in
batches of bounded size, many at a time in numpy, so a seed that thousands of items share costs
work in proportion, not memory. A document is one row, whatever number of items it holds.

Defined results: null and empty texts are clean; an item without words finds nothing, one of fewer
than five only documents that are these words and no more; very long texts and items are read
whole; of several items in a document the one with most matches is given (of equals the least
item_id), of several places the first of most matches; repeated rows repeat; items with equal
text count each but give the least item_id; a null item_id or doc_id stays null; an empty table
on either side gives no rows; other columns are not read, but ``clean`` returns those of the
documents as they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import keep_rows, map_texts, texts
from strataloom.session import materialize

#: Words that a mask keeps (1) and ignores (0), by the least length of the items they serve. With a
#: fifth of the words substituted, anywhere, one of them is whole somewhere (the tests try all ways).
MASKS = {5: ("111", "1101"), 7: ("1111", "11011"), 11: ("11111", "1101011", "11010011", "101100101")}
SHORT = min(MASKS)
_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MISS = -4
_AT_ONCE = 1 << 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def masks_for(length: int) -> tuple[str, ...]:
    """The masks of items of ``length`` words."""
    return MASKS[max(k for k in MASKS if k <= length)]


def _hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places whose kept words are all known (not 0), and the hashes there."""
    kept = [k for k, c in enumerate(mask) if c == "1"]
    size = len(ids) - len(mask) + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    whole = known[kept[0] : kept[0] + size].copy()
    for k in kept[1:]:
        whole &= known[k : k + size]
    at = np.flatnonzero(whole)
    found = np.full(len(at), len(mask), np.uint64)
    for k in kept:
        found = (found ^ ids[at + k].astype(np.uint64)) * _MULTIPLIER
        found ^= found >> np.uint64(29)
    return at, found


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the sorted columns changes."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


class Index:
    """One block of items ``(item_id, text, copies)``: numbered words, and for each mask the sorted hashes with their places."""

    def __init__(self, items: list[tuple[object, str, int]], least_words: int = 13):
        self.vocabulary: dict[str, int] = {}
        self.names, self.copies, classes = [], [], {}
        for name, text, copies in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or ""))
            if ids and ids in classes:
                self.copies[classes[ids]] += copies
            elif ids:
                classes[ids] = len(self.names)
                self.names.append(name)
                self.copies.append(copies)
        self.copies = np.array(self.copies, np.int64)
        self.size = np.array([*map(len, classes)], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.least = np.minimum(least_words, -(-4 * self.size // 5))
        self.flat = np.fromiter(itertools.chain.from_iterable(classes), np.int32, int(self.size.sum()))
        self.short = {ids: k for ids, k in classes.items() if len(ids) < SHORT}
        by_mask: dict[str, list] = {}
        for k in np.flatnonzero(self.size >= SHORT).tolist():
            for mask in masks_for(int(self.size[k])):
                at, hashes = _hashes(self.flat[self.begin[k] : self.begin[k] + self.size[k]], mask)
                by_mask.setdefault(mask, []).append((hashes, (self.begin[k] + at).astype(np.int32)))
        self.masks = {}
        for mask, parts in by_mask.items():
            hashes, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.masks[mask] = hashes[order], place[order]

    def find(self, batch: list[list[str]]) -> dict[int, tuple[int, tuple]]:
        """Of documents, given as their words: ``{document: (items, (item, matches, words, document start, item start))}``; starts count words."""
        number, gap = self.vocabulary.get, max(map(len, self.masks), default=0)
        sizes = np.array([*map(len, batch)], np.int64)
        starts = np.cumsum(sizes + gap) - sizes - gap
        ids = np.zeros(int(sizes.sum()) + gap * len(batch), np.int32)
        for start, found in zip(starts.tolist(), batch, strict=True):
            ids[start : start + len(found)] = np.fromiter(map(number, found, itertools.repeat(0)), np.int32, len(found))
        best: dict[tuple[int, int], tuple] = {}
        for document, found in enumerate(batch):
            if self.short and 0 < len(found) < SHORT:
                k = self.short.get(tuple(ids[starts[document] : starts[document] + len(found)].tolist()))
                if k is not None:
                    best[document, k] = (len(found), len(found), 0, 0)
        for document, item, shift in self._alignments(ids, starts):
            found = self._segments(ids, starts[document], sizes[document], item, shift)
            good = np.flatnonzero(found[0] >= self.least[item])
            for d, i, *segment in zip(document[good].tolist(), item[good].tolist(), *(c[good].tolist() for c in found), strict=True):
                if segment[0] > best.get((d, i), (0,))[0]:
                    best[d, i] = tuple(segment)
        out: dict[int, tuple[int, tuple]] = {}
        for (d, i), segment in sorted(best.items()):
            held, first = out.get(d, (0, None))
            if first is None or segment[0] > first[1] or segment[0] == first[1] and _order(self.names[i]) < _order(self.names[first[0]]):
                first = (i, *segment)
            out[d] = held + int(self.copies[i]), first
        return out

    def _alignments(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(document, item, shift)`` of all hits, in batches without repeats; a seed of many items comes in several."""
        for mask, (hashes, place) in self.masks.items():
            where, own = _hashes(ids, mask)
            low = np.searchsorted(hashes, own, side="left")
            hit = (low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == own)
            where, low = where[hit], low[hit]
            ends = np.cumsum(np.searchsorted(hashes, own[hit], side="right") - low)
            for at in range(0, int(ends[-1]) if len(ends) else 0, _AT_ONCE):
                each = np.arange(at, min(at + _AT_ONCE, ends[-1]))
                row = np.searchsorted(ends, each, side="right")
                target = place[low[row] + each - np.concatenate(([0], ends))[row]].astype(np.int64)
                document = np.searchsorted(starts, where[row], side="right") - 1
                item = np.searchsorted(self.begin, target, side="right") - 1
                shift = where[row] - starts[document] - (target - self.begin[item])
                order = np.lexsort((shift, item, document))
                document, item, shift = document[order], item[order], shift[order]
                first = _firsts(document, item, shift)
                document, item, shift = document[first], item[first], shift[first]
                cells = np.cumsum(self.size[item])
                for cut in np.split(np.arange(len(first)), np.flatnonzero(np.diff(cells // (2 * _AT_ONCE))) + 1):
                    yield document[cut], item[cut], shift[cut]

    def _segments(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each alignment the longest segment whose matches reach four fifths: matches, words, document start, item start."""
        low = np.maximum(0, -shift)
        n = np.minimum(self.size[item], size - shift) - low
        before = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - before[row]
        same = ids[(start + low + shift)[row] + step] == self.flat[(self.begin[item] + low)[row] + step]
        # sums of each alignment, 0 first, all in one array; a lower level for each row keeps minima apart
        head = before + np.arange(len(n))
        value = np.zeros(len(row) + len(n), np.int64)
        value[np.arange(len(row)) + row + 1] = np.where(same, 1, _MISS)
        wide = np.repeat(np.arange(len(n)), n + 1)
        sums = np.cumsum(value)
        sums -= sums[head][wide] + wide * (2 - _MISS) * (int(n.max(initial=0)) + 1)
        begin = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")  # the first place from which no sum is lost
        span = int(n.max(initial=0)) + 2
        place = np.arange(len(sums)) - head[wide]
        longest = np.maximum.reduceat((np.arange(len(sums)) - begin) * span + span - 1 - place, head) if len(head) else head
        stop = span - 1 - longest % span + before
        begin = stop - longest // span
        matches = np.flatnonzero(same)
        first, last = np.searchsorted(matches, begin), np.searchsorted(matches, stop)
        some = last > first
        matches = np.append(matches, 0)
        at = np.where(some, matches[np.minimum(first, len(matches) - 1)], begin)
        words_in = np.where(some, matches[last - 1] - at + 1, 0)
        return last - first, words_in, low + shift + at - before, low + at - before


def _order(name: object) -> tuple:
    return (name is not None, name)


def _passes(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, at_once: int) -> Iterator[list]:
    """Broadcast indexes of all items, some blocks at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))
    total = benchmark.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    parts = -(-2 * total // block_bytes) if total > block_bytes else 1  # twice as many as needed, for uneven parts
    rows = items.repartition(parts, F.xxhash64("text")).sortWithinPartitions("item_id", "text").toLocalIterator()
    ready, held, size = [], [], 0
    for r in itertools.chain(rows, [None]):
        if held and (r is None or size + len(r.text) > block_bytes):
            index = Index(held)
            if index.names:
                ready.append(spark.sparkContext.broadcast(index))
            held, size = [], 0
        if r is not None:
            held.append((r.item_id, r.text, r.copies))
            size += len(r.text)
        if len(ready) == at_once or r is None and ready:
            yield ready
            ready = []


def _found(sent: list, column: pa.Array) -> dict[int, tuple]:
    """``{row: (n_items, item_id, item words, matches, words, document start, item start)}`` over the blocks of a pass."""
    batch, out = [words(t) for t in texts(column)], {}
    for index in (s.value for s in sent):
        for row, (n, (item, *segment)) in index.find(batch).items():
            out[row] = _better(out.get(row), (n, index.names[item], int(index.size[item]), *segment))
    return out


def _better(a: tuple | None, b: tuple) -> tuple:
    """Of two results for a document the one of more matches, with the items of both."""
    if a is None:
        return b
    first = min(a, b, key=lambda r: (-r[3], _order(r[1])))
    return (a[0] + b[0], *first[1:])


def overlaps(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20, at_once: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_items, item_id, item_words, n_matches, n_words, doc_start, item_start)`` of each contaminated document."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    names = ("n_items", "item_id", "item_words", "n_matches", "n_words", "doc_start", "item_start")
    result = ", ".join(f"{n} {item_kind if n == 'item_id' else 'bigint'}" for n in names)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.lit(None).cast(item_kind if n == "item_id" else "bigint").alias(n) for n in names))
    passes = _passes(benchmark, item_col, item_text_col, block_bytes, at_once)
    sent = next(passes, None)
    if sent is None:
        return spark.createDataFrame([], T._parse_datatype_string(f"doc_id {kind}, {result}"))
    while sent is not None:
        following = next(passes, None)

        def work(batch: pa.RecordBatch, sent=sent, last=following is None) -> dict:
            found = _found(sent, batch.column(1))
            whole = []
            for k, before in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                whole.append(_better(before if before[0] else None, found[k]) if k in found else before)
            if last:
                keep = [k for k, r in enumerate(whole) if r[0]]
                batch, whole = batch.take(pa.array(keep, pa.int64())), [whole[k] for k in keep]
            columns = {n: pa.array([r[k] for r in whole], batch.schema.field(n).type) for k, n in enumerate(names)}
            return {"doc_id": batch.column(0), "text": batch.column(1)} | columns

        texted = "" if following is None else "text string, "
        rows = map_texts(rows, ["doc_id", "text", *names], "text", f"doc_id {kind}, {texted}{result}", work)
        if following is not None:
            rows = materialize(rows, "overlaps")
        sent = following
    return rows


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20, at_once: int = 4, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates."""
    at = docs.columns.index(text_col)
    passes = _passes(benchmark, item_col, item_text_col, block_bytes, at_once)
    sent = next(passes, None)
    while sent is not None:

        def good(batch: pa.RecordBatch, sent=sent) -> np.ndarray:
            keep = np.ones(batch.num_rows, bool)
            keep[[*_found(sent, batch.column(at))]] = False
            return keep

        docs, sent = keep_rows(docs, text_col, good), next(passes, None)
        if sent is not None:
            docs = materialize(docs, "clean")
    return docs
