"""SimHash near-duplicates: 64-bit fingerprints, linked by tiled exact comparison.

A fingerprint's bit is 1 if it is set in more than half of the XXH64 values (seed 42) of the
document's word shingles. Fingerprints link at ``radius`` or fewer differing bits, and
documents of one connected component are near-duplicates.

All links between different fingerprints are found exactly. The distinct fingerprints are
dealt to tiles by the population counts of their four 16-bit quarters. Two fingerprints
within the radius have quarter counts that differ by the radius at most in sum, so only such
tile pairs are compared, by exclusive-or and bit counts over whole tiles in numpy; all other
tile pairs are skipped. There are at most 17**4 = 83,521 count vectors whatever the input,
which bounds the one table that is broadcast. A count vector with more fingerprints than
``tile_rows`` is split into several tiles by a hash, so no task gets more than two tiles at a
time. From a tile pair only a spanning forest of its links leaves, never all its pairs.

Defined results: a bit that is set in just half the hashes is 0; very long texts are hashed whole, some shingles at
a time; a null or blank text has fingerprint zero and links like any other; repeated
rows and equal texts have equal fingerprints and one component; a null doc_id gets a row, and
``component_id`` is the least non-null doc_id reachable (null if there is none); an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import arrow_rows, map_texts, raw
from strataloom.operators.components import connected_components
from strataloom.session import materialize

SEED = 42
CELLS = 17**4
_AT_ONCE = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of one UTF-8 text; bytes.lower and bytes.split are exactly A-Z and the six ASCII blanks."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _AT_ONCE):
        part = hashes[start : start + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: a fingerprint for each row, as a signed long."""

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(x, words) for x in raw(batch.column(1))], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], text_col, f"doc_id {kind}, fp bigint", work)


def _cell(fp: Column) -> Column:
    quarters = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return sum((c * 17**k for k, c in enumerate(quarters[1:], 1)), quarters[0])


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that sum to ``radius`` at most."""
    steps = range(-radius, radius + 1)
    return [d for d in itertools.product(steps, repeat=4) if sum(map(abs, d)) <= radius]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of fingerprints (or within one, if both are the same)."""
    rows = max(1, (1 << 20) // max(1, len(b)))
    src, dst = [], []
    names = np.unique(np.concatenate((a, b)))
    label = np.arange(len(names))
    at_a, at_b = np.searchsorted(names, a), np.searchsorted(names, b)
    for start in range(0, len(a), rows):
        near = np.bitwise_count(a[start : start + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        x, y = at_a[start + i], at_b[j]
        while len(x := x[keep := label[x] != label[y]]):
            y = y[keep]
            # each round merges, for every label, its least partner: one link for each merge
            lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            order = np.lexsort((lo, hi))
            hi_sorted = hi[order]
            first = order[np.r_[True, hi_sorted[1:] != hi_sorted[:-1]]]
            src.append(names[x[first]])
            dst.append(names[y[first]])
            to = np.arange(len(names))
            to[hi[first]] = lo[first]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    empty = np.zeros(0, a.dtype)
    return (np.concatenate(src) if src else empty, np.concatenate(dst) if dst else empty)


def links(distinct: DataFrame, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """``distinct(fp)`` -> ``(src, dst)``: links that connect exactly what all links connect."""
    cells = distinct.select(_cell(F.col("fp")).alias("cell"), "fp")
    counts = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))  # CELLS rows at most
    tiles = (
        cells.join(F.broadcast(counts), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = materialize(tiles, "simhash-tiles")
    quarter = [F.pmod(F.floor(F.col("cell") / 17**k), F.lit(17)).cast("int") for k in range(4)]
    near = []
    for d in _neighbours(radius):
        if (shift := sum(x * 17**k for k, x in enumerate(d))) >= 0:  # of two tiles, one asks
            inside = F.lit(True)
            for q, x in zip(quarter, d, strict=True):
                inside = inside & (q + x).between(0, 16)
            near.append(F.when(inside, F.col("cell") + shift))
    asks = tiles.select(
        F.col("cell").alias("from_cell"), F.col("part").alias("from_part"), F.col("fps").alias("from_fps"), F.explode(F.array_compact(F.array(*near))).alias("cell")
    )
    asks = asks.join(F.broadcast(counts), "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    asks = asks.where("from_cell <> cell or from_part <= part").drop("parts")
    pairs = asks.join(tiles, ["cell", "part"]).select("from_fps", "fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                x, y = tile_links(a, b, radius)
                if len(x):
                    out.append((x.view(np.int64), y.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["src", "dst"])

    return pairs.mapInArrow(compare, "src bigint, dst bigint")


def components(prints: DataFrame, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """``prints(doc_id, fp)`` -> ``(fp, component_id)`` for each distinct fingerprint."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    with arrow_rows(prints.sparkSession, 64):
        linked = materialize(links(nodes.select("fp"), radius, tile_rows), "simhash-links")
    found = connected_components(linked)
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, tile_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each document; see the module."""
    prints = materialize(fingerprints(docs, words, id_col, text_col), "simhash-prints")
    whole = prints.join(components(prints, radius, tile_rows), "fp")
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
