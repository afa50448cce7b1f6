"""One row of each group of similar texts: SimHash finds candidates, exact likeness of shingle sets decides.

Two texts link if the Jaccard likeness of their sets of five-word shingles is 4/5 or more. Texts
with equal sets are one node. Candidates are found by fingerprints of 256 bits: at most 40 of
the first 128 and 72 of all may differ, where links of likeness 0.8 differ in about 19 and 38
(README: recall on planted pairs) and unrelated texts in 64 and 128. Sets that link also have sizes
within a factor of 1.25 (repeats of a shingle do not count), so the nodes are dealt to tiles
by the band of that factor their size lies in and, in it, by population count of the first half in steps of 16.
Only tiles of the same or the next band are compared, and tile pairs whose population
counts differ beyond the radius are skipped. Within a tile pair all fingerprints meet:
exclusive-or and bit counts over whole blocks in numpy, the second half only where the first
is near. From a tile pair only a spanning forest of its candidates leaves.

A link always lies within a component of candidates. The shingle sets of each such component are
dealt to blocks of about ``block_shingles`` shingles; all pairs of its blocks meet, and
every candidate pair that no link joins yet is counted exactly. Components of the links are the groups.

Both steps grow with the square: of the fingerprints in a band, and of the blocks in a
component of candidates; the README states what that means for large inputs.

Defined results: very long texts are hashed whole; a likeness of just four fifths links; null, empty and blank texts are alike and one stays; of each group the row of
least doc_id, then least hash of the text, stays; of rows that repeat with doc_id and text one stays; null
doc_ids come first; rows keep all their columns; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import arrow_rows, map_texts, raw
from strataloom.llm.simhash import SEED
from strataloom.operators.components import connected_components
from strataloom.session import materialize

_STEP = 16
_AT_ONCE = 1 << 15


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash of each shingle, from the first (the finaliser of the public splitmix64 generator)."""
    h = (h + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different shingles; blank texts have none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) > words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, itertools.repeat(SEED)), np.uint64))


def _bits(hashes: np.ndarray, parts: int) -> list[int]:
    """``parts`` 64-bit words of the fingerprint of a set of shingles."""
    if not len(hashes):
        return [0] * parts
    ones = np.zeros(64 * parts, np.int64)
    for start in range(0, len(hashes), _AT_ONCE):
        part = [hashes[start : start + _AT_ONCE]]
        while len(part) < parts:
            part.append(_mixed(part[-1]))
        whole = np.column_stack(part).astype("<u8").view(np.uint8).reshape(-1, 8 * parts)
        ones += np.unpackbits(whole, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int(x) for x in np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")]


def fingerprint(text: bytes, words: int = 5) -> tuple[int, int, int]:
    """The first two 64-bit words and the number of different shingles; blank texts have zeros."""
    found = shingles(text, words)
    return (*_bits(found, 2), len(found))


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``label`` after the links ``(x, y)``, and those of them that form a spanning forest."""
    src, dst = [], []
    while len(x := x[open_ := label[x] != label[y]]):
        y = y[open_]
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        order = np.lexsort((low, high))
        first_of = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        src.append(x[first_of])
        dst.append(y[first_of])
        to = np.arange(len(label))
        to[high[first_of]] = low[first_of]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    none = np.zeros(0, np.int64)
    return label, np.concatenate(src) if src else none, np.concatenate(dst) if dst else none


def _near(x: np.ndarray, y: np.ndarray, radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates between fingerprints ``(4, n)`` and ``(4, m)``."""
    first = np.bitwise_count(x[0][:, None] ^ y[0])
    first += np.bitwise_count(x[1][:, None] ^ y[1])
    i, j = np.nonzero(first <= radius)
    rest = np.bitwise_count(x[2][i] ^ y[2][j]) + np.bitwise_count(x[3][i] ^ y[3][j])
    good = first[i, j].astype(np.int64) + rest <= wide
    return i[good], j[good]


def _forest(a: np.ndarray, b: np.ndarray, radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a spanning forest of the candidates between two tiles ``(4, n)``."""
    n, m = a.shape[1], b.shape[1]
    label = np.arange(n + m)
    src, dst = [], []
    rows = max(1, (1 << 19) // max(1, m))
    for start in range(0, n, rows):
        i, j = _near(a[:, start : start + rows], b, radius, wide)
        label, x, y = _merge(label, start + i, n + j)
        src.append(x)
        dst.append(y - n)
    none = np.zeros(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def candidates(nodes: DataFrame, radius: int = 40, wide: int = 72, tile_rows: int = 16384) -> DataFrame:
    """``nodes(node, a, b, c, d, n)`` -> ``(src, dst)``: pairs that connect exactly what all candidates connect."""
    groups = 128 // _STEP + 1
    words = ["a", "b", "c", "d"]
    band = F.floor(F.log(F.col("n") + 1) / F.log(F.lit(1.25))).cast("int")
    group = F.floor((F.bit_count("a") + F.bit_count("b")) / _STEP).cast("int")
    cells = nodes.select((band * groups + group).alias("cell"), "node", *words)
    counts = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))  # 9 rows for each factor of 1.25 in length
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    tiles = cells.join(F.broadcast(counts), "cell").groupBy("cell", part).agg(*(F.collect_list(c).alias(c) for c in ("node", *words)))
    tiles = materialize(tiles, "similar-tiles")
    reach = (radius - 1) // _STEP + 1  # groups further apart than this differ beyond the radius
    steps = [*range(reach + 1)] + [groups + d for d in range(-reach, reach + 1)]
    own = F.pmod("cell", F.lit(groups))
    near = [F.when((own + (d - groups * (d > reach))).between(0, groups - 1), F.col("cell") + d) for d in steps]
    asks = tiles.select(*(F.col(c).alias(f"from_{c}") for c in ("cell", "part", "node", *words)), F.explode(F.array_compact(F.array(*near))).alias("cell"))
    asks = asks.join(F.broadcast(counts), "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    asks = asks.where("from_cell <> cell or from_part <= part").drop("parts", "from_cell", "from_part")
    pairs = asks.join(tiles, ["cell", "part"]).select("from_node", *(f"from_{c}" for c in words), "node", *words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                whole = [c[k].values.to_numpy(zero_copy_only=False) for c in batch.columns]
                (node_x, *x), (node_y, *y) = whole[:5], whole[5:]
                i, j = _forest(np.stack(x).view(np.uint64), np.stack(y).view(np.uint64), radius, wide)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(node_x[i]), pa.array(node_y[j])], ["src", "dst"])

    return pairs.mapInArrow(compare, "src bigint, dst bigint").where("src <> dst")


def exact_links(x: list[np.ndarray], y: list[np.ndarray], prints_x: np.ndarray, prints_y: np.ndarray, radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, of likeness 4/5 or more, between two blocks of shingle sets with fingerprints ``(4, n)``."""
    sizes, n = np.array([len(s) for s in y]), len(x)
    names, at = np.unique(np.concatenate((*x, *y)), return_inverse=True)
    ends_x = np.cumsum([0, *(len(s) for s in x)])
    starts = ends_x[-1] + np.cumsum(sizes) - sizes
    ends = starts + sizes
    label, own = np.arange(n + len(y)), np.zeros(len(names), bool)
    src, dst = [], []
    for i in range(n):
        mine = at[ends_x[i] : ends_x[i + 1]]
        j = _near(prints_x[:, i : i + 1], prints_y, radius, wide)[1]
        j = j[(label[n + j] != label[i]) & (5 * np.minimum(sizes[j], len(mine)) >= 4 * np.maximum(sizes[j], len(mine)))]
        if not len(j):
            continue
        own[mine] = True
        both = np.array([np.count_nonzero(own[at[starts[k] : ends[k]]]) for k in j])
        own[mine] = False
        j = j[5 * both >= 4 * (len(mine) + sizes[j] - both)]
        label, a, b = _merge(label, np.full(len(j), i), n + j)
        src.append(a)
        dst.append(b - n)
    none = np.zeros(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def links(members: DataFrame, radius: int = 40, wide: int = 72, block_shingles: int = 1 << 19) -> DataFrame:
    """``members(root, node, a, b, c, d, n, set)`` -> ``(src, dst)``: links that connect exactly what all links connect; ``root`` is the component of candidates."""
    fields = ["node", "a", "b", "c", "d", "set"]
    counts = members.groupBy("root").agg(F.ceil(F.sum(F.greatest("n", F.lit(1))) / block_shingles).cast("int").alias("parts"))
    blocks = members.join(counts, "root").groupBy("root", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    blocks = materialize(blocks.agg(*(F.collect_list(c).alias(c) for c in fields)), "similar-blocks")
    asks = blocks.where("parts > 1").select("root", *(F.col(c).alias(f"from_{c}") for c in fields), F.explode(F.expr("sequence(part, parts - 1)")).alias("part"))
    pairs = asks.join(blocks, ["root", "part"]).select(*(f"from_{c}" for c in fields), *fields)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for node, a, b, c, d, sets in itertools.batched((c[k].values for c in batch.columns), len(fields)):
                    prints = np.stack([w.to_numpy(zero_copy_only=False) for w in (a, b, c, d)]).view(np.uint64)
                    sides.append((node.to_numpy(zero_copy_only=False), prints, [np.frombuffer(s, "<u8") for s in sets.to_pylist()]))
                (node_x, prints_x, x), (node_y, prints_y, y) = sides if len(sides) > 1 else sides * 2
                i, j = exact_links(x, y, prints_x, prints_y, radius, wide)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(node_x[i]), pa.array(node_y[j])], ["src", "dst"])

    own = blocks.where("parts = 1").select(*fields)
    return own.mapInArrow(compare, "src bigint, dst bigint").unionAll(pairs.mapInArrow(compare, "src bigint, dst bigint")).where("src <> dst")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 40, wide: int = 72, tile_rows: int = 16384, block_shingles: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of similar texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    names = ["a", "b", "c", "d", "same", "n"]

    def work(batch: pa.RecordBatch) -> dict:
        found = []
        for text in raw(batch.column(2)):
            hashes = shingles(text, words)
            found.append((*_bits(hashes, 4), xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes()), len(hashes)))
        found = np.array(found, np.uint64).reshape(-1, 6).view(np.int64)
        return {"doc_id": batch.column(0), "key": batch.column(1)} | {c: pa.array(np.ascontiguousarray(found[:, k])) for k, c in enumerate(names)}

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key.alias("key"), F.col(text_col).alias("text"))
    prints = map_texts(rows, ["doc_id", "key", "text"], "text", f"doc_id {kind}, key bigint, " + ", ".join(f"{c} bigint" for c in names), work)
    prints = materialize(prints, "similar-prints")
    each = prints.groupBy("doc_id", "key", *names).agg(F.count("*").alias("copies"))
    nodes = each.groupBy(*names).agg(F.min(F.struct("doc_id", "key", "copies")).alias("least")).withColumn("node", F.xxhash64(*names)).drop("same")
    nodes = materialize(nodes, "similar-nodes")
    with arrow_rows(docs.sparkSession, 16):
        near = materialize(candidates(nodes.select("node", *"abcdn"), radius, wide, tile_rows), "similar-candidates")
    roots = connected_components(near).withColumnRenamed("component", "root")
    wanted = nodes.join(roots, "node").select("root", "node", *"abcdn", F.col("least.doc_id").alias("doc_id"), F.col("least.key").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    held = rows.select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "text").join(wanted, same).dropDuplicates(["node"])

    def sets(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in ("root", "node", *"abcdn")}
        return out | {"set": pa.array([shingles(x, words).astype("<u8").tobytes() for x in raw(batch.column("text"))], pa.binary())}

    members = map_texts(held, ["root", "node", *"abcdn", "text"], "text", "root bigint, node bigint, a bigint, b bigint, c bigint, d bigint, n bigint, set binary", sets)
    members = materialize(members, "similar-members")
    with arrow_rows(docs.sparkSession, 2):  # a row may be two blocks of about half a million shingles
        linked = materialize(links(members, radius, wide, block_shingles), "similar-links")
    found = connected_components(linked)
    rooted = nodes.join(found, "node", "left").select("least", F.coalesce("component", "node").alias("root"))
    kept = materialize(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.*"), "similar-kept")
    own = "kept"
    while any(c.startswith(own) for c in docs.columns):  # names that no column of the input has
        own += "_"
    kept = kept.select(F.col("doc_id").alias(f"{own}id"), F.col("key").alias(f"{own}key"), F.col("copies").alias(f"{own}n"))
    same = F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (text_key == F.col(f"{own}key"))
    once = docs.join(kept.where(F.col(f"{own}n") == 1), same, "left_semi")
    more = docs.join(kept.where(F.col(f"{own}n") > 1), same, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(more)
