"""Merkle manifest of a data set: a hash tree over the rows of each language and one over the languages.

Leaves and subroots get their places by ranges (``order.placed``). The trees are then worked on in
supersteps over RDDs of vertices, as in Pregel, all languages at once. Upwards, each node sends its
digest to its parent; a parent that has heard all its children hashes them and is a sender of the next
superstep. Downwards, from the root, each parent sends every child the digests of the child's siblings and its own
way up; at the lowest level a run of at most ``WIDTH`` leaves shares one way, against which each
leaf is folded up to the root again. Each superstep is a table in the shared folder, so a lost executor costs
one of them at most; their number is the depth of the trees, and each level has an eighth of the vertices of the one below.
A language of any size is spread over tasks by the numbers of its nodes; no vertex holds more than ``WIDTH`` children.

Digests are kept as 32 bytes and hashed as lowercase hex. The driver gets the root, and a flag after each superstep.

Defined results: a null value of a row is ``-``; a very long text is hashed whole in its row; rows of one language and doc_id
follow each other by digest of their leaf, so repeated rows are alike but for their place; null doc_ids come first and are never tampered with;
a null language is a tree of its own, the first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.order import placed, text_key
from strataloom.session import materialize

WIDTH = 8
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a node of some level: its tree, its number in the level, the level's nodes
NODE = "tree string, idx bigint, n bigint"


def canonical(*values: Column) -> Column:
    """The values as one string, each with its length in bytes, so that no two rows give the same."""
    one = lambda v: F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")))
    return F.concat(*map(one, values))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hashed(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _spread(key: tuple[str, int]) -> int:
    return zlib.crc32(f"{key[1]} {key[0]}".encode("utf-8", "surrogatepass"))


def _to_parent(item: tuple) -> tuple:
    (tree, idx), (n, own) = item
    return (tree, idx // WIDTH), (n, [(idx % WIDTH, own)])


def _complete(item: tuple) -> tuple:
    """A parent that has heard its children, as a row of the next level."""
    (tree, idx), (n, heard) = item
    children = [d for _, d in sorted(heard)]
    if len(children) != min(WIDTH, n - idx * WIDTH):
        raise RuntimeError(f"node {idx} of {tree} heard {len(children)} children")
    return tree, idx, -(-n // WIDTH), hashed(children), children


def climb(leaves: DataFrame, partitions: int) -> list[DataFrame]:
    """The levels above ``leaves(tree, idx, n, digest)``: tables ``(tree, idx, n, digest, children)``, until each tree has one node left."""
    spark, levels, current = leaves.sparkSession, [], leaves
    while current.where("n > 1").limit(1).count():
        partitions = max(4, partitions // 2)
        sent = current.where("n > 1").select("tree", "idx", "n", "digest").rdd.map(lambda r: _to_parent(((r.tree, r.idx), (r.n, bytes(r.digest)))))
        heard = sent.reduceByKey(lambda a, b: (a[0], a[1] + b[1]), partitions, _spread)
        current = materialize(spark.createDataFrame(heard.map(_complete), f"{NODE}, digest binary, children array<binary>", verifySchema=False), "merkle-up")
        levels.append(current)
    return levels


def subroots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``(tree, height, digest)`` of each tree's last node."""
    out = None
    for height, level in enumerate([leaves, *levels]):
        top = level.where("n = 1").select("tree", F.lit(height).alias("height"), "digest")
        out = top if out is None else out.unionAll(top)
    return out


def _step(at: int, children: list[bytes]) -> bytes:
    """One step of a way up: how many siblings, the own place among them, and their digests."""
    return bytes((len(children) - 1, at)) + b"".join(children[:at] + children[at + 1 :])


def steps(way: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Places and siblings, from the lowest level up."""
    at = 0
    while at < len(way):
        n, place = way[at], way[at + 1]
        yield place, [way[k : k + 32] for k in range(at + 2, at + 2 + 32 * n, 32)]
        at += 2 + 32 * n


def fold(own: bytes, way: bytes) -> bytes:
    """The root that a leaf and its way up give."""
    for place, siblings in steps(way):
        own = hashed([*siblings[:place], own, *siblings[place:]])
    return own


def proof(way: bytes) -> str:
    """Digest of all siblings of a way, level by level."""
    return hashlib.sha256("".join(s.hex() for _, siblings in steps(way) for s in siblings).encode()).hexdigest()


def _to_children(item: tuple) -> Iterator[tuple]:
    (tree, idx), (children, (top, way)) = item
    for at in range(len(children)):
        yield tree, idx * WIDTH + at, top, _step(at, children) + way


def descend(levels: list[DataFrame], tops: DataFrame, lowest: int, partitions: int) -> RDD:
    """Ways up of all nodes of level ``lowest``, and of trees that end below it: ``((tree, idx), (top, way))``.

    ``tops(tree, height, top, way)`` holds what each tree's last node knows: a value for the whole tree and its own way up.
    """
    spark = tops.sparkSession
    schema = "tree string, idx bigint, top binary, way binary"
    known = None
    for height in range(len(levels), -1, -1):
        here = tops.where(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("idx"), "top", "way")
        known = here if known is None else known.unionAll(here)
        if height <= lowest:
            continue
        pairs = known.rdd.map(lambda r: ((r.tree, r.idx), (bytes(r.top), bytes(r.way))))
        children = levels[height - 1].rdd.map(lambda r: ((r.tree, r.idx), list(map(bytes, r.children))))
        size = max(4, partitions >> height)
        sent = children.partitionBy(size, _spread).join(pairs.partitionBy(size, _spread), size).flatMap(_to_children)
        known = materialize(spark.createDataFrame(sent, schema, verifySchema=False), "merkle-down")
    return known.rdd.map(lambda r: ((r.tree, r.idx), (bytes(r.top), bytes(r.way))))


def _verify(item: tuple, root: bytes) -> Iterator[tuple]:
    """The rows of a run of leaves: proofs and what each leaf, tampered with or not, folds to."""
    _, (leaves, ways) = item
    leaves, (top, way) = sorted(leaves), next(iter(ways))
    digests = [r[1] for r in leaves]
    for at, (_, own, changed, n, doc_id) in enumerate(leaves):
        whole = (_step(at, digests) if n > 1 else b"") + way
        folded = fold(changed or own, whole)
        yield doc_id, own.hex(), top.hex(), root.hex(), proof(whole), folded.hex(), folded == root


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", tamper: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row.

    The text's capitals A-Z are lowered where ``tamper`` holds, after the manifest was made.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    changed = [F.translate(F.col(c), CAPITALS, SMALL) if c == text_col else F.col(c) for c in columns]
    hit = F.lit(False) if tamper is None else F.coalesce(tamper, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(group_col)).alias("tree"), digest(canonical(*map(F.col, columns))).alias("digest"), F.when(hit, digest(canonical(*changed))).alias("changed"))
    leaves = placed(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")]).withColumnsRenamed({"before": "idx", "total": "n"})
    leaves = materialize(leaves, "merkle-leaves")
    levels = climb(leaves, partitions)
    tops = materialize(subroots(leaves, levels), "merkle-tops")
    # the same over the languages: one tree, whose leaves are the subroots
    upper = placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), "tree", [F.col("name")])
    upper = materialize(upper.withColumnsRenamed({"before": "idx", "total": "n"}), "merkle-tops")
    above = climb(upper, partitions)
    last = subroots(upper, above)
    found = last.select("digest").first()  # one row, none for an empty table
    root = bytes(found[0]) if found else b""
    ways = descend(above, last.select("tree", "height", F.lit(b"").alias("top"), F.lit(b"").alias("way")), 0, partitions)
    ways = spark.createDataFrame(ways.map(lambda x: (x[0][1], x[1][1])), "idx bigint, way binary", verifySchema=False)
    tops = materialize(upper.join(ways, "idx").select(F.col("name").alias("tree"), "height", F.col("digest").alias("top"), "way"), "merkle-down")
    ways = descend(levels, tops, 1, partitions)
    sent = leaves.select("tree", "idx", "n", "digest", "changed", "doc_id").rdd.map(lambda r: ((r.tree, r.idx // WIDTH), (r.idx, bytes(r.digest), r.changed and bytes(r.changed), r.n, r.doc_id)))
    met = sent.partitionBy(partitions, _spread).cogroup(ways.partitionBy(partitions, _spread), partitions)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(met.flatMap(lambda x: _verify(x, root)), schema, verifySchema=False)


def third(doc_id: Column) -> Column:
    """Is the crc32 of the decimal doc_id divisible by 3?"""
    return F.crc32(doc_id.cast("string")) % 3 == 0


def verified(docs: DataFrame) -> DataFrame:
    """The manifest with production parameters: texts of a third of the rows are tampered with."""
    return manifest(docs, tamper=third(F.col("doc_id")))


def oracle() -> str:
    """DuckDB SQL of ``verified``: levels by a recursive query, siblings and folds by joins with them."""
    item = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"
    row = lambda text: f"sha256(concat({', '.join(map(item, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {bits}))"
    return f"""
    WITH RECURSIVE base AS (
        SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE concat('=', lang) END AS tree, {row('text')} AS leaf,
            CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {row(f"translate(text, '{CAPITALS}', '{SMALL}')")} END AS changed FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM base),
    low(phase, tree, level, idx, n, h) AS (
        SELECT 0, tree, 0, idx, n, leaf FROM leaves
        UNION ALL SELECT 0, tree, level + 1, idx // {WIDTH}, any_value(n + {WIDTH - 1}) // {WIDTH}, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // {WIDTH}),
    tops AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
    high(phase, tree, level, idx, n, h) AS (
        SELECT 1, '', 0, idx, n, h FROM tops
        UNION ALL SELECT 1, '', level + 1, idx // {WIDTH}, any_value(n + {WIDTH - 1}) // {WIDTH}, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // {WIDTH}),
    nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
    -- the way of each leaf: nodes of its tree, then those above its subroot
    way(tree, leaf_idx, doc_id, phase, level, idx, n, own, folded) AS (
        SELECT tree, idx, doc_id, 0, 0, idx, n, leaf, coalesce(changed, leaf) FROM leaves
        UNION ALL
        SELECT w.tree, w.leaf_idx, any_value(w.doc_id), any_value(CASE WHEN w.n = 1 THEN 1 ELSE w.phase END), any_value(CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END),
            any_value(CASE WHEN w.n = 1 THEN t.idx ELSE w.idx // {WIDTH} END), any_value(CASE WHEN w.n = 1 THEN t.n ELSE (w.n + {WIDTH - 1}) // {WIDTH} END),
            CASE WHEN any_value(w.n) = 1 THEN any_value(w.own) ELSE sha256(string_agg(s.h, '' ORDER BY s.idx)) END,
            CASE WHEN any_value(w.n) = 1 THEN any_value(w.folded) ELSE sha256(string_agg(CASE WHEN s.idx = w.idx THEN w.folded ELSE s.h END, '' ORDER BY s.idx)) END
        FROM way w JOIN tops t ON t.tree = w.tree
            JOIN nodes s ON s.phase = w.phase AND s.tree = CASE WHEN w.phase = 0 THEN w.tree ELSE '' END AND s.level = w.level AND s.idx // {WIDTH} = w.idx // {WIDTH}
        WHERE w.n > 1 OR w.phase = 0 GROUP BY w.tree, w.leaf_idx),
    shown AS (SELECT w.tree, w.leaf_idx, sha256(coalesce(string_agg(s.h, '' ORDER BY w.phase, w.level, s.idx), '')) AS proof
        FROM way w LEFT JOIN nodes s ON w.n > 1 AND s.phase = w.phase AND s.tree = CASE WHEN w.phase = 0 THEN w.tree ELSE '' END AND s.level = w.level AND s.idx // {WIDTH} = w.idx // {WIDTH} AND s.idx <> w.idx
        GROUP BY w.tree, w.leaf_idx)
    SELECT l.doc_id, l.leaf, t.h AS subroot, e.own AS root, p.proof AS proof_sha256, e.folded AS folded_root, e.folded = e.own AS verified
    FROM leaves l JOIN tops t USING (tree) JOIN way e ON e.tree = l.tree AND e.leaf_idx = l.idx AND e.phase = 1 AND e.n = 1 JOIN shown p ON p.tree = l.tree AND p.leaf_idx = l.idx
    """
