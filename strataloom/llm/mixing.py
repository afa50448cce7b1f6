"""Mixing sources to target weights by systematic sampling.

Sources get targets in words: their weight's share of all words, but at most ``ceiling`` times what they hold,
the excess going to the others by weight. A document's expected copies are its source's target over its
source's words. Within a source the documents stand by size; expected copies are summed up along that
order, one random offset is added, and a document is taken once for each whole number that its sum passes. So
it is taken the whole part of its expectation, or once more, and because sizes rise along the order, a
source's taken words miss its target by less than its longest document.

Expected copies are whole numbers of ``UNIT``-ths and their sums decimals, so no rounding depends on how the
rows are dealt. The offset is a digest of seed and source: reruns agree. Sources are numbered and documents
summed up by ranges (``order.placed``); what reaches the driver are two sums for each round of resharing.

Defined results: a null text has size 0, its copies count nothing but are given; texts of any length are counted whole; a null
source is a source of its own, the last; an empty one is another; rows of the same size, doc_id and text are alike, and the first of them
are taken; null doc_ids come first among equal sizes; with no words at all every target is 0 and nothing is
taken, and so are documents of a source without words; an empty table gives no rows; other columns are not
read by ``shares``, and ``mixed`` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.audit import words
from strataloom.llm.order import placed
from strataloom.session import materialize

UNIT = 10**15
#: the offset has nine decimal digits
DRAWS = 10**9


def targets(sources: DataFrame, ceiling: int = 3) -> DataFrame:
    """``sources(key, size, weight)`` with ``target`` (double) and ``expected``, the copies of each word in ``UNIT``-ths.

    Each round the sources whose share of what is left passes their ceiling are fixed at it; the rest share again.
    The share of a source is ``weight * left / weights``, in whole numbers up to the last division.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    most, weight = F.col("size").cast("decimal(38,0)") * ceiling, F.col("weight").cast("decimal(38,0)")
    left, weights, before = int(total), None, -1
    share_above = F.lit(False)
    while True:  # each round fixes a source at least
        fixed, open_weight, n = sources.agg(F.sum(F.when(share_above, most)), F.sum(F.when(share_above, None).otherwise(weight)), F.count_if(share_above)).first()
        left, weights = int(total - (fixed or 0)), int(open_weight or 0)
        if n == before or not weights:
            break
        before = n
        share_above = most * F.lit(weights).cast("decimal(38,0)") < weight * F.lit(left).cast("decimal(38,0)")
    share = F.lit(left).cast("decimal(38,0)") * weight
    target = F.when(share_above, most.cast("double")).otherwise(share.cast("double") / F.lit(float(weights or 1)))
    exact = F.expr(f"(cast({left} as decimal(38,0)) * cast(weight as decimal(38,0)) * cast({UNIT} as decimal(38,0))) div (cast({weights or 1} as decimal(38,0)) * cast(size as decimal(38,0)))")
    expected = F.when(F.col("size") == 0, F.lit(0).cast("bigint")).when(share_above, F.lit(ceiling * UNIT)).otherwise(exact)
    return sources.withColumns({"target": target, "expected": expected})


def shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, tie, source_key)`` of each document.

    Sources by code point, null last, have ``weights`` in turn. ``tie`` is the text's hash.
    """
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), "b").otherwise(F.concat(F.lit("a"), source))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("source_key"), F.coalesce(F.size(words(F.coalesce(text_col, F.lit("")))), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(text_col).alias("tie"))
    rows = materialize(rows, "sizes")
    sums = rows.groupBy("source_key").agg(F.sum("size").alias("size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    numbered = placed(sums.withColumn("all", F.lit("")), "all", [F.col("source_key")])
    found = targets(materialize(numbered.select("source_key", "size", turn.alias("weight")), "sources"), ceiling)
    found = materialize(found.select("source_key", F.col("size").alias("source_size"), "target", "expected"), "targets")
    digest = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "source_key"), 256), 1, 12), 16, 10).cast("bigint")
    offset = F.pmod(digest, F.lit(DRAWS)) * (UNIT // DRAWS)
    summed = placed(rows.join(found, "source_key"), "source_key", [F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("tie")], F.col("expected"), "decimal(20,0)")
    start = F.col("before").cast("decimal(38,0)") + offset
    passed = F.expr(f"(_start + expected) div {UNIT} - _start div {UNIT}")
    out = summed.withColumn("_start", start).withColumn("copies", passed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "tie", "source_key")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, all columns as they are, each as often as it is taken.

    Rows of one doc_id, source and text are taken together: the first of them stands for all.
    """
    source = F.col(source_col).cast("string")
    own = F.struct(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.when(source.isNull(), "b").otherwise(F.concat(F.lit("a"), source)).alias("s"))
    plan = shares(docs, weights, ceiling, seed, id_col, text_col, source_col)
    plan = plan.groupBy(F.struct(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.col("source_key").alias("s")).alias("__mix_key")).agg(F.sum("copies").alias("__mix_copies")).where("__mix_copies > 0")
    rows = docs.withColumn("__mix_key", own).dropDuplicates(["__mix_key"]).join(plan, "__mix_key")
    return rows.withColumn("__mix_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "__mix_copies"))).select(*docs.columns)


def mix(docs: DataFrame) -> DataFrame:
    """The digest of the mix with production parameters."""
    return shares(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    """DuckDB SQL of ``mix``: targets by the ratios of ceiling and weight in order, copies by running sums."""
    return rf"""
    WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k, coalesce(text, '') AS t,
            CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
    s AS (SELECT k, CAST(sum(size) AS HUGEINT) AS size, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS weight FROM d GROUP BY k),
    -- the sources with the least words for their weight are the ones at their ceiling: as many as leave the others below theirs
    q AS (SELECT *, coalesce(sum(3 * size) OVER earlier, 0) AS fixed, sum(weight) OVER later AS open, sum(size) OVER () AS total FROM s
          WINDOW earlier AS (ORDER BY size * 6 // weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 later AS (ORDER BY size * 6 // weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    p AS (SELECT CAST(total - fixed AS HUGEINT) AS remaining, CAST(open AS HUGEINT) AS open FROM q WHERE 3 * size * open >= (total - fixed) * weight ORDER BY size * 6 // weight, k LIMIT 1),
    g AS (SELECT k, CAST(s.size AS BIGINT) AS source_size,
            CASE WHEN 3 * s.size * open < remaining * weight THEN CAST(3 * s.size AS DOUBLE) ELSE CAST(remaining * weight AS DOUBLE) / CAST(open AS DOUBLE) END AS target,
            CASE WHEN s.size = 0 THEN 0 WHEN 3 * s.size * open < remaining * weight THEN 3 * {UNIT} ELSE (remaining * weight * {UNIT}) // (open * s.size) END AS expected,
            CAST(('0x' || substr(sha256('0:' || k), 1, 12))::BIGINT % {DRAWS} AS HUGEINT) * {UNIT // DRAWS} AS offs FROM s, p),
    r AS (SELECT d.*, g.*, coalesce(sum(expected) OVER (PARTITION BY d.k ORDER BY size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM d JOIN g ON d.k = g.k)
    SELECT doc_id, size, source_size, target,
        CAST(size * ((CAST(earlier AS HUGEINT) + offs + CAST(expected AS HUGEINT)) // {UNIT} - (CAST(earlier AS HUGEINT) + offs) // {UNIT}) AS BIGINT) AS taken FROM r
    """
