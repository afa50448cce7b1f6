"""Filter interaction audit: what each filter removes alone, after others, and on average over all orders.

Each document has a mask, one bit for each filter that it fails. Documents are counted by part and
mask before anything else, so that what follows does not grow with them: a part has ``2 ** filters``
cells at most. The cells are laid out in long form, a row for each cell, order of filters and step. Along
the steps of an order a running bit-or of what a cell fails tells whether an earlier filter took it;
sums under that condition give each step's counts, and a total over the rows of a filter its Shapley value
(summed over the orders, not divided).

Duplicates are found by digest. Copies of a text have the same mask, so they are counted by digest, part and
label, together with the least doc_id and how many rows have it, before the digests' least ids are compared: a group of copies of
any size reaches a task as a few rows from each map task.

Defined results: a null text is empty (and equal to an empty one), a null lang is the part ``''``; texts of any length are read whole;
a document is a duplicate if a smaller doc_id has its text: rows that repeat the smallest doc_id are none, a null
doc_id is smaller than none and has none below it, and finds no label; of several labels of a doc_id one that
says 1 is enough; the mask of a null condition has a 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII blanks, as an array."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def text_filters(text: Column, found: Column) -> dict[str, Column]:
    """The production filters on a text and its words, true where a document fails: too short, repetitive, shouting, markup."""
    size, different = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {"A": size < 200, "B": 100 * different < 50 * size, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def mask(conditions: list[Column]) -> Column:
    """Bit k is set where condition k holds."""
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and mask of the filters ABCDE, E being the duplicates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), text.alias("text")).withColumn("words", words(F.col("text")))
    failing = text_filters(F.col("text"), F.col("words"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask(list(failing.values())).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # rows without an id find no label: they are dealt over all tasks
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).otherwise(0))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(known.withColumn("salt", F.lit(0).cast("bigint")), ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")  # an id has one row in its group
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first, F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    least = F.min("first.id").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    copies = copies.withColumn("own", F.col("free") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    split = F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + F.lit(1 << len(failing))).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    each = copies.select("part", "good", "toxic", F.explode(split).alias("c")).where("c.n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return each.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), count("good"), count("toxic"))


def audit(cells: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``(part, filter_order, step, ...)`` for each part of ``cells(part, mask, n, good, toxic)``, order and step, zeros included."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    long = cells.select("*", F.explode(orders).alias("filter_order"))
    # one exchange serves the running masks of a cell and the sums of a step
    long = long.repartition("part", "filter_order").select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    long = long.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = F.element_at(F.create_map(*(F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k))), F.col("filter"))
    long = long.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    steps = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("before", F.coalesce(F.bit_or("fails").over(steps), F.lit(0)))
    fails, there = F.col("fails") > 0, F.col("before") == 0
    total = lambda condition, value, name: F.sum(F.when(condition, F.col(value)).otherwise(0)).alias(name)
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(there & ~fails, "n", "kept"),
        total(there & fails, "n", "removed"),
        total(~there & fails, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(there & fails, "good", "good_lost"),
        total(there & fails, "toxic", "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")  # as many rows as orders


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five production filters over whole texts."""
    return audit(cells(docs, labels))


def oracle() -> str:
    """DuckDB SQL of ``filter_audit``: every document in every order, step by step, by sets of letters."""
    return r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    f AS (SELECT doc_id, part, concat(
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS failed FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    g AS (SELECT part, failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
    one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM one a, one b, one c, one d, one e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, own,
        count(*) FILTER (failed = translate(failed, concat(earlier, own), '')) AS kept,
        count(*) FILTER (contains(failed, own) AND failed = translate(failed, earlier, '')) AS removed,
        count(*) FILTER (contains(failed, own) AND failed <> translate(failed, earlier, '')) AS redundant,
        count(*) FILTER (failed = own) AS unique_fails,
        count(*) FILTER (good = 1 AND contains(failed, own) AND failed = translate(failed, earlier, '')) AS good_lost,
        count(*) FILTER (toxic = 1 AND contains(failed, own) AND failed = translate(failed, earlier, '')) AS toxic_lost
        FROM g, s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
    """
