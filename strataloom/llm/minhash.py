"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles (five words, lower-cased, split at the six ASCII blanks; fewer words: all of
them) are hashed once. The top bits of a hash choose its bin, each bin keeps its least hash,
and of that the low-order ``BITS`` bits are stored. An empty bin takes the value of the first
bin that is not empty in its own fixed order of probing (optimal densification, Shrivastava
2017). Two fingerprints' share of equal bins, freed of what chance alone makes equal, estimates
the Jaccard likeness of their shingle sets.

Sorting a text's hashes brings each bin's least one to the bin's first place, so no shingle
ever leaves its row and nothing is shuffled for a fingerprint.

``edited`` needs each document's successor by doc_id. Documents are dealt to buckets of
consecutive doc_ids, whose borders are approximate quantiles, and each bucket also gets the
first document of the next bucket; so a window within the bucket finds every successor and the
texts are shuffled once. The number of buckets, which bounds what goes to the driver and what is
broadcast, is ``most_buckets`` at most.

Defined results: a null text is empty; a very long text is hashed whole in its row; shingles of equal hashes are one; texts without a word have the empty fingerprint, alike
to each other (1) and unlike any other (0); equal texts have equal fingerprints; repeated
doc_ids follow each other by text; null doc_ids come first; the last document is followed by
the first, a single one by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WORDS = 128, 8, 5
_BLANKS = "\t\n\x0b\x0c\r"
_PROBES = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(text: Column) -> Column:
    """Hashes of a text's shingles, repeats included."""
    words = F.filter(F.split(F.translate(F.lower(text), _BLANKS, " " * len(_BLANKS)), " "), lambda w: w != "")

    def rolled(h: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        return F.when(F.size(h) >= WORDS, parts).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - (BINS - 1).bit_length()).cast("int") + BINS // 2


def _dense(hashes: Column) -> Column:
    """The stored bits of each bin, null where a bin is empty."""

    def leasts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def spread(first: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(first, i - 1)))
            own = F.array(x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint"))
            return F.concat(F.array_repeat(F.lit(None).cast("smallint"), _bin(x) - before - 1), own)

        last = F.coalesce(_bin(F.get(first, F.size(first) - 1)), F.lit(-1))
        return F.concat(F.flatten(F.transform(first, piece)), F.array_repeat(F.lit(None).cast("smallint"), F.lit(BINS - 1) - last))

    return _let(_let(F.sort_array(hashes), leasts), spread)


def _probe(k: Column, t: Column | int) -> Column:
    """The ``t``-th bin that the empty bin ``k`` asks: an odd step of its own visits every bin."""
    start, step = F.pmod(k * 2654435 + 40503, F.lit(BINS)), F.pmod(k * 69069 + 1, F.lit(BINS // 2)) * 2 + 1
    return F.pmod(start + step * t, F.lit(BINS))


def signature(text: Column) -> Column:
    """The fingerprint of a text as ``array<smallint>``; empty if the text has no word."""

    def filled(d: Column) -> Column:
        def borrow(v: Column, k: Column) -> Column:
            some = [F.get(d, _probe(k, t)) for t in range(_PROBES)]
            every = F.filter(F.transform(F.sequence(F.lit(_PROBES), F.lit(BINS - 1)), lambda t: F.get(d, _probe(k, t))), lambda x: x.isNotNull())
            return F.coalesce(v, *some, F.get(every, F.lit(0)))

        whole = ~F.exists(d, lambda v: v.isNull())
        blank = ~F.exists(d, lambda v: v.isNotNull())
        return F.when(whole, d).when(blank, F.array().cast("array<smallint>")).otherwise(F.transform(d, borrow))

    return _let(_dense(_shingles(F.coalesce(text, F.lit("")))), filled)


def packed(signature: Column) -> Column:
    """A signature as lowercase hex."""
    digits = -(-BITS // 4)
    return F.array_join(F.transform(signature, lambda v: F.lower(F.lpad(F.hex(v.cast("bigint")), digits, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two signatures, from 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / BINS
    chance = 2.0**-BITS
    free = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(free)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of each document."""
    return docs.select(F.col(id_col).alias("doc_id"), packed(signature(F.col(text_col))).alias("fingerprint"))


def _bucket(doc_id: Column, bounds: list) -> Column:
    """The number of bounds at or below a doc_id, found in two steps; -1 for null."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    if not rows:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    coarse = F.array(*(F.lit(r[0]) for r in rows))
    fine = F.array(*(F.array(*map(F.lit, r)) for r in rows))
    at_most = lambda xs: F.size(F.filter(xs, lambda b: b <= doc_id))
    row = at_most(coarse)
    return F.when(doc_id.isNull(), -1).when(row == 0, 0).otherwise((row - 1) * width + at_most(F.get(fine, row - 1)))


def with_successors(docs: DataFrame, values: list[str], id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2000, most_buckets: int = 16384) -> DataFrame:
    """``docs`` with, for each of ``values``, a column ``next_<value>``: that of the next document by id."""
    spark = docs.sparkSession
    total = docs.count()
    parts = min(most_buckets, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // rows_per_bucket))
    shares = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(id_col, shares, 100 * most_buckets)).first()[0] if total else None
    bucket = _bucket(F.col(id_col), sorted(set(found or [])))
    firsts = docs.select(bucket.alias("bucket"), id_col).groupBy("bucket").agg(F.min(id_col).alias("first")).collect()  # a row for each bucket
    firsts.sort(key=lambda r: r.bucket)
    edges = [(r.first, firsts[k - 1].bucket) for k, r in enumerate(firsts)] if total else []
    kind = docs.schema[id_col].dataType.simpleString()
    also = spark.createDataFrame(edges, f"__first {kind}, __also int")  # most_buckets + 1 rows at most
    dealt = docs.withColumn("__own", bucket).join(F.broadcast(also), F.col(id_col).eqNullSafe(F.col("__first")), "left")
    dealt = dealt.withColumn("__to", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("late"), F.col("__own").alias("bucket")), F.when(F.col("__also").isNotNull(), F.struct(F.lit(1).alias("late"), F.col("__also").alias("bucket")))))))
    order = Window.partitionBy("__to.bucket").orderBy("__to.late", F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    out = dealt.select("*", *(F.lead(v).over(order).alias(f"next_{v}") for v in values)).where("__to.late = 0")
    return out.drop("__own", "__first", "__also", "__to")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has the last quarter of the code points (rounded down) replaced by the
    first as many of the next document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("own", signature(F.col("text")))
    pairs = with_successors(rows, ["text", "own"], "doc_id", "text")
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter))
    pairs = pairs.select("doc_id", size.cast("bigint").alias("n_chars"), changed.alias("changed"), "own", "next_own")
    pairs = pairs.withColumn("then", signature(F.col("changed")))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("changed", 256).alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("then")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("then")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
