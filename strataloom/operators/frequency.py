"""Term, document and n-gram frequencies; snapshots of a growing corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators.prefix import running_sums
from strataloom.session import materialize


def token_rows(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(*keys, pos, tok)``: a row for each token."""
    return docs.select(*keys, F.posexplode(tx.tokens(F.col(text_col))).alias("pos", "tok"))


def _firsts(terms: Column) -> Column:
    """Terms of one row in order, each with whether it is the first of its kind in the row."""

    def marked(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get(s, i - 1) != x)).cast("int").alias("first")))

    return F.get(F.transform(F.array(F.sort_array(terms)), marked), F.lit(0))


def _by_row(docs: DataFrame, terms: Column, by: list[str], name: str, freq: str, rows: str) -> DataFrame:
    """``(*by, name, freq, rows)``: how often a term stands and in how many rows, in one shuffle: a row marks its own first of each term."""
    marked = docs.select(*by, F.explode(_firsts(terms)).alias("t"))
    return marked.groupBy(*by, F.col("t.term").alias(name)).agg(F.count("*").alias(freq), F.sum("t.first").alias(rows))


def term_document_frequency(docs: DataFrame, doc: str | None, by: list[str] = (), text_col: str = "text") -> DataFrame:
    """``(*by, tok, tf, df)``; without ``doc`` each row is a document of its own, and one shuffle does.

    With it, counts are taken within a document first, so the second shuffle gets a row for each document's term at most.
    """
    if doc is None:
        return _by_row(docs, tx.tokens(F.col(text_col)), list(by), "tok", "tf", "df")
    each = token_rows(docs, [doc, *by], text_col).groupBy(doc, *by, "tok").agg(F.count("*").alias("n"))
    return each.groupBy(*by, "tok").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def ngram_frequency(docs: DataFrame, n: int, by: list[str] = (), text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """``(*by, ngram, freq, n_files)``: frequency and number of documents; ``keep`` filters tokens before they are joined."""
    toks = tx.tokens(F.col(text_col))
    if keep is not None:
        toks = keep
    return _by_row(docs, tx.ngrams(toks, n), list(by), "ngram", "freq", "n_files")


def document_counts(docs: DataFrame, by: list[str] = (), text_col: str = "text") -> DataFrame:
    """Numbers of documents, and of those with more than one distinct token."""
    distinct = F.size(F.array_distinct(tx.tokens(F.col(text_col))))
    return docs.groupBy(*by).agg(F.count("*").alias("docs"), F.count_if(F.coalesce(distinct, F.lit(0)) > 1).alias("non_empty"))


def class_split(counted: DataFrame, classes: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Unique and total counts of each named class of a dictionary ``(tok, freq)``."""
    sums = [x for name, c in classes.items() for x in (F.count_if(c).alias(f"{name}_uniq"), F.sum(F.when(c, F.col("freq")).otherwise(0)).alias(f"{name}_total"))]
    return counted.groupBy(*by).agg(*sums)


def heaps_by_document(docs: DataFrame, order: str, by: list[str], text_col: str = "text") -> DataFrame:
    """``(*by, order, total, uniq)`` after each document.

    New tokens are found by their first document, so only one row for each document, not each
    token, goes through the running sums.
    """
    return _heaps(docs, order, by, text_col).select(*by, order, "total", "uniq")


def _heaps(docs: DataFrame, order: str, by: list[str], text_col: str) -> DataFrame:
    toks = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    each = materialize(docs.select(order, *by, toks.alias("toks")).select(order, *by, F.size("toks").alias("n"), F.array_distinct("toks").alias("toks")), "heaps")  # read twice, cut once
    rows = each.select(order, *by, F.explode("toks").alias("tok"))
    sizes = each.select(order, *by, "n")
    first = rows.groupBy(*by, "tok").agg(F.min(order).alias(order)).groupBy(*by, order).agg(F.count("*").alias("new"))
    both = sizes.join(first, [*by, order], "left").select(*by, order, "n", F.coalesce("new", F.lit(0)).alias("new"))
    return running_sums(both, list(by), order, {"n": "total", "new": "uniq"})


def heaps_by_token(docs: DataFrame, order: str, by: list[str], text_col: str = "text") -> DataFrame:
    """``(*by, total, uniq)`` after each token: document totals first, then a window inside each document."""
    rows = token_rows(docs, [order, *by], text_col)
    first = rows.groupBy(*by, "tok").agg(F.min(F.struct(order, "pos")).alias("at")).select(*by, F.col(f"at.{order}").alias(order), F.col("at.pos").alias("pos"), F.lit(1).alias("new"))
    ends = _heaps(docs, order, by, text_col)
    starts = ends.select(*by, order, (F.col("total") - F.col("n")).alias("total0"), (F.col("uniq") - F.col("new")).alias("uniq0"))
    inside = Window.partitionBy(*by, order).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.join(first, [*by, order, "pos"], "left").select(*by, order, "pos", F.sum(F.coalesce("new", F.lit(0))).over(inside).alias("uniq"))
    return marked.join(starts, [*by, order]).select(*by, (F.col("total0") + F.col("pos") + 1).alias("total"), (F.col("uniq0") + F.col("uniq")).alias("uniq"))


def snapshots(docs: DataFrame, order: str, by: list[str], thresholds: list[int], text_col: str = "text") -> DataFrame:
    """The first document at which the vocabulary reaches each threshold: ``(*by, threshold, order, total, uniq)``."""
    curve = heaps_by_document(docs, order, by, text_col)
    reached = curve.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("uniq >= threshold")
    return reached.groupBy(*by, "threshold").agg(F.min_by(F.struct(order, "total", "uniq"), order).alias("s")).select(*by, "threshold", "s.*")


def snapshot_frequency(docs: DataFrame, order: str, shares: list[float], text_col: str = "text") -> DataFrame:
    """``(share, tok, tf, df)`` over the documents up to each share of the largest ``order``.

    A document's terms are counted once, with the first snapshot that holds it; a running sum over the few
    snapshots of each term does the rest.
    """
    top = docs.agg(F.max(order).alias("top"))  # one row
    held = [F.when(F.col(order) <= F.lit(s) * F.col("top"), F.lit(k)) for k, s in enumerate(sorted(shares))]
    first = docs.crossJoin(F.broadcast(top)).select(F.coalesce(*held).alias("k"), text_col).where("k is not null")
    each = _by_row(first, tx.tokens(F.col(text_col)), ["k"], "tok", "tf", "df")
    levels = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(k).alias("at")) for k, s in enumerate(sorted(shares))))
    seen = each.select("tok", "tf", "df", F.explode(F.filter(levels, lambda x: x["at"] >= F.col("k"))).alias("s"))
    return seen.groupBy(F.col("s.share").alias("share"), "tok").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def snapshot_vocabulary(docs: DataFrame, order: str, text_col: str = "text") -> DataFrame:
    """``(order, uniq_all, n_all, uniq_program, n_program)`` after each document, from one cut of the texts."""
    toks = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    each = materialize(docs.select(order, toks.alias("toks")).select(order, F.size("toks").alias("n"), F.size(F.filter("toks", tx.is_entity)).alias("p"), F.array_distinct("toks").alias("toks")), "snapshots")
    first = each.select(order, F.explode("toks").alias("tok")).groupBy("tok").agg(F.min(order).alias(order))
    new = first.groupBy(order).agg(F.count("*").alias("new"), F.count_if(tx.is_entity(F.col("tok"))).alias("new_p"))
    both = each.select(order, "n", "p").join(new, order, "left").select(order, "n", "p", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("new_p", F.lit(0)).alias("new_p"))
    names = {"new": "uniq_all", "n": "n_all", "new_p": "uniq_program", "p": "n_program"}
    return running_sums(both, [], order, names).select(order, *names.values())


def vocabulary_with_retractions(changes: DataFrame, order: str, tok: str = "tok", delta: str = "delta") -> DataFrame:
    """``(order, uniq, total)`` under signed changes of token counts.

    Each token's running count gives the steps at which it appears or vanishes; those steps are summed
    by ``order`` before the one running sum over all of them.
    """
    each = changes.groupBy(order, tok).agg(F.sum(delta).alias("d"))
    over = Window.partitionBy(tok).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    now = each.withColumn("count", F.sum("d").over(over))
    before = F.coalesce(F.lag("count").over(Window.partitionBy(tok).orderBy(order)), F.lit(0))
    steps = now.withColumn("step", (F.col("count") > 0).cast("int") - (before > 0).cast("int")).groupBy(order).agg(F.sum("step").alias("step"), F.sum("d").alias("d"))
    return running_sums(steps, [], order, {"step": "uniq", "d": "total"}).select(order, "uniq", "total")
