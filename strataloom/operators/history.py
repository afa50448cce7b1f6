"""What holds along the paths of a commit history: growth of vocabularies, lines and files from the root to each commit.

A history is walked along first parents, which makes it a forest. ``tour`` numbers each tree so that a commit's
descendants are an interval of numbers. Whatever adds up along a path is then one running sum by number, in which a commit's
share comes in at its own number and goes out behind its last descendant; so branches share no state, no
commit keeps a copy of its ancestors' counts, and paths of any length take rounds by their logarithm.

Defined results: parents that are not among the commits and null ends are ignored, of several parents the least is followed,
repeated commits count once, rows of unknown commits give nothing, an empty table gives no rows; a cycle raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.prefix import running_sums
from strataloom.session import materialize


def tour(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """``commits(node)`` and ``parents(node, parent)`` -> ``(node, parent, root, depth, enter, leave)``, numbers from 0 within a root."""
    nodes = commits.select("node").where("node is not null").distinct()
    known = parents.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").groupBy("node").agg(F.min("parent").alias("parent"))
    tree = materialize(nodes.join(known, "node", "left"), "tour-tree")
    parent = F.col("parent")
    sized = _doubled(
        tree.select("node", parent.alias("up"), F.coalesce(parent, F.col("node")).alias("root"), parent.isNotNull().cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("size")),
        {"root": F.coalesce("up_root", "root"), "depth": F.col("depth") + F.coalesce("up_depth", F.lit(0))},
        gathered="size",
    )
    sized = tree.join(sized.drop("up"), "node")
    # a child enters behind its parent and the earlier children with all their descendants
    below = running_sums(sized.where("parent is not null").select("node", "parent", "size"), ["parent"], "node", {"size": "through"})
    first = below.select("node", F.col("parent").alias("up"), (F.col("through") - F.col("size") + 1).alias("enter"))
    roots = tree.where("parent is null").select("node", parent.alias("up"), F.lit(0).cast("bigint").alias("enter"))
    entered = _doubled(first.unionByName(roots), {"enter": F.col("enter") + F.coalesce("up_enter", F.lit(0))})
    out = sized.join(entered.select("node", "enter"), "node")
    return out.select("node", "parent", "root", "depth", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def _doubled(rows: DataFrame, values: dict, gathered: str | None = None) -> DataFrame:
    """Pointer doubling: each round joins a node with the one that ``up`` names and looks twice as far.

    ``values`` says how a column and its namesake ``up_...`` combine; ``gathered`` is a column that sums up over descendants instead.
    """
    carried = [c for c in rows.columns if c not in ("node", "up", gathered)]
    at = materialize(rows, "tour")
    for _ in range(at.count().bit_length() + 1):  # a path is no longer than all nodes
        if not at.where("up is not null").limit(1).count():
            return at
        above = at.select(F.col("node").alias("up"), F.col("up").alias("upper"), *(F.col(c).alias(f"up_{c}") for c in carried))
        nxt = at.join(above, "up", "left")
        if gathered:
            more = at.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum(gathered).alias("more"))
            nxt = nxt.join(more, "node", "left").withColumn(gathered, F.col(gathered) + F.coalesce("more", F.lit(0)))
        at = materialize(nxt.select("node", F.col("upper").alias("up"), *(values[c].alias(c) for c in carried), *([gathered] if gathered else [])), "tour")
    raise RuntimeError("the history has a cycle")


def along_paths(toured: DataFrame, rows: DataFrame, values: list[str], by: list[str] = ()) -> DataFrame:
    """``rows(node, *by, *values)`` -> ``(node, *by, *values)``: sums over a node and its ancestors of the same ``by``.

    Only nodes that have a row (of those ``by``) appear.
    """
    held = rows.groupBy("node", *by).agg(*(F.sum(v).alias(v) for v in values)).join(toured.select("node", "root", "enter", "leave"), "node")
    opened = held.select("root", *by, (2 * F.col("enter")).alias("at"), "node", *values)
    closed = held.groupBy("root", *by, (2 * F.col("leave") + 1).alias("at")).agg(*((-F.sum(v)).alias(v) for v in values))
    both = opened.unionByName(closed.withColumn("node", F.lit(None)))
    # one row for each place: a column tells the rows of a group apart
    sums = running_sums(both, ["root", *by], "at", {v: f"path_{v}" for v in values})
    return sums.where("at % 2 = 0").select("node", *by, *(F.col(f"path_{v}").alias(v) for v in values))


def path_growth(toured: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(node, term, added, removed)`` -> what each commit's path has brought.

    ``(node, root, depth, touched, terms, added, size)``: changes, different terms, amounts added, and amounts added
    less removed, over the commit and all its ancestors. Commits without changes have what their parents have.
    """
    each = materialize(changes.groupBy("node", "term").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed")), "path-changes")
    seen = along_paths(toured, each.withColumn("n", F.lit(1).cast("bigint")), ["n"], ["term"])
    fresh = seen.groupBy("node").agg(F.count("*").alias("touched"), F.count_if(F.col("n") == 1).alias("terms"))
    amounts = each.groupBy("node").agg(F.sum("added").alias("added"), F.sum(F.col("added") - F.col("removed")).alias("size"))
    names = ["touched", "terms", "added", "size"]
    own = toured.select("node").join(fresh, "node", "left").join(amounts, "node", "left").select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    return toured.select("node", "root", "depth").join(along_paths(toured, own, names), "node")


def term_history(toured: DataFrame, changes: DataFrame) -> DataFrame:
    """``(node, term, nth, size)``: which change of the term on its path this is, and the amount left after it."""
    each = changes.groupBy("node", "term").agg(F.sum(F.col("added") - F.col("removed")).alias("size")).withColumn("nth", F.lit(1).cast("bigint"))
    return along_paths(toured, each, ["nth", "size"], ["term"])
