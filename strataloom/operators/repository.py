"""Analyses of commits, issues, watchers, forks and file changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in each unit that a gap is measured in.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def seconds(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def counts_by(rows: DataFrame, key: str, distinct: str | None = None, name: str = "n") -> DataFrame:
    """Rows (or different values of a column) of each key."""
    return rows.groupBy(key).agg((F.count("*") if distinct is None else F.countDistinct(distinct)).alias(name))


def gaps(rows: DataFrame, by: list[str], ts: str, unit: str = "hours", tie: str | None = None) -> DataFrame:
    """Time since the row before in each group; the first has none."""
    over = Window.partitionBy(*by).orderBy(ts, *([tie] if tie else []))
    gap = (seconds(ts) - F.lag(seconds(ts)).over(over)) / UNITS[unit]
    return rows.withColumn("gap", gap).where("gap is not null")


def gap_seconds_of_day(rows: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    """The same with whole days dropped from each gap."""
    return gaps(rows, by, ts, "seconds", tie).withColumn("gap", F.col("gap") % UNITS["days"])


def life_times(events: DataFrame, key: str, ts: str, unit: str = "hours") -> DataFrame:
    """Time from the first to the last event of each key."""
    return events.groupBy(key).agg(((F.max(seconds(ts)) - F.min(seconds(ts))) / UNITS[unit]).alias("life"), F.count("*").alias("events"))


def outer_counts(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Two counts by key side by side, 0 where one is missing."""
    return left.join(right, key, "full_outer").select(key, F.coalesce(a, F.lit(0)).alias(a), F.coalesce(b, F.lit(0)).alias(b))


def active_days(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """``(by, day, n)``: events of every day from a group's first to its last, 0 on idle ones; day 1 is the first."""
    each = rows.groupBy(by, F.to_date(ts).alias("date")).agg(F.count("*").alias("n"))
    ends = each.groupBy(by).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    calendar = ends.select(by, "first", F.explode(F.sequence("first", "last")).alias("date"))
    filled = calendar.join(each, [by, "date"], "left")
    return filled.select(by, (F.datediff("date", "first") + 1).alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def active_day_gaps(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """Days between consecutive active days of each group."""
    days = rows.select(by, F.to_date(ts).alias("date")).distinct()
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(by).orderBy("date")))
    return days.withColumn("gap", gap).where("gap is not null")


def merged_maps(entries: DataFrame, key: str, name: str, value: str, order: str) -> DataFrame:
    """``(key, name, value)`` of maps given as entries: the latest entry of a name wins."""
    return entries.groupBy(key, name).agg(F.max_by(value, order).alias(value))


def patch_lines(files: DataFrame, patch: str = "patch", keys: list[str] = ()) -> DataFrame:
    """``(*keys, kind, line_no)`` of the lines that unified diffs add (new numbers) and delete (old numbers).

    A hunk header sets both counters. Added lines advance the new one, deleted lines the old one, and any
    other line both. Window sums within a hunk replace a loop over lines.
    """
    lines = files.select(*keys, F.monotonically_increasing_id().alias("__patch"), F.split(patch, "\n").alias("__lines"))
    lines = lines.select(*keys, "__patch", F.posexplode("__lines").alias("pos", "line"))
    header = F.col("line").rlike("^@@ -[0-9]+")
    lines = lines.withColumn("hunk", F.sum(header.cast("int")).over(Window.partitionBy("__patch").orderBy("pos")))
    hunk = Window.partitionBy("__patch", "hunk")
    start = lambda sign: F.max(F.when(header, F.regexp_extract("line", rf"\{sign}([0-9]+)", 1).cast("int"))).over(hunk)
    kind = F.when(header, "@").when(F.col("line").startswith("+"), "+").when(F.col("line").startswith("-"), "-").otherwise(" ")
    lines = lines.where("hunk > 0").withColumn("kind", kind).withColumn("old0", start("-")).withColumn("new0", start("+"))
    before = hunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    passed = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(before), F.lit(0))
    numbered = lines.withColumn("new_no", F.col("new0") + passed(["+", " "])).withColumn("old_no", F.col("old0") + passed(["-", " "]))
    return numbered.where("kind in ('+', '-')").select(*keys, "kind", F.when(F.col("kind") == "+", F.col("new_no")).otherwise(F.col("old_no")).cast("int").alias("line_no"))


def blame(deleted: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Who last touched each deleted line: deleted lines joined to a table of lines with their commits."""
    return deleted.join(lines, key)


def fork_roots(projects: DataFrame, node: str = "id", parent: str = "forked_from", max_rounds: int = 64) -> DataFrame:
    """``(node, root)`` of a fork forest by pointer doubling: the rounds grow with the logarithm of its depth."""
    from strataloom.session import materialize

    known = projects.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    exists = known.select(F.col("node").alias("up"))
    linked = known.join(exists, "up", "left_semi").select("node", "up")
    at = known.join(linked, "node", "left_anti").select("node", F.col("node").alias("up")).unionByName(linked)
    for _ in range(max_rounds):
        above = at.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        nxt = materialize(at.join(above, "up").select("node", "up", "upper"), "fork-roots")
        moved = nxt.where("up <> upper").limit(1).count()
        at = nxt.select("node", F.col("upper").alias("up"))
        if not moved:
            return at.select("node", F.col("up").alias("root"))
    raise RuntimeError("the forest is too deep, or has a cycle")
