"""Places and running sums of rows within ordered groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import materialize


def text_key(value: Column) -> Column:
    """A string that is never null: empty for null, else ``=`` and the value. Its order is nulls first, then code points."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def placed(rows: DataFrame, group: str, order: list[Column], value: Column | None = None, kind: str = "bigint") -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` (one a row if None) over the rows before it in its group, and ``total``, over its group.

    ``group`` must not be null. Rows are dealt to ranges of group and order and written to the shared folder;
    each range is summed by itself, and what lies before a range is summed over the ranges of its group, of which
    there are as many as shuffle partitions. So a group of any size is spread over tasks. Rows that are equal in
    the order stand in any order; rows equal in all of group, order and ``salt`` (a number for each row) do not exist.
    """
    numbered = rows.withColumns({"value": F.lit(1).cast(kind) if value is None else value.cast(kind), "salt": F.monotonically_increasing_id()})
    numbered = materialize(numbered, "numbered")  # the salt of a row is fixed from here on
    ranged = numbered.repartitionByRange(group, *order, "salt").withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy(group, "range").agg(F.sum("value").alias("sum"))
    whole = Window.partitionBy(group)  # a row for each range of a group
    earlier = F.sum("sum").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(group, "range", F.coalesce(earlier, F.lit(0)).alias("start"), F.sum("sum").over(whole).alias("total"))
    inside = Window.partitionBy(group, "range").orderBy(*order, "salt").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(starts, [group, "range"])
    return out.withColumn("before", F.col("start") + F.coalesce(F.sum("value").over(inside), F.lit(0))).drop("start", "range", "salt", "value")
