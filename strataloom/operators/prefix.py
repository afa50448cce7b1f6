"""Running sums over a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import materialize


def running_sums(rows: DataFrame, by: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each ``value: name`` of ``values``, its sum up to each row by ``order`` within ``by``.

    Rows are dealt to ranges of the order and written; each range is summed up to each row by itself, and
    what lies before a range is summed over the ranges, of which there are as many as shuffle partitions.
    ``order`` must tell the rows of a group apart.
    """
    ranged = rows.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "prefix")
    sums = ranged.groupBy(*by, "__part").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__before_{v}") for v in values))
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(starts, [*by, "__part"])
    out = joined.select("*", *((F.sum(v).over(inside) + F.col(f"__before_{v}")).alias(name) for v, name in values.items()))
    return out.drop("__part", *(f"__before_{v}" for v in values))
