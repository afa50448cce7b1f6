"""Frequency distributions, histograms and their cumulative forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.prefix import running_sums


def pdf(values: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``(*by, value, freq)``."""
    return values.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("freq"))


def count_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many keys occur how often."""
    return pdf(rows.groupBy(key).agg(F.count("*").alias("n")), "n")


def cumulative(dist: DataFrame, by: list[str] = (), descending: bool = False) -> DataFrame:
    """A ``(value, freq)`` distribution with ``cum``, the running sum by value: cdf, or ccdf if descending."""
    if not by:  # no key to deal the values by: ranges of them
        whole = running_sums(dist, [], "value", {"freq": "cum"})
        if not descending:
            return whole
        total = dist.agg(F.sum("freq").alias("__total"))
        return whole.crossJoin(F.broadcast(total)).withColumn("cum", F.col("__total") - F.col("cum") + F.col("freq")).drop("__total")  # one row
    order = F.col("value").desc() if descending else F.col("value").asc()
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dist.withColumn("cum", F.sum("freq").over(over))


def dense(dist: DataFrame, by: list[str] = (), descending: bool = True) -> DataFrame:
    """The cumulative form at every whole value from 1 to the largest; values below 1 count at none."""
    top = dist.groupBy(*by).agg(F.max("value").alias("top")).where("top >= 1")
    # laid out in two steps, so that a long grid grows in many tasks
    steps = top.select(*by, "top", F.explode(F.expr("sequence(0L, cast(top as bigint), 65536L)")).alias("begin")).repartition("begin")
    grid = steps.select(*by, F.explode(F.expr("sequence(begin, least(begin + 65535, cast(top as bigint)))")).alias("value")).where("value >= 1")
    filled = grid.join(dist, [*by, "value"], "left").select(*by, "value", F.coalesce("freq", F.lit(0)).alias("freq"))
    return cumulative(filled, by, descending)


def normalised(cum: DataFrame, by: list[str] = ()) -> DataFrame:
    """``p``: the cumulative count by its largest."""
    return cum.withColumn("p", F.col("cum") / F.max("cum").over(Window.partitionBy(*by)))


def moments(dist: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count, mean and population variance of a weighted distribution."""
    n, m = F.sum("freq"), F.sum(F.col("value") * F.col("freq")) / F.sum("freq")
    return dist.groupBy(*by).agg(n.alias("n"), m.alias("mean"), (F.sum(F.col("value") * F.col("value") * F.col("freq")) / n - m * m).alias("variance"))


def difference(cum: DataFrame, by: list[str] = ()) -> DataFrame:
    """From a cdf ``(value, cum)`` back to its pdf."""
    return cum.withColumn("freq", F.col("cum") - F.coalesce(F.lag("cum").over(Window.partitionBy(*by).orderBy("value")), F.lit(0)))


def exponential_bins(dist: DataFrame, factor: float = 2.0, by: list[str] = ()) -> DataFrame:
    """Mean value and frequency in bins whose borders grow by ``factor``; values below 1 are left out."""
    bin_ = F.floor(F.round(F.log(F.col("value")) / F.log(F.lit(factor)), 9)).cast("int")
    return dist.where("value >= 1").groupBy(*by, bin_.alias("bin")).agg(F.avg("value").alias("avg_value"), F.avg("freq").alias("avg_freq"), F.count("*").alias("points"))


def expanded(dist: DataFrame) -> DataFrame:
    """A sample whose values occur as often as the distribution says."""
    return dist.select("value", F.explode(F.expr("array_repeat(0, cast(freq as int))"))).select("value")


def right_closed_histogram(dist: DataFrame, bins: int, top_extra: int = 0, low: Column | None = None) -> DataFrame:
    """``(bin, left, freq, ccdf)``: equal bins closed on the right, the lowest value in the first.

    The range is from ``low`` (the least value) to the largest plus ``top_extra``.
    """
    bounds = dist.agg((F.min("value") if low is None else low).alias("lo"), (F.max("value") + top_extra).alias("hi"))
    placed = dist.crossJoin(F.broadcast(bounds)).withColumn("step", (F.col("hi") - F.col("lo")) / bins)  # bounds is one row
    bin_ = F.greatest(F.ceil(F.round((F.col("value") - F.col("lo")) / F.col("step"), 9)) - 1, F.lit(0)).cast("int")
    binned = placed.withColumn("bin", F.when(F.col("step") > 0, bin_).otherwise(0)).groupBy("bin").agg(F.sum("freq").alias("freq"), F.first("lo").alias("lo"), F.first("step").alias("step"))
    over = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    return binned.select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("left"), "freq", F.sum("freq").over(over).alias("ccdf"))


def histogram(values: DataFrame, value: str, bins: int, low: float, high: float, weight: Column | None = None) -> DataFrame:
    """``(bin, freq)``: equal half-open bins over a fixed range, the last closed; values outside are left out."""
    v = F.col(value)
    bin_ = F.least(F.floor((v - low) * bins / (high - low)).cast("int"), F.lit(bins - 1))
    return values.where(v.between(low, high)).groupBy(bin_.alias("bin")).agg(F.sum(F.lit(1) if weight is None else weight).alias("freq"))


def joint(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y, freq)``."""
    return pairs.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("freq"))


def histogram_2d(pairs: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    return pairs.groupBy(F.floor(F.col(x) / width_x).alias("bx"), F.floor(F.col(y) / width_y).alias("by")).agg(F.count("*").alias("freq"))


def entropy(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Shannon entropy in bits of ``key`` within each group; null is a value like any other."""
    counts = rows.groupBy(*by, key).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("p", p).groupBy(*by).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.count("*").alias("kinds"))
