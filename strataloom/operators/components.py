"""Connected components of an edge list by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). A round needs only
joins and minima, the number of rounds grows with the logarithm of the longest path, and no
neighbour list is ever collected into one row. Minima are taken before the shuffle and written, so
that both sides of the join that follows are plain shuffles, whose hubs adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import drop_path, materialize, scratch, shared_path


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).where("src <> dst")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    to_least = down.join(least, "u").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return to_least.unionAll(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges(src, dst)`` of any ordered type -> ``(node, component)``, component = least node reachable.

    Nodes without an edge do not appear. Self edges keep their node. Null ends are ignored.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    schema = edges.schema

    def keep(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = shared_path(spark, "components")
        df.distinct().write.parquet(path)
        kept = spark.read.schema(schema).parquet(path)
        row = kept.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        return kept, path, tuple(row)

    alone, alone_path, _ = keep(edges.where("src = dst"))
    links, path, before = keep(edges.where("src <> dst"))
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        with scratch(spark):
            after_links, after_path, after = keep(_small_star(_large_star(links).distinct()))
        drop_path(spark, path)
        links, path = after_links, after_path
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = links.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    selves = alone.select(F.col("src").alias("node"), F.col("src").alias("component"))
    return found.unionAll(roots).unionAll(selves).groupBy("node").agg(F.min("component").alias("component"))
