"""Signed graphs in time: what triads a new link closes, and whether status or balance explains its sign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import graph as gr


def closed_triads(arcs: DataFrame) -> DataFrame:
    """``(src, dst, x, sign, ts, context, status, balance)`` of each arc ``(src, dst, sign, ts)`` and each node x that was linked to both its ends before.

    The context has four letters: ``f`` if the earlier arc runs from src to x and ``b`` if from x to src, its sign ``+``
    or ``-``, and the same for x to dst. ``status`` is 2, 0 or -2: how far dst then stands above src, an arc of sign ``+`` saying that
    its end stands above its start; ``balance`` is the product of the two signs. Triangles of the undirected
    graph are found first, by degree; all further joins are on pairs, of two arcs at most.
    """
    arcs = arcs.select("src", "dst", "sign", "ts").where("src <> dst")
    edges = gr.undirected(arcs)
    corners = [("x", "y", "z"), ("y", "x", "z"), ("x", "z", "y"), ("z", "x", "y"), ("y", "z", "x"), ("z", "y", "x")]
    t = gr.triangles(edges).select(F.explode(F.array(*(F.struct(F.col(p).alias("src"), F.col(q).alias("dst"), F.col(r).alias("x")) for p, q, r in corners))).alias("c")).select("c.*")
    closing = t.join(arcs, ["src", "dst"])
    ends = arcs.select(F.col("src").alias("p"), F.col("dst").alias("q"), F.lit("f").alias("way"), F.col("sign").alias("s"), F.col("ts").alias("before")).unionAll(arcs.select("dst", "src", F.lit("b"), "sign", "ts"))
    one = ends.toDF("src", "x", "way1", "s1", "ts1")
    two = ends.toDF("x", "dst", "way2", "s2", "ts2")
    whole = closing.join(one, ["src", "x"]).where("ts1 < ts").join(two, ["x", "dst"]).where("ts2 < ts")
    mark = lambda s: F.when(F.col(s) > 0, "+").otherwise("-")
    up = lambda way, s: F.when(F.col(way) == "f", F.col(s)).otherwise(-F.col(s))
    return whole.select("src", "dst", "x", "sign", "ts", F.concat("way1", mark("s1"), "way2", mark("s2")).alias("context"), (up("way1", "s1") + up("way2", "s2")).alias("status"), (F.col("s1") * F.col("s2")).alias("balance"))


def status_theory(arcs: DataFrame) -> DataFrame:
    """``(context, status, balance, n, positive, expected_out, surprise_out, expected_in, surprise_in)`` of arcs ``(src, dst, sign, ts)`` by the context they close.

    Expected are the positive signs that sources of the closing arcs give on the whole, and ends get on the whole; surprise is the
    distance from that in standard deviations, null where nothing can vary.
    """
    arcs = arcs.select("src", "dst", "sign", "ts").where("src <> dst")
    plus = F.avg((F.col("sign") > 0).cast("int"))
    out, into = arcs.groupBy("src").agg(plus.alias("p")), arcs.groupBy("dst").agg(plus.alias("r"))
    each = closed_triads(arcs).join(out, "src").join(into, "dst")
    k = F.count_if(F.col("sign") > 0)
    surprise = lambda p: F.try_divide(k - F.sum(p), F.sqrt(F.sum(F.col(p) * (1 - F.col(p)))))
    return each.groupBy("context", "status", "balance").agg(F.count("*").alias("n"), k.alias("positive"), F.sum("p").alias("expected_out"), surprise("p").alias("surprise_out"), F.sum("r").alias("expected_in"), surprise("r").alias("surprise_in"))


def closures_over_time(arcs: DataFrame, bucket) -> DataFrame:
    """``(bucket, closings, triads, by_status, by_balance)``: arcs that close a triad in each bucket of time, the triads, and how many of them have the sign that status or balance says."""
    each = closed_triads(arcs).withColumn("bucket", bucket)
    sign = F.signum(F.col("sign"))
    return each.groupBy("bucket").agg(F.countDistinct("src", "dst").alias("closings"), F.count("*").alias("triads"), F.count_if(F.signum("status") == sign).alias("by_status"), F.count_if(F.col("balance") == sign).alias("by_balance"))
