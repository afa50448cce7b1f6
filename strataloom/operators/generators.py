"""Graphs by rule: regular shapes, and seeded random ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators.graph import dense_ids, placed, split_join
from strataloom.session import materialize


def grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    n = spark.range(rows * columns).select(F.col("id").alias("src"), (F.col("id") % columns).alias("j"))
    right = n.where(F.col("j") < columns - 1).select("src", (F.col("src") + 1).alias("dst"))
    down = n.where(F.col("src") < (rows - 1) * columns).select("src", (F.col("src") + columns).alias("dst"))
    return right.unionAll(down)


def star(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))


def circle(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


def full(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("dst")).where(F.col("dst") < n)


def tree(spark: SparkSession, n: int, fanout: int) -> DataFrame:
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / fanout).alias("src"), F.col("id").alias("dst"))


def random_edges(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """G(n, m): ``m`` different undirected edges, drawn by hash; a tenth more than needed, of which the first ``m`` by hash stay."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    e = spark.range(2 * m + 64).select(draw(1).alias("x"), draw(2).alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return e.orderBy(F.xxhash64("a", "b", F.lit(seed))).limit(m)


def rmat(spark: SparkSession, levels: int, m: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 1) -> DataFrame:
    """``m`` directed edges by recursive quadrant choice, each by itself."""
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for k in range(levels):
        u = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / (1 << 30)
        src = src * 2 + F.when(u < a + b, 0).otherwise(1)
        dst = dst * 2 + F.when((u < a) | ((u >= a + b) & (u < a + b + c)), 0).otherwise(1)
    return spark.range(m).select(src.alias("src"), dst.alias("dst"))


def kronecker(seed_edges: DataFrame, size: int, power: int) -> DataFrame:
    """Deterministic Kronecker power of a seed graph ``(src, dst)`` on ``size`` nodes."""
    out = seed_edges
    for _ in range(power - 1):
        s = seed_edges.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
        out = out.crossJoin(F.broadcast(s)).select((F.col("src") * size + F.col("s2")).alias("src"), (F.col("dst") * size + F.col("d2")).alias("dst"))  # the seed is a parameter
    return out


def _uniform(*parts) -> Column:
    """A number from 0 up to 1 by the hash of its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def hierarchical(spark: SparkSession, fanout: int, levels: int) -> DataFrame:
    """A tree of ``levels`` below its root, every node but the last level's with ``fanout`` children."""
    return tree(spark, sum(fanout**k for k in range(levels + 1)), fanout)


def random_bipartite(spark: SparkSession, left: int, right: int, m: int, seed: int = 1) -> DataFrame:
    """``m`` different edges ``(src, dst)`` between two kinds of nodes, drawn by hash from twice as many."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    e = spark.range(2 * m + 64).select(draw(1, left).alias("src"), draw(2, right).alias("dst")).distinct()
    return e.orderBy(F.xxhash64("src", "dst", F.lit(seed))).limit(m)


def power_law_degrees(spark: SparkSession, n: int, alpha: float, least: int = 1, seed: int = 1) -> DataFrame:
    """``(node, deg)`` by the inverse of a power law's distribution, bounded by n - 1."""
    deg = F.least(F.floor(least * F.pow(1 - _uniform("id", F.lit(seed)), F.lit(-1 / (alpha - 1)))), F.lit(n - 1))
    return spark.range(n).select(F.col("id").alias("node"), deg.cast("bigint").alias("deg"))


def configuration(degrees: DataFrame, seed: int = 1) -> DataFrame:
    """``(src, dst)``: the ends of nodes ``(node, deg)`` matched in a random order, repeats and self edges as they come; an odd end is left over."""
    stubs = degrees.where("deg > 0").select("node", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("deg"))).alias("k"))
    key = F.struct(F.xxhash64("node", "k", F.lit(seed)).alias("h"), "node", "k")
    placed = dense_ids(stubs.select(key.alias("src"), key.alias("dst"))).select("node.node", "id")
    pairs = placed.groupBy(F.floor(F.col("id") / 2).alias("pair")).agg(F.min_by("node", "id").alias("src"), F.max_by("node", "id").alias("dst"), F.count("*").alias("n"))
    return pairs.where("n = 2").select("src", "dst")


def regular(spark: SparkSession, n: int, k: int, seed: int = 1) -> DataFrame:
    """A configuration of ``n`` nodes of degree ``k``."""
    return configuration(spark.range(n).select(F.col("id").alias("node"), F.lit(k).cast("bigint").alias("deg")), seed)


def _permuted(edges: DataFrame, seed: int) -> DataFrame:
    """``(id, src, dst)``: the targets change places among all edges ``(id, src, dst)``, in an order drawn by hash."""
    drawn = lambda column, k: placed(edges.select(F.xxhash64("id", F.lit(seed), F.lit(k)).alias("h"), "id", column), "h", "id")
    return drawn("src", 1).drop("h").join(drawn("dst", 2).drop("h", "id"), "place").select("id", "src", "dst")


def rewired(edges: DataFrame, seed: int = 1, rounds: int = 60) -> DataFrame:
    """A random simple graph of the same out- and in-degrees as the different directed ``edges``, without self edges.

    The targets change places among all edges in a random order. Then each self edge or repeat is offered another edge, drawn by hash, to
    change targets with, round by round until none is left; an offer is taken if it makes two edges that are new,
    no self edges, and made by no other offer. Raises if ``rounds`` do not suffice, as for degrees that no simple graph has.

    After the first order all edges stay where they are, dealt by their ends. A round shuffles what it offers: self edges, repeats, some edges drawn for them, and
    those that moved before. A moved edge is new, so groups of equal edges only shrink.
    """
    spark = edges.sparkSession
    known = placed(edges.select("src", "dst").distinct(), "src", "dst", name="id")
    first = materialize(_permuted(materialize(known.select("id", "src", "dst"), "rewired"), seed), "rewired")
    held = first.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src", "dst").persist(StorageLevel.DISK_ONLY)
    try:
        total = held.count()  # only a finished table is known to be dealt by ends
        same = F.count("*").over(Window.partitionBy("src", "dst")) > 1
        groups = materialize(held.withColumn("same", same).where("same or src = dst").drop("same"), "rewired")
        moved = spark.createDataFrame([], first.schema)
        for k in range(rounds):
            bad = (F.col("src") == F.col("dst")) | (F.row_number().over(Window.partitionBy("src", "dst").orderBy("id")) > 1)
            bad = materialize(groups.withColumn("bad", bad).where("bad").drop("bad"), "rewired")
            n = bad.count()
            if not n:
                return first.join(moved.select("id"), "id", "left_anti").unionByName(moved).select("src", "dst")
            draw = F.xxhash64("id", F.lit(seed), F.lit(-1 - k))
            share = min(1.0, (4 * n + 128) / max(1, total - n))
            some = lambda rows: rows.where(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30)))
            drawn = some(first).join(moved.select("id"), "id", "left_anti").unionByName(some(moved)).join(bad.select("id"), "id", "left_anti")
            drawn = materialize(drawn.select("id", "src", "dst"), "rewired")
            ranked = lambda rows: placed(rows.withColumn("h", draw), "h", "id", name="rank")
            half = F.pmod(F.shiftright(draw, 40), F.lit(2)) == 0  # some good edges change as well, or a few could be stuck
            one = ranked(bad.unionByName(drawn.where(half))).select("rank", F.col("id").alias("i"), F.col("src").alias("a"), F.col("dst").alias("b"))
            two = ranked(drawn.where(~half)).select("rank", F.col("id").alias("j"), F.col("src").alias("c"), F.col("dst").alias("d"))
            offers = one.join(two, "rank").where("a <> d and c <> b")
            made = offers.select("rank", F.explode(F.array(F.struct(F.col("i").alias("id"), F.col("a").alias("src"), F.col("d").alias("dst")), F.struct(F.col("j").alias("id"), F.col("c").alias("src"), F.col("b").alias("dst")))).alias("e")).select("rank", "e.*")
            made = materialize(made, "rewired")
            asked = made.select("src", "dst").distinct()
            there = held.join(asked, ["src", "dst"]).select("id", "src", "dst").join(moved.select("id"), "id", "left_anti").select("src", "dst")
            there = there.unionByName(moved.join(asked, ["src", "dst"], "left_semi").select("src", "dst"))
            fresh = made.join(there.distinct(), ["src", "dst"], "left_anti").withColumn("same", F.count("*").over(Window.partitionBy("src", "dst"))).where("same = 1")
            taken = fresh.groupBy("rank").agg(F.count("*").alias("n")).where("n = 2")
            now = materialize(made.join(taken.select("rank"), "rank", "left_semi").select("id", "src", "dst"), "rewired")
            moved = materialize(moved.join(now.select("id"), "id", "left_anti").unionByName(now), "rewired")
            groups = materialize(groups.join(now.select("id"), "id", "left_anti").select("id", "src", "dst"), "rewired")
        raise RuntimeError(f"self edges or repeats are left after {rounds} rounds")
    finally:
        held.unpersist()


def preferential_attachment(spark: SparkSession, n: int, out: int, seed: int = 1, copy: float = 1.0) -> DataFrame:
    """``(src, dst)``: node by node ``out`` edges to ends of earlier edges, each end as likely as any other.

    Place 2i of the list of all ends is the source of edge i, place 2i + 1 its target: the end at a random earlier
    place (Sanders and Schulz 2016). Targets that are targets themselves are followed back together, by joins
    without any order of nodes, in rounds that grow with the logarithm. With ``copy`` below 1 a target is
    that share of the time such an end and else any earlier node (the copying model).
    """
    edge = spark.range(n * out).select(F.col("id").alias("edge"), F.floor(F.col("id") / out).alias("src"))
    place = F.floor(_uniform(F.col("at"), F.lit(seed)) * F.col("at"))
    free = F.floor(_uniform(F.col("at"), F.lit(seed + 1)) * F.greatest(F.floor(F.col("at") / (2 * out)), F.lit(1))) * (2 * out)
    step = F.when(_uniform(F.col("at"), F.lit(seed + 2)) < copy, place).otherwise(free).cast("bigint")
    # a hash of the place decides, so a place leads to the same end whoever asks: no table of ends is needed
    now = edge.select("edge", "src", (2 * F.col("edge") + 1).alias("at"))
    for _ in range(200):
        now = materialize(now.select("edge", "src", F.when(F.col("at") % 2 == 1, step).otherwise(F.col("at")).alias("at")), "attachment")
        if not now.where("at % 2 = 1").limit(1).count():
            break
    return now.select("src", F.floor(F.col("at") / (2 * out)).alias("dst"))


def timed_attachment(spark: SparkSession, n: int, out: int, seed: int = 1) -> DataFrame:
    """``(src, dst, ts)``: preferential attachment, an edge's time the number of its source."""
    return preferential_attachment(spark, n, out, seed).withColumn("ts", F.col("src"))


def small_world(spark: SparkSession, n: int, near: int, share: float, seed: int = 1) -> DataFrame:
    """``(src, dst)``: a ring where each node meets the next ``near``, a ``share`` of the edges led elsewhere (Watts and Strogatz)."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(near))).alias("k"))
    far = F.pmod(F.col("src") + 1 + F.floor(_uniform("src", "k", F.lit(seed + 1)) * (n - 1)), F.lit(n)).cast("bigint")
    return ring.select("src", F.when(_uniform("src", "k", F.lit(seed)) < share, far).otherwise(F.pmod(F.col("src") + F.col("k"), F.lit(n))).alias("dst"))


def geometric_attachment(spark: SparkSession, n: int, out: int, cells: int = 8, seed: int = 1) -> DataFrame:
    """``(src, dst)``: preferential attachment within the cells of a square that nodes lie in."""
    a = preferential_attachment(spark, n, out, seed)
    cell = lambda c: F.floor(_uniform(F.col(c), F.lit(seed + 5)) * cells) * cells + F.floor(_uniform(F.col(c), F.lit(seed + 6)) * cells)
    return a.where((cell("src") == cell("dst")) | (_uniform("src", "dst", F.lit(seed + 7)) < 1 / cells))


def forest_fire(spark: SparkSession, n: int, forward: float, backward: float, seed: int = 1) -> DataFrame:
    """``(src, dst)``: each new node links to an ambassador and to all that a fire from there burns.

    Every node depends on all before it, so this runs in one process; ``n`` is bounded by its memory.
    """
    import numpy as np

    draw = np.random.default_rng(seed)
    out: list[set[int]] = [set() for _ in range(n)]
    back: list[set[int]] = [set() for _ in range(n)]
    for v in range(1, n):
        burnt, todo = set(), [int(draw.integers(v))]
        while todo:
            w = todo.pop()
            if w in burnt:
                continue
            burnt.add(w)
            for chance, near in ((forward, out[w]), (forward * backward, back[w])):
                fresh = sorted(near - burnt)
                take = min(len(fresh), int(draw.geometric(1 - chance)) - 1) if chance < 1 else len(fresh)
                todo += [fresh[k] for k in draw.permutation(len(fresh))[:take]]
        for w in burnt:
            out[v].add(w)
            back[w].add(v)
    return spark.createDataFrame([(v, w) for v in range(n) for w in sorted(out[v])], "src bigint, dst bigint")


def stochastic_kronecker(spark: SparkSession, initiator: list[list[float]], power: int, m: int, seed: int = 1) -> DataFrame:
    """``m`` edges, repeats among them, each led through ``power`` levels by the weights of the initiator matrix."""
    size, total = len(initiator), sum(map(sum, initiator))
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for level in range(power):
        u, sums, row, column = _uniform("id", F.lit(seed), F.lit(level)) * total, 0.0, None, None
        for i in range(size):
            for j in range(size):
                sums += initiator[i][j]
                row = F.when(u < sums, i) if row is None else row.when(u < sums, i)
                column = F.when(u < sums, j) if column is None else column.when(u < sums, j)
        src, dst = src * size + row.otherwise(size - 1), dst * size + column.otherwise(size - 1)
    return spark.range(m).select(src.alias("src"), dst.alias("dst"))


def attribute_graph(spark: SparkSession, n: int, attributes: int, chance: float, affinity: list[list[float]], m: int, seed: int = 1) -> DataFrame:
    """``(src, dst)``: of ``m`` drawn pairs of nodes with ``attributes`` yes-or-no traits, those kept by the product of their affinities."""
    ends = spark.range(m).select("id", F.floor(_uniform("id", F.lit(seed)) * n).alias("src"), F.floor(_uniform("id", F.lit(seed + 1)) * n).alias("dst")).where("src <> dst")
    likely = F.lit(1.0)
    for k in range(attributes):
        has = lambda c, k=k: _uniform(F.col(c), F.lit(seed + 2), F.lit(k)) < chance
        likely = likely * F.when(has("src"), F.when(has("dst"), affinity[1][1]).otherwise(affinity[1][0])).otherwise(F.when(has("dst"), affinity[0][1]).otherwise(affinity[0][0]))
    return ends.where(_uniform("src", "dst", F.lit(seed + 3)) < likely).select("src", "dst").distinct()


def affiliation_graph(membership: DataFrame, chance: float, seed: int = 1) -> DataFrame:
    """``(a, b)``: members ``(node, group)`` of a group are linked with ``chance``, once for every group that they share."""
    m = membership.select("node", "group").distinct()
    pairs = split_join(m.withColumnRenamed("node", "a"), m.withColumnRenamed("node", "b"), "group").where("a < b")
    return pairs.where(_uniform("a", "b", "group", F.lit(seed)) < chance).select("a", "b").distinct()
