"""Graph operators as joins and aggregates.

A directed graph is ``(src, dst)``; an undirected simple one is ``(a, b)`` with a < b. Loops keep
their state in tables written to the shared folder, one each round, and stop by a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Directed edges as ``(a, b)``, self edges and repeats dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as ``(src, dst)`` in both directions."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def nodes(edges: DataFrame) -> DataFrame:
    """All ends of directed edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, in_deg, out_deg)`` of directed edges; an end of either kind has a row."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_deg"), F.sum("e.o").alias("out_deg"))


def undirected_degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))


def strengths(weighted: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """``(side, node, deg, strength)`` of a bipartite graph."""
    ends = weighted.select(F.explode(F.array(F.struct(F.lit(left).alias("side"), F.col(left).alias("node")), F.struct(F.lit(right).alias("side"), F.col(right).alias("node")))).alias("e"), F.col(weight).alias("w"))
    return ends.groupBy("e.side", "e.node").agg(F.count("*").alias("deg"), F.sum("w").alias("strength"))


def split_join(left: DataFrame, right: DataFrame, key: str, block: int = 2000) -> DataFrame:
    """Inner join on ``key`` whose hubs are cut: a key with many rows on a side is dealt to blocks of about ``block`` of them.

    Every block of one side meets every block of the other, so no task gets more than about ``block`` squared
    pairs of one key, whatever its size. Keys of one block on either side, nearly all, join as they are.
    """
    own = [c for c in left.columns if c != key]
    other = [c for c in right.columns if c != key]
    size = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias(name)).where(F.col(name) > 1)
    cuts = size(left, "__m").join(size(right, "__n"), key, "full_outer").select(key, F.coalesce("__m", F.lit(1)).alias("__m"), F.coalesce("__n", F.lit(1)).alias("__n"))

    def dealt(rows: DataFrame, columns: list[str], mine: str, theirs: str, i: str, j: str) -> DataFrame:
        cut = rows.join(cuts, key, "left").select(key, *columns, F.coalesce(mine, F.lit(1)).alias(mine), F.coalesce(theirs, F.lit(1)).alias(theirs))
        salt = F.pmod(F.xxhash64(*columns), F.col(mine)).cast("int").alias(i)
        return cut.select(key, *columns, salt, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(j))

    a = dealt(left, own, "__m", "__n", "__i", "__j")
    b = dealt(right, other, "__n", "__m", "__j", "__i")
    return a.join(b, [key, "__i", "__j"]).drop("__i", "__j")


def projection(pairs: DataFrame, item: str, person: str) -> DataFrame:
    """``(a, b, w)`` with a < b: the number of items two persons share. Added up by blocks of persons; no pair is shuffled."""
    from strataloom.operators.pairs import pair_sums  # it numbers nodes by this module

    return pair_sums(pairs.select(F.col(item).alias("key"), F.col(person).alias("node")).distinct()).toDF("a", "b", "w")


def kl_divergence(weighted: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """``(side, node, kl, scaled)``: how far each node's weights are from its neighbours' strengths; scaled to 0..1 in its side."""
    s = strengths(weighted, left, right, weight).select("side", "node", F.col("strength").cast("double").alias("s"))
    total = weighted.agg(F.sum(weight).cast("double").alias("total"))
    arcs = weighted.select(F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("node"), F.lit(y).alias("other_side"), F.col(y).alias("other"), F.col(weight).cast("double").alias("w")) for x, y in ((left, right), (right, left))))).alias("e")).select("e.*")
    own = arcs.join(s, ["side", "node"])
    both = own.join(s.select(F.col("side").alias("other_side"), F.col("node").alias("other"), F.col("s").alias("t")), ["other_side", "other"]).crossJoin(F.broadcast(total))  # one row
    kl = both.groupBy("side", "node").agg(F.sum(F.col("w") / F.col("s") * (F.log(F.col("w") / F.col("s")) - F.log(F.col("t") / F.col("total")))).alias("kl"))
    ends = kl.groupBy("side").agg(F.min("kl").alias("lo"), F.max("kl").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("kl") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return kl.join(F.broadcast(ends), "side").select("side", "node", "kl", scaled.alias("scaled"))  # two rows


def reciprocal(edges: DataFrame) -> DataFrame:
    """Directed edges whose reverse is there too, self edges left out."""
    e = edges.where("src <> dst").distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Directed edges with both ends among ``keep(node)``."""
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def dense_ids(edges: DataFrame) -> DataFrame:
    """``(node, id)``: dense ids from 0 in order of the nodes; ranges are counted first, then numbered within."""
    n = nodes(edges).repartitionByRange("node").withColumn("part", F.spark_partition_id())
    n = materialize(n, "renumber")
    sizes = n.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))  # a row for each partition
    return n.join(F.broadcast(starts), "part").select("node", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1).alias("id"))


def placed(rows: DataFrame, *keys: str, name: str = "place") -> DataFrame:
    """``rows`` with their number ``name`` from 0 on in the order of ``keys``, which no two rows share; one shuffle, by ranges."""
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())  # partition, then row
    at = materialize(at, "placed").withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count("*").alias("size"))
    starts = sizes.select("__part", (F.sum("size").over(Window.orderBy("__part")) - F.col("size")).alias("__start"))  # a row for each partition
    return at.join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def renumbered(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edges with dense ids from 0, in order of the old ones."""
    ids = dense_ids(edges) if ids is None else ids
    return edges.join(ids.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def triangles(edges: DataFrame, timed: DataFrame | None = None) -> DataFrame:
    """``(x, y, z)`` of each triangle once; with ``timed(a, b, ts)``, the same edges with times, also ``t1, t2, t3`` of its sides xy, xz and yz.

    Edges point from the end of lower degree to the higher, which bounds each node's out-degree by the
    square root of twice the edges; so hubs make no large wedges and need no cap.
    """
    deg = undirected_degrees(edges)
    d = (edges if timed is None else timed).join(deg.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    low, high = F.when(up, F.col("a")).otherwise(F.col("b")), F.when(up, F.col("b")).otherwise(F.col("a"))
    if timed is not None:
        arcs = d.select(low.alias("x"), high.alias("y"), F.col("ts").alias("t1"))
        wedges = arcs.join(arcs.select("x", F.col("y").alias("z"), F.col("t1").alias("t2")), "x").where("y < z")
        return wedges.join(timed.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("ts").alias("t3")), ["y", "z"]).select("x", "y", "z", "t1", "t2", "t3")
    arcs = d.select(low.alias("x"), high.alias("y"))
    wedges = arcs.join(arcs.select("x", F.col("y").alias("z")), "x").where("y < z")
    return wedges.join(edges.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"], "left_semi").select("x", "y", "z")


def triangle_sides(edges: DataFrame) -> DataFrame:
    """``(a, b, shared)`` of edges in triangles: how many neighbours their ends share. By triangles, so hubs lay out no wedges of their own."""
    side = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    sides = triangles(edges).select(F.explode(F.array(side("x", "y"), side("y", "z"), side("x", "z"))).alias("e"))
    return sides.groupBy("e.a", "e.b").agg(F.count("*").alias("shared"))


def triads(edges: DataFrame) -> DataFrame:
    """``(node, deg, closed, open, clustering)`` for every node with an edge. No wedge is shuffled."""
    from strataloom.operators.corners import triangle_counts  # it numbers nodes by this module

    closed = triangle_counts(edges)
    t = undirected_degrees(edges).join(closed, "node", "left").select("node", "deg", F.coalesce("closed", F.lit(0)).alias("closed"))
    pairs = (F.col("deg") * (F.col("deg") - 1) / 2).cast("bigint")
    return t.select("node", "deg", "closed", (pairs - F.col("closed")).alias("open"), F.when(pairs > 0, F.col("closed") / pairs).otherwise(0.0).alias("clustering"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, common)`` of asked pairs."""
    s = both_ways(edges)
    left = split_join(pairs.select("a", "b"), s.select(F.col("src").alias("a"), F.col("dst").alias("n")), "a")
    return left.join(s.select(F.col("src").alias("b"), F.col("dst").alias("n")), ["b", "n"]).groupBy("a", "b").agg(F.count("*").alias("common"))


def two_step_paths(arcs: DataFrame) -> DataFrame:
    """``(a, b, paths)``: the number of directed paths of two steps between different ends."""
    first = arcs.select(F.col("src").alias("a"), F.col("dst").alias("m"))
    second = arcs.select(F.col("src").alias("m"), F.col("dst").alias("b"))
    return split_join(first, second, "m").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("paths"))


def group_triads(edges: DataFrame, group: DataFrame) -> DataFrame:
    """``(node, in_in, in_out, out_out)``: each node's closed triads by how many of its two other ends lie in ``group(node)``."""
    t = triangles(edges)
    corners = F.array(*(F.struct(F.col(n).alias("node"), F.array(F.col(p), F.col(q)).alias("others")) for n, p, q in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))))
    each = t.select(F.explode(corners).alias("c")).select("c.node", F.col("c.others")[0].alias("p"), F.col("c.others")[1].alias("q"))
    mark = group.select("node", F.lit(1).alias("inside")).distinct()
    each = each.join(mark.select(F.col("node").alias("p"), F.col("inside").alias("i")), "p", "left").join(mark.select(F.col("node").alias("q"), F.col("inside").alias("j")), "q", "left")
    both = F.coalesce("i", F.lit(0)) + F.coalesce("j", F.lit(0))
    return each.groupBy("node").agg(F.count_if(both == 2).alias("in_in"), F.count_if(both == 1).alias("in_out"), F.count_if(both == 0).alias("out_out"))


def constraint(edges: DataFrame) -> DataFrame:
    """``(node, value)``: structural-hole constraint over neighbours and over two-step contacts.

    Each unordered start i and contact j has (p_ij + sum over q of p_iq p_qj) squared, with p = 1 / degree.
    """
    from strataloom.operators.pairs import pair_sums  # it numbers nodes by this module

    # with w_ij = the sum of 1 / degree over shared neighbours, node i has (sum of w_ij^2 + 2 * sum of w_ij over neighbours + degree) / degree^2
    edges = materialize(edges.select("a", "b"), "constraint")
    deg = materialize(undirected_degrees(edges), "constraint")
    rows = both_ways(edges).join(deg.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("key"), F.col("dst").alias("node"), (1 / F.col("deg")).alias("w"))
    squares = pair_sums(rows, weighted=True, squares=True).select(F.col("a").alias("node"), F.col("w").alias("v"))
    t = triangles(edges)
    for n in ("x", "y", "z"):
        t = t.join(deg.select(F.col("node").alias(n), (1 / F.col("deg")).alias(f"p{n}")), n)
    corners = F.array(*(F.struct(F.col(n).alias("node"), (2 * (F.col(f"p{o}") + F.col(f"p{q}"))).alias("v")) for n, o, q in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))))
    sums = squares.unionAll(t.select(F.explode(corners).alias("c")).select("c.node", "c.v")).groupBy("node").agg(F.sum("v").alias("v"))
    return deg.join(sums, "node", "left").select("node", ((F.coalesce("v", F.lit(0.0)) + F.col("deg")) / F.col("deg") / F.col("deg")).alias("value"))


def bfs(edges: DataFrame, sources: DataFrame, max_hops: int = 1000, direction: str = "out", most: int | None = None) -> DataFrame:
    """``(source, node, dist)`` from each of ``sources(node)`` along directed edges, against them (``in``) or both ways, up to ``most`` hops if given."""
    if direction == "in":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        edges = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist")), "bfs")
    frontier, parts = seen, [seen]
    for hop in range(1, max_hops + 1):
        if most is not None and hop > most:
            return known_of(parts)
        step = frontier.select("source", F.col("node").alias("src")).join(edges, "src").select("source", F.col("dst").alias("node")).distinct()
        known = known_of(parts)
        frontier = materialize(step.join(known.select("source", "node"), ["source", "node"], "left_anti").withColumn("dist", F.lit(hop)), "bfs")
        if not frontier.limit(1).count():
            return known
        parts.append(frontier)
    raise RuntimeError(f"nodes are further than {max_hops} hops")


def bfs_words(edges: DataFrame, sources: DataFrame, max_hops: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Searches from all of ``sources(node)`` at once: ``(node, word, bits, dist)`` and the sources' places ``(source, word, bit)``.

    Sources are numbered; 64 of them share a word, in which a node's row has the bits of those that reach it first at ``dist``.
    A hop is one join and a bitwise or, so neither the work nor the rows are one for each source and arc.
    """
    named = sources.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    ids = dense_ids(named)
    place = materialize(ids.select(F.col("node").alias("source"), F.floor(F.col("id") / 64).cast("int").alias("word"), (F.col("id") % 64).cast("int").alias("bit")), "bfs")
    edges = materialize(edges.select("src", "dst"), "bfs")
    one = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    frontier = materialize(place.groupBy(F.col("source").alias("node"), "word").agg(one).withColumn("dist", F.lit(0)), "bfs")
    parts, seen = [frontier], frontier.select("node", "word", "bits")
    for hop in range(1, max_hops + 1):
        step = frontier.select(F.col("node").alias("src"), "word", "bits").join(edges, "src").groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        new = F.expr("bits & ~coalesce(known, 0L)")
        met = step.join(seen.withColumnRenamed("bits", "known"), ["node", "word"], "left").select("node", "word", new.alias("bits"), F.lit(hop).alias("dist")).where("bits <> 0")
        frontier = materialize(met, "bfs")
        if not frontier.limit(1).count():
            return known_of(parts), place
        parts.append(frontier)
        seen = materialize(seen.unionAll(frontier.select("node", "word", "bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "bfs")
    raise RuntimeError(f"nodes are further than {max_hops} hops")


def _bits(words: DataFrame) -> DataFrame:
    """A row for each bit of ``bits``, as ``bit``; the other columns stay."""
    others = [c for c in words.columns if c != "bits"]
    return words.select(*others, F.explode(F.expr("filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1L) = 1L)")).alias("bit"))


def word_distances(words: DataFrame, place: DataFrame) -> DataFrame:
    """``(source, node, dist)`` of ``bfs_words``."""
    return _bits(words).join(place, ["word", "bit"]).select("source", "node", "dist")


def word_hop_counts(words: DataFrame) -> DataFrame:
    """``(dist, pairs)`` of ``bfs_words``, its bits counted, not laid out."""
    return words.groupBy("dist").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("pairs"))


def word_source_counts(words: DataFrame, place: DataFrame) -> DataFrame:
    """``(source, dist, nodes)`` of ``bfs_words``: how many nodes each source first reaches at each distance."""
    return _bits(words.select("word", "dist", "bits")).groupBy("word", "bit", "dist").agg(F.count("*").alias("nodes")).join(place, ["word", "bit"]).select("source", "dist", "nodes")


def known_of(parts: list[DataFrame]) -> DataFrame:
    """All rows of the tables of a search's rounds."""
    known = parts[0]
    for p in parts[1:]:
        known = known.unionAll(p)
    return known


def random_paths(edges: DataFrame, dist: DataFrame, seed: int = 1) -> DataFrame:
    """``(source, node, path)``: one shortest path to each node reached, its steps drawn by a hash among the predecessors."""
    drawn = bfs_predecessors(edges, dist).groupBy("source", "node").agg(F.min_by("pred", F.xxhash64("source", "node", "pred", F.lit(seed))).alias("pred"))
    drawn = materialize(drawn, "paths")
    done = materialize(dist.where("dist = 0").select("source", "node", F.array("node").alias("path")), "paths")
    level, parts = done, [done]
    while True:
        up = level.select("source", F.col("node").alias("pred"), "path")
        level = materialize(drawn.join(up, ["source", "pred"]).select("source", "node", F.concat("path", F.array("node")).alias("path")), "paths")
        if not level.limit(1).count():
            return known_of(parts)
        parts.append(level)


def diameter(edges: DataFrame) -> int:
    """The exact diameter of an undirected graph, from all its nodes; raises if it does not hang together."""
    s = materialize(both_ways(edges), "diameter")
    everyone = materialize(nodes(s), "diameter")
    dist = bfs(s, everyone)
    n, pairs, longest = everyone.count(), *dist.agg(F.count("*"), F.max("dist")).first()
    if pairs < n * n:
        raise ValueError("the graph is not connected: it has no diameter")
    return longest or 0


def spectrum(edges: DataFrame, k: int, rounds: int = 60, eps: float = 1e-7) -> DataFrame:
    """``(k, value, ipr)``: the ``k`` eigenvalues of greatest absolute value of an undirected graph, and the inverse participation ratios of their vectors.

    Orthogonal iteration over packed arcs, of which none is shuffled; what reaches the driver are the k * k
    products that make the vectors orthogonal again.
    """
    from strataloom.operators import grid  # it numbers nodes by this module

    values, ratios = grid.spectrum(edges, k, rounds, eps)
    return edges.sparkSession.createDataFrame([(i, float(v), float(r)) for i, (v, r) in enumerate(zip(values, ratios, strict=True))], "k int, value double, ipr double")


def bfs_predecessors(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """``(source, node, pred)``: every edge on a shortest path."""
    before = dist.select("source", F.col("node").alias("src"), F.col("dist").alias("d0"))
    return before.join(edges, "src").join(dist.select("source", F.col("node").alias("dst"), "dist"), ["source", "dst"]).where("dist = d0 + 1").select("source", F.col("dst").alias("node"), F.col("src").alias("pred"))


def hop_counts(dist: DataFrame) -> DataFrame:
    return dist.groupBy("dist").agg(F.count("*").alias("pairs"))


def effective_diameter(dist: DataFrame, share: float = 0.9) -> DataFrame:
    return effective_diameter_of(hop_counts(dist), share)


def effective_diameter_of(hops: DataFrame, share: float = 0.9) -> DataFrame:
    """One row of ``hops(dist, pairs)``: effective diameter by linear interpolation of the cumulative hop counts, the largest distance and the mean one.

    Pairs at distance 0 count; if they alone exceed the share the result is 1.
    """
    w = Window.orderBy("dist")  # a row for each distance
    c = hops.select("dist", F.sum("pairs").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), (F.col("dist") * F.col("pairs")).alias("dp"))
    c = c.withColumn("total", F.max("cum").over(Window.partitionBy(F.lit(1)))).withColumn("before", F.lag("cum").over(w))
    need = F.col("total") * share
    at = F.when(F.col("before").isNull(), F.lit(1.0)).otherwise(F.col("dist") - 1 + (need - F.col("before")) / (F.col("cum") - F.col("before")))
    return c.agg(F.min(F.when(F.col("cum") >= need, at)).alias("effective"), F.max("dist").alias("full"), (F.sum("dp") / F.max("total")).alias("mean"))


def closeness(dist: DataFrame) -> DataFrame:
    """``(node, farness, closeness, eccentricity)`` of each source over what it reaches."""
    return closeness_of(dist.groupBy("source", "dist").agg(F.count("*").alias("nodes")))


def closeness_of(counts: DataFrame) -> DataFrame:
    """``closeness`` from ``counts(source, dist, nodes)``."""
    far = F.sum(F.col("dist") * F.col("nodes")) / F.sum("nodes")
    d = counts.where("dist > 0").groupBy(F.col("source").alias("node")).agg(far.alias("farness"), F.max("dist").alias("eccentricity"))
    return d.select("node", "farness", (1 / F.col("farness")).alias("closeness"), "eccentricity")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, component)``, component = the least node of each strong component.

    First everything without a way in or out is trimmed, which alone settles a graph without cycles. Then
    each round spreads least labels forwards within what is left; a node whose own label came back from
    its colour's root over reversed edges is done. Nodes without an edge either way are done at once.
    """
    rest = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    everyone = nodes(edges)
    done = []
    for _ in range(max_rounds):
        rest = _trimmed(rest)
        if not rest.limit(1).count():
            break
        inner = nodes(rest)
        colour = _spread(rest, inner.select("node", F.col("node").alias("label")))
        back = rest.join(colour.select(F.col("node").alias("src"), F.col("label").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("cd")), "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("c"))
        found = materialize(_reach(back, colour.where("node = label").select("node", F.col("label").alias("c"))), "scc")
        done.append(found.select("node", F.col("c").alias("component")))
        left = inner.join(found, "node", "left_anti")
        rest = materialize(induced(rest, left), "scc")
    out = None
    for d in done:
        out = d if out is None else out.unionAll(d)
    single = everyone if out is None else everyone.join(out, "node", "left_anti")
    single = single.select("node", F.col("node").alias("component"))
    return single if out is None else out.unionAll(single)


def _trimmed(arcs: DataFrame) -> DataFrame:
    """What is left of directed edges when those at nodes without an edge in or out are taken away, again and again."""
    before = arcs.count()
    while before:
        both = arcs.select(F.col("src").alias("node")).distinct().join(arcs.select(F.col("dst").alias("node")), "node", "left_semi")
        left = materialize(induced(arcs, both), "scc")
        after = left.count()
        arcs = left
        if after == before:
            break
        before = after
    return arcs


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label that reaches each node along directed edges."""
    labels = materialize(labels, "labels")
    while True:
        sent = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("sent"))
        nxt = materialize(labels.join(sent, "node", "left").select("node", F.least("label", F.coalesce("sent", "label")).alias("label"), (F.col("sent") < F.col("label")).alias("moved")), "labels")
        moved = nxt.where("moved").limit(1).count()
        labels = nxt.select("node", "label")
        if not moved:
            return labels


def _reach(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reached from ``start(node, c)`` along ``arcs(src, dst, c)`` of their colour."""
    seen = materialize(start, "reach")
    frontier = seen
    while True:
        step = frontier.withColumnRenamed("node", "src").join(arcs, ["src", "c"]).select(F.col("dst").alias("node"), "c").distinct()
        frontier = materialize(step.join(seen, ["node", "c"], "left_anti"), "reach")
        if not frontier.limit(1).count():
            return seen
        seen = materialize(seen.unionByName(frontier), "reach")


def core_numbers(edges: DataFrame) -> DataFrame:
    """``(node, core)``: the largest k of which a node is in the k-core. Rounds over packed arcs, of which none is shuffled."""
    from strataloom.operators import grid  # it numbers nodes by this module

    return grid.core_numbers(edges)


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, eps: float | None = 1e-4) -> DataFrame:
    """``(node, rank)``; what leaks is spread evenly. Stops when the ranks move less than ``eps`` in sum, or after ``rounds``."""
    arcs = edges.select("src", "dst").distinct()
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    arcs = materialize(arcs.join(out, "src"), "pagerank")
    n = (all_nodes := materialize(nodes(edges), "pagerank")).count()
    if not n:
        return all_nodes.withColumn("rank", F.lit(0.0))
    ranks = all_nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        sent = arcs.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        raw = materialize(ranks.join(sent, "node", "left").select("node", "rank", (damping * F.coalesce("got", F.lit(0.0))).alias("new")), "pagerank")
        leak = (1.0 - raw.agg(F.sum("new")).first()[0]) / n
        ranks = raw.select("node", (F.col("new") + leak).alias("rank"))
        if eps is not None and raw.agg(F.sum(F.abs(F.col("new") + leak - F.col("rank")))).first()[0] < eps:
            break
    return ranks


def _unit(df: DataFrame, *columns: str) -> DataFrame:
    """Columns divided by their Euclidean length."""
    lengths = df.agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns)).first()
    for c in columns:
        df = df.withColumn(c, F.col(c) / (lengths[c] or 1.0))
    return df


def hits(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``(node, hub, auth)``, each of length 1."""
    arcs = materialize(edges.select("src", "dst").distinct(), "hits")
    v = materialize(nodes(arcs).withColumn("hub", F.lit(1.0)), "hits")
    for _ in range(rounds):
        auth = arcs.join(v.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("auth"))
        v = _unit(materialize(v.select("node").join(auth, "node", "left").fillna(0.0), "hits"), "auth")
        hub = arcs.join(v.select(F.col("node").alias("dst"), "auth"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("auth").alias("hub"))
        v = _unit(materialize(v.join(hub, "node", "left").fillna(0.0), "hits"), "hub")
    return v.select("node", "hub", "auth")


def eigenvector(edges: DataFrame, rounds: int = 100, eps: float | None = 1e-4) -> DataFrame:
    """``(node, value)``: power iteration on an undirected graph, of length 1, until the values move less than ``eps`` in sum. No arc is shuffled in a round."""
    from strataloom.operators import grid  # it numbers nodes by this module

    return grid.eigenvector(edges, rounds, eps)


def product(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """Sparse matrix ``(src, dst, w)`` times ``vector(node, value)``, a row for each src."""
    return matrix.join(vector.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``(group, inner, outer, q)`` of ``membership(node, group)``: inner edges, edges leaving and the group's share of modularity."""
    m = edges.count()
    g = edges.join(membership.select(F.col("node").alias("a"), F.col("group").alias("ga")), "a").join(membership.select(F.col("node").alias("b"), F.col("group").alias("gb")), "b")
    inner = g.groupBy(F.col("ga").alias("group")).agg(F.count_if(F.col("ga") == F.col("gb")).alias("inner"))
    deg = undirected_degrees(edges).join(membership, "node").groupBy("group").agg(F.sum("deg").alias("deg"))
    both = deg.join(inner, "group", "left").select("group", "deg", F.coalesce("inner", F.lit(0)).alias("inner"))
    q = (2 * F.col("inner") - F.col("deg") * F.col("deg") / (2 * m)) / (2 * m)
    return both.select("group", "inner", (F.col("deg") - 2 * F.col("inner")).alias("outer"), q.alias("q"))


def strongest(weighted: DataFrame, k: int = 2) -> DataFrame:
    """Each node's ``k`` heaviest edges of ``(src, dst, w)``, ties to the lesser neighbour."""
    order = Window.partitionBy("src").orderBy(F.col("w").desc(), "dst")
    return weighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def triad_closing(timed: DataFrame) -> DataFrame:
    """Of ``(a, b, ts)``, each unordered pair's first edge, with the number of neighbours already shared when it came."""
    first = timed.groupBy("a", "b").agg(F.min("ts").alias("ts"))
    first = materialize(first, "closing")
    side = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    # a triangle is closed by the one side that comes after both others, if there is one
    t = triangles(first.select("a", "b"), first)
    last = F.when((F.col("t1") > F.col("t2")) & (F.col("t1") > F.col("t3")), side("x", "y")).when((F.col("t2") > F.col("t1")) & (F.col("t2") > F.col("t3")), side("x", "z")).when((F.col("t3") > F.col("t1")) & (F.col("t3") > F.col("t2")), side("y", "z"))
    closed = t.select(last.alias("e")).where("e is not null").groupBy("e.a", "e.b").agg(F.count("*").alias("shared"))
    return first.join(closed, ["a", "b"], "left").select("a", "b", "ts", F.coalesce("shared", F.lit(0)).alias("shared"))


def growth(timed: DataFrame, bucket: Column) -> DataFrame:
    """``(bucket, nodes, edges)`` up to each bucket: first appearances are counted, then summed."""
    e = timed.select(bucket.alias("bucket"), "a", "b").groupBy("a", "b").agg(F.min("bucket").alias("bucket"))
    n = e.select("bucket", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.min("bucket").alias("bucket"))
    new = e.groupBy("bucket").agg(F.count("*").alias("e")).join(n.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left")
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bucket
    return new.select("bucket", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("nodes"), F.sum("e").over(w).alias("edges"))


def conductance(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Cut, volume and conductance of the node set ``inside(node)``."""
    s = both_ways(edges)
    mark = inside.select("node", F.lit(1).alias("in_"))
    m = s.join(mark.select(F.col("node").alias("src"), F.col("in_").alias("x")), "src", "left").join(mark.select(F.col("node").alias("dst"), F.col("in_").alias("y")), "dst", "left")
    r = m.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNull()).alias("cut"), F.count_if(F.col("x").isNotNull()).alias("volume"), F.count("*").alias("total"))
    return r.select("cut", "volume", F.try_divide("cut", F.least("volume", F.col("total") - F.col("volume"))).alias("conductance"))
