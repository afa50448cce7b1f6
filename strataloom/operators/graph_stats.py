"""Statistics of whole graphs and of graphs that grow, motifs, edits, and local clusters."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators import graph as gr
from strataloom.operators.components import connected_components
from strataloom.operators.pairs import pair_sums
from strataloom.session import materialize


def statistics(arcs: DataFrame) -> DataFrame:
    """One row of counts of a directed graph: nodes, edges of every kind, degrees, triads and the largest weak component."""
    arcs = materialize(arcs.select("src", "dst").distinct(), "statistics")
    edges = materialize(gr.undirected(arcs), "statistics")
    deg = gr.degrees(arcs).agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("out_deg") > 0).alias("src_nodes"),
        F.count_if(F.col("in_deg") > 0).alias("dst_nodes"),
        F.count_if((F.col("out_deg") > 0) & (F.col("in_deg") > 0)).alias("both_nodes"),
        F.max("out_deg").alias("max_out"),
        F.max("in_deg").alias("max_in"),
    )
    kinds = arcs.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_edges"))
    unique = edges.agg(F.count("*").alias("unique_edges"))
    both = gr.reciprocal(arcs).agg(F.count("*").alias("reciprocal_edges"))
    tri = gr.triads(edges).agg(F.coalesce(F.sum("open"), F.lit(0)).alias("open_triads"), F.coalesce(F.sum("closed") / 3, F.lit(0)).cast("bigint").alias("triangles"), F.avg("clustering").alias("clustering"))
    parts = connected_components(arcs)
    sizes = materialize(parts.groupBy("component").agg(F.count("*").alias("size")), "statistics")
    largest = sizes.agg(F.count("*").alias("wcc_count"), F.max("size").alias("wcc_nodes"))
    out = deg
    for one in (kinds, unique, both, tri, largest):  # one row each
        out = out.crossJoin(one)
    return out


def over_time(timed: DataFrame, bucket: Column) -> DataFrame:
    """``(bucket, nodes, edges, median_degree, triangles, open_triads, clustering)`` of the graph of ``(a, b, ts)`` up to each bucket.

    There are few buckets; every edge is counted with its first one, and each bucket takes the edges up to it.
    """
    first = materialize(timed.select("a", "b", bucket.alias("bucket")).groupBy("a", "b").agg(F.min("bucket").alias("bucket")), "over-time")
    out = None
    for (at,) in sorted(first.select("bucket").distinct().collect()):  # a row for each bucket
        t = gr.triads(first.where(F.col("bucket") <= F.lit(at)).select("a", "b"))
        row = t.agg(
            F.lit(at).alias("bucket"),
            F.count("*").alias("nodes"),
            (F.sum("deg") / 2).cast("bigint").alias("edges"),
            F.median("deg").alias("median_degree"),
            (F.sum("closed") / 3).cast("bigint").alias("triangles"),
            F.sum("open").alias("open_triads"),
            F.avg("clustering").alias("clustering"),
        )
        out = row if out is None else out.unionAll(row)
    return out


def tree_check(arcs: DataFrame) -> DataFrame:
    """``(nodes, edges, roots, is_tree)``: a tree has one root, one way in to every other node, and hangs together."""
    d = gr.degrees(arcs.where("src <> dst")).agg(F.count("*").alias("nodes"), F.sum("in_deg").alias("edges"), F.count_if(F.col("in_deg") == 0).alias("roots"), F.max("in_deg").alias("most"))
    parts = connected_components(arcs).agg(F.countDistinct("component").alias("parts"))
    return d.crossJoin(parts).select("nodes", "edges", "roots", ((F.col("roots") == 1) & (F.col("most") <= 1) & (F.col("parts") == 1)).alias("is_tree"))  # one row each


def tree_signature(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """``(source, depth, children, nodes)``: how many nodes of each number of children a tree has at each depth below ``roots(node)``."""
    dist = gr.bfs(arcs, roots)
    kids = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("children"))
    return dist.join(kids, "node", "left").groupBy("source", F.col("dist").alias("depth"), F.coalesce("children", F.lit(0)).alias("children")).agg(F.count("*").alias("nodes"))


def random_nodes(edges: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Directed edges among ``n`` nodes drawn by a hash of node and seed."""
    drawn = gr.nodes(edges).orderBy(F.md5(F.concat(F.col("node").cast("string"), F.lit(f"-{seed}")))).limit(n)
    return gr.induced(edges, drawn)


def random_edges(edges: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` directed edges drawn by a hash of their ends and seed."""
    return edges.select("src", "dst").orderBy(F.md5(F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(str(seed))))).limit(n)


def with_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges of either; an edge that is there already stays one."""
    return edges.select("src", "dst").union(more.select("src", "dst")).distinct()


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of ``gone(node)``."""
    return edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)


def with_attribute(table: DataFrame, keys: list[str], name: str, values: DataFrame, default) -> DataFrame:
    """``table`` with a column of ``values(*keys, name)``, ``default`` where there is none; an older column of that name keeps what is not set."""
    old = F.col(name) if name in table.columns else F.lit(None)
    fresh = values.select(*keys, F.col(name).alias("__new"))
    joined = table.join(fresh, keys, "left")
    return joined.select(*(c for c in table.columns if c != name), F.coalesce("__new", old, F.lit(default)).alias(name))


def motifs(edges: DataFrame) -> DataFrame:
    """``(motif, n)``: connected induced subgraphs of three and four nodes by kind.

    Subgraphs that may have further edges are counted by degrees, triangles and shared neighbours; inclusion and
    exclusion then gives the induced ones. Only pairs with a shared neighbour are ever laid out, those of hubs in blocks.
    """
    edges = materialize(edges.select("a", "b"), "motifs")
    t = materialize(gr.triads(edges).select("node", "deg", "closed"), "motifs")
    d = F.col("deg")
    nodes = t.agg(F.sum(d * (d - 1) / 2).alias("wedges"), F.sum(d * (d - 1) * (d - 2) / 6).alias("stars"), (F.sum("closed") / 3).alias("triangles"), F.sum(F.col("closed") * (d - 2)).alias("tailed"))
    ends = edges.join(t.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(t.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b")
    paths = ends.agg(F.sum((F.col("da") - 1) * (F.col("db") - 1)).alias("paths"))
    tri = materialize(gr.triangles(edges), "motifs")
    sides = tri.select(F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("x", "y"), ("y", "z"), ("x", "z"))))).alias("e")).select("e.*")
    diamonds = sides.groupBy("a", "b").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).alias("diamonds"))
    s = gr.both_ways(edges)
    shared = gr.projection(s, "src", "dst")
    cycles = shared.agg(F.coalesce(F.sum(F.col("w") * (F.col("w") - 1) / 2) / 2, F.lit(0)).alias("cycles"))
    # triangles reach from a node to two of its later ones: two triangles that share their first side, and an edge between their tips
    other = tri.select("x", "y", F.col("z").alias("z2"))
    tips = gr.split_join(tri.select(F.struct("x", "y").alias("side"), "z"), other.select(F.struct("x", "y").alias("side"), "z2"), "side").where("z < z2")
    cliques = tips.join(edges.select(F.col("a").alias("z"), F.col("b").alias("z2")), ["z", "z2"], "left_semi").agg(F.count("*").alias("cliques"))
    whole = nodes
    for one in (paths, diamonds, cycles, cliques):  # one row each
        whole = whole.crossJoin(one)
    c = {n: F.coalesce(n, F.lit(0)) for n in ("wedges", "stars", "triangles", "tailed", "paths", "diamonds", "cycles", "cliques")}
    p = c["paths"] - 3 * c["triangles"]
    kinds = {
        "path3": c["wedges"] - 3 * c["triangles"],
        "triangle": c["triangles"],
        "star4": c["stars"] - c["tailed"] + 2 * c["diamonds"] - 4 * c["cliques"],
        "path4": p - 2 * c["tailed"] - 4 * c["cycles"] + 6 * c["diamonds"] - 12 * c["cliques"],
        "tailed_triangle": c["tailed"] - 4 * c["diamonds"] + 12 * c["cliques"],
        "cycle4": c["cycles"] - c["diamonds"] + 3 * c["cliques"],
        "diamond": c["diamonds"] - 6 * c["cliques"],
        "clique4": c["cliques"],
    }
    return whole.select(F.explode(F.array(*(F.struct(F.lit(k).alias("motif"), F.round(v).cast("bigint").alias("n")) for k, v in kinds.items()))).alias("m")).select("m.*")


def personal_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, eps: float = 1e-3, max_rounds: int = 200) -> DataFrame:
    """``(seed, node, p)``: approximate personalised PageRank around each of ``seeds(node)`` by pushes (Andersen, Chung and Lang).

    In each round every node whose residue is ``eps`` of its degree or more keeps ``alpha`` of it, and sends half of the
    rest to its neighbours; so only nodes near a seed are ever touched, whatever the graph. Arcs bring the degrees of both
    ends and are dealt and sorted by their source once, so that a round shuffles what is touched and nothing else.
    """
    both = materialize(gr.both_ways(edges), "ppr")
    deg = materialize(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg")), "ppr")
    state = materialize(seeds.join(deg, "node").select(F.col("node").alias("seed"), "node", "deg", F.lit(0.0).alias("p"), F.lit(1.0).alias("r")), "ppr")
    arcs = both.join(deg.select(F.col("node").alias("dst"), "deg"), "dst").select("src", "dst", F.col("deg").alias("far"))
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // (1 << 22)))
    arcs = arcs.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)
    try:
        arcs.count()  # only a finished table is known to be dealt by source
        for _ in range(max_rounds):
            push = F.col("r") >= eps * F.col("deg")
            if not state.where(push).limit(1).count():
                break
            pushed = state.where(push).select("seed", F.col("node").alias("src"), ((1 - alpha) / 2 * F.col("r") / F.col("deg")).alias("q"))
            sent = pushed.hint("shuffle_merge").join(arcs, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.sum("q").alias("got"), F.max("far").alias("far"))
            kept = state.select("seed", "node", "deg", F.when(push, F.col("p") + alpha * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(push, (1 - alpha) / 2 * F.col("r")).otherwise(F.col("r")).alias("r"))
            merged = kept.join(sent, ["seed", "node"], "full_outer").select("seed", "node", F.coalesce("deg", "far").alias("deg"), F.coalesce("p", F.lit(0.0)).alias("p"), (F.coalesce("r", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("r"))
            state = materialize(merged, "ppr")
    finally:
        arcs.unpersist()
    return state.where("p > 0").select("seed", "node", "p")


def sweep(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """``(seed, size, cut, volume, conductance)`` of the first nodes by ``p`` per degree, of every size, around each seed."""
    both = materialize(gr.both_ways(edges), "sweep")
    total = both.count()
    deg = materialize(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg")), "sweep")
    order = Window.partitionBy("seed").orderBy((F.col("p") / F.col("deg")).desc(), "node")
    ranked = materialize(scores.join(deg, "node").withColumn("size", F.row_number().over(order)), "sweep")  # a seed's scores are as many as its pushes reached
    left = ranked.select("seed", F.col("node").alias("src"), F.col("size").alias("i"))
    right = ranked.select("seed", F.col("node").alias("dst"), F.col("size").alias("j"))
    inner = both.where("src < dst").join(left, "src").join(right, ["seed", "dst"]).groupBy("seed", F.greatest("i", "j").alias("size")).agg(F.count("*").alias("inside"))
    over = Window.partitionBy("seed").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranked.join(inner, ["seed", "size"], "left").select("seed", "size", F.sum("deg").over(over).alias("volume"), F.sum(F.coalesce("inside", F.lit(0))).over(over).alias("inside"))
    cut = F.col("volume") - 2 * F.col("inside")
    return sums.select("seed", "size", cut.alias("cut"), "volume", F.try_divide(cut, F.least(F.col("volume"), F.lit(total) - F.col("volume"))).alias("conductance"))


def community_profile(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, eps: float = 1e-3) -> DataFrame:
    """``(size, conductance)``: the least conductance of each size over the sweeps of all seeds."""
    return sweep(edges, personal_pagerank(edges, seeds, alpha, eps)).where("conductance is not null").groupBy("size").agg(F.min("conductance").alias("conductance"))


def whiskers(blocks: DataFrame) -> DataFrame:
    """``(whisker, nodes, edges, volume, conductance)``: what single bridges hold on to the core of the largest component.

    The core is the largest of the pieces that are left without bridges (ties: the one of the least node). Each component of what
    remains when the core is taken out hangs on it by one bridge, for two would be in a cycle with the core; trees
    count as well as denser parts, and its volume is twice its edges and the bridge.
    """
    blocks = materialize(blocks.select("a", "b", "bridge"), "whiskers")
    arcs = blocks.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = materialize(connected_components(arcs), "whiskers")
    alone = gr.nodes(arcs).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    pieces = connected_components(blocks.where("not bridge").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(alone))
    best = F.struct(F.count("*").alias("size"), (-F.col("component")).alias("less"))
    whole = parts.groupBy("component").agg(best.alias("m")).agg(F.max("m").alias("m")).select((-F.col("m.less")).alias("component"))  # one row
    inside = materialize(parts.join(F.broadcast(whole), "component", "left_semi").select("node"), "whiskers")
    pieces = materialize(pieces.join(inside, "node", "left_semi"), "whiskers")
    core = pieces.groupBy("component").agg(best.alias("m")).agg(F.max("m").alias("m")).select((-F.col("m.less")).alias("component"))  # one row
    centre = materialize(pieces.join(F.broadcast(core), "component", "left_semi").select("node"), "whiskers")
    out = materialize(inside.join(centre, "node", "left_anti"), "whiskers")
    links = materialize(gr.induced(arcs, out), "whiskers")
    hanging = connected_components(links.unionAll(out.select(F.col("node").alias("src"), F.col("node").alias("dst"))))
    sizes = hanging.groupBy("component").agg(F.count("*").alias("nodes"))
    inner = links.join(hanging.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("edges"))
    total = blocks.join(inside.withColumnRenamed("node", "a"), "a", "left_semi").agg((2 * F.count("*")).alias("total"))  # one row
    found = sizes.join(inner, "component", "left").fillna(0, ["edges"]).crossJoin(F.broadcast(total)).withColumn("volume", 2 * F.col("edges") + 1)
    return found.select(F.col("component").alias("whisker"), "nodes", "edges", "volume", (1 / F.least("volume", F.col("total") - F.col("volume"))).alias("conductance"))


def bag_of_whiskers(found: DataFrame, total: int, most: int = 100) -> DataFrame:
    """``(nodes, whiskers, volume, conductance)``: for each number of nodes up to ``most`` the union of ``whiskers`` of least conductance (ties: fewer whiskers).

    Of whiskers of n nodes only the ``most / n`` of greatest volume can be in a best union, so what reaches the driver are
    ``most * (1 + ln most)`` rows at most, whatever the graph; a knapsack over them gives the greatest volume for each number of nodes and whiskers.
    """
    import numpy as np

    order = Window.partitionBy("nodes").orderBy(F.desc("volume"), "whisker")
    best = found.where(F.col("nodes") <= most).withColumn("k", F.row_number().over(order)).where(F.col("k") * F.col("nodes") <= most)
    volume = np.full((most + 1, most + 1), -1, np.int64)  # by nodes and whiskers
    volume[0, 0] = 0
    for r in best.select("nodes", "volume").collect():
        before = volume[: most + 1 - r.nodes, :-1]
        volume[r.nodes :, 1:] = np.maximum(volume[r.nodes :, 1:], np.where(before >= 0, before + r.volume, -1))
    rows = []
    for n in range(1, most + 1):
        unions = [(k / min(v, total - v), k, int(v)) for k, v in enumerate(volume[n].tolist()) if v >= 0 and min(v, total - v) > 0]
        if unions:
            phi, k, v = min(unions)
            rows.append((n, k, v, phi))
    return found.sparkSession.createDataFrame(rows, "nodes bigint, whiskers bigint, volume bigint, conductance double")


def sign_prediction(signed: DataFrame) -> DataFrame:
    """``(a, b, sign, balance, predicted)`` of signed edges ``(a, b, sign)`` in triangles: the sum of what their other two sides' signs make, and its sign."""
    t = gr.triangles(signed.select("a", "b"))
    side = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    rows = t.select(F.xxhash64("x", "y", "z").alias("t"), F.explode(F.array(side("x", "y"), side("y", "z"), side("x", "z"))).alias("e")).select("t", "e.a", "e.b").join(signed, ["a", "b"])
    whole = rows.groupBy("t").agg(F.product("sign").alias("product"))
    each = rows.join(whole, "t").groupBy("a", "b", "sign").agg(F.sum(F.col("product") * F.col("sign")).cast("bigint").alias("balance"))
    return each.select("a", "b", "sign", "balance", F.signum("balance").cast("int").alias("predicted"))


def node_buckets(timed: DataFrame, size: int) -> DataFrame:
    """``(node, ts, bucket)``: nodes of ``(a, b, ts)`` in order of their first edge, ``size`` to a bucket."""
    first = timed.select(F.explode(F.array("a", "b")).alias("node"), "ts").groupBy("node").agg(F.min("ts").alias("ts"))
    key = F.struct("ts", "node")
    ids = gr.dense_ids(first.select(key.alias("src"), key.alias("dst")))
    return ids.select("node.node", "node.ts", F.floor(F.col("id") / size).alias("bucket"))


def cascades(arcs: DataFrame, seeds: DataFrame, passed: Column) -> DataFrame:
    """``(source, size, depth)`` of what each of ``seeds(node)`` sets off where only the arcs for which ``passed`` is true pass it on."""
    dist = gr.bfs(materialize(arcs.where(passed).select("src", "dst"), "cascades"), seeds)
    return dist.groupBy("source").agg(F.count("*").alias("size"), F.max("dist").alias("depth"))


def acyclic_order(arcs: DataFrame) -> DataFrame:
    """``(node, place)``: nodes by falling surplus of edges out over edges in, ties by node; edges to later places make no cycle."""
    d = gr.degrees(arcs.where("src <> dst")).select("node", (F.col("in_deg") - F.col("out_deg")).alias("lack"))
    key = F.struct("lack", "node")
    ids = gr.dense_ids(d.select(key.alias("src"), key.alias("dst")))
    return ids.select("node.node", F.col("id").alias("place"))


def vote_statistics(votes: DataFrame, candidate: str, voter: str, vote: Column, ts: str) -> DataFrame:
    """``(candidate, voters, in_favour, against, won, first_at, last_at)`` of votes above, below or at 0; the last vote of a voter counts."""
    last = votes.select(F.col(candidate).alias("candidate"), F.col(voter).alias("voter"), vote.alias("vote"), F.col(ts).alias("ts")).groupBy("candidate", "voter").agg(F.max(F.struct("ts", "vote")).alias("l"))
    v = F.col("l.vote")
    sums = last.groupBy("candidate").agg(F.count("*").alias("voters"), F.count_if(v > 0).alias("in_favour"), F.count_if(v < 0).alias("against"), F.min("l.ts").alias("first_at"), F.max("l.ts").alias("last_at"))
    return sums.select("candidate", "voters", "in_favour", "against", (F.col("in_favour") > F.col("against")).alias("won"), "first_at", "last_at")


def link_model(edges: DataFrame, rounds: int = 8, ridge: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """``(a, b, common, adamic, p)`` of all pairs with a shared neighbour, and the weights of a logistic regression of being linked.

    Weights come from Newton steps, whose sums over all pairs are taken on the executors: ten numbers reach the driver.
    """
    edges = materialize(edges.select("a", "b"), "links")
    deg = gr.undirected_degrees(edges).withColumnRenamed("node", "src")
    rows = gr.both_ways(edges).join(deg, "src").select(F.col("src").alias("key"), F.col("dst").alias("node"), (1 / F.log(F.col("deg") + 1)).alias("w"))
    pairs = pair_sums(rows, weighted=True).toDF("a", "b", "common", "adamic")  # added up by blocks of pairs
    marked = materialize(pairs.join(edges.select("a", "b", F.lit(1.0).alias("y")), ["a", "b"], "left").fillna(0.0, ["y"]), "links")
    import numpy as np

    x = [F.lit(1.0), F.log1p(F.col("common").cast("double")), F.log1p("adamic")]
    weights = np.zeros(3)
    score = lambda: sum((F.lit(float(b)) * c for b, c in zip(weights, x, strict=True)), F.lit(0.0))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-score()))
        both = [F.sum((F.col("y") - p) * c) for c in x] + [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(3) for j in range(3)]
        sums = [v or 0.0 for v in marked.agg(*both).first()]
        weights = weights + np.linalg.solve(np.array(sums[3:]).reshape(3, 3) + ridge * np.eye(3), np.array(sums[:3]) - ridge * weights)
    return marked.select("a", "b", "common", "adamic", (1 / (1 + F.exp(-score()))).alias("p")), weights.tolist()
