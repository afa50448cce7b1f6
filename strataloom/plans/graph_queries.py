"""Queries on bipartite, collaboration, follower and commit graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.operators import distribution as ds
from strataloom.operators import graph as gr
from strataloom.operators import pairs as pr
from strataloom.operators import searches as se
from strataloom.operators.components import connected_components
from strataloom.session import materialize
from strataloom.tables import Tables, oracle

#: both directions of the undirected follower graph, and its degrees
S = "s as (select a as src, b as dst from v_edges union all select b, a from v_edges)"
DEG = f"{S}, g as (select src as node, count(*) as deg from s group by src)"
#: searches start at every twentieth id and run over all edges
EVERY = 20


def _q(name: str, sql: str):
    return register(name, oracle(sql))


def _arcs(spark, sf_dir):
    return Tables(spark, sf_dir).v_followers.select("src", "dst")


def _edges(spark, sf_dir):
    return Tables(spark, sf_dir).v_edges


def _sources(edges):
    return gr.nodes(edges).where(F.col("node") % EVERY == 0)


@_q("bipartite_weight", "select repo_id, user_id, weight from v_bipartite")
def bipartite_weight(spark, sf_dir):
    return Tables(spark, sf_dir).v_commits.groupBy(F.col("project_id").alias("repo_id"), F.col("author_id").alias("user_id")).agg(F.count("*").alias("weight"))


@_q("bipartite_last_write", "select project_id, author_id, max(id) as last_commit from v_commits c where created_at = (select max(created_at) from v_commits d where d.project_id = c.project_id and d.author_id = c.author_id) group by 1, 2")
def bipartite_last_write(spark, sf_dir):
    last = F.max(F.struct("created_at", "id"))["id"]
    return Tables(spark, sf_dir).v_commits.groupBy("project_id", "author_id").agg(last.alias("last_commit"))


@_q("projection", "select x.user_id as a, y.user_id as b, count(*) as w from v_bipartite x join v_bipartite y on x.repo_id = y.repo_id and x.user_id < y.user_id group by 1, 2")
def projection(spark, sf_dir):
    return gr.projection(Tables(spark, sf_dir).v_bipartite, "repo_id", "user_id")


@_q("projection_self", "select user_id as a, count(*) as self_w from v_bipartite group by user_id")
def projection_self(spark, sf_dir):
    return Tables(spark, sf_dir).v_bipartite.groupBy(F.col("user_id").alias("a")).agg(F.countDistinct("repo_id").alias("self_w"))


_ENDS = "ends as (select 'repo_id' as side, repo_id as node, weight as w from v_bipartite union all select 'user_id', user_id, weight from v_bipartite), st as (select side, node, count(*) as deg, sum(w) as strength from ends group by side, node)"


@_q("degree_hist_by_type", f"with {_ENDS} select side, deg as value, count(*) as freq from st group by side, deg")
def degree_hist_by_type(spark, sf_dir):
    return ds.pdf(gr.strengths(Tables(spark, sf_dir).v_bipartite, "repo_id", "user_id", "weight"), "deg", ["side"])


@_q("strength_hist", f"with {_ENDS} select side, strength as value, count(*) as freq from st group by side, strength")
def strength_hist(spark, sf_dir):
    return ds.pdf(gr.strengths(Tables(spark, sf_dir).v_bipartite, "repo_id", "user_id", "weight"), "strength", ["side"])


@_q("collaboration_degree", "with p as (select x.user_id as a, y.user_id as b, count(*) as w from v_bipartite x join v_bipartite y on x.repo_id = y.repo_id and x.user_id <> y.user_id group by 1, 2), d as (select a, count(*) as deg from p group by a) select deg as value, count(*) as freq from d group by deg")
def collaboration_degree(spark, sf_dir):
    p = gr.projection(Tables(spark, sf_dir).v_bipartite, "repo_id", "user_id")
    return ds.pdf(gr.undirected_degrees(p), "deg")


@_q("collaboration_weight_ccdf", "with p as (select x.user_id as a, y.user_id as b, count(*) as w from v_bipartite x join v_bipartite y on x.repo_id = y.repo_id and x.user_id < y.user_id group by 1, 2), d as (select w as value, count(*) as freq from p group by w) select value, freq, sum(freq) over (order by value desc) as cum from d")
def collaboration_weight_ccdf(spark, sf_dir):
    return ds.cumulative(ds.pdf(gr.projection(Tables(spark, sf_dir).v_bipartite, "repo_id", "user_id"), "w"), descending=True)


@_q("kl_divergence", f"""with {_ENDS}, t as (select cast(sum(weight) as double) as total from v_bipartite), arcs as (select 'repo_id' as side, repo_id as node, 'user_id' as oside, user_id as other, weight as w from v_bipartite union all select 'user_id', user_id, 'repo_id', repo_id, weight from v_bipartite),
 k as (select a.side, a.node, sum(a.w / cast(x.strength as double) * (ln(a.w / cast(x.strength as double)) - ln(y.strength / total))) as kl from arcs a join st x on x.side = a.side and x.node = a.node join st y on y.side = a.oside and y.node = a.other cross join t group by 1, 2)
 select side, node, round(kl, 6) as kl, round(case when max(kl) over w > min(kl) over w then (kl - min(kl) over w) / (max(kl) over w - min(kl) over w) else 0.0 end, 6) as scaled from k window w as (partition by side)""")
def kl_divergence(spark, sf_dir):
    k = gr.kl_divergence(Tables(spark, sf_dir).v_bipartite, "repo_id", "user_id", "weight")
    return k.select("side", "node", F.round("kl", 6).alias("kl"), F.round("scaled", 6).alias("scaled"))


@_q("in_out_degree", "with i as (select dst as node, count(*) as in_deg from v_followers group by 1), o as (select src as node, count(*) as out_deg from v_followers group by 1) select node, coalesce(in_deg, 0) as in_deg, coalesce(out_deg, 0) as out_deg from i full outer join o using (node)")
def in_out_degree(spark, sf_dir):
    return gr.degrees(_arcs(spark, sf_dir))


@_q("follower_degree_ccdf", "with d as (select n as value, count(*) as freq from (select dst, count(*) as n from v_followers group by dst) t group by n) select value, freq, sum(freq) over (order by value desc) as cum from d")
def follower_degree_ccdf(spark, sf_dir):
    return ds.cumulative(ds.pdf(gr.degrees(_arcs(spark, sf_dir)).where("in_deg > 0"), "in_deg"), descending=True)


@_q("degree_hist_with_zero", f"with {DEG} select coalesce(deg, 0) as value, count(*) as freq from v_users u left join g on g.node = u.id group by 1")
def degree_hist_with_zero(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.v_users.select(F.col("id").alias("node")).join(gr.undirected_degrees(t.v_edges), "node", "left").select(F.coalesce("deg", F.lit(0)).alias("deg"))
    return ds.pdf(d, "deg")


@_q("degree_counts", f"with {DEG} select count(*) as nodes, count(*) filter (where deg = 3) as of_degree_3, max(deg) as max_deg, max(node) filter (where deg = (select max(deg) from g)) as max_node from g")
def degree_counts(spark, sf_dir):
    d = gr.undirected_degrees(_edges(spark, sf_dir))
    return d.agg(F.count("*").alias("nodes"), F.count_if(F.col("deg") == 3).alias("of_degree_3"), F.max("deg").alias("max_deg"), F.max(F.struct("deg", "node"))["node"].alias("max_node"))


@_q("edge_counts", "select count(*) as directed, count(*) filter (where src = dst) as self_edges, (select count(*) from v_edges) as undirected, (select count(*) from v_followers a join v_followers b on a.src = b.dst and a.dst = b.src where a.src <> a.dst) as reciprocal from v_followers")
def edge_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = gr.reciprocal(_arcs(spark, sf_dir)).agg(F.count("*").alias("reciprocal"))
    und = t.v_edges.agg(F.count("*").alias("undirected"))
    one = t.v_followers.agg(F.count("*").alias("directed"), F.count_if(F.col("src") == F.col("dst")).alias("self_edges"))
    return one.crossJoin(und).crossJoin(both)  # one row each


@_q("reciprocal_edges", "select a.src, a.dst from v_followers a join v_followers b on a.src = b.dst and a.dst = b.src where a.src <> a.dst")
def reciprocal_edges(spark, sf_dir):
    return gr.reciprocal(_arcs(spark, sf_dir))


@_q("edges_into_set", "select src, count(distinct dst) as n from v_followers where dst in (select id from v_users where company = 'BUILDING') group by src")
def edges_into_set(spark, sf_dir):
    t = Tables(spark, sf_dir)
    inside = t.v_users.where("company = 'BUILDING'").select(F.col("id").alias("dst"))
    return _arcs(spark, sf_dir).join(inside, "dst", "left_semi").groupBy("src").agg(F.countDistinct("dst").alias("n"))


@_q("symmetrised", "select src, dst from v_followers union select dst, src from v_followers")
def symmetrised(spark, sf_dir):
    e = _arcs(spark, sf_dir)
    return e.union(e.select("dst", "src")).distinct()


@_q("without_low_degree", f"with {DEG} select a, b from v_edges where a not in (select node from g where deg <= 2) and b not in (select node from g where deg <= 2)")
def without_low_degree(spark, sf_dir):
    e = _edges(spark, sf_dir)
    low = gr.undirected_degrees(e).where("deg <= 2")
    return e.join(low.select(F.col("node").alias("a")), "a", "left_anti").join(low.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")


@_q("induced_subgraph", "select src, dst from v_followers where src in (select id from v_users where location < 5) and dst in (select id from v_users where location < 5)")
def induced_subgraph(spark, sf_dir):
    keep = Tables(spark, sf_dir).v_users.where("location < 5").select(F.col("id").alias("node"))
    return gr.induced(_arcs(spark, sf_dir), keep).select("src", "dst")


@_q("renumbered_graph", "with n as (select node, row_number() over (order by node) - 1 as id from (select src as node from v_followers union select dst from v_followers) t) select x.id as src, y.id as dst from v_followers f join n x on x.node = f.src join n y on y.node = f.dst")
def renumbered_graph(spark, sf_dir):
    return gr.renumbered(_arcs(spark, sf_dir))


@_q("degree_centrality", f"with {DEG} select node, round(deg / cast((select count(*) from g) - 1 as double), 9) as value from g")
def degree_centrality(spark, sf_dir):
    d = gr.undirected_degrees(_edges(spark, sf_dir))
    n = d.count()
    return d.select("node", F.round(F.col("deg") / (n - 1) if n > 1 else F.lit(0.0), 9).alias("value"))


_TRI = f"{DEG}, t as (select x.a as p, x.b as q, y.b as r from v_edges x join v_edges y on x.b = y.a join v_edges z on z.a = x.a and z.b = y.b), c as (select node, count(*) as closed from (select p as node from t union all select q from t union all select r from t) u group by node), tr as (select g.node, g.deg, coalesce(c.closed, 0) as closed, cast(deg * (deg - 1) / 2 as bigint) as pairs from g left join c using (node))"


@_q("triads", f"with {_TRI} select node, closed, pairs - closed as open from tr")
def triads(spark, sf_dir):
    return gr.triads(_edges(spark, sf_dir)).select("node", "closed", "open")


@_q("triangle_total", f"with {_TRI} select cast(sum(closed) / 3 as bigint) as triangles, sum(pairs - closed) as open from tr")
def triangle_total(spark, sf_dir):
    return gr.triads(_edges(spark, sf_dir)).agg((F.sum("closed") / 3).cast("bigint").alias("triangles"), F.sum("open").alias("open"))


@_q("clustering", f"with {_TRI} select round(avg(case when pairs > 0 then closed / cast(pairs as double) else 0 end), 9) as clustering from tr")
def clustering(spark, sf_dir):
    return gr.triads(_edges(spark, sf_dir)).agg(F.round(F.avg("clustering"), 9).alias("clustering"))


@_q("clustering_by_degree", f"with {_TRI} select deg, round(avg(case when pairs > 0 then closed / cast(pairs as double) else 0 end), 9) as clustering from tr group by deg")
def clustering_by_degree(spark, sf_dir):
    return gr.triads(_edges(spark, sf_dir)).groupBy("deg").agg(F.round(F.avg("clustering"), 9).alias("clustering"))


@_q("triad_participation", f"with {_TRI} select closed as value, count(*) as freq from tr group by closed")
def triad_participation(spark, sf_dir):
    return ds.pdf(gr.triads(_edges(spark, sf_dir)), "closed")


@_q("edges_in_triangles", f"with {_TRI} select distinct a, b from (select p as a, q as b from t union all select q, r from t union all select p, r from t) u")
def edges_in_triangles(spark, sf_dir):
    t = gr.triangles(_edges(spark, sf_dir))
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return t.select(F.explode(F.array(pair("x", "y"), pair("y", "z"), pair("x", "z"))).alias("e")).select("e.*").distinct()


@_q("common_neighbours", f"with {S} select e.a, e.b, count(*) as common from v_edges e join s x on x.src = e.a join s y on y.src = e.b and y.dst = x.dst group by 1, 2")
def common_neighbours(spark, sf_dir):
    return gr.triangle_sides(materialize(_edges(spark, sf_dir), "edges")).withColumnRenamed("shared", "common")


@_q("two_step_paths", "select x.src as a, y.dst as b, count(*) as paths from v_followers x join v_followers y on x.dst = y.src where x.src <> y.dst group by 1, 2")
def two_step_paths(spark, sf_dir):
    arcs = materialize(_arcs(spark, sf_dir), "arcs")
    first = arcs.select(F.col("dst").alias("key"), F.col("src").alias("node"))
    return pr.pair_sums(first, arcs.select(F.col("src").alias("key"), F.col("dst").alias("node"))).toDF("a", "b", "paths")


@_q("group_triads", f"with {S}, t as (select x.a as p, x.b as q, y.b as r from v_edges x join v_edges y on x.b = y.a join v_edges z on z.a = x.a and z.b = y.b), c as (select p as node, q as y, r as z from t union all select q, p, r from t union all select r, p, q from t), n as (select node, cast(y % 3 = 0 as integer) + cast(z % 3 = 0 as integer) as k from c) select node, count(*) filter (where k = 2) as in_in, count(*) filter (where k = 1) as in_out, count(*) filter (where k = 0) as out_out from n group by node")
def group_triads(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return gr.group_triads(e, gr.nodes(gr.both_ways(e)).where("node % 3 = 0"))


@_q("constraint", f"with {S}, p as (select src, dst, 1.0 / count(*) over (partition by src) as p from s), v as (select src as i, dst as j, p as v from p union all select x.src, y.dst, x.p * y.p from p x join p y on x.dst = y.src where x.src <> y.dst), w as (select i, j, sum(v) as v from v group by 1, 2) select i as node, round(sum(v * v), 6) as value from w group by i")
def constraint(spark, sf_dir):
    return gr.constraint(_edges(spark, sf_dir)).select("node", F.round("value", 6).alias("value"))


#: distances by the recursion of a table keyed by its pair: a later row never replaces a nearer one
_BFS = f"with recursive {S}, b as (select distinct src as source, src as node, 0 as dist from s union select b.source, s.dst, b.dist + 1 from b join s on s.src = b.node where b.dist < 24 and not exists (select 1 from recurring.b k where k.source = b.source and k.node = s.dst)), d as (select source, node, min(dist) as dist from b group by source, node)"
#: the same from every twentieth id
_BFS_SOME = f"with recursive {S}, b as (select distinct src as source, src as node, 0 as dist from s where src % {EVERY} = 0 union select b.source, s.dst, b.dist + 1 from b join s on s.src = b.node where b.dist < 24 and not exists (select 1 from recurring.b k where k.source = b.source and k.node = s.dst)), d as (select source, node, min(dist) as dist from b group by source, node)"


@_q("bfs_hops", f"{_BFS} select source, node, dist from d")
def bfs_hops(spark, sf_dir):
    """From all nodes."""
    return se.distances(_edges(spark, sf_dir))


@_q("bfs_tree", f"{_BFS_SOME} select x.source, s.dst as node, s.src as pred from d x join s on s.src = x.node join d y on y.source = x.source and y.node = s.dst and y.dist = x.dist + 1")
def bfs_tree(spark, sf_dir):
    edges = materialize(_edges(spark, sf_dir), "edges")
    return se.predecessors(edges, _sources(gr.both_ways(edges)))


@_q("hop_histogram", f"{_BFS} select dist, count(*) as pairs from d group by dist")
def hop_histogram(spark, sf_dir):
    return se.hop_counts(_edges(spark, sf_dir))


@_q("subtree_size", f"{_BFS} select source, count(*) as size, max(dist) as depth from d group by source")
def subtree_size(spark, sf_dir):
    return se.source_counts(_edges(spark, sf_dir)).groupBy("source").agg(F.sum("nodes").alias("size"), F.max("dist").alias("depth"))


@_q("closeness", f"{_BFS} select source as node, round(avg(dist), 6) as farness, round(1 / avg(dist), 6) as closeness, max(dist) as eccentricity from d where dist > 0 group by source")
def closeness(spark, sf_dir):
    c = gr.closeness_of(se.source_counts(_edges(spark, sf_dir)))
    return c.select("node", F.round("farness", 6).alias("farness"), F.round("closeness", 6).alias("closeness"), "eccentricity")


@_q("eff_diameter", f"""{_BFS}, h as (select dist, count(*) as n from d group by dist), c as (select dist, sum(n) over (order by dist) as cum, sum(n) over () as total, sum(dist * n) over () as dp from h), l as (select *, lag(cum) over (order by dist) as prev from c)
 select round(min(case when cum >= 0.9 * total then case when prev is null then 1.0 else dist - 1 + (0.9 * total - prev) / (cum - prev) end end), 6) as effective, max(dist) as "full", round(max(dp / cast(total as double)), 6) as mean from l""")
def eff_diameter(spark, sf_dir):
    e = gr.effective_diameter_of(se.hop_counts(_edges(spark, sf_dir)))
    return e.select(F.round("effective", 6).alias("effective"), "full", F.round("mean", 6).alias("mean"))


#: least labels by rounds over all edges: labels only fall, so 24 rounds reach the end of any component here
_WCC = f"with recursive {S}, loops as (select src, dst from s union select src, src from s), l as (select distinct src as node, src as label, 0 as i from s union all select loops.dst, min(l.label), l.i + 1 from l join loops on loops.src = l.node where l.i < 24 group by loops.dst, l.i), m as (select node, label as component from l where i = 24)"


@_q("wcc", f"{_WCC} select component, count(*) as size from m group by component")
def wcc(spark, sf_dir):
    c = connected_components(_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return c.groupBy("component").agg(F.count("*").alias("size"))


@_q("wcc_sizes", f"{_WCC}, z as (select component, count(*) as size from m group by component) select size, count(*) as freq from z group by size")
def wcc_sizes(spark, sf_dir):
    return wcc(spark, sf_dir).groupBy("size").agg(F.count("*").alias("freq"))


@_q("wcc_largest", f"{_WCC}, z as (select component, count(*) as size from m group by component) select max(size) as largest, round(max(size) / cast(sum(size) as double), 9) as share, count(*) = 1 as connected from z")
def wcc_largest(spark, sf_dir):
    """Size and share of the largest weak component, and whether it is the only one."""
    return wcc(spark, sf_dir).agg(F.max("size").alias("largest"), F.round(F.max("size") / F.sum("size"), 9).alias("share"), (F.count("*") == 1).alias("connected"))


@_q("scc", "with recursive r as (select src, dst from v_followers union select r.src, f.dst from r join v_followers f on f.src = r.dst), n as (select src as node from v_followers union select dst from v_followers) select n.node, least(n.node, coalesce(min(x.dst), n.node)) as component from n left join (select x.src, x.dst from r x join r y on x.src = y.dst and x.dst = y.src) x on x.src = n.node group by n.node")
def scc(spark, sf_dir):
    return gr.strong_components(_arcs(spark, sf_dir))


#: core numbers as the fixed point of neighbours' h-indices, from the degrees down
_CORES = f"{DEG}, k(node, core, round) as (select node, deg, 0 from g union all select src, cast(sum(case when core >= r then 1 else 0 end) as bigint), any_value(round) + 1 from (select s.src, k.core, k.round, row_number() over (partition by s.src order by k.core desc) as r from k join s on s.dst = k.node where k.round < 100) t group by src), c as (select node, core from k where round = 100)"


@_q("kcore", f"with recursive {_CORES} select node, core from c")
def kcore(spark, sf_dir):
    return gr.core_numbers(_edges(spark, sf_dir))


@_q("kcore_sizes", f"with recursive {_CORES}, o as (select distinct core as k from c), e as (select least(x.core, y.core) as core from v_edges join c x on x.node = a join c y on y.node = b) select k, (select count(*) from c where core >= k) as nodes, (select count(*) from e where core >= k) as edges from o")
def kcore_sizes(spark, sf_dir):
    """Nodes and edges of the k-core of every order."""
    cores = gr.core_numbers(_edges(spark, sf_dir))
    e = _edges(spark, sf_dir).join(cores.select(F.col("node").alias("a"), F.col("core").alias("ca")), "a").join(cores.select(F.col("node").alias("b"), F.col("core").alias("cb")), "b")
    counts = cores.groupBy("core").agg(F.count("*").alias("n")).join(e.groupBy(F.least("ca", "cb").alias("core")).agg(F.count("*").alias("m")), "core", "left")
    over = Window.orderBy(F.col("core").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row for each core order
    return counts.select(F.col("core").alias("k"), F.sum("n").over(over).alias("nodes"), F.sum(F.coalesce("m", F.lit(0))).over(over).alias("edges"))


#: power iterations as recursions: every node has an edge of weight 0 to itself, which keeps its row and its last value
_PR = """with recursive n as (select src as node from v_followers union select dst from v_followers), k as (select count(*) as k from n), o as (select src, count(*) as o from v_followers group by src),
 w as (select f.src, f.dst, 1.0 / o.o as w, 0 as own from v_followers f join o on o.src = f.src union all select node, node, 0, 1 from n),
 r as (select node, 1.0 / k as rank, cast(1 as double) as moved, 0 as i from n, k
 union all select node, v + (1 - sum(v) over ()) / k, sum(abs(v + (1 - total) / k - old)) over (), i + 1 from (select *, sum(v) over () as total from (select w.dst as node, 0.85 * sum(r.rank * w.w) as v, sum(case when own = 1 then r.rank end) as old, r.i from r join w on w.src = r.node where r.moved >= 1e-4 and r.i < 100 group by w.dst, r.i) a) b, k),
 ranks as (select node, rank from r where i = (select max(i) from r))"""


@_q("pagerank_k", f"{_PR} select node, round(rank, 9) as rank from ranks")
def pagerank_k(spark, sf_dir):
    """Damping 0.85 until the ranks move less than 1e-4 in sum, or 100 rounds."""
    return gr.pagerank(_arcs(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


@_q("pagerank_developers", f"{_PR}, d as (select node, round(rank, 9) as r from ranks where node in (select author_id from v_commits)) select node, dense_rank() over (order by r desc) as place from d")
def pagerank_developers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ranks = gr.pagerank(_arcs(spark, sf_dir)).select("node", F.round("rank", 9).alias("r"))
    devs = ranks.join(t.v_commits.select(F.col("author_id").alias("node")), "node", "left_semi")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    values = materialize(devs.select("r").distinct().repartitionByRange(F.col("r").desc()).withColumn("part", F.spark_partition_id()), "places")
    starts = values.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("start"))  # a row for each range
    places = values.join(F.broadcast(starts), "part").select("r", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("r").desc()))).alias("place"))
    return devs.join(places, "r").select("node", "place")


_HITS = """with recursive n as (select src as node from v_followers union select dst from v_followers),
 x as (select src, dst, 1 as w from v_followers union all select node, node, 0 from n),
 r as (select node, cast(1 as double) as hub, cast(0 as double) as auth, 0 as i from n
 union all select node, case when norm > 0 then h / norm else 0 end, a, i + 1 from (select b.node, h, q.a, b.i, sqrt(sum(h * h) over ()) as norm from (select x.src as node, sum(x.w * a) as h, sum(case when x.src = x.dst and x.w = 0 then a end) as a, i from
 (select node, case when norm > 0 then g / norm else 0 end as a, i from (select x.dst as node, sum(x.w * r.hub) as g, r.i, sqrt(sum(sum(x.w * r.hub) * sum(x.w * r.hub)) over ()) as norm from r join x on x.src = r.node where r.i < 20 group by x.dst, r.i) c) q0 join x on x.dst = q0.node group by x.src, i) b, lateral (select b.a) q) d)"""


@_q("hits", f"{_HITS} select node, round(hub, 9) as hub, round(auth, 9) as auth from r where i = 20")
def hits(spark, sf_dir):
    h = gr.hits(_arcs(spark, sf_dir), rounds=20)
    return h.select("node", F.round("hub", 9).alias("hub"), F.round("auth", 9).alias("auth"))


_EIGEN = f"""with recursive {S}, x as (select src, dst, 1 as w from s union all select distinct src, src, 0 from s), k as (select count(distinct src) as k from s),
 r as (select distinct src as node, 1 / sqrt(k) as value, cast(1 as double) as moved, 0 as i from s, k
 union all select node, g / norm, sum(abs(g / norm - old)) over (), i + 1 from (select x.dst as node, sum(x.w * r.value) as g, sum(case when x.w = 0 then r.value end) as old, r.i, sqrt(sum(sum(x.w * r.value) * sum(x.w * r.value)) over ()) as norm from r join x on x.src = r.node where r.moved >= 1e-4 and r.i < 100 group by x.dst, r.i) c)"""


@_q("eigenvector_centrality", f"{_EIGEN} select node, round(value, 9) as value from r where i = (select max(i) from r)")
def eigenvector_centrality(spark, sf_dir):
    """Until the values move less than 1e-4 in sum, or 100 rounds."""
    return gr.eigenvector(_edges(spark, sf_dir)).withColumn("value", F.round("value", 9))


@_q("sparse_product", f"with {S} select s.src as node, cast(sum(s.dst % 7) as double) as value from s group by s.src")
def sparse_product(spark, sf_dir):
    s = gr.both_ways(_edges(spark, sf_dir)).withColumn("w", F.lit(1.0))
    return gr.product(s, gr.nodes(s).withColumn("value", (F.col("node") % 7).cast("double")))


@_q("modularity", f"""with {DEG}, m as (select count(*) as m from v_edges), i as (select u.location as grp, count(*) as inner_n from v_edges e join v_users u on u.id = e.a join v_users v on v.id = e.b and v.location = u.location group by 1),
 d as (select u.location as grp, sum(deg) as deg from g join v_users u on u.id = g.node group by 1) select d.grp as "group", coalesce(inner_n, 0) as "inner", deg - 2 * coalesce(inner_n, 0) as "outer", round((2 * coalesce(inner_n, 0) - deg * deg / (2.0 * m)) / (2.0 * m), 9) as q from d left join i using (grp), m""")
def modularity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = gr.modularity(t.v_edges, t.v_users.select(F.col("id").alias("node"), F.col("location").alias("group")))
    return m.withColumn("q", F.round("q", 9))


@_q("conductance", f"with {S} select count(*) filter (where src < 300 and dst >= 300) as cut, count(*) filter (where src < 300) as volume, round(count(*) filter (where src < 300 and dst >= 300) / cast(least(count(*) filter (where src < 300), count(*) filter (where src >= 300)) as double), 9) as conductance from s")
def conductance(spark, sf_dir):
    inside = gr.nodes(gr.both_ways(_edges(spark, sf_dir))).where("node < 300")
    return gr.conductance(_edges(spark, sf_dir), inside).withColumn("conductance", F.round("conductance", 9))


@_q("top_two_friends", "with p as (select x.user_id as src, y.user_id as dst, count(*) as w from v_bipartite x join v_bipartite y on x.repo_id = y.repo_id and x.user_id <> y.user_id group by 1, 2), r as (select *, row_number() over (partition by src order by w desc, dst) as rank from p) select src, dst, w, rank from r where rank <= 2")
def top_two_friends(spark, sf_dir):
    shared = Tables(spark, sf_dir).v_bipartite.select(F.col("repo_id").alias("key"), F.col("user_id").alias("node"))
    return gr.strongest(pr.pair_sums(shared, most=2).toDF("src", "dst", "w"), 2)


_TIMED = "tm as (select least(author_id, project_id + 2000) as a, greatest(author_id, project_id + 2000) as b, created_at as ts from v_commits)"


def _timed(spark, sf_dir):
    c = Tables(spark, sf_dir).v_commits
    return c.select(F.least("author_id", F.col("project_id") + 2000).alias("a"), F.greatest("author_id", F.col("project_id") + 2000).alias("b"), F.col("created_at").alias("ts"))


@_q("growth_basic", f"with {_TIMED}, e as (select a, b, min(date_trunc('month', ts)) as bucket from tm group by a, b), n as (select node, min(bucket) as bucket from (select a as node, bucket from e union all select b, bucket from e) u group by node), ec as (select bucket, count(*) as e from e group by 1), nc as (select bucket, count(*) as n from n group by 1) select cast(bucket as date) as bucket, sum(coalesce(n, 0)) over (order by bucket) as nodes, sum(e) over (order by bucket) as edges from ec left join nc using (bucket)")
def growth_basic(spark, sf_dir):
    return gr.growth(_timed(spark, sf_dir), F.to_date(F.date_trunc("month", F.col("ts"))))


@_q("node_first_time", f"with {_TIMED} select node, min(ts) as ts from (select a as node, ts from tm union all select b, ts from tm) t group by node")
def node_first_time(spark, sf_dir):
    return _timed(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("node"), "ts").groupBy("node").agg(F.min("ts").alias("ts"))


@_q("triad_closing_edges", "with t as (select least(src, dst) as a, greatest(src, dst) as b, cast((src * 31 + dst * 17) % 1000 as integer) as ts from v_followers where src <> dst), f as (select a, b, min(ts) as ts from t group by a, b), s as (select a as u, b as n, ts from f union all select b, a, ts from f), c as (select f.a, f.b, count(*) as shared from f join s x on x.u = f.a and x.ts < f.ts join s y on y.u = f.b and y.n = x.n and y.ts < f.ts group by 1, 2) select f.a, f.b, f.ts, coalesce(c.shared, 0) as shared from f left join c on c.a = f.a and c.b = f.b")
def triad_closing_edges(spark, sf_dir):
    e = _arcs(spark, sf_dir).where("src <> dst")
    timed = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), ((F.col("src") * 31 + F.col("dst") * 17) % 1000).cast("int").alias("ts"))
    return gr.triad_closing(timed)


@_q("commit_graph_degrees", "with d as (select commit_id, count(*) as n from v_commit_parents group by 1), c as (select parent_id, count(*) as children from v_commit_parents group by 1) select children as value, count(*) as freq from c group by 1")
def commit_graph_degrees(spark, sf_dir):
    return ds.count_of_counts(Tables(spark, sf_dir).v_commit_parents, "parent_id")


@_q("commit_leaves", "select c.id from v_commits c where c.id not in (select parent_id from v_commit_parents)")
def commit_leaves(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.v_commits.select("id").join(t.v_commit_parents.select(F.col("parent_id").alias("id")), "id", "left_anti")


@_q("commit_ancestors", "with recursive r as (select id, id as ancestor from v_commits where project_id = 3 union select r.id, p.parent_id from r join v_commit_parents p on p.commit_id = r.ancestor) select distinct ancestor as node from r")
def commit_ancestors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    start = t.v_commits.where("project_id = 3").select("id")
    up = t.v_commit_parents.select(F.col("commit_id").alias("src"), F.col("parent_id").alias("dst"), F.lit(1).alias("c"))
    return gr._reach(up, start.select(F.col("id").alias("node"), F.lit(1).alias("c"))).select("node")


@register("graph_grid", "select i * 10 + j as src, i * 10 + j + 1 as dst from range(0, 10) a(i), range(0, 9) b(j) union all select i * 10 + j, i * 10 + 10 + j from range(0, 9) a(i), range(0, 10) b(j)")
def graph_grid(spark, sf_dir):
    from strataloom.operators import generators as gn

    return gn.grid(spark, 10, 10)


@register("graph_shapes", """select 'star' as kind, 0 as src, i as dst from range(1, 20) t(i) union all select 'circle', i, (i + 1) % 20 from range(0, 20) t(i) union all select 'full', i, j from range(0, 6) a(i), range(0, 6) b(j) where i < j
 union all select 'tree', (i - 1) // 3, i from range(1, 40) t(i)""")
def graph_shapes(spark, sf_dir):
    from strataloom.operators import generators as gn

    kinds = {"star": gn.star(spark, 20), "circle": gn.circle(spark, 20), "full": gn.full(spark, 6), "tree": gn.tree(spark, 40, 3)}
    out = None
    for name, df in kinds.items():
        df = df.select(F.lit(name).alias("kind"), "src", "dst")
        out = df if out is None else out.unionAll(df)
    return out


@_q("graph_info", f"with {DEG} select (select count(*) from g) as nodes, (select count(*) from v_edges) as edges, (select count(*) from v_followers) as arcs, (select max(deg) from g) as max_deg, round(2.0 * (select count(*) from v_edges) / (select count(*) from g), 6) as mean_deg")
def graph_info(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = gr.undirected_degrees(t.v_edges).agg(F.count("*").alias("nodes"), F.max("deg").alias("max_deg"), F.sum("deg").alias("ends"))
    return d.crossJoin(t.v_followers.agg(F.count("*").alias("arcs"))).select("nodes", (F.col("ends") / 2).cast("bigint").alias("edges"), "arcs", "max_deg", F.round(F.col("ends") / F.col("nodes"), 6).alias("mean_deg"))  # one row each
