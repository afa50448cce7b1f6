"""Queries on whole-graph statistics, growth over time, motifs, edits, local clusters and random graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.operators import generators as gn
from strataloom.operators import graph as gr
from strataloom.operators import graph_blocks as gb
from strataloom.operators import graph_local as gl
from strataloom.operators import graph_stats as gs
from strataloom.operators import repository as rp
from strataloom.operators.components import connected_components
from strataloom.plans.graph_queries import _WCC, DEG, EVERY, S, _arcs, _edges, _q
from strataloom.tables import Tables, oracle


@_q("graph_statistics", f"""{_WCC}, z as (select component, count(*) as size from m group by component), i as (select dst as node, count(*) as i from v_followers group by 1), o as (select src as node, count(*) as o from v_followers group by 1),
 d as (select coalesce(i, 0) as i, coalesce(o, 0) as o from i full outer join o using (node)), g as (select src as node, count(*) as deg from s group by src),
 t as (select x.a as p, x.b as q, y.b as r from v_edges x join v_edges y on x.b = y.a join v_edges z on z.a = x.a and z.b = y.b), c as (select node, count(*) as closed from (select p as node from t union all select q from t union all select r from t) u group by node),
 tr as (select deg, coalesce(closed, 0) as closed, deg * (deg - 1) // 2 as pairs from g left join c using (node))
 select (select count(*) from d) as nodes, (select count(*) from o) as src_nodes, (select count(*) from i) as dst_nodes, (select count(*) from d where i > 0 and o > 0) as both_nodes, (select max(o) from d) as max_out, (select max(i) from d) as max_in,
 (select count(*) from v_followers) as edges, (select count(*) from v_followers where src = dst) as self_edges, (select count(*) from v_edges) as unique_edges, (select count(*) from v_followers a join v_followers b on a.src = b.dst and a.dst = b.src where a.src <> a.dst) as reciprocal_edges,
 (select cast(sum(pairs - closed) as bigint) from tr) as open_triads, (select count(*) from t) as triangles, (select round(avg(case when pairs > 0 then closed / cast(pairs as double) else 0 end), 9) from tr) as clustering, (select count(*) from z) as wcc_count, (select max(size) from z) as wcc_nodes""")
def graph_statistics(spark, sf_dir):
    return gs.statistics(_arcs(spark, sf_dir)).withColumn("clustering", F.round("clustering", 9))


_FIRST = "f as (select least(src, dst) as a, greatest(src, dst) as b, min((src * 31 + dst * 17) % 1000 // 250) as bucket from v_followers where src <> dst group by 1, 2), k as (select unnest([0, 1, 2, 3]) as bucket), e as (select k.bucket, a, b from f join k on f.bucket <= k.bucket), s as (select bucket, a as src, b as dst from e union all select bucket, b, a from e), g as (select bucket, src as node, count(*) as deg from s group by 1, 2), t as (select x.bucket, x.a as p, x.b as q, y.b as r from e x join e y on x.b = y.a and x.bucket = y.bucket join e z on z.a = x.a and z.b = y.b and z.bucket = x.bucket), c as (select bucket, node, count(*) as closed from (select bucket, p as node from t union all select bucket, q from t union all select bucket, r from t) u group by 1, 2)"


@_q("graph_over_time", f"with {_FIRST}, tr as (select bucket, deg, coalesce(closed, 0) as closed, deg * (deg - 1) // 2 as pairs from g left join c using (bucket, node)) select bucket, count(*) as nodes, cast(sum(deg) // 2 as bigint) as edges, median(deg) as median_degree, cast(sum(closed) // 3 as bigint) as triangles, cast(sum(pairs - closed) as bigint) as open_triads, round(avg(case when pairs > 0 then closed / cast(pairs as double) else 0 end), 9) as clustering from tr group by bucket")
def graph_over_time(spark, sf_dir):
    """Growth, median degree and clustering of the graph up to each of four times."""
    timed = _arcs(spark, sf_dir).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), ((F.col("src") * 31 + F.col("dst") * 17) % 1000).alias("ts"))
    return gs.over_time(timed, F.floor(F.col("ts") / 250)).withColumn("clustering", F.round("clustering", 9))


_FORKS = "a as (select forked_from as src, id as dst from v_projects where forked_from is not null)"


def _forks(spark, sf_dir):
    return Tables(spark, sf_dir).v_projects.where("forked_from is not null").select(F.col("forked_from").alias("src"), F.col("id").alias("dst"))


@_q("tree_check", f"with recursive {_FORKS}, n as (select src as node from a union select dst from a), r as (select node, node as root from n where node not in (select dst from a) union all select a.dst, r.root from r join a on a.src = r.node) select (select count(*) from n) as nodes, (select count(*) from a) as edges, (select count(*) from n where node not in (select dst from a)) as roots, (select count(distinct root) = 1 from r) as is_tree")
def tree_check(spark, sf_dir):
    """Are the forks one tree? A project has one parent at most, so one root is enough."""
    return gs.tree_check(_forks(spark, sf_dir))


@_q("tree_signature", f"with recursive {_FORKS}, r as (select distinct src as source, src as node, 0 as depth from a where src not in (select dst from a) union all select r.source, a.dst, r.depth + 1 from r join a on a.src = r.node), k as (select src as node, count(*) as children from a group by src) select source, depth, coalesce(children, 0) as children, count(*) as nodes from r left join k using (node) group by 1, 2, 3")
def tree_signature(spark, sf_dir):
    arcs = _forks(spark, sf_dir)
    roots = arcs.select(F.col("src").alias("node")).distinct().join(arcs.select(F.col("dst").alias("node")), "node", "left_anti")
    return gs.tree_signature(arcs, roots)


@_q("random_node_subgraph", "with n as (select src as node from v_followers union select dst from v_followers), d as (select node from n order by md5(concat(node, '-1')) limit 200) select src, dst from v_followers where src in (select node from d) and dst in (select node from d)")
def random_node_subgraph(spark, sf_dir):
    """The subgraph of 200 nodes drawn by hash; drawing is the feature."""
    return gs.random_nodes(_arcs(spark, sf_dir), 200)


@_q("random_edge_subgraph", "select src, dst from v_followers order by md5(concat(src, '-', dst, '-1')) limit 500")
def random_edge_subgraph(spark, sf_dir):
    """500 edges drawn by hash; drawing is the feature."""
    return gs.random_edges(_arcs(spark, sf_dir), 500)


@_q("edge_data_subgraph", "select repo_id, user_id, weight from v_bipartite where weight >= 2")
def edge_data_subgraph(spark, sf_dir):
    """Edges whose datum compares as asked."""
    return Tables(spark, sf_dir).v_bipartite.where("weight >= 2")


@_q("graph_edits", "with e as (select src, dst from v_followers where src % 10 <> 0 and dst % 10 <> 0), m as (select src, dst from e union select src, src + 1 from e where src % 7 = 0) select src, dst, case when (src + dst) % 3 = 0 then 'red' else 'none' end as colour from m where not (src = dst)")
def graph_edits(spark, sf_dir):
    """Nodes deleted, edges added and deleted, an attribute with a default set on some edges."""
    arcs = _arcs(spark, sf_dir)
    left = gs.without_nodes(arcs, gr.nodes(arcs).where("node % 10 = 0"))
    more = gs.with_edges(left, left.where("src % 7 = 0").select("src", (F.col("src") + 1).alias("dst")))
    edited = gs.without_edges(more, more.where("src = dst"))
    red = edited.where("(src + dst) % 3 = 0").withColumn("colour", F.lit("red"))
    return gs.with_attribute(edited, ["src", "dst"], "colour", red, "none")


_MOTIFS = f"""with {DEG}, t as (select x.a as p, x.b as q, y.b as r from v_edges x join v_edges y on x.b = y.a join v_edges z on z.a = x.a and z.b = y.b), c as (select node, count(*) as closed from (select p as node from t union all select q from t union all select r from t) u group by node),
 sd as (select a, b, count(*) as n from (select p as a, q as b from t union all select q, r from t union all select p, r from t) u group by a, b), cn as (select x.dst as a, y.dst as b, count(*) as w from s x join s y on x.src = y.src and x.dst < y.dst group by 1, 2),
 k as (select sum(deg * (deg - 1) / 2) as wedges, sum(deg * (deg - 1) * (deg - 2) / 6) as stars, sum(coalesce(closed, 0) * (deg - 2)) as tailed from g left join c using (node)),
 u as (select wedges, stars, tailed, (select count(*) from t) as tri, (select sum((x.deg - 1) * (y.deg - 1)) from v_edges e join g x on x.node = e.a join g y on y.node = e.b) as paths, (select coalesce(sum(n * (n - 1) / 2), 0) from sd) as dia, (select coalesce(sum(w * (w - 1) / 2) / 2, 0) from cn) as cyc, (select count(*) from t join t t2 on t.p = t2.p and t.q = t2.q and t.r < t2.r join v_edges e on e.a = t.r and e.b = t2.r) as cl from k),
 r as (select 'path3' as motif, wedges - 3 * tri as n from u union all select 'triangle', tri from u union all select 'star4', stars - tailed + 2 * dia - 4 * cl from u union all select 'path4', paths - 3 * tri - 2 * tailed - 4 * cyc + 6 * dia - 12 * cl from u union all select 'tailed_triangle', tailed - 4 * dia + 12 * cl from u union all select 'cycle4', cyc - dia + 3 * cl from u union all select 'diamond', dia - 6 * cl from u union all select 'clique4', cl from u)"""


@_q("motifs", f"{_MOTIFS} select motif, cast(round(n) as bigint) as n from r")
def motifs(spark, sf_dir):
    """Connected induced subgraphs of three and four nodes by kind."""
    return gs.motifs(_edges(spark, sf_dir))


def _seeds(edges):
    return gr.nodes(gr.both_ways(edges)).where(F.col("node") % (25 * EVERY) == 0)


@register("personal_pagerank")
def personal_pagerank(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return gs.personal_pagerank(e, _seeds(e), eps=1e-5).withColumn("p", F.round("p", 9))


@register("community_profile")
def community_profile(spark, sf_dir):
    """The least conductance of each size over sweeps around seeds."""
    e = _edges(spark, sf_dir)
    return gs.community_profile(e, _seeds(e), eps=1e-5).withColumn("conductance", F.round("conductance", 9))


def _tight(spark, sf_dir):
    """Developers and the projects that they committed to twice or more, one graph."""
    w = Tables(spark, sf_dir).v_bipartite.where("weight >= 2")
    return w.select(F.col("user_id").alias("a"), (F.col("repo_id") + 1_000_000).alias("b"))


@register("graph_whiskers")
def graph_whiskers(spark, sf_dir):
    """What hangs on the core of developers and projects by one link."""
    return gs.whiskers(gb.biconnected(_tight(spark, sf_dir))).withColumn("conductance", F.round("conductance", 9))


@register("bag_of_whiskers")
def bag_of_whiskers(spark, sf_dir):
    """The unions of whiskers that are cut off best, by their number of nodes."""
    edges = _tight(spark, sf_dir)
    found = gs.whiskers(gb.biconnected(edges))
    parts = connected_components(edges.toDF("src", "dst"))
    largest = parts.groupBy("component").count().agg(F.max(F.struct("count", -F.col("component"))).alias("m"))  # one row
    total = 2 * edges.join(parts.withColumnRenamed("node", "a"), "a").join(F.broadcast(largest.select((-F.col("m.col2")).alias("component"))), "component", "left_semi").count()
    return gs.bag_of_whiskers(found, total).withColumn("conductance", F.round("conductance", 9))


@_q("cascade_sizes", f"with recursive p as (select src, dst from v_followers where (src * 31 + dst * 17) % 100 < 3), b as (select distinct src as source, src as node, 0 as dist from v_followers where src % {5 * EVERY} = 0 union select b.source, p.dst, b.dist + 1 from b join p on p.src = b.node where b.dist < 60 and not exists (select 1 from recurring.b k where k.source = b.source and k.node = p.dst)), d as (select source, node, min(dist) as dist from b group by 1, 2) select source, count(*) as size, max(dist) as depth from d group by source")
def cascade_sizes(spark, sf_dir):
    """What every hundredth node sets off if three in a hundred arcs pass it on."""
    arcs = _arcs(spark, sf_dir)
    seeds = arcs.select(F.col("src").alias("node")).distinct().where(F.col("node") % (5 * EVERY) == 0)
    return gs.cascades(arcs, seeds, (F.col("src") * 31 + F.col("dst") * 17) % 100 < 3)


@_q("acyclic_order", "with a as (select src, dst from v_followers where src <> dst), d as (select node, sum(i) - sum(o) as lack from (select src as node, 1 as o, 0 as i from a union all select dst, 0, 1 from a) t group by node) select node, row_number() over (order by lack, node) - 1 as place from d")
def acyclic_order(spark, sf_dir):
    return gs.acyclic_order(_arcs(spark, sf_dir))


@register("vote_statistics", oracle("with v as (select issue_id as candidate, actor_id as voter, arg_max(case when event in ('purchase', 'click') then 1 when event = 'error' then -1 else 0 end, (created_at, case when event in ('purchase', 'click') then 1 when event = 'error' then -1 else 0 end)) as vote, max(created_at) as ts from v_issue_events group by 1, 2) select candidate, count(*) as voters, count(*) filter (where vote > 0) as in_favour, count(*) filter (where vote < 0) as against, count(*) filter (where vote > 0) > count(*) filter (where vote < 0) as won, min(ts) as first_at, max(ts) as last_at from v group by candidate"))
def vote_statistics(spark, sf_dir):
    vote = F.when(F.col("event").isin("purchase", "click"), 1).when(F.col("event") == "error", -1).otherwise(0)
    return gs.vote_statistics(Tables(spark, sf_dir).v_issue_events, "issue_id", "actor_id", vote, "created_at")


@register("link_predictions")
def link_predictions(spark, sf_dir):
    """The chance of a link by shared neighbours, from a logistic regression over all pairs that have any."""
    return gs.link_model(_edges(spark, sf_dir))[0].select("a", "b", F.round("p", 6).alias("p"))


@register("edge_removal_communities")
def edge_removal_communities(spark, sf_dir):
    """Girvan and Newman over the projects' forks and their roots, a graph of the size the method is for."""
    return gl.edge_removal_communities(gr.undirected(_forks(spark, sf_dir)))


@register("fork_depths", oracle("with recursive r as (select id as node, 0 as depth from v_projects where forked_from is null or forked_from not in (select id from v_projects) union all select p.id, r.depth + 1 from r join v_projects p on p.forked_from = r.node) select depth, count(*) as projects from r group by depth"))
def fork_depths(spark, sf_dir):
    """How deep projects stand below the root of their forks."""
    t = Tables(spark, sf_dir)
    roots = rp.fork_roots(t.v_projects).where("node = root").select("node")
    return gr.bfs(_forks(spark, sf_dir), roots).groupBy(F.col("dist").alias("depth")).agg(F.count("*").alias("projects"))


def _degrees_of(edges):
    return gr.degrees(edges).groupBy("out_deg", "in_deg").agg(F.count("*").alias("nodes"))


#: random graphs by hash: no SQL draws the same; the tests hold their degrees and sizes
_RANDOM = {
    "random_bipartite_graph": lambda spark: gn.random_bipartite(spark, 200, 50, 1500),
    "regular_graph": lambda spark: gn.regular(spark, 300, 4),
    "power_law_graph": lambda spark: gn.configuration(gn.power_law_degrees(spark, 500, 2.5)),
    "attachment_graph": lambda spark: gn.preferential_attachment(spark, 500, 3),
    "copying_graph": lambda spark: gn.preferential_attachment(spark, 500, 3, copy=0.5),
    "geometric_graph": lambda spark: gn.geometric_attachment(spark, 500, 3),
    "small_world_graph": lambda spark: gn.small_world(spark, 400, 3, 0.1),
    "forest_fire_graph": lambda spark: gn.forest_fire(spark, 300, 0.3, 0.3),
    "stochastic_kronecker_graph": lambda spark: gn.stochastic_kronecker(spark, [[0.9, 0.5], [0.5, 0.2]], 9, 2000),
    "attribute_graph": lambda spark: gn.attribute_graph(spark, 200, 3, 0.4, [[0.9, 0.4], [0.4, 0.2]], 4000),
    "timed_attachment_graph": lambda spark: gn.timed_attachment(spark, 300, 2),
}
for _name, _make in _RANDOM.items():
    register(_name)(lambda spark, sf_dir, make=_make: make(spark))


@register("rewired_graph")
def rewired_graph(spark, sf_dir):
    """The followers with targets that changed places: degrees stay."""
    return gn.rewired(_arcs(spark, sf_dir))


@_q("rewired_degrees", "with i as (select dst as node, count(*) as in_deg from v_followers group by 1), o as (select src as node, count(*) as out_deg from v_followers group by 1), d as (select coalesce(in_deg, 0) as in_deg, coalesce(out_deg, 0) as out_deg from i full outer join o using (node)) select out_deg, in_deg, count(*) as nodes from d group by 1, 2")
def rewired_degrees(spark, sf_dir):
    return _degrees_of(gn.rewired(_arcs(spark, sf_dir)))


@register("graph_hierarchy", "select (i - 1) // 3 as src, i as dst from range(1, 40) t(i)")
def graph_hierarchy(spark, sf_dir):
    return gn.hierarchical(spark, 3, 3)


@register("affiliation_graph")
def affiliation_graph(spark, sf_dir):
    """Members of a repository linked by chance."""
    m = Tables(spark, sf_dir).v_project_members.select(F.col("user_id").alias("node"), F.col("repo_id").alias("group"))
    return gn.affiliation_graph(m, 0.05)


@register("sirs_epidemic")
def sirs_epidemic(spark, sf_dir):
    return spark.createDataFrame(gl.epidemic(0.5, 0.1, (0.99, 0.01, 0.0), 200, loss=0.05), "t double, s double, i double, r double")


@register("graph_spectrum")
def graph_spectrum(spark, sf_dir):
    """The three eigenvalues of greatest absolute value, with inverse participation ratios."""
    return gr.spectrum(_edges(spark, sf_dir), 3, rounds=30, eps=1e-5).select("k", F.round("value", 4).alias("value"), F.round("ipr", 6).alias("ipr"))


@register("shortest_paths")
def shortest_paths(spark, sf_dir):
    """One shortest path from the least node to every other."""
    s = gr.both_ways(_edges(spark, sf_dir))
    start = gr.nodes(s).agg(F.min("node").alias("node"))
    return gr.random_paths(s, gr.bfs(s, start)).select("node", F.array_join(F.transform("path", lambda n: n.cast("string")), "-").alias("path"))


@_q("hops_against_arcs", f"with recursive b as (select distinct dst as source, dst as node, 0 as dist from v_followers where dst % {EVERY} = 0 union select b.source, f.src, b.dist + 1 from b join v_followers f on f.dst = b.node where b.dist < 2 and not exists (select 1 from recurring.b k where k.source = b.source and k.node = f.src)) select source, node, min(dist) as dist from b group by 1, 2")
def hops_against_arcs(spark, sf_dir):
    """Who reaches every twentieth node in two hops at most."""
    arcs = _arcs(spark, sf_dir)
    return gr.bfs(arcs, arcs.select(F.col("dst").alias("node")).distinct().where(F.col("node") % EVERY == 0), direction="in", most=2)


@_q("sign_prediction", f"with e as (select a, b, case when (a + b) % 3 = 0 then -1 else 1 end as sign from v_edges), t as (select x.a as p, x.b as q, y.b as r, x.sign as s1, y.sign as s2, z.sign as s3 from e x join e y on x.b = y.a join e z on z.a = x.a and z.b = y.b), u as (select p as a, q as b, s1 as sign, s2 * s3 as v from t union all select q, r, s2, s1 * s3 from t union all select p, r, s3, s1 * s2 from t) select a, b, sign, cast(sum(v) as bigint) as balance, cast(sign(sum(v)) as integer) as predicted from u group by a, b, u.sign")
def sign_prediction(spark, sf_dir):
    """Each edge's sign and what the balance of its triangles says."""
    signed = _edges(spark, sf_dir).withColumn("sign", F.when((F.col("a") + F.col("b")) % 3 == 0, -1).otherwise(1))
    return gs.sign_prediction(signed)


@_q("node_buckets", "with tm as (select least(author_id, project_id + 2000) as a, greatest(author_id, project_id + 2000) as b, created_at as ts from v_commits), f as (select node, min(ts) as ts from (select a as node, ts from tm union all select b, ts from tm) u group by node) select node, ts, (row_number() over (order by ts, node) - 1) // 100 as bucket from f")
def node_buckets(spark, sf_dir):
    """Nodes of the growing graph, a hundred to a bucket."""
    c = Tables(spark, sf_dir).v_commits
    timed = c.select(F.least("author_id", F.col("project_id") + 2000).alias("a"), F.greatest("author_id", F.col("project_id") + 2000).alias("b"), F.col("created_at").alias("ts"))
    return gs.node_buckets(timed, 100)


@_q("graph_up_to", "select distinct author_id as src, project_id as dst from v_commits where created_at <= timestamp '1996-06-30'")
def graph_up_to(spark, sf_dir):
    """The graph as it stood at a time."""
    return Tables(spark, sf_dir).v_commits.where("created_at <= timestamp_ntz '1996-06-30 00:00:00'").select(F.col("author_id").alias("src"), F.col("project_id").alias("dst")).distinct()
