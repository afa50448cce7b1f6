import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom.operators import generators as gn
from strataloom.operators import graph as gr
from strataloom.operators import graph_blocks as gb
from strataloom.operators import graph_local as gl
from strataloom.operators import graph_stats as gs
from tests.test_graph import arcs, around, edges, some_graph


def test_motifs_by_enumeration(spark):
    pairs = some_graph(21, 16, 45)
    adj = around(pairs)
    kinds = Counter()
    names = {(3, 2): "path3", (3, 3): "triangle", (4, 6): "clique4", (4, 5): "diamond"}
    for size in (3, 4):
        for nodes in itertools.combinations(sorted(adj), size):
            inner = [p for p in itertools.combinations(nodes, 2) if p[1] in adj[p[0]]]
            deg = sorted(Counter(n for p in inner for n in p).values())
            seen, todo = {nodes[0]}, [nodes[0]]
            while todo:
                for m in adj[todo.pop()] & set(nodes) - seen:
                    seen.add(m)
                    todo.append(m)
            if len(seen) < size:
                continue
            if size == 4 and len(inner) == 3:
                kinds["star4" if deg[-1] == 3 else "path4"] += 1
            elif size == 4 and len(inner) == 4:
                kinds["tailed_triangle" if deg[-1] == 3 else "cycle4"] += 1
            else:
                kinds[names[size, len(inner)]] += 1
    got = {r.motif: r.n for r in gs.motifs(edges(spark, pairs)).collect()}
    assert {k: n for k, n in got.items() if n} == dict(kinds)


def test_personal_pagerank_and_sweeps(spark):
    pairs = some_graph(4, 30, 60)
    adj = around(pairs)
    e = edges(spark, pairs)
    seed = min(adj)
    got = {r.node: r.p for r in gs.personal_pagerank(e, spark.createDataFrame([(seed,)], "node bigint"), eps=1e-4).collect()}
    p, r = dict.fromkeys(adj, 0.0), dict.fromkeys(adj, 0.0)
    r[seed] = 1.0
    while any(r[n] >= 1e-4 * len(adj[n]) for n in adj):
        pushed = {n: r[n] for n in adj if r[n] >= 1e-4 * len(adj[n])}
        for n, q in pushed.items():
            p[n] += 0.15 * q
            r[n] -= q - 0.425 * q
            for m in adj[n]:
                r[m] += 0.425 * q / len(adj[n])
    assert got == pytest.approx({n: v for n, v in p.items() if v > 0}, rel=1e-6)
    rows = gs.sweep(e, spark.createDataFrame([(seed, n, v) for n, v in p.items() if v > 0], "seed bigint, node bigint, p double")).collect()
    order = sorted((n for n in p if p[n] > 0), key=lambda n: (-p[n] / len(adj[n]), n))
    for row in rows:
        inside = set(order[: row.size])
        cut = sum(1 for a, b in pairs if (a in inside) != (b in inside))
        assert row.cut == cut and row.volume == sum(len(adj[n]) for n in inside)
    profile = gs.community_profile(e, spark.createDataFrame([(seed,)], "node bigint"))
    assert profile.count() == profile.select("size").distinct().count() > 0


def test_whiskers_and_communities(spark):
    # a clique of five, a bridge to a triangle, a bridge to a leaf
    pairs = [*itertools.combinations(range(5), 2), (4, 10), (10, 11), (11, 12), (10, 12), (0, 20)]
    found = gs.whiskers(gb.biconnected(edges(spark, pairs))).collect()
    assert sorted((r.whisker, r.nodes, r.edges) for r in found) == [(10, 3, 3), (20, 1, 0)]  # trees hang on as well
    two = edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)])
    split = gl.edge_removal_communities(two).collect()
    assert {r.node: r.community for r in split} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4} and abs(split[0].q - 5 / 14) < 1e-9


def test_trees_edits_and_orders(spark):
    tree = arcs(spark, [(0, 1), (0, 2), (1, 3)])
    assert gs.tree_check(tree).first().is_tree
    assert not gs.tree_check(arcs(spark, [(0, 1), (2, 3), (3, 2)])).first().is_tree
    rows = gs.tree_signature(tree, spark.createDataFrame([(0,)], "node bigint")).collect()
    assert {(r.depth, r.children): r.nodes for r in rows} == {(0, 2): 1, (1, 1): 1, (1, 0): 1, (2, 0): 1}
    coloured = gs.with_attribute(tree, ["src", "dst"], "w", spark.createDataFrame([(0, 1, 5)], "src bigint, dst bigint, w int"), 0)
    again = gs.with_attribute(coloured, ["src", "dst"], "w", spark.createDataFrame([(0, 2, 7)], "src bigint, dst bigint, w int"), 9)
    assert {(r.src, r.dst): r.w for r in again.collect()} == {(0, 1): 5, (0, 2): 7, (1, 3): 0}
    assert gs.without_edges(tree, arcs(spark, [(0, 1), (7, 7)])).count() == 2
    order = {r.node: r.place for r in gs.acyclic_order(tree).collect()}
    assert sorted(order.values()) == [0, 1, 2, 3] and order[0] == 0


def test_links_are_learnt(spark):
    pairs = [p for k in range(6) for p in itertools.combinations(range(10 * k, 10 * k + 8), 2)] + [(10 * k, 10 * k + 10) for k in range(5)]
    rows, weights = gs.link_model(edges(spark, pairs))
    got = {(r.a, r.b): r.p for r in rows.collect()}
    inner = [p for e, p in got.items() if e[0] // 10 == e[1] // 10]
    assert min(inner) > 0.5 > max(p for e, p in got.items() if e[0] // 10 != e[1] // 10) and len(weights) == 3


def test_random_graphs_have_the_asked_degrees(spark):
    e = gn.random_bipartite(spark, 40, 10, 200)
    assert e.count() == 200 == e.distinct().count() and e.agg(F.max("dst")).first()[0] < 10
    deg = Counter(n for r in gn.regular(spark, 50, 4).collect() for n in (r.src, r.dst))
    assert set(deg.values()) == {4} and len(deg) == 50
    wanted = {r.node: r.deg for r in gn.power_law_degrees(spark, 300, 2.5).collect()}
    assert max(wanted.values()) > 10 and min(wanted.values()) == 1
    have = Counter(n for r in gn.configuration(gn.power_law_degrees(spark, 300, 2.5)).collect() for n in (r.src, r.dst))
    assert sum(wanted.values()) - sum(have.values()) in (0, 1) and all(have[n] <= d for n, d in wanted.items())
    some = arcs(spark, [(random.Random(k).randrange(20), random.Random(k + 99).randrange(20)) for k in range(60)]).distinct()
    assert sorted(gr.degrees(some).collect()) == sorted(gr.degrees(gn.rewired(some)).collect())
    assert sorted(some.collect()) != sorted(gn.rewired(some).collect())


def test_graphs_that_grow(spark):
    grown = gn.preferential_attachment(spark, 400, 3).collect()
    assert len(grown) == 1200 and all(0 <= r.dst <= r.src < 400 for r in grown)
    got = Counter(r.dst for r in grown)
    even = Counter(r.dst for r in gn.preferential_attachment(spark, 400, 3, copy=0.0).collect())
    assert max(got.values()) > 2 * max(even.values()) > 0
    fire = gn.forest_fire(spark, 100, 0.3, 0.3)
    assert fire.where("dst >= src").count() == 0 and fire.select("src").distinct().count() == 99
    ring = gn.small_world(spark, 60, 2, 0.0)
    assert ring.count() == 120 and ring.where("pmod(dst - src, 60) not in (1, 2)").count() == 0
    assert 0 < gn.small_world(spark, 60, 2, 0.3).where("pmod(dst - src, 60) not in (1, 2)").count() < 80
    assert gn.hierarchical(spark, 3, 2).count() == 12
    k = gn.stochastic_kronecker(spark, [[1.0, 0.0], [0.0, 0.0]], 5, 50)
    assert k.distinct().collect() == [(0, 0)]
    m = spark.createDataFrame([(n, n % 2) for n in range(20)], "node bigint, `group` bigint")
    assert gn.affiliation_graph(m, 1.0).count() == 2 * 45 and gn.affiliation_graph(m, 0.0).count() == 0


def test_epidemic_rates_are_found():
    start = (0.99, 0.01, 0.0)
    seen = [r[2] for r in gl.epidemic(0.8, 0.3, start, 150, euler=True)]
    beta, gamma = gl.epidemic_fit(seen, start, steps=1500)
    assert abs(beta - 0.8) < 0.1 and abs(gamma - 0.3) < 0.1
    last = gl.epidemic(0.5, 0.1, start, 3000, loss=0.05)[-1]
    assert abs(sum(last[1:]) - 1) < 1e-9 and last[2] > 0.05  # stays endemic


def test_paths_directions_and_diameters(spark):
    chain = arcs(spark, [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4)])
    one = spark.createDataFrame([(4,)], "node bigint")
    found = {d: sorted((r.node, r.dist) for r in gr.bfs(chain, one, direction=d).collect()) for d in ("out", "in", "both")}
    assert found["out"] == [(4, 0)] and found["in"] == [(1, 2), (2, 2), (3, 1), (4, 0), (5, 1)] and len(found["both"]) == 5
    assert sorted(r.dist for r in gr.bfs(chain, one, direction="in", most=1).collect()) == [0, 1, 1]
    start = spark.createDataFrame([(1,)], "node bigint")
    paths = {r.node: r.path for r in gr.random_paths(chain, gr.bfs(chain, start)).collect()}
    assert paths == {1: [1], 2: [1, 2], 3: [1, 2, 3], 5: [1, 5], 4: [1, 5, 4]}
    assert gr.diameter(edges(spark, [(1, 2), (2, 3), (3, 4)])) == 3
    with pytest.raises(ValueError, match="not connected"):
        gr.diameter(edges(spark, [(1, 2), (3, 4)]))


def test_spectrum_is_that_of_the_matrix(spark):
    import numpy as np

    pairs = some_graph(6, 14, 40)
    adj = np.zeros((14, 14))
    for a, b in pairs:
        adj[a, b] = adj[b, a] = 1
    values, vectors = np.linalg.eigh(adj)
    order = np.argsort(-np.abs(values))[:2]
    got = gr.spectrum(edges(spark, pairs), 2, rounds=80).orderBy("k").collect()
    assert [r.value for r in got] == pytest.approx(values[order], abs=1e-3)
    assert got[0].ipr == pytest.approx((vectors[:, order[0]] ** 4).sum(), abs=1e-3)


def test_signs_and_buckets(spark):
    signed = spark.createDataFrame([(1, 2, 1), (2, 3, -1), (1, 3, -1), (3, 4, 1), (1, 4, 1)], "a bigint, b bigint, sign int")
    got = {(r.a, r.b): (r.balance, r.predicted) for r in gs.sign_prediction(signed).collect()}
    assert got == {(1, 2): (1, 1), (2, 3): (-1, -1), (1, 3): (0, 0), (3, 4): (-1, -1), (1, 4): (-1, -1)}
    timed = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (3, 4, 9)], "a bigint, b bigint, ts bigint")
    assert {r.node: (r.ts, r.bucket) for r in gs.node_buckets(timed, 2).collect()} == {2: (1, 0), 3: (1, 0), 1: (5, 1), 4: (9, 1)}


def test_cliques_percolate_by_subsets(spark, monkeypatch):
    pairs = some_graph(31, 24, 170)
    cliques = gb.maximal_cliques(edges(spark, pairs)).localCheckpoint()
    sets = [set(r.clique) for r in cliques.collect() if len(r.clique) >= 4]
    groups: list[list[set]] = []
    for own in sets:
        near = [g for g in groups if any(len(own & other) >= 3 for other in g)]
        groups = [g for g in groups if g not in near] + [[own, *itertools.chain(*near)]]
    plain = sorted((min(set().union(*g)), len(set().union(*g)), n) for g in groups for n in set().union(*g))
    found = lambda **how: sorted((r.community, r.size, r.node) for r in gb.clique_communities(cliques, 4, **how).collect())
    assert max(map(len, sets)) > 4
    assert found(most=4) == plain  # larger cliques in pairs
    monkeypatch.setattr(gr, "split_join", None)  # no pairs of cliques at a node
    assert found() == plain


def test_pushes_move_no_arcs(spark, monkeypatch):
    plans, keep = [], gs.materialize
    monkeypatch.setattr(gs, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    e = edges(spark, some_graph(4, 30, 60))
    assert gs.personal_pagerank(e, gr.nodes(gr.both_ways(e)).where("node < 3"), eps=1e-4).count()
    pushes = [p for p in plans if "FullOuter" in p]
    assert pushes and all("InMemoryRelation" in p for p in pushes)


def test_link_model_shuffles_no_wedges(spark, monkeypatch):
    monkeypatch.setattr(gr, "split_join", None)
    pairs = some_graph(9, 16, 30)
    adj = around(pairs)
    rows, _ = gs.link_model(edges(spark, pairs), rounds=2)
    assert {(r.a, r.b): r.common for r in rows.collect()} == {(a, b): n for a in adj for b in adj if a < b and (n := len(set(adj[a]) & set(adj[b])))}
