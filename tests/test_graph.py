import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import generators as gn
from strataloom.operators import graph as gr
from strataloom.operators import graph_blocks as gb
from strataloom.operators import graph_local as gl
from strataloom.operators.components import connected_components


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a bigint, b bigint")


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


@pytest.fixture(scope="module")
def house(spark):
    # a square 1-2-3-4 with one diagonal 1-3 and a tail 4-5-6
    return edges(spark, [(1, 2), (2, 3), (3, 4), (1, 4), (1, 3), (4, 5), (5, 6)]).cache()


def test_triads(spark, house):
    t = {r.node: (r.closed, r.open) for r in gr.triads(house).collect()}
    assert t == {1: (2, 1), 2: (1, 0), 3: (2, 1), 4: (1, 2), 5: (0, 1), 6: (0, 0)}
    assert gr.triangles(house).count() == 2


def test_sides_and_closing_by_triangles(spark):
    draw = random.Random(9)
    first = {tuple(sorted(draw.sample(range(24), 2))): draw.randrange(6) for _ in range(110)}
    near = {n: {x for e in first for x in e if n in e and x != n} for n in range(24)}
    at = lambda x, y: first[min(x, y), max(x, y)]
    e = edges(spark, list(first)).cache()
    assert {(r.a, r.b): r.shared for r in gr.triangle_sides(e).collect()} == {(a, b): len(near[a] & near[b]) for a, b in first if near[a] & near[b]}
    timed = spark.createDataFrame([(a, b, t) for (a, b), t in first.items()] + [(a, b, t + 3) for (a, b), t in first.items()], "a bigint, b bigint, ts int")
    got = {(r.a, r.b): (r.ts, r.shared) for r in gr.triad_closing(timed).collect()}
    assert got == {(a, b): (t, sum(at(a, n) < t and at(b, n) < t for n in near[a] & near[b])) for (a, b), t in first.items()}
    hub = edges(spark, [(0, k) for k in range(1, 1500)] + [(1, 2)])  # a hub's own pairs, a million, are never laid out
    assert sorted(map(tuple, gr.triangle_sides(hub).collect())) == [(0, 1, 1), (0, 2, 1), (1, 2, 1)]


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(200)]
    hub = [(1000, k) for k in range(1001, 1400)]
    got = {r.node: r.component for r in connected_components(arcs(spark, chain + hub + [(5000, 5000)])).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1400)} | {5000: 5000}
    assert connected_components(arcs(spark, [])).count() == 0


def test_strong_components(spark):
    e = arcs(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7)])
    assert {r.node: r.component for r in gr.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_cores(spark, house):
    assert {r.node: r.core for r in gr.core_numbers(house).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1}


def test_searches_in_words(spark):
    draw = random.Random(5)
    pairs = sorted({tuple(sorted(draw.sample(range(220), 2))) for _ in range(260)})  # more than two words of sources, several components
    s = gr.both_ways(edges(spark, pairs)).cache()
    sources = gr.nodes(s).where("node % 2 = 0")
    plain = gr.bfs(s, sources)
    words, place = gr.bfs_words(s, sources)
    rows = words.count()
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, gr.word_distances(words, place).collect())) == want
    assert rows < len(want) / 2  # not a row for each source and node
    assert sorted(map(tuple, gr.word_hop_counts(words).collect())) == sorted(map(tuple, gr.hop_counts(plain).collect()))
    assert Counter({(r.source, r.dist): r.nodes for r in gr.word_source_counts(words, place).collect()}) == Counter((a, d) for a, _, d in want)


def test_bfs_and_diameter(spark, house):
    s = gr.both_ways(house)
    d = gr.bfs(s, gr.nodes(s)).cache()
    assert d.where("source = 6").groupBy("dist").count().orderBy("dist").collect() == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 1)]
    assert gr.effective_diameter(d).first().full == 4
    assert gr.closeness(d).where("node = 4").first().eccentricity == 2
    assert gr.bfs_predecessors(s, d).where("source = 1 and node = 6").first().pred == 5


def test_pagerank_sums_to_one(spark):
    e = arcs(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)])
    assert abs(gr.pagerank(e).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    h = gr.hits(e, 10).agg(F.sum(F.col("hub") * F.col("hub")), F.sum(F.col("auth") * F.col("auth"))).first()
    assert np.allclose(h, 1)


def test_blocks_and_bridges(spark, house):
    b = gb.biconnected(house)
    assert {(r.a, r.b) for r in b.where("bridge").collect()} == {(4, 5), (5, 6)}
    assert {r.node for r in gb.articulation_points(b).collect()} == {4, 5}


def some_graph(seed, n, m):
    draw = random.Random(seed)
    return sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(m)})


def around(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def reached(adj, start, without=()):
    seen, todo = {start}, [start]
    while todo:
        for n in adj[todo.pop()]:
            if n not in seen and n not in without:
                seen.add(n)
                todo.append(n)
    return seen


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 40, 45), (2, 30, 60), (3, 25, 24)])
def test_blocks_by_their_definition(spark, seed, n, m):
    pairs = some_graph(seed, n, m)
    got = {(r.a, r.b): (r.block, r.bridge) for r in gb.biconnected(edges(spark, pairs)).collect()}
    assert sorted(got) == pairs
    adj = around(pairs)
    # two edges at a node are in one block if their other ends still reach each other without the node
    label = {e: e for e in pairs}
    for v in adj:
        at = [tuple(sorted((v, x))) for x in sorted(adj[v])]
        for x in sorted(adj[v]):
            for y in reached(adj, x, {v}) & adj[v]:
                one, two = sorted((label[tuple(sorted((v, x)))], label[tuple(sorted((v, y)))]))
                label = {e: one if g == two else g for e, g in label.items()}
        assert at
    size = Counter(label.values())
    assert got == {e: (f"{g[0]}-{g[1]}", size[g] == 1) for e, g in label.items()}


def test_cliques_betweenness_and_communities(spark, house):
    assert sorted(r.clique for r in gb.maximal_cliques(house).collect()) == [[1, 2, 3], [1, 3, 4]]
    pairs = some_graph(5, 24, 110)
    adj = around(pairs)
    every = [set(c) for k in range(2, 8) for c in itertools.combinations(sorted(adj), k) if all(y in adj[x] for x, y in itertools.combinations(c, 2))] if len(adj) < 25 else []
    maximal = [sorted(c) for c in every if len(c) > 2 and not any(c <= adj[n] for n in adj)]
    assert sorted(r.clique for r in gb.maximal_cliques(edges(spark, pairs)).collect()) == sorted(maximal)
    node, edge = gb.betweenness(house, gr.nodes(gr.both_ways(house)))
    value = {r.node: r.value for r in node.collect()}
    assert value[6] == 0 and value[5] == 4 and value[4] == 6
    assert {(r.a, r.b): r.value for r in edge.collect()}[5, 6] == 10
    plain = dict.fromkeys(adj, 0.0)
    for s, t in itertools.combinations(sorted(adj), 2):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            seen = {n for p in paths for n in p}
            paths = [[*p, n] for p in paths for n in adj[p[-1]] if n not in seen]
        paths = [p for p in paths if p[-1] == t]
        for p in paths:
            for n in p[1:-1]:
                plain[n] += 1 / len(paths)
    e = edges(spark, pairs)
    got = {r.node: r.value for r in gb.betweenness(e, gr.nodes(gr.both_ways(e)))[0].collect()}
    assert got == pytest.approx(plain)
    two = edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)])
    assert {r.node: r.community for r in gl.greedy_communities(two).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    rings = edges(spark, [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5), (5, 6), (5, 7), (6, 7)])
    found = gb.clique_communities(gb.maximal_cliques(rings), 3).collect()
    assert sorted((r.community, r.size, r.node) for r in found) == [(1, 4, 1), (1, 4, 2), (1, 4, 3), (1, 4, 4), (5, 3, 5), (5, 3, 6), (5, 3, 7)]


def test_components_and_cores_by_loops(spark):
    draw = random.Random(9)
    pairs = sorted({(draw.randrange(40), draw.randrange(40)) for _ in range(70)})
    adj = {n: {b for a, b in pairs if a == n} for n in range(40)}
    used = {n for p in pairs for n in p}
    reach = {n: reached(adj, n) for n in used}
    expected = {n: min(m for m in reach[n] if n in reach[m]) for n in used}
    assert {r.node: r.component for r in gr.strong_components(arcs(spark, pairs)).collect()} == expected
    graph = some_graph(11, 40, 120)
    left, core, k = around(graph), {}, 0
    while left:
        low = min(map(len, left.values()))
        k = max(k, low)
        for n in [n for n, v in left.items() if len(v) <= k]:
            core[n] = k
            for m in left.pop(n):
                left[m].discard(n)
            break
    assert {r.node: r.core for r in gr.core_numbers(edges(spark, graph)).collect()} == core


def test_hubs_are_cut_and_lose_nothing(spark):
    left = spark.createDataFrame([(k % 3, k) for k in range(300)], "key bigint, x bigint")
    right = spark.createDataFrame([(k % 4, k) for k in range(200)], "key bigint, y bigint")
    whole = sorted(map(tuple, left.join(right, "key").collect()))
    assert sorted(map(tuple, gr.split_join(left, right, "key", block=7).select("key", "x", "y").collect())) == whole


def test_empty_graphs(spark):
    none = arcs(spark, [])
    assert gr.pagerank(none).count() == 0 and gr.strong_components(none).count() == 0 and gr.core_numbers(edges(spark, [])).count() == 0
    assert gb.biconnected(edges(spark, [])).count() == 0 and gb.maximal_cliques(edges(spark, [])).count() == 0


def test_sketches_are_close(spark):
    e = gn.circle(spark, 200)
    got = {r.hop: r.pairs for r in gl.neighbourhood_function(e, 3).collect()}
    assert got[0] == 200 and abs(got[3] - 800) < 20


def test_generators(spark):
    assert gn.grid(spark, 3, 4).count() == 17 and gn.star(spark, 5).count() == 4 and gn.full(spark, 5).count() == 10 and gn.tree(spark, 7, 2).count() == 6
    g = gn.random_edges(spark, 100, 300)
    assert g.count() == 300 == g.distinct().count() and g.where("a >= b").count() == 0
    assert gn.rmat(spark, 5, 100).where("src > 31 or dst > 31").count() == 0


def test_factors(spark):
    draw = np.random.default_rng(1)
    v = draw.random((60, 2)) @ draw.random((2, 5))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(60, None)], "id bigint, v array<double>").repartition(3)
    w, h = gl.factorise(rows, "id", "v", 2, rounds=60)
    found = {(r.id, r.k): r.w for r in w.collect()}
    own = np.array([[found[i, k] for k in range(2)] for i in range(60)])
    assert len(found) == 120 and own.min() >= 0 and h.min() >= 0 and np.abs(own @ h - v).max() < 0.05


def test_epidemic():
    s, i, r = gl.epidemic(0.5, 0.1, (0.99, 0.01, 0.0), 500)[-1][1:]
    assert abs(s + i + r - 1) < 1e-9 and s < 0.1
