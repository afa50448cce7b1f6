"""Whiskers, rewiring, shapes and orders against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from strataloom.operators import generators as gn
from strataloom.operators import graph as gr
from strataloom.operators import graph_blocks as gb
from strataloom.operators import graph_stats as gs
from strataloom.operators import shapes as sh


def parts(nodes, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    left, out = set(nodes), []
    while left:
        found, front = set(), [min(left)]
        while front:
            n = front.pop()
            if n in left:
                left.discard(n)
                found.add(n)
                front += near[n]
        out.append(found)
    return out


def plain_whiskers(pairs):
    """Bridges by taking each edge out."""
    nodes = {n for p in pairs for n in p}
    whole = max(parts(nodes, pairs), key=lambda c: (len(c), -min(c)))
    inside = [p for p in pairs if p[0] in whole]
    bridges = [p for p in inside if len(parts(whole, [q for q in inside if q != p])) > 1]
    core = max(parts(whole, [p for p in inside if p not in bridges]), key=lambda c: (len(c), -min(c)))
    total, out = 2 * len(inside), []
    for c in parts(whole - core, [p for p in inside if not core & set(p)]):
        edges = sum(a in c and b in c for a, b in inside)
        out.append((min(c), len(c), edges, 2 * edges + 1, 1 / min(2 * edges + 1, total - 2 * edges - 1)))
    return sorted(out), total


def test_whiskers_and_their_bag(spark):
    draw = random.Random(3)
    pairs = {(a, b) for a, b in itertools.combinations(range(9), 2) if draw.random() < 0.6} | {(k, k + 1) for k in range(8)} | {(0, 8)}
    for k in range(9, 40):  # trees and small cycles that hang on somewhere
        pairs.add((draw.randrange(k), k))
    pairs |= {(12, 50), (50, 51), (12, 51), (3, 60), (60, 61), (61, 62), (60, 62)} | set(itertools.combinations(range(70, 75), 2))  # and a component apart
    found = gs.whiskers(gb.biconnected(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")))
    want, total = plain_whiskers(sorted(pairs))
    rows = sorted(map(tuple, found.collect()))
    assert [r[:4] for r in rows] == [w[:4] for w in want] and [r[4] for r in rows] == pytest.approx([w[4] for w in want]) and len(rows) > 5
    few = want[:12]
    got = {r.nodes: r for r in gs.bag_of_whiskers(spark.createDataFrame(few, found.schema), total, 20).collect()}
    best = {}
    for n in range(1, len(few) + 1):
        for some in itertools.combinations(few, n):
            size, volume = sum(w[1] for w in some), sum(w[3] for w in some)
            if size <= 20 and min(volume, total - volume) > 0:
                best[size] = min(best.get(size, (9,)), (n / min(volume, total - volume), n, volume))
    assert {n: (pytest.approx(r.conductance), r.whiskers, r.volume) for n, r in got.items()} == best


def test_rewired_graphs_are_simple(spark):
    draw = random.Random(1)
    pairs = {(draw.randrange(12), draw.randrange(12)) for _ in range(50)} | {(0, k) for k in range(1, 8)}
    df = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    got = [tuple(r) for r in gn.rewired(df).collect()]
    assert len(set(got)) == len(got) == len(pairs) and not [p for p in got if p[0] == p[1]]
    for end in (0, 1):
        assert Counter(p[end] for p in got) == Counter(p[end] for p in pairs)
    assert set(got) != pairs
    with pytest.raises(RuntimeError):  # no simple graph has these degrees
        gn.rewired(spark.createDataFrame([(1, 1)], "src bigint, dst bigint"), rounds=2).count()


def same_shape(one, two):
    a, b = sorted({n for p in one for n in p}), sorted({n for p in two for n in p})
    if (len(a), len(one)) != (len(b), len(two)):
        return False
    return any({(m[s], m[d]) for s, d in one} == two for m in (dict(zip(a, p, strict=True)) for p in itertools.permutations(b)))


def test_shapes_meet_exactly_if_the_graphs_do(spark):
    draw = random.Random(6)
    graphs = []
    for k in range(60):
        n = 2 + k % 5
        edges = {(a, draw.randrange(a)) for a in range(1, n)} | {(draw.randrange(n), draw.randrange(n)) for _ in range(k % 4)}
        graphs.append({(a, b) if k % 2 else (b, a) for a, b in edges if a != b})
    for g in list(graphs[:20]):  # the same under other names
        names = dict(zip(range(7), draw.sample(range(100, 200), 7), strict=True))
        graphs.append({(names[a], names[b]) for a, b in g})
    rows = [(k, a, b) for k, g in enumerate(graphs) for a, b in g]
    got = {r.graph: r for r in sh.shape_keys(spark.createDataFrame(rows, "graph bigint, src bigint, dst bigint").repartition(4)).collect()}
    for k, g in enumerate(graphs):
        assert (got[k].nodes, got[k].edges) == (len({n for p in g for n in p}), len(g))
    for k, m in itertools.combinations(range(len(graphs)), 2):
        assert (got[k].shape == got[m].shape) == same_shape(graphs[k], graphs[m]), (graphs[k], graphs[m])


def test_shapes_of_trees_of_any_size(spark):
    """Equal shapes exactly if the nested lists of children are equal."""
    draw = random.Random(8)
    trees = []
    for k in range(40):
        parent = {n: draw.randrange(max(0, n - 3), n) for n in range(1, 7 + k % 3)}
        trees.append([(p, n) for n, p in parent.items()])

    def nested(tree, root=0):
        return tuple(sorted(nested(tree, b) for a, b in tree if a == root))

    rows = [(k, 50 - a, 50 - b) for k, t in enumerate(trees) for a, b in t]
    got = {r.graph: r.shape for r in sh.shape_keys(spark.createDataFrame(rows, "graph bigint, src bigint, dst bigint")).collect()}
    for k, m in itertools.combinations(range(40), 2):
        assert (got[k] == got[m]) == (nested(trees[k]) == nested(trees[m]))


def forward(pairs, order):
    return sum(order[a] < order[b] for a, b in set(pairs) if a != b)


def test_orders_gain_in_every_round_and_solve_graphs_without_cycles(spark):
    draw = random.Random(2)
    dag = [(a, b) for a in range(20) for b in range(a + 1, 20) if draw.random() < 0.2]
    names = draw.sample(range(100), 20)
    df = spark.createDataFrame([(names[a], names[b]) for a, b in dag], "src bigint, dst bigint")
    assert sh.forward_edges(df, sh.peeled_order(df)) == len(dag)
    pairs = [(draw.randrange(30), draw.randrange(30)) for _ in range(160)] + [(30, 0), (31, 30), (5, 32)]
    arcs = spark.createDataFrame(pairs, "src bigint, dst bigint")
    start = sh.peeled_order(arcs)
    before = {r.node: r.place for r in start.collect()}
    assert sorted(before.values()) == list(range(len(before))) and before[31] == 0 and before[30] == 1 and before[32] == len(before) - 1
    assert sh.forward_edges(arcs, start) == forward(pairs, before) >= forward(pairs, {r.node: r.place for r in gs.acyclic_order(arcs).collect()})
    last = forward(pairs, before)
    order = start
    for k in range(3):
        order = sh.swapped_order(arcs, order, 1, seed=k)
        places = {r.node: r.place for r in order.collect()}
        assert sorted(places.values()) == sorted(before.values())
        now = forward(pairs, places)
        assert now >= last
        last = now
    assert last > forward(pairs, before)


def test_swaps_reach_the_best_order_of_seven_nodes(spark):
    draw = random.Random(4)
    pairs = [(a, b) for a, b in itertools.permutations(range(7), 2) if draw.random() < 0.4]
    arcs = spark.createDataFrame(pairs, "src bigint, dst bigint")
    best = max(forward(pairs, dict(zip(p, range(7), strict=True))) for p in itertools.permutations(range(7)))
    got = sh.forward_edges(arcs, sh.swapped_order(arcs, sh.peeled_order(arcs), 8))
    assert best - 1 <= got <= best


def test_nodes_of_self_edges_keep_their_place(spark):
    arcs = spark.createDataFrame([(1, 1), (2, 3)], "src bigint, dst bigint")
    assert {r.node for r in sh.peeled_order(arcs).collect()} == {1, 2, 3}
    assert gr.degrees(arcs).count() == 3


def test_rewiring_writes_all_edges_twice_only(spark, monkeypatch):
    draw = random.Random(2)
    pairs = sorted({(draw.randrange(60), draw.randrange(30)) for _ in range(700)})
    written, real = [], gn.materialize

    def counted(df, name):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(gn, "materialize", counted)
    got = [tuple(r) for r in gn.rewired(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()]
    assert len(set(got)) == len(got) == len(pairs) and not [p for p in got if p[0] == p[1]]
    assert written.count(len(pairs)) == 2 and len(written) > 10
