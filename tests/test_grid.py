from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import graph as gr
from strataloom.operators import grid
from tests.test_graph import around, edges, some_graph


def test_rounds_leave_the_arcs_where_they_are(spark):
    pairs = some_graph(41, 60, 300)
    g = grid.Grid(gr.both_ways(edges(spark, pairs)), least=4, most=200)
    state = g.start(F.col("node") * 1.0, F.lit(1.0))
    plan = g.arcs.groupBy("i").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and g.strips >= 4
    got = {r.node: (r.v0, r.v1) for r in g.values(g.product(state, np.array([[1.0, 0.0], [0.0, 2.0]])), k=2).collect()}
    g.close()
    assert got == {n: (sum(near), 2.0 * len(near)) for n, near in around(pairs).items()}


def test_cores_and_eigenvector_by_loops(spark):
    pairs = some_graph(42, 50, 160)
    adj, core, k = {n: set(near) for n, near in around(pairs).items()}, {}, 0
    while adj:
        n = min(adj, key=lambda v: len(adj[v]))
        k = max(k, len(adj[n]))
        core[n] = k
        for m in adj.pop(n):
            adj[m].discard(n)
    assert len(Counter(core.values())) > 2
    assert {r.node: r.core for r in gr.core_numbers(edges(spark, pairs)).collect()} == core
    adj = around(pairs)
    v = dict.fromkeys(adj, 1 / len(adj) ** 0.5)
    for _ in range(5):
        w = {n: sum(v[m] for m in adj[n]) for n in adj}
        size = sum(x * x for x in w.values()) ** 0.5
        v = {n: x / size for n, x in w.items()}
    assert {r.node: r.value for r in gr.eigenvector(edges(spark, pairs), 5, None).collect()} == pytest.approx(v)
    assert gr.eigenvector(edges(spark, [])).count() == 0


def test_spectrum_keeps_its_arcs_in_place(spark, monkeypatch):
    rounds, joins = [], []
    round_, join = grid.Grid.round, DataFrame.join
    monkeypatch.setattr(grid.Grid, "round", lambda self, *rest: rounds.append(1) or round_(self, *rest))
    monkeypatch.setattr(DataFrame, "join", lambda self, *rest, **more: joins.append(1) or join(self, *rest, **more))
    assert gr.spectrum(edges(spark, some_graph(43, 12, 30)), 2, rounds=3).count() == 2
    assert len(rounds) == 3 and len(joins) < 6  # to number and to deal, none a round
    assert gr.spectrum(edges(spark, []), 2).count() == 0


def test_triangles_at_each_node_by_strips(spark, monkeypatch):
    from itertools import combinations

    from strataloom.operators import corners

    pairs = some_graph(44, 40, 220)
    linked = {frozenset(p) for p in pairs}
    want = Counter(n for t in combinations(sorted({n for p in pairs for n in p}), 3) if all(frozenset(p) in linked for p in combinations(t, 2)) for n in t)
    assert {r.node: r.closed for r in corners.triangle_counts(edges(spark, pairs), most=20).collect()} == want
    assert corners.triangle_counts(edges(spark, [])).count() == 0
    monkeypatch.setattr(gr, "triangles", None)  # no wedges are laid out as rows
    assert {r.node: r.closed for r in gr.triads(edges(spark, pairs)).collect() if r.closed} == want
