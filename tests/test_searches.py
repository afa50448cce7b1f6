"""Searches by blocks of sources against the plain ones, and the queries that are made of them over all sources."""

import random
from collections import Counter

import pytest

from strataloom.operators import graph as gr
from strataloom.operators import searches as se


@pytest.fixture(scope="module")
def parts(spark):
    """More than two words of sources, several components, and a hub with more neighbours than are asked first."""
    draw = random.Random(5)
    pairs = {tuple(sorted(draw.sample(range(220), 2))) for _ in range(260)} | {(300, k) for k in range(301, 401)} | {(k, k + 1) for k in range(301, 400)}
    edges = spark.createDataFrame(sorted(pairs), "a bigint, b bigint").cache()
    s = gr.both_ways(edges).cache()
    return edges, s


@pytest.mark.parametrize(("some", "words"), [(False, None), (True, 2)])
def test_blocks_of_sources(parts, some, words):
    edges, s = parts
    asked = gr.nodes(s).where("node % 2 = 0") if some else None
    plain = gr.bfs(s, gr.nodes(s) if asked is None else asked).cache()
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, se.distances(edges, asked, words).collect())) == want
    assert sorted(map(tuple, se.predecessors(edges, asked, words).collect())) == sorted(map(tuple, gr.bfs_predecessors(s, plain).collect()))
    assert Counter(dict(map(tuple, se.hop_counts(edges, asked, words).collect()))) == Counter(d for _, _, d in want)
    assert Counter({(r.source, r.dist): r.nodes for r in se.source_counts(edges, asked, words).collect()}) == Counter((a, d) for a, _, d in want)


def test_no_edges(parts):
    assert not se.distances(parts[0].where("a < 0")).collect()


def _edges(spark):
    from strataloom.tables import Tables

    return Tables(spark, "/root/testdata/sf0.001").v_edges


def every_node(spark):
    return gr.nodes(gr.both_ways(_edges(spark)))


def query(spark, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")


def test_bfs_hops_from_all(spark):
    assert query(spark, "bfs_hops").select("source").distinct().count() == every_node(spark).count()


def test_closeness_of_all(spark):
    assert query(spark, "closeness").count() == every_node(spark).count()


def test_hop_histogram_of_all(spark):
    assert {r.dist: r.pairs for r in query(spark, "hop_histogram").collect()}[0] == every_node(spark).count()


def test_subtree_size_of_all(spark):
    assert query(spark, "subtree_size").count() == every_node(spark).count()


def test_eff_diameter_of_all(spark):
    plain = gr.bfs(gr.both_ways(_edges(spark)), every_node(spark))
    assert abs(query(spark, "eff_diameter").first().mean - plain.agg({"dist": "avg"}).first()[0]) < 1e-6


def test_bfs_tree_stores_no_pairs(spark):
    from strataloom import session

    before = len(session._written)
    query(spark, "bfs_tree").count()
    assert not any("/bfs-" in path for path in session._written[before:])  # no table of distances for each hop


@pytest.mark.parametrize("some", [False, True])
def test_betweenness_by_sources(spark, monkeypatch, some):
    from strataloom.operators import graph_blocks as gb

    monkeypatch.setattr(se, "STRIP", 64)  # several strips
    draw = random.Random(5)
    e = spark.createDataFrame(sorted({tuple(sorted(draw.sample(range(50), 2))) for _ in range(90)} | {(100, 101), (101, 102)}), "a bigint, b bigint").cache()
    every = gr.nodes(gr.both_ways(e))
    asked = every.where("node % 3 = 0") if some else None
    node, edge = gb.betweenness(e, every if asked is None else asked)
    assert {r.node: r.value for r in se.betweenness(e, asked).collect()} == pytest.approx({r.node: r.value for r in node.collect()})
    want = pytest.approx({(r.a, r.b): r.value for r in edge.collect()})
    for groups in (None, 3):
        assert {(r.a, r.b): r.value for r in se.edge_betweenness(e, asked, groups).collect()} == want


def test_edge_betweenness_from_all(spark):
    s = gr.both_ways(_edges(spark))
    distances = gr.bfs(s, every_node(spark)).agg({"dist": "sum"}).first()[0]
    assert query(spark, "edge_betweenness").agg({"value": "sum"}).first()[0] == pytest.approx(distances)  # each pair's path has as many edges as its distance
