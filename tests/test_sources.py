"""Readers on the lines that break a plain parser."""

import pytest

from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.sources import text_sources as src


@pytest.fixture
def written(tmp_path):
    def write(text):
        (tmp_path / "x.txt").write_text(text)
        return str(tmp_path / "x.txt")

    return write


def test_malformed_lines_are_skipped(spark, written):
    assert sorted(src.read_adjacency(spark, written("# head\n1 2 3\n4 x 5\nbad line\n\n2\n")).collect()) == [(1, 2), (1, 3), (4, 5)]
    assert sorted(src.read_named_adjacency(spark, written("a b c\n# no\n")).collect()) == [("a", "b"), ("a", "c")]
    lines = spark.createDataFrame([("repo:r1 user:u1 weight:3",), ("repo:r1 user:u2",), ("repo:r2 user:u2 weight:x",), ("nothing",)], "value string")
    aliases = spark.createDataFrame([("r2", "r9")], "old string, new string")
    assert sorted(map(tuple, src.parse_crawl_log(lines, aliases).collect())) == [("r1", "u1", 3), ("r1", "u2", 1), ("r9", "u2", 1)]
    rows = src.read_blame_log(spark, written("c i f.py 3 a b\nc i f.py three a b\n")).collect()
    assert [tuple(r) for r in rows] == [("c", "i", "f.py", 3, "a", "b")]
    assert sorted(map(tuple, src.read_branch_log(spark, written("m s1 d p1\nm s2 d\n\n")).collect()), key=str) == [("m", "s1", "p1"), ("m", "s2", None)]
    assert sorted(map(tuple, src.read_weighted_network(spark, written("a\tb\t2\na\tc\nx\n")).collect())) == [("a", "b", 2), ("a", "c", 1)]
    assert src.read_timed_edges(spark, written("1\t2\t2020-01-02\n1\tx\t2020-01-02\n1\t2\tnever\n")).count() == 1
    assert sorted(map(tuple, src.read_matrix(spark, written("1 1 1\n2 3 0\n2 4 0.5\nx\n")).collect())) == [("Paper0", "Author0"), ("Paper1", "Author3")]


def test_names_keep_their_ids(spark, written):
    edges, names = src.read_named_edges(spark, written("b\ta\nc\tb\n# x\ty\n"))
    ids = {r.name: r.id for r in names.collect()}
    assert ids == {"a": 0, "b": 1, "c": 2}
    assert sorted(map(tuple, edges.collect())) == [(1, 0), (2, 1)]


def test_documents_from_lines(spark):
    lines = [(1, "lost"), (2, "## a"), (3, "x"), (4, "y"), (5, "## b"), (6, "## c"), (7, "z")]
    rows = src.reassembled(spark.createDataFrame(lines, "at bigint, value string"), "at", "value", "## ").collect()
    assert sorted(map(tuple, rows)) == [("a", "x\ny"), ("b", ""), ("c", "z")]


def test_last_page():
    for last in (0, 1, 2, 3, 7, 8, 100):
        asked = []
        assert src.last_page(lambda k, last=last, asked=asked: asked.append(k) or k <= last) == last
        assert len(asked) <= 2 * max(1, last).bit_length() + 2


def test_crawl_meets_each_page_once(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (9, 1)], "src bigint, dst bigint")
    got = src.crawl(links, spark.createDataFrame([(1,), (1,)], "node bigint")).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_normal_urls(spark):
    urls = ["http://www.X.com/a/?q=1", "https://x.com/a//", "x.com#f", "http://x.com/a/b?c/", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(tx.normal_url(tx.F.col("u")).alias("n")).collect()
    assert [r.n for r in rows] == ["x.com/a", "x.com/a", "x.com", "x.com/a/b", None]


def test_dot_and_pajek_are_whole_files(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    src.write_dot(e, f"{tmp_path}/dot")
    assert [r.value for r in spark.read.text(f"{tmp_path}/dot").collect()] == ["digraph G {", "  1 -> 2;", "  2 -> 3;", "}"]
    src.write_pajek(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, label string"), e, f"{tmp_path}/net")
    vertices, arcs = src.read_pajek(spark, f"{tmp_path}/net")
    assert sorted(map(tuple, vertices.collect())) == [(1, "a"), (2, "b"), (3, "c")] and sorted(map(tuple, arcs.collect())) == [(1, 2), (2, 3)]


def test_dot_and_pajek_are_sorted_by_ranges(spark, tmp_path):
    e = spark.range(3000).select("id", (F.col("id") + 1).alias("dst")).toDF("src", "dst")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with much data
    try:
        src.write_dot(e, f"{tmp_path}/dot")
        src.write_pajek(spark.range(3001).select("id", F.concat(F.lit("v"), "id").alias("label")), e, f"{tmp_path}/net")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for name, first, last in (("dot", "digraph G {", "}"), ("net", "*Vertices 3001", "999 1000")):
        parts = sorted((tmp_path / name).glob("part-*"))
        lines = "".join(p.read_text() for p in parts).splitlines()
        assert sum(p.stat().st_size > 0 for p in parts) > 1 and (lines[0], lines[-1]) == (first, last)
    assert src.read_pajek(spark, f"{tmp_path}/net")[0].count() == 3001 and src.read_pajek(spark, f"{tmp_path}/net")[1].count() == 3000
