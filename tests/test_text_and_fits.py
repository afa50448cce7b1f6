import math

from pyspark.sql import functions as F

from strataloom.functions import fit, lexing
from strataloom.functions import text as tx
from strataloom.operators import distribution as ds
from strataloom.operators import frequency as fr
from strataloom.operators import repository as rp
from strataloom.sources import text_sources as src
from strataloom.streaming import jobs


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, r"foo(a_1, \n é)", tx.tokens) == ["foo", "(", "a_1", ",", "\\n", "é", ")"]
    assert one(spark, "", tx.tokens) == []
    assert one(spark, None, tx.tokens) is None


def test_ngrams(spark):
    assert one(spark, "a b c d", lambda c: tx.ngrams(tx.tokens(c), 3)) == ["a:b:c", "b:c:d"]
    assert one(spark, "a", lambda c: tx.ngrams(tx.tokens(c), 3)) == []
    assert one(spark, "x=y.z@w", lambda c: tx.refined(c, 2)) == ["x.y", "y.z", "z.w"]


def test_names_and_messages(spark):
    assert one(spark, "src/a.b/c.py", tx.file_extension) == "py"
    assert one(spark, "dir.x/Makefile", tx.file_extension) == "Makefile"
    assert one(spark, "Fixes #12 and #7", tx.is_bug_fix) and not one(spark, "fix 12", tx.is_bug_fix)
    assert one(spark, "Fixes #12 and #7", tx.issue_numbers) == ["12", "7"]
    assert one(spark, "a.cc", tx.is_source_file) and not one(spark, "a.txt", tx.is_source_file)
    assert one(spark, "<p>Hi<script>x</script> there</p>", tx.html_text) == "Hi there"


def test_script_tokens():
    assert lexing.script_tokens("a == 1.5e-3 # no\n'str' + b") == ["a", "==", "1.5e-3", "'", "+", "b"]
    assert lexing.script_tokens("") == [] and lexing.script_tokens("'open") == ["'"]


def test_distribution_forms(spark):
    d = spark.createDataFrame([(1, 5), (3, 2), (6, 1)], "value bigint, freq bigint")
    assert [r.cum for r in ds.cumulative(d, descending=True).orderBy("value").collect()] == [8, 3, 1]
    assert [r.cum for r in ds.dense(d).orderBy("value").collect()] == [8, 3, 3, 1, 1, 1]
    assert ds.expanded(d).count() == 8
    m = ds.moments(d).first()
    assert m.n == 8 and m.mean == 17 / 8
    assert [r.freq for r in ds.difference(ds.cumulative(d).select("value", "cum")).orderBy("value").collect()] == [5, 2, 1]


def test_zipf_forms_agree(spark):
    counted = spark.createDataFrame([("x", f"t{k}", 1 + 1000 // (k + 1)) for k in range(400)], "g string, tok string, tf bigint")
    a = fit.zipf(counted, ["g"]).first()
    b = fit.zipf_from_counts(counted.groupBy("g", F.col("tf").alias("freq")).agg(F.count("*").alias("n")), ["g"]).first()
    assert abs(a.slope - b.slope) < 1e-12 and a.points == b.points


def test_special_functions(spark):
    assert abs(fit.chi_square_p(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(fit.chi_square_p(18.307038053275146, 10) - 0.05) < 1e-9
    rows = {(r.alpha, r.n): r.ratio for r in fit.gamma_ratio_curve(spark, [0.6, 1.3], 50).collect()}
    for (a, n), v in rows.items():
        assert abs(v - math.exp(math.lgamma(n - a + 1) - math.lgamma(n + 1))) < 1e-9 * max(1, v)


def test_heaps_forms_agree(spark):
    docs = spark.createDataFrame([(1, "g", "a b a"), (2, "g", ""), (5, "g", "b c d"), (7, "h", "a")], "doc_id bigint, g string, text string")
    by_doc = {(r.g, r.doc_id): (r.total, r.uniq) for r in fr.heaps_by_document(docs, "doc_id", ["g"]).collect()}
    assert by_doc == {("g", 1): (3, 2), ("g", 2): (3, 2), ("g", 5): (6, 4), ("h", 7): (1, 1)}
    by_tok = sorted((r.g, r.total, r.uniq) for r in fr.heaps_by_token(docs, "doc_id", ["g"]).collect())
    assert by_tok == [("g", 1, 1), ("g", 2, 2), ("g", 3, 2), ("g", 4, 2), ("g", 5, 3), ("g", 6, 4), ("h", 1, 1)]


def test_retractions(spark):
    c = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "a", -2), (4, "a", 1)], "seq bigint, tok string, delta bigint")
    assert [(r.uniq, r.total) for r in fr.vocabulary_with_retractions(c, "seq").orderBy("seq").collect()] == [(1, 2), (2, 3), (1, 1), (2, 2)]


def test_patch_counters(spark):
    patch = "@@ -1,3 +1,4 @@\n a\n+b\n+c\n-d\n\\ No newline\n+e"
    rows = rp.patch_lines(spark.createDataFrame([(1, patch)], "id int, patch string"), keys=["id"]).collect()
    assert sorted((r.kind, r.line_no) for r in rows) == [("+", 2), ("+", 3), ("+", 5), ("-", 2)]


def test_fork_roots(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 77)], "id bigint, forked_from bigint")
    assert {r.node: r.root for r in rp.fork_roots(p).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1\t2\nbad\n2\t3\n1\t2\n")
    assert src.read_edge_list(spark, f"{tmp_path}/e.txt").count() == 2
    (tmp_path / "w.txt").write_text("1\t2\t5\n1\t2\t9\n3\t4\n")
    assert {(r.src, r.weight) for r in src.read_edge_list(spark, f"{tmp_path}/w.txt", weighted=True).collect()} == {(1, 5), (3, 1)}
    (tmp_path / "a.txt").write_text("1 2 3\n4\n5 6\n")
    assert src.read_adjacency(spark, f"{tmp_path}/a.txt").count() == 3
    (tmp_path / "log").write_text("main s1 01/02/2013\nmain s2 01/03/2013 s1 s0\n")
    log = src.read_commit_log(spark, f"{tmp_path}/log")
    assert src.commit_edges(log).count() == 2 and log.count() == 2
    (tmp_path / "g.net").write_text('*Vertices 2\n1 "x"\n2 "y"\n*Edges\n1 2\n')
    v, e = src.read_pajek(spark, f"{tmp_path}/g.net")
    assert v.count() == 2 and e.count() == 1
    (tmp_path / "d.txt").write_text("1 5\nx y\n3 2\n")
    assert src.read_distribution(spark, f"{tmp_path}/d.txt").count() == 2
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.py").write_text("x = 1")
    assert src.read_tree(spark, f"{tmp_path}/code", {"py": "python"}).first().lang == "python"


def test_stream_equals_batch(spark):
    docs = spark.createDataFrame([(k, "a b " + "c" * (k % 3)) for k in range(20)], "doc_id bigint, text string")
    got = jobs.drain(jobs.token_counts(jobs.landed(docs)), "complete")
    assert {r.tok: r.tf for r in got.collect()} == {r.tok: r.tf for r in fr.token_rows(docs, []).groupBy("tok").agg(F.count("*").alias("tf")).collect()}
