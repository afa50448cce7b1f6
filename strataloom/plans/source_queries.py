"""Queries that read and write the text forms: each writes a table as the form has it and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.session import shared_path
from strataloom.sources import text_sources as src
from strataloom.tables import Tables, oracle


def _q(name: str, sql: str):
    return register(name, oracle(sql))


def _path(spark, name):
    return shared_path(spark, f"form-{name}")


def _text(spark, df, name):
    path = _path(spark, name)
    df.write.text(path)
    return path


def _arcs(spark, sf_dir):
    return Tables(spark, sf_dir).v_followers.select("src", "dst")


@_q("io_edge_list", "select src, dst from v_followers")
def io_edge_list(spark, sf_dir):
    path = _path(spark, "edges")
    src.write_edge_list(_arcs(spark, sf_dir), path, header=True)
    return src.read_edge_list(spark, path)


@_q("io_weighted_edges", "select repo_id as src, user_id as dst, weight from v_bipartite")
def io_weighted_edges(spark, sf_dir):
    path = _path(spark, "weighted")
    src.write_edge_list(Tables(spark, sf_dir).v_bipartite.select(F.col("repo_id").alias("src"), F.col("user_id").alias("dst"), "weight"), path, header=True)
    return src.read_edge_list(spark, path, weighted=True)


@_q("io_named_edges", "with n as (select node, row_number() over (order by node) - 1 as id from (select concat('n', src) as node from v_followers union select concat('n', dst) from v_followers) t) select x.id as src, y.id as dst from v_followers f join n x on x.node = concat('n', f.src) join n y on y.node = concat('n', f.dst)")
def io_named_edges(spark, sf_dir):
    path = _path(spark, "named")
    src.write_edge_list(_arcs(spark, sf_dir).select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst")), path)
    return src.read_named_edges(spark, path)[0]


@_q("io_node_names", "select node as name, row_number() over (order by node) - 1 as id from (select concat('n', src) as node from v_followers union select concat('n', dst) from v_followers) t")
def io_node_names(spark, sf_dir):
    path = _path(spark, "named")
    src.write_edge_list(_arcs(spark, sf_dir).select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst")), path)
    return src.read_named_edges(spark, path)[1]


@_q("io_adjacency", "select src, dst from v_followers")
def io_adjacency(spark, sf_dir):
    """Neighbour lists, among them a comment and a line that is none."""
    lists = _arcs(spark, sf_dir).groupBy("src").agg(F.collect_list(F.col("dst").cast("string")).alias("d")).select(F.concat_ws(" ", F.col("src").cast("string"), F.array_join("d", " ")).alias("value"))
    odd = spark.createDataFrame([("# a comment",), ("no numbers here",)], "value string")
    return src.read_adjacency(spark, _text(spark, lists.unionAll(odd), "adjacency"))


@_q("io_pajek", "select src, dst from v_followers")
def io_pajek(spark, sf_dir):
    path, arcs = _path(spark, "pajek"), _arcs(spark, sf_dir)
    ids = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    src.write_pajek(ids.select("id", F.concat(F.lit("v"), "id").alias("label")), arcs, path)
    return src.read_pajek(spark, path)[1]


@_q("io_pajek_vertices", "select id, concat('v', id) as label from (select src as id from v_followers union select dst from v_followers) t")
def io_pajek_vertices(spark, sf_dir):
    path, arcs = _path(spark, "pajek"), _arcs(spark, sf_dir)
    ids = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    src.write_pajek(ids.select("id", F.concat(F.lit("v"), "id").alias("label")), arcs, path)
    return src.read_pajek(spark, path)[0]


@_q("io_matrix", "select concat('Paper', src) as paper, concat('Author', dst) as author from v_followers")
def io_matrix(spark, sf_dir):
    path = _path(spark, "matrix")
    src.write_matlab(_arcs(spark, sf_dir), path)
    return src.read_matrix(spark, path)


@_q("io_dot", "select (select count(*) from v_followers) + 2 as lines, (select count(*) from v_followers) as arrows")
def io_dot(spark, sf_dir):
    path = _path(spark, "dot")
    src.write_dot(_arcs(spark, sf_dir), path)
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(F.col("value").contains("->")).alias("arrows"))


@_q("io_separated", "select cast(r_regionkey as varchar) as key, r_name as name, kind from region, (select unnest(['tab', 'comma', 'semicolon', 'bar', 'white']) as kind) k")
def io_separated(spark, sf_dir):
    """The same table in each kind of separated values."""
    out, marks = None, {"tab": "\t", "comma": ",", "semicolon": ";", "bar": "|", "white": " \t "}
    for kind, mark in marks.items():
        lines = Tables(spark, sf_dir).region.select(F.concat_ws(mark, F.col("r_regionkey").cast("string"), F.translate("r_name", " ", "_")).alias("value"))
        part = src.read_separated(spark, _text(spark, lines, kind), kind, ["key", "name"]).select("key", F.regexp_replace("name", "_", " ").alias("name"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionAll(part)
    return out


@_q("io_dynetml", "select concat('a', r_regionkey) as src, r_name as dst from region")
def io_dynetml(spark, sf_dir):
    links = Tables(spark, sf_dir).region.select(F.concat(F.lit('  <link source="a'), F.col("r_regionkey"), F.lit('" target="'), F.col("r_name"), F.lit('" value="1"/>')).alias("l"))
    whole = links.agg(F.concat(F.lit("<DynamicNetwork><MetaMatrix><networks><network>\n"), F.array_join(F.collect_list("l"), "\n"), F.lit("\n</network></networks></MetaMatrix></DynamicNetwork>")).alias("value"))
    return src.read_dynetml(spark, _text(spark, whole, "dynetml"))


@_q("io_timed_edges", "select author_id as src, project_id as dst, date_trunc('day', created_at) as ts from v_commits")
def io_timed_edges(spark, sf_dir):
    c = Tables(spark, sf_dir).v_commits.select(F.col("author_id").alias("src"), F.col("project_id").alias("dst"), F.date_format("created_at", "yyyy-MM-dd").alias("at"))
    path = _path(spark, "timed")
    src.write_edge_list(c, path)
    return src.read_timed_edges(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_q("io_citations", "select src, dst from v_followers")
def io_citations(spark, sf_dir):
    lines = _arcs(spark, sf_dir).select(F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    head = spark.createDataFrame([('"CITING","CITED"',)], "value string")
    return src.read_citations(spark, _text(spark, head.unionAll(lines), "citations"))


@_q("io_reviews", "select repo_id as item, concat('A', user_id) as user from v_bipartite")
def io_reviews(spark, sf_dir):
    blocks = Tables(spark, sf_dir).v_bipartite.groupBy("repo_id").agg(F.collect_list(F.concat(F.lit("    2000-1-1  cutomer: A"), F.col("user_id"), F.lit("  rating: 5"))).alias("l"))
    lines = blocks.select(F.concat(F.lit("Id:   "), F.col("repo_id"), F.lit("\n  reviews:\n"), F.array_join("l", "\n"), F.lit("\n")).alias("value"))
    return src.read_reviews(spark, _text(spark, lines, "reviews"))


@_q("io_branch_log", "select concat('b', c.id % 3) as branch, cast(c.id as varchar) as sha, cast(p.parent_id as varchar) as parent from v_commits c left join v_commit_parents p on p.commit_id = c.id")
def io_branch_log(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.v_commits.join(t.v_commit_parents, F.col("commit_id") == F.col("id"), "left")
    lines = c.select(F.concat_ws(" ", F.concat(F.lit("b"), F.col("id") % 3), F.col("id").cast("string"), F.lit("01/02/2013"), F.col("parent_id").cast("string")).alias("value"))
    return src.read_branch_log(spark, _text(spark, lines, "branches"))


@_q("io_commit_log", "select concat('b', c.id % 3) as branch, cast(c.id as varchar) as sha, cast(c.created_at as date) as commit_date, case when p.parent_id is null then 0 else 1 end as n_parents from v_commits c left join v_commit_parents p on p.commit_id = c.id")
def io_commit_log(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.v_commits.join(t.v_commit_parents, F.col("commit_id") == F.col("id"), "left")
    lines = c.select(F.concat_ws(" ", F.concat(F.lit("b"), F.col("id") % 3), F.col("id").cast("string"), F.date_format("created_at", "MM/dd/yyyy"), F.col("parent_id").cast("string")).alias("value"))
    return src.read_commit_log(spark, _text(spark, lines, "commits")).select("branch", "sha", "commit_date", F.size("parents").alias("n_parents"))


@_q("io_pair_log", "select distinct concat('/r', project_id) as repo, concat('/u', author_id) as user from v_commits")
def io_pair_log(spark, sf_dir):
    lines = Tables(spark, sf_dir).v_commits.select(F.concat(F.lit("r"), "project_id", F.lit(" u"), "author_id", F.lit(" 2013-01-01")).alias("value"))
    return src.read_pair_log(spark, _text(spark, lines, "pairs"))


@_q("io_crawl_log", "select case when repo_id % 2 = 0 then concat('new', repo_id) else concat('r', repo_id) end as repo, concat('u', user_id) as user, case when user_id % 3 = 0 then 1 else weight end as weight from v_bipartite")
def io_crawl_log(spark, sf_dir):
    """Every third line has no weight; repositories of even number were renamed."""
    b = Tables(spark, sf_dir).v_bipartite
    weight = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" weight:"), F.col("weight")))
    lines = b.select(F.concat(F.lit("repo:r"), F.col("repo_id"), F.lit(" user:u"), F.col("user_id"), weight).alias("value"))
    aliases = b.where("repo_id % 2 = 0").select(F.concat(F.lit("r"), "repo_id").alias("old"), F.concat(F.lit("new"), "repo_id").alias("new")).distinct()
    return src.parse_crawl_log(spark.read.text(_text(spark, lines, "crawl")), aliases)


@_q("io_network", "select concat('Repos', repo_id) as left, concat('User', user_id) as right, weight from v_bipartite")
def io_network(spark, sf_dir):
    lines = Tables(spark, sf_dir).v_bipartite.select(F.concat_ws("\t", F.concat(F.lit("Repos"), "repo_id"), F.concat(F.lit("User"), "user_id"), F.col("weight").cast("string")).alias("value"))
    return src.read_weighted_network(spark, _text(spark, lines, "network"))


@_q("io_blame_log", "select cast(sha as varchar) as introducing_sha, cast(sha % 97 as integer) as line_no, concat('d', introducer) as introducer, concat('d', fixer) as fixer from v_bugs")
def io_blame_log(spark, sf_dir):
    b = Tables(spark, sf_dir).v_bugs
    lines = b.select(F.concat_ws(" ", F.lit("head"), F.col("sha").cast("string"), F.lit("a/b.py"), (F.col("sha") % 97).cast("string"), F.concat(F.lit("d"), "introducer"), F.concat(F.lit("d"), "fixer")).alias("value"))
    odd = spark.createDataFrame([("too few fields",)], "value string")
    return src.read_blame_log(spark, _text(spark, lines.unionAll(odd), "blame")).select("introducing_sha", "line_no", "introducer", "fixer")


@register("io_corpus", "select doc_id, lang, length(text) as chars from documents")
def io_corpus(spark, sf_dir):
    """The corpus in folders by language, read back."""
    path = _path(spark, "corpus")
    src.write_corpus(Tables(spark, sf_dir).documents.select("doc_id", "lang", "text"), path)
    return spark.read.parquet(path).select("doc_id", "lang", F.length("text").alias("chars"))


@register("io_reassembled", "select cast(doc_id as varchar) as path, text as content from documents")
def io_reassembled(spark, sf_dir):
    """Documents laid out as lines, each begun by a line with its path, put together again."""
    docs = Tables(spark, sf_dir).documents
    lines = docs.select("doc_id", F.posexplode(F.concat(F.array(F.concat(F.lit("file://"), F.col("doc_id"))), F.split("text", "\n"))).alias("k", "value"))
    return src.reassembled(lines.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("at"), "value"), "at", "value", "file://")


@register("html_links", """with l as (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as label from pages) select page_id, href, label, count(*) as n from l group by all""")
def html_links(spark, sf_dir):
    return src.page_links(Tables(spark, sf_dir).pages, "html", ["page_id"]).groupBy("page_id", "href", "label").agg(F.count("*").alias("n"))


@register("html_counters", """select page_id, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) as language, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '<h[1-6]', 0)) as headings,
 len(regexp_extract_all(html, '<a ', 0)) as links, len(regexp_extract_all(html, '<script', 0)) as scripts, len(regexp_extract_all(html, '<img', 0)) as images from pages""")
def html_counters(spark, sf_dir):
    return src.page_counters(Tables(spark, sf_dir).pages, "html", ["page_id"])


@_q("crawl_frontier", "with recursive b as (select src as node, 0 as round from v_followers where src = (select min(src) from v_followers) union select f.dst, b.round + 1 from b join v_followers f on f.src = b.node where b.round < 30 and not exists (select 1 from recurring.b k where k.node = f.dst)) select node, min(round) as round from b group by node")
def crawl_frontier(spark, sf_dir):
    arcs = _arcs(spark, sf_dir)
    return src.crawl(arcs, arcs.agg(F.min("src").alias("node")))


@_q("io_distribution", "select cast(n as double) as value, count(*) as freq from (select commit_id, count(*) as n from v_commit_files group by commit_id) t group by n")
def io_distribution(spark, sf_dir):
    from strataloom.operators import distribution as ds

    d = ds.count_of_counts(Tables(spark, sf_dir).v_commit_files, "commit_id")
    lines = d.select(F.concat_ws(" ", F.col("value").cast("string"), F.col("freq").cast("string")).alias("value"))
    odd = spark.createDataFrame([("no number",)], "value string")
    return src.read_distribution(spark, _text(spark, lines.unionAll(odd), "distribution"))


@_q("io_dictionary", "select lower(l_returnflag) as tok, count(*) as freq from lineitem group by 1")
def io_dictionary(spark, sf_dir):
    counted = Tables(spark, sf_dir).lineitem.groupBy(F.lower("l_returnflag").alias("tok")).agg(F.count("*").alias("freq"))
    path = _path(spark, "dictionary")
    src.write_dictionary(counted, path)
    return src.read_separated(spark, path, "tab", ["tok", "freq"]).select("tok", F.col("freq").cast("bigint").alias("freq"))


@_q("commit_document_lookup", "select cast(c.id as varchar) as sha, concat('u', c.author_id) as actor, f.filename, f.additions, f.deletions from v_commits c join v_commit_files f on f.commit_id = c.id where c.id in (7, 8, 9)")
def commit_document_lookup(spark, sf_dir):
    """Nested commit documents written as JSON, three of them looked up by their sha."""
    t = Tables(spark, sf_dir)
    files = t.v_commit_files.groupBy("commit_id").agg(F.collect_list(F.struct("filename", "additions", "deletions")).alias("files"))
    person = lambda login: F.struct(login.cast("string").alias("login"), F.lit(1).alias("id"))
    named = F.struct(F.lit("n").alias("name"), F.lit("e").alias("email"))
    docs = t.v_commits.join(files, F.col("commit_id") == F.col("id")).select(
        F.col("id").cast("string").alias("sha"),
        F.array(F.struct(F.lit("p").alias("sha"))).alias("parents"),
        person(F.concat(F.lit("u"), "author_id")).alias("author"),
        person(F.lit(None)).alias("committer"),
        F.struct(F.lit("m").alias("message"), named.alias("author"), named.alias("committer")).alias("commit"),
        "files",
    )
    path = _path(spark, "commit-documents")
    docs.write.json(path)
    stored = spark.read.schema(docs.schema).json(path)
    return src.commit_documents(stored.where(F.col("sha").isin("7", "8", "9"))).select("sha", "actor", "filename", "additions", "deletions")
