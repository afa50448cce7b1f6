"""Readers and writers of the text forms: corpora, dictionaries, logs, edge lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as tx
from strataloom.operators.prefix import running_sums
from strataloom.session import materialize


def read_tree(spark: SparkSession, folder: str, languages: dict[str, str] | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """``(path, ext, lang, content)`` of all files below a folder, routed by extension; others have no language.

    ``only`` keeps the files of these extensions, before their contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = tx.file_extension(F.col("path"))
    if only:
        files = files.where(ext.isin(*only))
    rows = files.select("path", ext.alias("ext"), F.decode("content", "UTF-8").alias("content"))
    if not languages:
        return rows.withColumn("lang", F.lit(None).cast("string"))
    table = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return rows.withColumn("lang", table[F.col("ext")])


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """``(value, freq)`` of lines ``value freq``; malformed lines are left out."""
    # malformed fields read as null; the filter makes both columns be parsed even where a query needs neither
    return spark.read.schema("value double, freq long").option("sep", " ").csv(path).where("value is not null and freq is not null")


def write_dictionary(counted: DataFrame, path: str, tok: str = "tok", freq: str = "freq") -> None:
    """Tab-separated lines by ascending count, ties by token."""
    counted.orderBy(freq, tok).select(F.concat_ws("\t", F.col(tok), F.col(freq)).alias("value")).write.text(path)


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """``(branch, sha, commit_date, parents)`` of lines ``branch sha mm/dd/yyyy parent...``."""
    parts = F.split("value", " +")
    lines = spark.read.text(path).where(F.size(parts) >= 3)
    return lines.select(parts[0].alias("branch"), parts[1].alias("sha"), F.to_date(parts[2], "MM/dd/yyyy").alias("commit_date"), F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))).alias("parents"))


def commit_edges(log: DataFrame) -> DataFrame:
    """``(src, dst)`` parent -> child; commits without a parent give none."""
    return log.select(F.explode("parents").alias("src"), F.col("sha").alias("dst")).distinct()


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", weighted: bool = False) -> DataFrame:
    """``(src, dst[, weight])`` of lines; comments (#) and malformed lines are skipped, a missing weight is 1, of repeats the first counts."""
    kinds = "src long, dst long" + (", weight long" if weighted else "")
    e = spark.read.schema(kinds).option("sep", sep).option("comment", "#").csv(path).where("src is not null and dst is not null")
    if not weighted:
        return e.distinct()
    numbered = e.withColumn("weight", F.coalesce("weight", F.lit(1))).withColumn("at", F.monotonically_increasing_id())
    return numbered.groupBy("src", "dst").agg(F.min_by("weight", "at").alias("weight"))


def read_named_edges(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Edges between strings with dense ids, and the ids ``(name, id)`` in order of the names."""
    from strataloom.operators.graph import dense_ids, renumbered

    e = spark.read.schema("src string, dst string").option("sep", sep).option("comment", "#").csv(path).dropna()
    ids = dense_ids(e)
    return renumbered(e, ids), ids.withColumnRenamed("node", "name")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of lines ``node neighbour...``; comments (#) and fields that are no numbers are skipped."""
    return read_named_adjacency(spark, path).select(F.col("src").try_cast("long").alias("src"), F.col("dst").try_cast("long").alias("dst")).dropna().distinct()


def read_named_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of lines ``node neighbour...`` between strings; comments (#) are skipped."""
    parts = F.split(F.trim("value"), "[ \t]+")
    lines = spark.read.text(path).where("trim(value) <> '' and not trim(value) like '#%'")
    return lines.select(parts[0].alias("src"), F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("dst")).distinct()


def read_pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, label)`` and edges ``(src, dst)`` of a Pajek file. Sections are told apart by their line's form."""
    lines = spark.read.text(path).where("not value like '*%'")
    vertices = lines.select(F.regexp_extract("value", r'^\s*([0-9]+)\s+"([^"]*)"', 1).alias("id"), F.regexp_extract("value", r'"([^"]*)"', 1).alias("label")).where("id <> ''")
    edges = lines.where(F.col("value").rlike(r"^\s*[0-9]+\s+[0-9]+")).select(F.regexp_extract("value", r"^\s*([0-9]+)\s+([0-9]+)", 1).cast("long").alias("src"), F.regexp_extract("value", r"^\s*([0-9]+)\s+([0-9]+)", 2).cast("long").alias("dst"))
    return vertices.select(F.col("id").cast("long").alias("id"), "label"), edges


def write_edge_list(edges: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    """Lines ``src dst``, further columns after them; with ``header`` each part begins with a comment that names the columns."""
    columns = ["src", "dst", *(c for c in edges.columns if c not in ("src", "dst"))]
    line = edges.select(F.concat_ws(sep, *columns).alias("value"))
    if header:
        head = edges.sparkSession.createDataFrame([("# " + sep.join(columns),)], "value string")
        line = head.unionAll(line)
    line.write.text(path)


def write_dot(edges: DataFrame, path: str, directed: bool = True) -> None:
    """A DOT graph: its head, an edge a line, its end. The parts in the folder, put one after the other in order of their names, are the file."""
    arrow, kind = (" -> ", "digraph G {") if directed else (" -- ", "graph G {")
    lines = edges.select(F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("src"), F.lit(arrow), F.col("dst"), F.lit(";")).alias("value"))
    ends = edges.sparkSession.createDataFrame([(0, kind), (2, "}")], "part int, value string")
    ends.unionAll(lines).orderBy("part", "value").select("value").write.text(path)  # by ranges: no task sorts the whole


def write_matlab(edges: DataFrame, path: str) -> None:
    """Lines ``row column 1`` of a sparse matrix, counted from 1."""
    edges.select(F.concat_ws("\t", F.col("src") + 1, F.col("dst") + 1, F.lit(1)).alias("value")).write.text(path)


def write_pajek(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A Pajek file of vertices ``(id, label)`` and arcs ``(src, dst)``. The parts in the folder, put one after the other in order of their names, are the file."""
    spark = edges.sparkSession
    heads = spark.createDataFrame([(0, f"*Vertices {vertices.count()}"), (2, "*Arcs")], "part int, value string")
    rows = vertices.select(F.lit(1).alias("part"), F.concat(F.col("id"), F.lit(' "'), F.col("label"), F.lit('"')).alias("value"))
    arcs = edges.select(F.lit(3).alias("part"), F.concat_ws(" ", "src", "dst").alias("value"))
    heads.unionAll(rows).unionAll(arcs).orderBy("part", "value").select("value").write.text(path)  # by ranges: no task sorts the whole


#: what parts the fields of each kind of table
SEPARATORS = {"tab": "\t", "comma": ",", "semicolon": ";", "bar": r"\|", "space": " ", "white": r"[ \t]+"}


def read_separated(spark: SparkSession, path: str, kind: str, columns: list[str]) -> DataFrame:
    """Fields of lines, as strings; comments (#) and lines with fewer fields are skipped."""
    parts = F.split(F.trim("value") if kind == "white" else F.col("value"), SEPARATORS[kind])
    lines = spark.read.text(path).where("not value like '#%'").select(parts.alias("f")).where(F.size("f") >= len(columns))
    return lines.select(*(F.col("f")[k].alias(c) for k, c in enumerate(columns)))


def read_dynetml(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of the links or edges of DyNetML files."""
    out = None
    for tag in ("link", "edge"):
        rows = spark.read.format("xml").option("rowTag", tag).schema("_source string, _target string").load(path)
        rows = rows.select(F.col("_source").alias("src"), F.col("_target").alias("dst")).dropna()
        out = rows if out is None else out.unionAll(rows)
    return out.distinct()


def read_timed_edges(spark: SparkSession, path: str, kind: str = "tab", layout: str = "yyyy-MM-dd") -> DataFrame:
    """``(src, dst, ts)`` of lines ``src dst date``; malformed lines are skipped."""
    rows = read_separated(spark, path, kind, ["src", "dst", "at"])
    return rows.select(F.col("src").try_cast("long").alias("src"), F.col("dst").try_cast("long").alias("dst"), F.try_to_timestamp("at", F.lit(layout)).alias("ts")).dropna()


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of citation lists ``"citing","cited"`` whose first line names the columns, as patent offices publish them."""
    rows = read_separated(spark, path, "comma", ["src", "dst"])
    bare = lambda c: F.translate(c, '" ', "").try_cast("long").alias(c)
    return rows.select(bare("src"), bare("dst")).dropna().distinct()


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """``(item, user)`` of blocks ``Id: n`` followed by lines ``date cutomer|customer: user rating: ...``: each line goes with the block before it, within its file."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=Id:)")).alias("block"))
    item = F.regexp_extract("block", r"^\s*Id:\s*([0-9]+)", 1)
    users = F.regexp_extract_all("block", F.lit(r"cus?tomer:\s*(\S+)"), F.lit(1))
    return lines.select(item.try_cast("long").alias("item"), F.explode(users).alias("user")).dropna().distinct()


def write_corpus(docs: DataFrame, path: str, language: str = "lang") -> None:
    """A corpus in folders by language, so that a job on one language reads its own folder."""
    docs.write.partitionBy(language).parquet(path)


def reassembled(lines: DataFrame, order: str, value: str, header: str) -> DataFrame:
    """``(path, content)`` of documents laid out as lines in order, each begun by a line ``header`` + path.

    The number of headers up to a line names its document; ranges of lines are summed, so no task reads them all.
    """
    marked = lines.select(F.col(order).alias("at"), F.col(value).alias("value"), F.startswith(value, F.lit(header)).cast("int").alias("head"))
    numbered = running_sums(marked, [], "at", {"head": "doc"}).where("doc > 0")
    parts = numbered.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("l"))
    return parts.select(F.substring(F.col("l")[0]["value"], F.lit(len(header) + 1), F.length(F.col("l")[0]["value"])).alias("path"), F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["value"]), "\n").alias("content"))


def read_branch_log(spark: SparkSession, path: str) -> DataFrame:
    """``(branch, sha, parent)`` of lines ``branch sha date [parent]``; without a parent it is null."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where("size(p) >= 2")
    return lines.select(F.col("p")[0].alias("branch"), F.col("p")[1].alias("sha"), F.when(F.size("p") == 4, F.get("p", F.lit(3))).alias("parent"))


def read_pair_log(spark: SparkSession, path: str) -> DataFrame:
    """``(repo, user)``, each pair once, of lines ``repo user date``; both get a leading slash."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where("size(p) >= 2")
    return lines.select(F.concat(F.lit("/"), F.col("p")[0]).alias("repo"), F.concat(F.lit("/"), F.col("p")[1]).alias("user")).distinct()


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(paper, author)`` edges of a sparse matrix in lines ``row column value``, counted from 1; zeros are no edges."""
    m = read_separated(spark, path, "white", ["i", "j", "v"]).select(F.col("i").try_cast("long").alias("i"), F.col("j").try_cast("long").alias("j"), F.col("v").try_cast("double").alias("v")).dropna()
    return m.where("v <> 0").select(F.concat(F.lit("Paper"), F.col("i") - 1).alias("paper"), F.concat(F.lit("Author"), F.col("j") - 1).alias("author"))


def read_weighted_network(spark: SparkSession, path: str) -> DataFrame:
    """``(left, right, weight)`` of a saved bipartite network; a missing weight is 1."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(parts.alias("p")).where("size(p) >= 2")
    return lines.select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right"), F.coalesce(F.get("p", F.lit(2)).try_cast("long"), F.lit(1)).alias("weight"))


def read_blame_log(spark: SparkSession, path: str) -> DataFrame:
    """``(current_sha, introducing_sha, file, line_no, introducer, fixer)`` of lines with these fields between blanks; malformed lines are skipped."""
    layout = r"^(\S+)\s+(\S+)\s+(\S+)\s+([0-9]+)\s+(\S+)\s+(\S+)\s*$"
    names = ("current_sha", "introducing_sha", "file", "line_no", "introducer", "fixer")
    lines = spark.read.text(path).where(F.col("value").rlike(layout))
    return lines.select(*(F.regexp_extract("value", layout, k).cast("int" if n == "line_no" else "string").alias(n) for k, n in enumerate(names, 1)))


def last_page(exists: Callable[[int], bool], most: int = 1 << 30) -> int:
    """The last page that exists, if all before it do: doubling, then halving; 0 if there is none."""
    high = 1
    while high <= most and exists(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(middle) else (low, middle)
    return low


def crawl(links: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``(node, round)``: pages in the round that a breadth-first crawl from ``seeds(node)`` meets them; none is met twice."""
    arcs = links.select("src", "dst")
    visited = materialize(seeds.select("node", F.lit(0).alias("round")).distinct(), "crawl")
    frontier = visited
    for k in range(1, most_rounds + 1):
        found = frontier.select(F.col("node").alias("src")).join(arcs, "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(found.join(visited, "node", "left_anti").withColumn("round", F.lit(k)), "crawl")
        if not frontier.limit(1).count():
            return visited
        visited = materialize(visited.unionByName(frontier), "crawl")
    raise RuntimeError(f"pages are further than {most_rounds} rounds")


def page_links(pages: DataFrame, html: str = "html", keys: list[str] = ()) -> DataFrame:
    """``(*keys, href, label)`` of the links of stored pages, in whatever list, card or menu they stand."""
    tag = r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(tag), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(tag), F.lit(2)).alias("label"))
    return pages.select(*keys, F.explode(links).alias("l")).select(*keys, "l.href", "l.label")


def page_counters(pages: DataFrame, html: str = "html", keys: list[str] = ()) -> DataFrame:
    """``(*keys, language, title, headings, links, scripts, images)`` of stored pages."""
    count = lambda rx: F.size(F.regexp_extract_all(html, F.lit(rx), F.lit(0)))
    return pages.select(*keys, F.regexp_extract(html, r'<html[^>]* lang="([^"]*)"', 1).alias("language"), tx.xml_tag(F.col(html), "title").alias("title"), count("<h[1-6]").alias("headings"), count("<a ").alias("links"), count("<script").alias("scripts"), count("<img").alias("images"))


def parse_crawl_log(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(repo, user, weight)`` of ``repo:... user:... weight:...`` lines, renamed repositories by their new name; without a weight it is 1."""
    part = lambda k: F.regexp_extract("value", rf"\b{k}:(\S+)", 1)
    rows = lines.select(part("repo").alias("repo"), part("user").alias("user"), F.coalesce(part("weight").try_cast("long"), F.lit(1)).alias("weight")).where("repo <> '' and user <> ''")
    return rows.join(aliases, rows.repo == aliases.old, "left").select(F.coalesce("new", "repo").alias("repo"), "user", "weight")


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table over JDBC; filters and columns are pushed to the server."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def commit_documents(docs: DataFrame) -> DataFrame:
    """``(sha, actor, message, n_parents, filename, additions, deletions)`` of nested commit documents."""
    actor = tx.actor_name(F.col("committer.login"), F.col("author.login"), F.col("commit.committer.name"), F.col("commit.author.name"))
    rows = docs.select("sha", actor.alias("actor"), F.col("commit.message").alias("message"), F.size("parents").alias("n_parents"), F.explode_outer("files").alias("f"))
    return rows.select("sha", "actor", "message", "n_parents", "f.filename", "f.additions", "f.deletions")
