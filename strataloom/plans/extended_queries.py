"""Queries on streams, syntax classes, and graph algorithms without an SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.functions import lexing
from strataloom.functions import text as tx
from strataloom.operators import generators as gn
from strataloom.operators import graph as gr
from strataloom.operators import graph_blocks as gb
from strataloom.operators import graph_local as gl
from strataloom.operators import pairs as pr
from strataloom.operators import searches as se
from strataloom.plans.graph_queries import EVERY, S, _arcs, _edges
from strataloom.session import materialize
from strataloom.streaming import jobs
from strataloom.tables import Tables, oracle

RX = tx.TOKEN.replace("'", "''")
TOK = f"toks as (select lang, unnest(regexp_extract_all(trim(text), '{RX}', 0)) as tok from documents)"


def _stream(spark, sf_dir, name, batches=4):
    """A table as a stream of so many batches, each of a file for every task that can run at once: a file alone would be one task's."""
    width = spark.sparkContext.defaultParallelism
    return jobs.landed(getattr(Tables(spark, sf_dir), name), batches * width, width)


@register("stream_token_counts", f"with {TOK} select tok, count(*) as tf from toks group by tok")
def stream_token_counts(spark, sf_dir):
    return jobs.drain(jobs.token_counts(_stream(spark, sf_dir, "documents")), "complete")


@register("stream_vocab_growth", f"with {TOK} select lang, count(*) as total, count(distinct tok) as uniq from toks group by lang")
def stream_vocab_growth(spark, sf_dir):
    """Where the growth of each language stands after the last batch."""
    g = jobs.growth(_stream(spark, sf_dir, "documents"), "lang")
    return g.groupBy("lang").agg(F.max_by("all_total", "batch").alias("total"), F.max_by("all_uniq", "batch").alias("uniq"))


@register("stream_growth_curve", f"with t as (select coalesce(lang, '') as lang, doc_id, unnest(regexp_extract_all(trim(text), '{RX}', 0)) as tok from documents), n as (select coalesce(lang, '') as lang, doc_id, coalesce(len(regexp_extract_all(trim(text), '{RX}', 0)), 0) as n from documents), f as (select lang, doc_id, count(*) as fresh from (select lang, tok, min(doc_id) as doc_id from t group by lang, tok) x group by lang, doc_id) select n.lang, n.doc_id, cast(sum(n) over w as bigint) as total, cast(sum(coalesce(fresh, 0)) over w as bigint) as uniq from n left join f on f.lang = n.lang and f.doc_id = n.doc_id window w as (partition by n.lang order by n.doc_id)")
def stream_growth_curve(spark, sf_dir):
    """Vocabulary growth document by document: four batches, in order of doc_id, each with state of what came before only."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "lang", "text")
    folder = jobs.landed_in_order(docs, "doc_id", 4)
    found, sizes = jobs.growth_by_document(folder, "lang", "doc_id")
    return jobs.growth_curve(jobs.drain(found, "append"), jobs.drain(sizes, "append")).toDF("lang", "doc_id", "total", "uniq")


@register("stream_retractions", f"with t as (select doc_id, unnest(regexp_extract_all(trim(text), '{RX}', 0)) as tok from documents) select count(*) as total, count(distinct tok) as uniq from t where doc_id % 3 <> 0")
def stream_retractions(spark, sf_dir):
    """Every document comes, every third is taken away again: what is left after the last batch."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text", F.lit(1).alias("delta"))
    taken = docs.where("doc_id % 3 = 0").withColumn("delta", F.lit(-1))
    rows = jobs.landed(docs.unionAll(taken), 5).select(F.lit("all").alias("by"), F.explode(tx.tokens(F.col("text"))).alias("tok"), "delta")
    g = jobs.changes(rows)
    return g.agg(F.max_by("all_total", "batch").alias("total"), F.max_by("all_uniq", "batch").alias("uniq"))


@register("stream_ngram_counts", f"with t as (select doc_id, unnest(regexp_extract_all(trim(text), '{RX}', 0)) as tok, unnest(range(0, len(regexp_extract_all(trim(text), '{RX}', 0)))) as pos from documents), g as (select concat_ws(':', tok, lead(tok) over w) as ngram, lead(tok) over w as nxt from t window w as (partition by doc_id order by pos)) select ngram, count(*) as freq from g where nxt is not null group by ngram")
def stream_ngram_counts(spark, sf_dir):
    return jobs.drain_counts(jobs.ngrams(_stream(spark, sf_dir, "documents"), 2), "ngram", "freq")


@register("stream_arrival_gap", "with g as (select user_id, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts) as gap from events) select user_id as key, count(*) as gaps, round(sum(gap), 3) as total_gap from g where gap is not null group by user_id")
def stream_arrival_gap(spark, sf_dir):
    """One file a batch, in no order of time; a last row far ahead in time closes the stream."""
    events = Tables(spark, sf_dir).events.select("user_id", "ts")
    closing = spark.createDataFrame([(None,)], "user_id bigint").select("user_id", F.lit("2100-01-01 00:00:00").cast(events.schema["ts"].dataType).alias("ts"))
    rows = jobs.drain(jobs.arrival_gaps(jobs.landed(events, 4, 1, closing), "user_id", "ts", "400 days"), "append")
    return rows.where("key is not null").groupBy("key").agg(F.count("*").alias("gaps"), F.round(F.sum("gap_seconds"), 3).alias("total_gap"))


@register("window_counts", "select date_trunc('hour', ts) as start, count(*) as n from events group by 1")
def window_counts(spark, sf_dir):
    rows = jobs.drain(jobs.tumbling_counts(_stream(spark, sf_dir, "events"), "ts"), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("session_counts", "with m as (select user_id, ts, case when epoch(ts) - lag(epoch(ts)) over w > 1800 or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, fresh desc rows unbounded preceding) as k from m) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def session_counts(spark, sf_dir):
    rows = jobs.session_counts(Tables(spark, sf_dir).events, "user_id", "ts")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("time_buckets", oracle("select date_trunc('year', created_at)::date as year, date_trunc('month', created_at)::date as month, date_trunc('week', created_at)::date + 3 as week, created_at::date as day, hour(created_at) as hour, minute(created_at) // 10 as ten_minutes, count(*) as n from v_issue_events group by all"))
def time_buckets(spark, sf_dir):
    t = F.col("created_at").cast("timestamp")
    e = Tables(spark, sf_dir).v_issue_events
    units = [F.to_date(F.date_trunc("year", t)).alias("year"), F.to_date(F.date_trunc("month", t)).alias("month"), F.date_add(F.to_date(F.date_trunc("week", t)), 3).alias("week")]
    units += [F.to_date(t).alias("day"), F.hour(t).alias("hour"), F.floor(F.minute(t) / 10).alias("ten_minutes")]
    return e.groupBy(*units).agg(F.count("*").alias("n"))


@register("script_token_freq")
def script_token_freq(spark, sf_dir):
    toks = lexing.tokenise_scripts(Tables(spark, sf_dir).documents, "doc_id", "text")
    return toks.groupBy("tok").agg(F.count("*").alias("tf"), F.countDistinct("id").alias("df"))


def _lexed(spark, sf_dir):
    """Every document lexed as one of the languages, by turns."""
    names = F.array(*map(F.lit, lexing.LEXERS))
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text", F.get(names, (F.col("doc_id") % len(lexing.LEXERS)).cast("int")).alias("language"))
    return lexing.lexed(docs, "doc_id", "text", "language")


def lexed_class_freq(spark, sf_dir):
    return _lexed(spark, sf_dir).groupBy("language", "tok_class").agg(F.count("*").alias("freq"), F.countDistinct("id").alias("n_files"))


def lexed_class_split(spark, sf_dir):
    """Different and all tokens of comments, literals, programs and programs with operators, cut again by the naive tokenizer."""
    return lexing.class_group_counts(lexing.resplit(_lexed(spark, sf_dir)))


def lexed_reserved_ratio(spark, sf_dir):
    """Keywords and names as a share of all tokens."""
    n = lexed_class_split(spark, sf_dir).groupBy("language").pivot("group", ["all", "program"]).agg(F.first("uniq").alias("uniq"), F.first("total").alias("total"))
    return n.select("language", F.round(F.col("program_uniq") / F.col("all_uniq"), 6).alias("ratio_uniq"), F.round(F.col("program_total") / F.col("all_total"), 6).alias("ratio_total"))


if lexing.can_lex():
    for _query in (lexed_class_freq, lexed_class_split, lexed_reserved_ratio):
        register(_query.__name__)(_query)


@register("biconnected_blocks")
def biconnected_blocks(spark, sf_dir):
    return gb.biconnected(_edges(spark, sf_dir))


@register("articulation_points")
def articulation_points(spark, sf_dir):
    """Of the projects and their forks: the follower graph has none."""
    forks = Tables(spark, sf_dir).v_projects.where("forked_from is not null").select(F.col("forked_from").alias("src"), F.col("id").alias("dst"))
    return gb.articulation_points(gb.biconnected(gr.undirected(forks)))


@register("betweenness")
def betweenness(spark, sf_dir):
    """Of all nodes, from every twentieth as a source."""
    e = materialize(_edges(spark, sf_dir), "edges")
    return se.betweenness(e, gr.nodes(gr.both_ways(e)).where(F.col("node") % EVERY == 0)).withColumn("value", F.round("value", 6))


@register("edge_betweenness")
def edge_betweenness(spark, sf_dir):
    """From all nodes as sources."""
    return se.edge_betweenness(materialize(_edges(spark, sf_dir), "edges")).withColumn("value", F.round("value", 6))


@register("greedy_communities")
def greedy_communities(spark, sf_dir):
    return gl.greedy_communities(_edges(spark, sf_dir), most_edges=2_000_000)


@register("maximal_cliques")
def maximal_cliques(spark, sf_dir):
    return gb.maximal_cliques(_edges(spark, sf_dir)).select(F.array_join("clique", "-").alias("clique"))


@register("clique_communities")
def clique_communities(spark, sf_dir):
    """Communities by percolation of cliques of four nodes."""
    return gb.clique_communities(gb.maximal_cliques(_edges(spark, sf_dir)), 4).select("community", "size", "node")


@register("neighbourhood_function")
def neighbourhood_function(spark, sf_dir):
    return gl.neighbourhood_function(_arcs(spark, sf_dir), 3)


@register("singular_values")
def singular_values(spark, sf_dir):
    values, _ = gl.singular_values(Tables(spark, sf_dir).embeddings, "embedding", 5)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, value double")


@register("motif_counts", oracle(f"with {S}, g as (select src as node, count(*) as deg from s group by src), w as (select sum(deg * (deg - 1) / 2) as wedges from g), t as (select count(*) as triangles from v_edges x join v_edges y on x.b = y.a join v_edges z on z.a = x.a and z.b = y.b) select cast(wedges - 3 * triangles as bigint) as open_wedges, triangles from w, t"))
def motif_counts(spark, sf_dir):
    return gr.triads(_edges(spark, sf_dir)).agg(F.sum("open").alias("open_wedges"), (F.sum("closed") / 3).cast("bigint").alias("triangles"))


@register("signed_triads", oracle("with e as (select a, b, case when (a + b) % 3 = 0 then -1 else 1 end as sign from v_edges) select x.sign + y.sign + z.sign as balance, count(*) as triads from e x join e y on x.b = y.a join e z on z.a = x.a and z.b = y.b group by 1"))
def signed_triads(spark, sf_dir):
    t = gr.triangles(_edges(spark, sf_dir))
    sign = lambda x, y: F.when((F.col(x) + F.col(y)) % 3 == 0, -1).otherwise(1)
    return t.groupBy((sign("x", "y") + sign("y", "z") + sign("x", "z")).alias("balance")).agg(F.count("*").alias("triads"))


@register("frequent_neighbours", oracle("select x.dst as a, y.dst as b, count(*) as freq from v_followers x join v_followers y on x.src = y.src and x.dst < y.dst group by 1, 2"))
def frequent_neighbours(spark, sf_dir):
    return gr.projection(_arcs(spark, sf_dir), "src", "dst").select("a", "b", F.col("w").alias("freq"))


@register("link_features", oracle(f"with {S}, g as (select src as node, count(*) as deg from s group by src), c as (select x.dst as a, y.dst as b, count(*) as common, sum(1 / ln(z.deg)) as adamic from s x join s y on x.src = y.src and x.dst < y.dst join g z on z.node = x.src group by 1, 2) select a, b, common, round(adamic, 6) as adamic from c"))
def link_features(spark, sf_dir):
    edges = materialize(_edges(spark, sf_dir), "edges")
    deg = gr.undirected_degrees(edges).withColumnRenamed("node", "src")
    w = gr.both_ways(edges).join(deg.where("deg > 1"), "src").select(F.col("src").alias("key"), F.col("dst").alias("node"), (1 / F.log("deg")).alias("w"))  # a node of one neighbour joins none
    return pr.pair_sums(w, weighted=True).select("a", "b", F.col("n").alias("common"), F.round("w", 6).alias("adamic"))


@register("cascade_candidates", oracle("select x.user_id as src, y.user_id as dst, count(*) as cascades from v_watchers x join v_watchers y on x.repo_id = y.repo_id and x.created_at < y.created_at and x.user_id <> y.user_id group by 1, 2"))
def cascade_candidates(spark, sf_dir):
    w = Tables(spark, sf_dir).v_watchers
    rows = w.select(F.col("repo_id").alias("key"), F.col("user_id").alias("node"), F.col("created_at").alias("t"))
    return pr.pair_sums(rows, timed=True).toDF("src", "dst", "cascades")


@register("quote_peaks", "with d as (select doc_id, lang, n_chars % 24 as hour from documents), c as (select lang, hour, count(*) as n from d group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, hour) as k from c) select lang, hour, n from r where k = 1")
def quote_peaks(spark, sf_dir):
    c = Tables(spark, sf_dir).documents.groupBy("lang", (F.col("n_chars") % 24).alias("hour")).agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.min_by(F.struct("hour", "n"), F.struct(-F.col("n"), "hour")).alias("p")).select("lang", "p.hour", "p.n")


@register("random_graph")
def random_graph(spark, sf_dir):
    return gn.random_edges(spark, 500, 2000)


@register("rmat_graph")
def rmat_graph(spark, sf_dir):
    return gn.rmat(spark, 10, 4000)


@register("kronecker_graph", "with e as (select * from (values (0, 0), (0, 1), (1, 0)) t(src, dst)) select cast(a.src * 4 + b.src * 2 + c.src as bigint) as src, cast(a.dst * 4 + b.dst * 2 + c.dst as bigint) as dst from e a, e b, e c")
def kronecker_graph(spark, sf_dir):
    seed = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "src bigint, dst bigint")
    return gn.kronecker(seed, 2, 3)


@register("sir_epidemic")
def sir_epidemic(spark, sf_dir):
    return spark.createDataFrame(gl.epidemic(0.5, 0.1, (0.99, 0.01, 0.0), 200), "t double, s double, i double, r double")


@register("nmf_factors")
def nmf_factors(spark, sf_dir):
    """Three non-negative factors of the absolute embeddings."""
    vectors = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", F.abs).alias("v"))
    return gl.factorise(vectors, "id", "v", 3)[0].withColumn("w", F.round("w", 6))
