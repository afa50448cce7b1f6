"""Queries on tokens, n-grams, names, messages, urls and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.functions import fit
from strataloom.functions import text as tx
from strataloom.operators import distribution as ds
from strataloom.operators import frequency as fr
from strataloom.tables import Tables, oracle

RX = tx.TOKEN.replace("'", "''")
#: tokens of every document, for the oracles
TOK = f"toks as (select doc_id, lang, source, unnest(regexp_extract_all(trim(text), '{RX}', 0)) as tok from documents)"
ARR = f"arrs as (select doc_id, lang, source, regexp_extract_all(trim(text), '{RX}', 0) as a from documents)"


@register("zipf_by_lang", f"""with {TOK}, c as (select lang, tok, count(*) as tf from toks group by lang, tok),
 r as (select lang, tf, row_number() over (partition by lang order by tf desc, tok) as rk, count(*) over (partition by lang) as n from c)
 select lang, round(regr_slope(log10(tf), log10(rk)), 6) as slope, round(regr_intercept(log10(tf), log10(rk)), 6) as intercept, count(*) as points
 from r where rk >= 10 and rk <= floor(n * 0.1) group by lang""")
def zipf_by_lang(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    counted = fr.token_rows(docs, ["lang"]).groupBy("lang", "tok").agg(F.count("*").alias("tf"))
    dist = counted.groupBy("lang", F.col("tf").alias("freq")).agg(F.count("*").alias("n"))
    f = fit.zipf_from_counts(dist, ["lang"])
    return f.select("lang", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "points")


@register("zipf_normalised", f"""with {TOK}, c as (select lang, tok, count(*) as tf from toks group by lang, tok),
 r as (select lang, tf / cast(sum(tf) over (partition by lang) as double) as p, row_number() over (partition by lang order by tf desc, tok) as rk, count(*) over (partition by lang) as n from c)
 select lang, round(regr_slope(log10(p), log10(rk)), 6) as slope, round(regr_intercept(log10(p), log10(rk)), 6) as intercept, count(*) as points from r where rk >= 100 and rk <= floor(n * 0.1) group by lang""")
def zipf_normalised(spark, sf_dir):
    """The fit over ranks 100 to a tenth, of shares in place of counts: the slope is the same, the intercept moves by the logarithm of the total."""
    counted = fr.token_rows(Tables(spark, sf_dir).documents, ["lang"]).groupBy("lang", "tok").agg(F.count("*").alias("tf"))
    dist = counted.groupBy("lang", F.col("tf").alias("freq")).agg(F.count("*").alias("n"))
    total = dist.groupBy("lang").agg(F.sum(F.col("freq") * F.col("n")).alias("total"))
    f = fit.zipf_from_counts(dist, ["lang"], first=100).join(total, "lang")
    return f.select("lang", F.round("slope", 6).alias("slope"), F.round(F.col("intercept") - F.log10("total"), 6).alias("intercept"), "points")


@register("loglog_series", f"with {TOK}, c as (select tok, count(*) as tf from toks group by tok) select log10(cast(tok as bigint) + 1)::decimal(12,6)::double as x, log10(sum(tf))::decimal(12,6)::double as y from c where regexp_matches(tok, '^[0-9]{{1,9}}$') group by cast(tok as bigint)")
def loglog_series(spark, sf_dir):
    """Points of a series whose keys are whole numbers only, on logarithmic axes."""
    c = fr.token_rows(Tables(spark, sf_dir).documents, []).where(F.col("tok").rlike("^[0-9]{1,9}$")).groupBy(F.col("tok").cast("bigint").alias("key")).agg(F.count("*").alias("tf"))
    return c.select(F.round(F.log10(F.col("key") + 1), 6).alias("x"), F.round(F.log10("tf"), 6).alias("y"))


@register("token_freq", f"with {TOK} select tok, count(*) as tf from toks group by tok")
def token_freq(spark, sf_dir):
    return fr.token_rows(Tables(spark, sf_dir).documents, []).groupBy("tok").agg(F.count("*").alias("tf"))


@register("doc_freq", f"with {TOK} select lang, tok, count(*) as tf, count(distinct doc_id) as df from toks group by lang, tok")
def doc_freq(spark, sf_dir):
    return fr.term_document_frequency(Tables(spark, sf_dir).documents, None, ["lang"])


@register("project_as_doc_freq", f"with {TOK} select tok, count(*) as tf, count(distinct source) as df from toks group by tok")
def project_as_doc_freq(spark, sf_dir):
    return fr.term_document_frequency(Tables(spark, sf_dir).documents, "source")


@register("language_as_doc_freq", f"with {TOK} select tok, count(*) as tf, count(distinct lang) as df from toks group by tok")
def language_as_doc_freq(spark, sf_dir):
    return fr.term_document_frequency(Tables(spark, sf_dir).documents, "lang")


@register("document_counts", f"with {ARR} select lang, count(*) as docs, count(*) filter (where len(list_distinct(a)) > 1) as non_empty from arrs group by lang")
def document_counts(spark, sf_dir):
    return fr.document_counts(Tables(spark, sf_dir).documents, ["lang"])


@register("stream_document_count", "select count(*) as docs from documents")
def stream_document_count(spark, sf_dir):
    return Tables(spark, sf_dir).documents.agg(F.count("*").alias("docs"))


@register("token_entity_filter", f"with {TOK} select lang, tok, count(*) as tf from toks where regexp_matches(tok, '^[A-Za-z_]') group by lang, tok")
def token_entity_filter(spark, sf_dir):
    rows = fr.token_rows(Tables(spark, sf_dir).documents, ["lang"]).where(tx.is_entity(F.col("tok")))
    return rows.groupBy("lang", "tok").agg(F.count("*").alias("tf"))


@register("token_omit_number", f"with {TOK} select lang, count(*) as total, count(distinct tok) as uniq from toks where not regexp_matches(tok, '^[0-9]') and trim(tok) <> '' group by lang")
def token_omit_number(spark, sf_dir):
    rows = fr.token_rows(Tables(spark, sf_dir).documents, ["lang"]).where(~tx.is_number(F.col("tok")) & (F.trim("tok") != ""))
    each = rows.groupBy("lang", "tok").agg(F.count("*").alias("n"))
    return each.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("uniq"))


@register("token_length_hist", f"with {TOK} select length(tok) as value, count(*) as freq from toks group by length(tok)")
def token_length_hist(spark, sf_dir):
    return ds.pdf(fr.token_rows(Tables(spark, sf_dir).documents, []).select(F.length("tok").alias("len")), "len")


_MEMBERS = {name: ", ".join("'" + c.replace("'", "''") + "'" for c in members) for name, members in tx.CHAR_CLASSES.items()}


@register("char_class_hist", f"""with c as (select unnest(string_split(text, '')) as c from documents)
 select case when regexp_matches(c, '^[A-Za-z_]$') then 'entity' when regexp_matches(c, '^[0-9]$') then 'digit' {" ".join(f"when c in ({m}) then '{n}'" for n, m in _MEMBERS.items())} else 'other' end as class, count(*) as freq from c where c <> '' group by 1""")
def char_class_hist(spark, sf_dir):
    # characters are counted first, so a class is found once for each different character
    chars = Tables(spark, sf_dir).documents.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return chars.groupBy(tx.char_class(F.col("c")).alias("class")).agg(F.sum("n").alias("freq"))


@register("pair_operator_freq", " union all ".join(f"select '{p}' as pair, cast(coalesce(sum((length(text) - length(replace(text, '{p}', ''))) // 2), 0) as bigint) as freq from documents" for p in tx.PAIR_OPERATORS))
def pair_operator_freq(spark, sf_dir):
    """Operators of two characters in all texts, from the left without overlap."""
    text = F.col("text")
    counts = [((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / 2).cast("bigint") for p in tx.PAIR_OPERATORS]
    sums = Tables(spark, sf_dir).documents.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n{k}") for k, c in enumerate(counts)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(p).alias("pair"), F.col(f"n{k}").alias("freq")) for k, p in enumerate(tx.PAIR_OPERATORS)))).alias("r")).select("r.*")


def _grams_sql(n: int, keep: str = "true") -> str:
    """CTEs of the n-grams of every document, by window functions."""
    leads = ", ".join(f"lead(tok, {k}) over w" for k in range(1, n))
    glued = "tok" if n == 1 else f"concat_ws(':', tok, {leads})"
    window = " window w as (partition by doc_id order by pos)" if n > 1 else ""
    last = f"lead(tok, {n - 1}) over w" if n > 1 else "tok"
    return f"""placed as (select doc_id, lang, unnest(regexp_extract_all(trim(text), '{RX}', 0)) as tok, unnest(range(0, len(regexp_extract_all(trim(text), '{RX}', 0)))) as pos from documents),
 kept as (select * from placed where {keep}), gr as (select doc_id, lang, {glued} as ngram, {last} as last_tok from kept{window}), grams as (select doc_id, lang, ngram from gr where last_tok is not null)"""


def _ngram_sql(n: int) -> str:
    return f"with {_grams_sql(n)} select lang, ngram, count(*) as freq, count(distinct doc_id) as n_files from grams group by lang, ngram"


def _register_ngrams() -> None:
    for n in (1, 2, 3):
        register(f"ngram{n}", _ngram_sql(n))(lambda spark, sf_dir, n=n: fr.ngram_frequency(Tables(spark, sf_dir).documents, n, ["lang"]))


_register_ngrams()


@register("ngram_program_only", f"""with {_grams_sql(2, "regexp_matches(tok, '^[A-Za-z_]')")} select ngram, count(*) as freq, count(distinct doc_id) as n_files from grams group by ngram""")
def ngram_program_only(spark, sf_dir):
    kept = F.filter(tx.tokens(F.col("text")), tx.is_entity)  # n-grams bridge what the filter removes
    return fr.ngram_frequency(Tables(spark, sf_dir).documents, 2, keep=kept)


@register("ngram_merge_counts", f"""with {_grams_sql(2)}, m as (select doc_id, ngram, count(*) as n from grams group by doc_id, ngram)
 select ngram, sum(n) as freq, count(*) as records from m group by ngram""")
def ngram_merge_counts(spark, sf_dir):
    f = fr.ngram_frequency(Tables(spark, sf_dir).documents, 2)
    return f.select("ngram", "freq", F.col("n_files").alias("records"))


@register("refine_ngram", """with p as (select p_partkey, list_filter(string_split(translate(concat(p_name, '=', p_type, '@', p_brand), '%#&@:,=[]', '.........'), '.'), lambda x: x <> '') as a from part),
 u as (select p_partkey, unnest(a) as tok, unnest(range(0, len(a))) as pos from p), l as (select tok, lead(tok) over (partition by p_partkey order by pos) as nxt from u),
 g as (select concat(tok, '.', nxt) as ngram from l where nxt is not null) select ngram, count(*) as freq from g group by ngram""")
def refine_ngram(spark, sf_dir):
    name = F.concat("p_name", F.lit("="), "p_type", F.lit("@"), "p_brand")
    return Tables(spark, sf_dir).part.select(F.explode(tx.refined(name, 2)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("freq"))


@register("split_names", """select tok, sum(freq) as freq from (select unnest(list_filter(regexp_split_to_array(concat(p_brand, '.', p_type), '[.:]'), lambda x: x <> '')) as tok, p_size as freq from part) t group by tok""")
def split_names(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.select(F.explode(tx.split_names(F.concat("p_brand", F.lit("."), "p_type"))).alias("tok"), F.col("p_size").cast("bigint").alias("freq"))
    return rows.groupBy("tok").agg(F.sum("freq").alias("freq"))


_EXT = "list_extract(string_split(list_extract(string_split(filename, '.'), -1), '/'), -1)"


@register("file_ext", oracle(f"select {_EXT} as ext, count(*) as changes, count(distinct file_id) as files from v_commit_files group by 1"))
def file_ext(spark, sf_dir):
    rows = Tables(spark, sf_dir).v_commit_files.select(tx.file_extension(F.col("filename")).alias("ext"), "file_id")
    return rows.groupBy("ext").agg(F.count("*").alias("changes"), F.countDistinct("file_id").alias("files"))


@register("extension_language", oracle(f"""with m as (select * from (values ('promo', 'php'), ('small', 'py'), ('large', 'rb')) t(prefix, lang))
 select coalesce(m.lang, 'unknown') as lang, count(*) as files from (select distinct file_id, {_EXT} as ext from v_commit_files) f left join m on starts_with(f.ext, m.prefix) group by 1"""))
def extension_language(spark, sf_dir):
    languages = spark.createDataFrame([("promo", "php"), ("small", "py"), ("large", "rb")], "prefix string, lang string")  # a fixed map
    files = Tables(spark, sf_dir).v_commit_files.select("file_id", tx.file_extension(F.col("filename")).alias("ext")).distinct()
    joined = files.join(F.broadcast(languages), F.expr("startswith(ext, prefix)"), "left")
    return joined.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("files"))


@register("source_file_changes", oracle("select count(*) as changes, count(*) filter (where regexp_matches(filename, '([.]c|php|rb|py|java|cpp|scala|js|h|cc|pl|hpp)$')) as source_changes from v_commit_files"))
def source_file_changes(spark, sf_dir):
    return Tables(spark, sf_dir).v_commit_files.agg(F.count("*").alias("changes"), F.count_if(tx.is_source_file(F.col("filename"))).alias("source_changes"))


@register("bugfix_messages", oracle("select id from v_messages where regexp_matches(lower(message), '#[0-9]+') and regexp_matches(lower(message), 'close|resolve|fix')"))
def bugfix_messages(spark, sf_dir):
    return Tables(spark, sf_dir).v_messages.where(tx.is_bug_fix(F.col("message"))).select("id")


@register("issue_refs", oracle("select issue, count(*) as refs from (select unnest(regexp_extract_all(message, '#([0-9]+)', 1)) as issue from v_messages) t group by issue"))
def issue_refs(spark, sf_dir):
    return Tables(spark, sf_dir).v_messages.select(F.explode(tx.issue_numbers(F.col("message"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("refs"))


@register("email_alias", oracle("""select lower(email) as alias, count(*) as users from v_users where position('@' in email) > 0 and position('(' in email) = 0 group by lower(email) having count(*) > 1"""))
def email_alias(spark, sf_dir):
    valid = Tables(spark, sf_dir).v_users.where("instr(email, '@') > 0 and instr(email, '(') = 0")
    return valid.groupBy(F.lower("email").alias("alias")).agg(F.count("*").alias("users")).where("users > 1")


@register("email_alias_commits", oracle("""with g as (select lower(email) as alias, count(*) over (partition by lower(email)) as n, id from v_users where position('@' in email) > 0)
 select alias, count(*) as commits from g join v_commits c on c.committer_id = g.id where n > 1 group by alias"""))
def email_alias_commits(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = t.v_users.where("instr(email, '@') > 0").select("id", F.lower("email").alias("alias"))
    groups = named.groupBy("alias").agg(F.count("*").alias("n")).where("n > 1")
    members = named.join(groups, "alias", "left_semi")
    commits = t.v_commits.groupBy("committer_id").agg(F.count("*").alias("n"))
    return members.join(commits, members.id == commits.committer_id).groupBy("alias").agg(F.sum("n").alias("commits"))


@register("local_part_alias", oracle("select lower(split_part(email, '@', 1)) as local, count(*) as users, min(id) as first_user, max(id) as last_user from v_users group by 1"))
def local_part_alias(spark, sf_dir):
    users = Tables(spark, sf_dir).v_users
    return users.groupBy(tx.email_local(F.col("email")).alias("local")).agg(F.count("*").alias("users"), F.min("id").alias("first_user"), F.max("id").alias("last_user"))


@register("name_characters", oracle("select id, array_to_string(list_sort(list_distinct(string_split(lower(login), ''))), '') as characters from v_users"))
def name_characters(spark, sf_dir):
    return Tables(spark, sf_dir).v_users.select("id", F.array_join(tx.name_characters(F.col("login")), "").alias("characters"))


@register("url_domain", """select regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') as domain,
 regexp_extract(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', ''), '([^.]+\\.[^.]+)$', 1) as site, count(*) as pages from pages group by 1, 2""")
def url_domain(spark, sf_dir):
    return Tables(spark, sf_dir).pages.groupBy(tx.url_domain(F.col("url")).alias("domain"), tx.url_site(F.col("url")).alias("site")).agg(F.count("*").alias("pages"))


@register("url_normal", "select page_id, rtrim(regexp_extract(regexp_replace(lower(url), '^[a-z]+://(www\\.)?', ''), '^[^?#]*'), '/') as url from pages")
def url_normal(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", tx.normal_url(F.col("url")).alias("url"))


@register("html_text", """select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as text from pages""")
def html_text(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", tx.html_text(F.col("html")).alias("text"))


@register("html_scrape", """select page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as links, len(regexp_extract_all(html, '(?i)<p[ >]', 0)) as paragraphs,
 regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title from pages""")
def html_scrape(spark, sf_dir):
    links = F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1)))
    paragraphs = F.size(F.regexp_extract_all("html", F.lit("(?i)<p[ >]"), F.lit(0)))
    return Tables(spark, sf_dir).pages.select("page_id", links.alias("links"), paragraphs.alias("paragraphs"), tx.xml_tag(F.col("html"), "title").alias("title"))


@register("string_helpers", """select doc_id, length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as clean_chars, len(regexp_extract_all(text, '[A-Za-z0-9]+', 0)) as words,
 round(cast(length(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) as double) / length(text), 6) as latin, len(string_split(text, chr(10))) as lines from documents""")
def string_helpers(spark, sf_dir):
    t = F.col("text")
    return Tables(spark, sf_dir).documents.select("doc_id", F.length(tx.clean_words(t)).alias("clean_chars"), tx.word_count(t).alias("words"), F.round(tx.latin_share(t), 6).alias("latin"), F.size(F.split(t, "\n")).alias("lines"))


@register("comment_sentiment", """with w as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) as word from conversations),
 l as (select * from (values ('good', 1.0), ('great', 1.0), ('thanks', 0.5), ('help', 0.25), ('bad', -1.0), ('wrong', -0.5), ('error', -0.5), ('the', 0.0)) t(word, polarity))
 select conv_id, turn, round(avg(polarity), 6) as polarity, count(*) as words from w join l using (word) group by conv_id, turn""")
def comment_sentiment(spark, sf_dir):
    lexicon = spark.createDataFrame([("good", 1.0), ("great", 1.0), ("thanks", 0.5), ("help", 0.25), ("bad", -1.0), ("wrong", -0.5), ("error", -0.5), ("the", 0.0)], "word string, polarity double")  # a fixed list
    words = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.join(F.broadcast(lexicon), "word").groupBy("conv_id", "turn").agg(F.round(F.avg("polarity"), 6).alias("polarity"), F.count("*").alias("words"))


@register("dates_parsed", oracle("select id, case when id % 4 = 3 then null else date_trunc('day', created_at) end as day from v_commits"))
def dates_parsed(spark, sf_dir):
    """The three layouts by turns, and one that is none."""
    layouts = ["MM/dd/yyyy", "yyyy-MM-dd_HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd.MM.yyyy"]
    laid = F.coalesce(*(F.when(F.col("id") % 4 == k, F.date_format(F.date_trunc("day", "created_at"), f)) for k, f in enumerate(layouts)))
    return Tables(spark, sf_dir).v_commits.select("id", tx.parsed_date(laid).cast("timestamp_ntz").alias("day"))


@register("actor_names", oracle("select id, coalesce(case when id % 2 = 0 then login end, case when id % 3 = 0 then concat('a', id) end, case when id % 5 = 0 then company end, case when id % 7 = 0 then email end, 'null null') as actor from v_users"))
def actor_names(spark, sf_dir):
    """The first identity that is known of committer's login, author's login, committer's name, author's name."""
    known = lambda n, c: F.when(F.col("id") % n == 0, c)
    actor = tx.actor_name(known(2, F.col("login")), known(3, F.concat(F.lit("a"), "id")), known(5, F.col("company")), known(7, F.col("email")))
    return Tables(spark, sf_dir).v_users.select("id", actor.alias("actor"))


@register("repo_keys", oracle("select id, concat('u', id % 50, '_', replace(lower(name), '#', '-'), '_commits') as repo from v_projects"))
def repo_keys(spark, sf_dir):
    url = F.concat(F.lit("https://api.github.com/repos/u"), F.col("id") % 50, F.lit("/"), F.translate(F.lower("name"), "#", "-"), F.lit("/commits"))
    return Tables(spark, sf_dir).v_projects.select("id", tx.repo_of_url(url).alias("repo"))


_CLASSES = """count(*) filter (where regexp_matches(tok, '^[A-Za-z_]')) as program_uniq, coalesce(sum(freq) filter (where regexp_matches(tok, '^[A-Za-z_]')), 0) as program_total,
 count(*) filter (where regexp_matches(tok, '^[0-9]')) as literal_uniq, coalesce(sum(freq) filter (where regexp_matches(tok, '^[0-9]')), 0) as literal_total,
 count(*) as all_uniq, sum(freq) as all_total"""


@register("token_class_split", f"with {TOK}, c as (select lang, tok, count(*) as freq from toks group by lang, tok) select lang, {_CLASSES} from c group by lang")
def token_class_split(spark, sf_dir):
    counted = fr.token_rows(Tables(spark, sf_dir).documents, ["lang"]).groupBy("lang", "tok").agg(F.count("*").alias("freq"))
    tok = F.col("tok")
    return fr.class_split(counted, {"program": tx.is_entity(tok), "literal": tx.is_number(tok), "all": F.lit(True)}, ["lang"])


@register("reserved_ratio", f"""with {TOK}, c as (select lang, tok, count(*) as freq from toks group by lang, tok)
 select lang, round(cast(sum(freq) filter (where regexp_matches(tok, '^[A-Za-z_]')) as double) / sum(freq), 6) as ratio_total,
 round(cast(count(*) filter (where regexp_matches(tok, '^[A-Za-z_]')) as double) / count(*), 6) as ratio_uniq from c group by lang""")
def reserved_ratio(spark, sf_dir):
    s = token_class_split(spark, sf_dir)
    return s.select("lang", F.round(F.col("program_total") / F.col("all_total"), 6).alias("ratio_total"), F.round(F.col("program_uniq") / F.col("all_uniq"), 6).alias("ratio_uniq"))


@register("program_ratio", f"""with {ARR}, r as (select doc_id, cast(len(list_filter(a, lambda t: regexp_matches(t, '^[A-Za-z_]'))) as double) / len(a) as r from arrs where len(a) > 0)
 select cast(least(floor(round(r * 500, 9)), 499) as integer) as bin, count(*) as freq from r group by 1""")
def program_ratio(spark, sf_dir):
    toks = tx.tokens(F.col("text"))
    sizes = Tables(spark, sf_dir).documents.select(F.size(toks).alias("n"), F.size(F.filter(toks, tx.is_entity)).alias("p")).where("n > 0")
    ratio = sizes.select(F.round(F.col("p") / F.col("n"), 12).alias("r"))
    return ratio.groupBy(F.least(F.floor(F.round(F.col("r") * 500, 9)), F.lit(499)).cast("int").alias("bin")).agg(F.count("*").alias("freq"))


@register("file_size_hist", f"with {ARR}, s as (select 'all' as kind, len(a) as value from arrs union all select 'program', len(list_filter(a, lambda t: regexp_matches(t, '^[A-Za-z_]'))) from arrs) select kind, value, count(*) as freq from s group by 1, 2")
def file_size_hist(spark, sf_dir):
    """Sizes of files in all tokens, and in those of programs."""
    toks = tx.tokens(F.col("text"))
    sizes = F.array(F.struct(F.lit("all").alias("kind"), F.size(toks).alias("n")), F.struct(F.lit("program").alias("kind"), F.size(F.filter(toks, tx.is_entity)).alias("n")))
    return ds.pdf(Tables(spark, sf_dir).documents.select(F.explode(sizes).alias("s")).select("s.*"), "n", ["kind"])


HEAPS = f"""{TOK}, firsts as (select lang, tok, min(doc_id) as doc_id from toks group by lang, tok), fresh as (select lang, doc_id, count(*) as fresh from firsts group by lang, doc_id),
 sizes as (select lang, doc_id, len(regexp_extract_all(trim(text), '{RX}', 0)) as n from documents),
 curve as (select lang, doc_id, sum(n) over w as total, sum(coalesce(fresh, 0)) over w as uniq from sizes left join fresh using (lang, doc_id) window w as (partition by lang order by doc_id))"""


@register("heaps_curve", f"with {HEAPS} select lang, doc_id, total, uniq from curve")
def heaps_curve(spark, sf_dir):
    return fr.heaps_by_document(Tables(spark, sf_dir).documents, "doc_id", ["lang"])


@register("heaps_fit", f"""with {HEAPS}, d as (select distinct lang, total, uniq from curve where total > 0)
 select lang, round(regr_slope(log10(uniq), log10(total)), 6) as slope, round(regr_intercept(log10(uniq), log10(total)), 6) as intercept, count(*) as points from d group by lang""")
def heaps_fit(spark, sf_dir):
    curve = fr.heaps_by_document(Tables(spark, sf_dir).documents, "doc_id", ["lang"]).where("total > 0").select("lang", "total", "uniq").distinct()
    f = fit.line(curve, F.log10("total"), F.log10("uniq"), ["lang"])
    return f.select("lang", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "points")


@register("heaps_token_curve", f"""with arrs as (select doc_id, lang, regexp_extract_all(trim(text), '{RX}', 0) as a from documents),
 rows as (select lang, doc_id, unnest(a) as tok, unnest(range(0, len(a))) as pos from arrs), numbered as (select lang, tok, row_number() over (partition by lang order by doc_id, pos) as total,
 row_number() over (partition by lang, tok order by doc_id, pos) as nth from rows), u as (select lang, total, sum(case when nth = 1 then 1 else 0 end) over (partition by lang order by total) as uniq from numbered)
 select lang, total, uniq from u""")
def heaps_token_curve(spark, sf_dir):
    return fr.heaps_by_token(Tables(spark, sf_dir).documents, "doc_id", ["lang"])


@register("finite_observation", f"""with {HEAPS}, t as (select unnest([100, 500, 1000, 5000, 10000]) as threshold)
 select lang, threshold, min(doc_id) as doc_id, min(total) as total, min(uniq) as uniq from curve join t on uniq >= threshold group by lang, threshold""")
def finite_observation(spark, sf_dir):
    return fr.snapshots(Tables(spark, sf_dir).documents, "doc_id", ["lang"], [100, 500, 1000, 5000, 10000])


@register("snapshot_doc_freq", f"with {TOK}, s as (select unnest([0.25, 0.5, 1.0])::double as share), m as (select max(doc_id) as top from documents) select share, tok, count(*) as tf, count(distinct doc_id) as df from toks, s, m where doc_id <= share * top group by share, tok")
def snapshot_doc_freq(spark, sf_dir):
    """Frequencies as they stood when a quarter, half and all of the documents had come."""
    return fr.snapshot_frequency(Tables(spark, sf_dir).documents, "doc_id", [0.25, 0.5, 1.0])


@register("snapshot_file_sizes", f"with {ARR} select arrs.doc_id, len(a) as n_all, len(list_filter(a, lambda t: regexp_matches(t, '^[A-Za-z_]'))) as n_program, octet_length(encode(text)) as n_bytes from arrs join documents using (doc_id)")
def snapshot_file_sizes(spark, sf_dir):
    toks = tx.tokens(F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", F.size(toks).cast("bigint").alias("n_all"), F.size(F.filter(toks, tx.is_entity)).cast("bigint").alias("n_program"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def _four(keep: str, name: str) -> str:
    return f"""f{name} as (select tok, min(doc_id) as doc_id from toks where {keep} group by tok), c{name} as (select doc_id, count(*) as n from f{name} group by doc_id), t{name} as (select doc_id, count(*) as n from toks where {keep} group by doc_id)"""


@register("snapshot_vocabulary", f"""with {TOK}, {_four("true", "a")}, {_four("regexp_matches(tok, '^[A-Za-z_]')", "p")}
 select doc_id, sum(coalesce(ca.n, 0)) over w as uniq_all, sum(coalesce(ta.n, 0)) over w as n_all, sum(coalesce(cp.n, 0)) over w as uniq_program, sum(coalesce(tp.n, 0)) over w as n_program
 from documents left join ca using (doc_id) left join ta using (doc_id) left join cp using (doc_id) left join tp using (doc_id) window w as (order by doc_id)""")
def snapshot_vocabulary(spark, sf_dir):
    """After each document: different and all tokens, and those of programs."""
    return fr.snapshot_vocabulary(Tables(spark, sf_dir).documents, "doc_id")


CHANGES = f"""{TOK}, d as (select doc_id * 2 as seq, tok, 1 as delta from toks union all select doc_id * 2 + 101 as seq, tok, -1 as delta from toks where doc_id % 3 = 0),
 e as (select seq, tok, sum(delta) as d from d group by seq, tok), r as (select seq, tok, d, sum(d) over (partition by tok order by seq) as c from e),
 s as (select seq, d, case when c > 0 then 1 else 0 end - case when coalesce(lag(c) over (partition by tok order by seq), 0) > 0 then 1 else 0 end as step from r),
 g as (select seq, sum(step) as step, sum(d) as d from s group by seq)"""


@register("vocab_with_retractions", f"with {CHANGES} select seq, sum(step) over (order by seq) as uniq, sum(d) over (order by seq) as total from g")
def vocab_with_retractions(spark, sf_dir):
    """Every document is added at step 2 id; every third is taken away again at step 2 id + 101."""
    toks = fr.token_rows(Tables(spark, sf_dir).documents, ["doc_id"])
    added = toks.select((F.col("doc_id") * 2).alias("seq"), "tok", F.lit(1).alias("delta"))
    removed = toks.where("doc_id % 3 = 0").select((F.col("doc_id") * 2 + 101).alias("seq"), "tok", F.lit(-1).alias("delta"))
    return fr.vocabulary_with_retractions(added.unionAll(removed), "seq")
