"""Queries on commits, issues, watchers, forks, users and file changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.functions import fit
from strataloom.operators import distribution as ds
from strataloom.operators import repository as rp
from strataloom.tables import Tables, oracle


def sql_query(name: str, sql: str) -> None:
    """Register a query that the reference states as SQL itself: the same text in both engines."""
    register(name, oracle(sql))(lambda spark, sf_dir: Tables(spark, sf_dir).sql(sql))


sql_query("sql_scan_projects", "select * from v_projects")
sql_query("sql_scan_users", "select * from v_users")
sql_query("sql_project_columns", "select id, author_id, project_id, created_at from v_commits")
sql_query("sql_filter_equal", "select id, name from v_projects where id = 7")
sql_query("sql_filter_any", "select id, committer_id from v_commits where committer_id in (1, 2, 3, 5, 8, 13)")
sql_query("sql_join_members", "select c.id, c.project_id, m.user_id from v_commits c join v_project_members m on c.project_id = m.repo_id and c.author_id = m.user_id")
sql_query("sql_join_members_fanout", "select c.project_id, count(*) as n from v_commits c join v_project_members m on c.project_id = m.repo_id group by c.project_id")
sql_query("sql_distinct", "select distinct user_id from v_watchers")
sql_query("sql_count_by", "select committer_id, count(*) as n from v_commits group by committer_id")
sql_query("sql_count_column_by", "select actor_id, count(id) as n from v_issue_events group by actor_id")
sql_query("sql_count_distinct_by", "select actor_id, count(distinct issue_id) as n from v_issue_events group by actor_id")
sql_query("sql_min_max_by", "select issue_id, min(created_at) as first_at, max(created_at) as last_at from v_issue_events group by issue_id")
sql_query("sql_order_by", "select id, created_at from v_commits order by created_at, id")
sql_query("sql_count_all", "select count(*) as n from v_commits")
sql_query("sql_union_keys", "select author_id as user_id from v_commits union select actor_id from v_issue_events")
sql_query("sql_intersect_keys", "select author_id as user_id from v_commits intersect select actor_id from v_issue_events")
sql_query("sql_except_keys", "select actor_id as user_id from v_issue_events except select author_id from v_commits")
sql_query("top_files", "select file_id, count(*) as n from v_commit_files group by file_id order by n desc, file_id limit 10")


@register("catalog_tables", """select 'repository_info' as "tableName" where (select count(*) from supplier) >= 0""")
def catalog_tables(spark, sf_dir):
    Tables(spark, sf_dir).v_projects.createOrReplaceTempView("repository_info")
    return spark.sql("show tables").select("tableName").where("tableName = 'repository_info'")


@register("language_map_merge", """select n_regionkey as id, upper(left(n_name, 1)) as key, max_by(n_name, n_nationkey) as value from nation group by 1, 2""")
def language_map_merge(spark, sf_dir):
    """Maps of several sources merged; of a key's values the one of the last source stays."""
    entries = Tables(spark, sf_dir).nation.select(F.col("n_regionkey").alias("id"), F.upper(F.substring("n_name", 1, 1)).alias("key"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("at"))
    return rp.merged_maps(entries, "id", "key", "value", "at")


def _simple(name: str, sql: str):
    return register(name, oracle(sql))


@_simple("files_per_commit", "select n as value, count(*) as freq from (select commit_id, count(*) as n from v_commit_files group by commit_id) t group by n")
def files_per_commit(spark, sf_dir):
    return ds.count_of_counts(Tables(spark, sf_dir).v_commit_files, "commit_id")


@_simple("add_del_pairs", "select additions as x, deletions as y, count(*) as freq from v_commit_files group by 1, 2")
def add_del_pairs(spark, sf_dir):
    return ds.joint(Tables(spark, sf_dir).v_commit_files, "additions", "deletions")


@_simple("changes_by_project", "select c.project_id, count(*) as changes, count(distinct f.file_id) as files, sum(additions) as additions, sum(deletions) as deletions from v_commit_files f join v_commits c on c.id = f.commit_id group by 1")
def changes_by_project(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_commit_files.join(t.v_commits.select(F.col("id").alias("commit_id"), "project_id"), "commit_id")
    return rows.groupBy("project_id").agg(F.count("*").alias("changes"), F.countDistinct("file_id").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


@_simple("changes_of_fixes", "select file_id, count(*) as fixes, sum(additions + deletions) as lines from v_commit_files where commit_id in (select sha from v_bugs) group by file_id")
def changes_of_fixes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_commit_files.join(t.v_bugs.select(F.col("sha").alias("commit_id")), "commit_id", "left_semi")
    return rows.groupBy("file_id").agg(F.count("*").alias("fixes"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"))


@_simple("buggy_line_hist", "select n as value, count(*) as freq from (select commit_id, sum(deletions) as n from v_commit_files where commit_id in (select sha from v_bugs) group by commit_id) t group by n")
def buggy_line_hist(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_commit_files.join(t.v_bugs.select(F.col("sha").alias("commit_id")), "commit_id", "left_semi")
    return ds.pdf(rows.groupBy("commit_id").agg(F.sum("deletions").alias("n")), "n")


@_simple("fixes_per_fixer", "select fixer, count(*) as fixes from v_bugs where sha in (select commit_id from v_commit_parents group by commit_id having count(*) = 1) group by fixer")
def fixes_per_fixer(spark, sf_dir):
    t = Tables(spark, sf_dir)
    single = rp.counts_by(t.v_commit_parents, "commit_id").where("n = 1").select(F.col("commit_id").alias("sha"))
    return rp.counts_by(t.v_bugs.join(single, "sha", "left_semi"), "fixer", name="fixes")


@_simple("comments_per_conversation", "select n as value, count(*) as freq from (select conv_id, count(*) as n from conversations group by conv_id) t group by n")
def comments_per_conversation(spark, sf_dir):
    return ds.count_of_counts(Tables(spark, sf_dir).conversations, "conv_id")


@_simple("comments_grouped", "select conv_id, count(*) as comments, string_agg(role, ',' order by turn, role) as roles from conversations group by conv_id")
def comments_grouped(spark, sf_dir):
    t = Tables(spark, sf_dir).conversations
    rows = t.groupBy("conv_id").agg(F.count("*").alias("comments"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", "comments", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


@_simple("labels_per_repo", "select repo_id, count(*) as total, count(distinct event) as kinds from v_issue_events e join v_issues i on i.id = e.issue_id group by repo_id")
def labels_per_repo(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_issue_events.join(t.v_issues.select(F.col("id").alias("issue_id"), "repo_id"), "issue_id")
    return rows.groupBy("repo_id").agg(F.count("*").alias("total"), F.countDistinct("event").alias("kinds"))


@_simple("project_profile", """with p as (select distinct repo_id from v_project_members) select p.repo_id, coalesce(m.n, 0) as members, coalesce(w.n, 0) as watchers, coalesce(i.n, 0) as issues, coalesce(c.n, 0) as commits from p
 left join (select repo_id, count(distinct user_id) as n from v_project_members group by repo_id) m using (repo_id) left join (select repo_id, count(*) as n from v_watchers group by repo_id) w using (repo_id)
 left join (select repo_id, count(*) as n from v_issues group by repo_id) i using (repo_id) left join (select project_id as repo_id, count(*) as n from v_commits group by project_id) c using (repo_id)""")
def project_profile(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = t.v_project_members.select("repo_id").distinct()
    parts = {
        "members": rp.counts_by(t.v_project_members, "repo_id", "user_id", "members"),
        "watchers": rp.counts_by(t.v_watchers, "repo_id", name="watchers"),
        "issues": rp.counts_by(t.v_issues, "repo_id", name="issues"),
        "commits": rp.counts_by(t.v_commits.withColumnRenamed("project_id", "repo_id"), "repo_id", name="commits"),
    }
    for part in parts.values():
        out = out.join(part, "repo_id", "left")
    return out.select("repo_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in parts))


@_simple("org_entropy", """with c as (select m.repo_id, u.company, count(*) as n from v_project_members m join v_users u on u.id = m.user_id group by 1, 2), p as (select repo_id, n / cast(sum(n) over (partition by repo_id) as double) as p from c)
 select repo_id, round(sum(-p * log2(p)), 6) as entropy, count(*) as kinds from p group by repo_id""")
def org_entropy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_project_members.join(t.v_users.select(F.col("id").alias("user_id"), "company"), "user_id")
    return ds.entropy(rows, "company", ["repo_id"]).select("repo_id", F.round("entropy", 6).alias("entropy"), "kinds")


@_simple("repo_watchers_dist", "select n as value, count(*) as freq from (select repo_id, count(distinct user_id) as n from v_watchers group by repo_id) t group by n")
def repo_watchers_dist(spark, sf_dir):
    return ds.pdf(rp.counts_by(Tables(spark, sf_dir).v_watchers, "repo_id", "user_id"), "n")


@_simple("watcher_repos_dist", "select n as value, count(*) as freq from (select user_id, count(distinct repo_id) as n from v_watchers group by user_id) t group by n")
def watcher_repos_dist(spark, sf_dir):
    return ds.pdf(rp.counts_by(Tables(spark, sf_dir).v_watchers, "user_id", "repo_id"), "n")


@_simple("contributor_watch_dist", "select n as value, count(*) as freq from (select user_id, count(distinct repo_id) as n from v_watchers where user_id in (select committer_id from v_commits) group by user_id) t group by n")
def contributor_watch_dist(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_watchers.join(t.v_commits.select(F.col("committer_id").alias("user_id")), "user_id", "left_semi")
    return ds.pdf(rp.counts_by(rows, "user_id", "repo_id"), "n")


@_simple("members_dist_ccdf", "with d as (select n as value, count(*) as freq from (select repo_id, count(distinct user_id) as n from v_project_members group by repo_id) t group by n) select value, freq, sum(freq) over (order by value desc) as cum from d")
def members_dist_ccdf(spark, sf_dir):
    return ds.cumulative(ds.pdf(rp.counts_by(Tables(spark, sf_dir).v_project_members, "repo_id", "user_id"), "n"), descending=True)


@_simple("members_vs_watchers", "with m as (select repo_id, count(distinct user_id) as members from v_project_members group by repo_id), w as (select repo_id, count(distinct user_id) as watchers from v_watchers group by repo_id) select repo_id, members, coalesce(watchers, 0) as watchers from m left join w using (repo_id)")
def members_vs_watchers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m, w = rp.counts_by(t.v_project_members, "repo_id", "user_id", "members"), rp.counts_by(t.v_watchers, "repo_id", "user_id", "watchers")
    return m.join(w, "repo_id", "left").select("repo_id", "members", F.coalesce("watchers", F.lit(0)).alias("watchers"))


@_simple("project_committers", "select project_id, committer_id, min(created_at) as first_at from v_commits group by 1, 2")
def project_committers(spark, sf_dir):
    return Tables(spark, sf_dir).v_commits.groupBy("project_id", "committer_id").agg(F.min("created_at").alias("first_at"))


@_simple("events_per_issue", "select n as value, count(*) as freq from (select issue_id, count(*) as n from v_issue_events group by issue_id) t group by n")
def events_per_issue(spark, sf_dir):
    return ds.count_of_counts(Tables(spark, sf_dir).v_issue_events, "issue_id")


@_simple("issues_per_actor", "select n as value, count(*) as freq from (select actor_id, count(distinct issue_id) as n from v_issue_events group by actor_id) t group by n")
def issues_per_actor(spark, sf_dir):
    return ds.pdf(rp.counts_by(Tables(spark, sf_dir).v_issue_events, "actor_id", "issue_id"), "n")


@_simple("bug_issue_events", "select event, count(*) as n, count(distinct issue_id) as issues from v_issue_events where issue_id in (select id from v_issues where repo_id % 2 = 0) group by event")
def bug_issue_events(spark, sf_dir):
    t = Tables(spark, sf_dir)
    bugs = t.v_issues.where("repo_id % 2 = 0").select(F.col("id").alias("issue_id"))
    return t.v_issue_events.join(bugs, "issue_id", "left_semi").groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("issue_id").alias("issues"))


@_simple("introducer_vs_fixer", """with i as (select introducer as user_id, count(distinct sha) as introduced, count(distinct case when introducer <> fixer then sha end) as fixed_by_other from v_bugs group by 1), f as (select fixer as user_id, count(distinct sha) as fixed from v_bugs group by 1)
 select user_id, coalesce(introduced, 0) as introduced, coalesce(fixed_by_other, 0) as fixed_by_other, coalesce(fixed, 0) as fixed from i full outer join f using (user_id)""")
def introducer_vs_fixer(spark, sf_dir):
    bugs = Tables(spark, sf_dir).v_bugs
    i = bugs.groupBy(F.col("introducer").alias("user_id")).agg(F.countDistinct("sha").alias("introduced"), F.countDistinct(F.when(F.col("introducer") != F.col("fixer"), F.col("sha"))).alias("fixed_by_other"))
    f = rp.counts_by(bugs.withColumnRenamed("fixer", "user_id"), "user_id", "sha", "fixed")
    return i.join(f, "user_id", "full_outer").select("user_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("introduced", "fixed_by_other", "fixed")))


_BPC = "c as (select committer_id as user_id, count(*) as commits from v_commits group by 1), b as (select introducer as user_id, count(distinct sha) as bugs from v_bugs group by 1), r as (select user_id, coalesce(bugs, 0) as bugs, coalesce(commits, 0) as commits from c full outer join b using (user_id))"


def _bugs_commits(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = rp.counts_by(t.v_commits.withColumnRenamed("committer_id", "user_id"), "user_id", name="commits")
    b = rp.counts_by(t.v_bugs.withColumnRenamed("introducer", "user_id"), "user_id", "sha", "bugs")
    return rp.outer_counts(c, b, "user_id", "commits", "bugs")


@_simple("bug_per_commit", f"with {_BPC} select user_id, bugs, commits, round(bugs / cast(commits as double), 6) as ratio, bugs / cast(commits as double) > 0.8 as often from r where commits > 0")
def bug_per_commit(spark, sf_dir):
    ratio = F.col("bugs") / F.col("commits")
    return _bugs_commits(spark, sf_dir).where("commits > 0").select("user_id", "bugs", "commits", F.round(ratio, 6).alias("ratio"), (ratio > 0.8).alias("often"))


@_simple("touch_file", "select c.project_id, c.author_id, f.file_id, coalesce(additions, -1) as additions, coalesce(deletions, -1) as deletions from v_commit_files f join v_commits c on c.id = f.commit_id")
def touch_file(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_commit_files.join(t.v_commits.select(F.col("id").alias("commit_id"), "project_id", "author_id"), "commit_id")
    missing = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return rows.select("project_id", "author_id", "file_id", missing("additions"), missing("deletions"))


@_simple("file_commit_lists", "select file_id, list_sort(list(distinct commit_id)) as commits from v_commit_files group by file_id")
def file_commit_lists(spark, sf_dir):
    return Tables(spark, sf_dir).v_commit_files.groupBy("file_id").agg(F.array_sort(F.collect_set("commit_id")).alias("commits"))


@_simple("shared_commits", "select commit_id, count(*) as projects from v_project_commits group by commit_id having count(*) > 1")
def shared_commits(spark, sf_dir):
    return rp.counts_by(Tables(spark, sf_dir).v_project_commits, "commit_id", name="projects").where("projects > 1")


@_simple("developer_info", "select count(distinct company) as companies, count(distinct location) as locations, count(*) as developers from v_users where id in (select author_id from v_commits)")
def developer_info(spark, sf_dir):
    t = Tables(spark, sf_dir)
    devs = t.v_users.join(t.v_commits.select(F.col("author_id").alias("id")), "id", "left_semi")
    return devs.agg(F.countDistinct("company").alias("companies"), F.countDistinct("location").alias("locations"), F.count("*").alias("developers"))


@_simple("orphan_commits", "select id from v_commits where project_id not in (select id from v_projects where forked_from is null)")
def orphan_commits(spark, sf_dir):
    """Commits whose project is not among the listed ones, here those that are no forks."""
    t = Tables(spark, sf_dir)
    known = t.v_projects.where("forked_from is null").select(F.col("id").alias("project_id"))
    return t.v_commits.join(known, "project_id", "left_anti").select("id")


@_simple("root_projects", "select id, name from v_projects where forked_from is null")
def root_projects(spark, sf_dir):
    return Tables(spark, sf_dir).v_projects.where("forked_from is null").select("id", "name")


@_simple("user_export", "select id, concat(login, ' ', company, ' ', location) as line from v_users")
def user_export(spark, sf_dir):
    return Tables(spark, sf_dir).v_users.select("id", F.concat_ws(" ", "login", "company", "location").alias("line"))


@_simple("user_file_sequence", "select author_id, file_id, row_number() over (partition by author_id order by created_at, c.id, file_id, additions, deletions) as step from v_commits c join v_commit_files f on f.commit_id = c.id")
def user_file_sequence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_commits.join(t.v_commit_files, F.col("commit_id") == F.col("id"))
    order = Window.partitionBy("author_id").orderBy("created_at", "id", "file_id", "additions", "deletions")
    return rows.select("author_id", "file_id", F.row_number().over(order).alias("step"))


def _gap_sql(table: str, by: str, ts: str, tie: str, expr: str) -> str:
    return f"with g as (select {by} as k, epoch(cast({ts} as timestamp)) - lag(epoch(cast({ts} as timestamp))) over (partition by {by} order by {ts}, {tie}) as s from {table}) select k, count(*) as gaps, round(avg({expr}), 6) as mean_gap from g where s is not null group by k"


def _gap_mean(rows, by):
    return rows.groupBy(F.col(by).alias("k")).agg(F.count("*").alias("gaps"), F.round(F.avg("gap"), 6).alias("mean_gap"))


_ROOTS = "roots as (select id as node, id as root from v_projects where forked_from is null or forked_from not in (select id from v_projects) union all select p.id, r.root from roots r join v_projects p on p.forked_from = r.node)"


@_simple("commit_gap_hours", f"with recursive {_ROOTS}, g as (select root, epoch(cast(created_at as timestamp)) - lag(epoch(cast(created_at as timestamp))) over (partition by root order by created_at, id) as s from v_commits c join roots on node = project_id) select root, cast(floor(s / 3600.0) as bigint) as value, count(*) as freq from g where s is not null group by 1, 2")
def commit_gap_hours(spark, sf_dir):
    """Whole hours between consecutive commits to a root repository and its forks, as a distribution of each root."""
    t = Tables(spark, sf_dir)
    commits = t.v_commits.join(rp.fork_roots(t.v_projects).withColumnRenamed("node", "project_id"), "project_id")
    return ds.pdf(rp.gaps(commits, ["root"], "created_at", "hours", "id").withColumn("gap", F.floor("gap")), "gap", ["root"])


@_simple("fork_gap_minutes", f"""with recursive {_ROOTS}, born as (select project_id, min(created_at) as born_at from v_commits group by 1), f as (select root, node, born_at from roots join born on project_id = node where node <> root),
 g as (select root, epoch(cast(born_at as timestamp)) - lag(epoch(cast(born_at as timestamp))) over (partition by root order by born_at, node) as s from f) select root, cast(floor(s / 60.0) as bigint) as value, count(*) as freq from g where s is not null group by 1, 2""")
def fork_gap_minutes(spark, sf_dir):
    """Whole minutes between the births of a root's consecutive forks; a fork is born with its first commit."""
    t = Tables(spark, sf_dir)
    born = t.v_commits.groupBy(F.col("project_id").alias("node")).agg(F.min("created_at").alias("at"))
    forks = rp.fork_roots(t.v_projects).where("node <> root").join(born, "node")
    return ds.pdf(rp.gaps(forks, ["root"], "at", "minutes", "node").withColumn("gap", F.floor("gap")), "gap", ["root"])


@_simple("watcher_gap_days", _gap_sql("v_watchers", "repo_id", "created_at", "user_id", "floor(s / 86400.0)"))
def watcher_gap_days(spark, sf_dir):
    g = rp.gaps(Tables(spark, sf_dir).v_watchers, ["repo_id"], "created_at", "days", "user_id")
    return _gap_mean(g.withColumn("gap", F.floor("gap")), "repo_id")


@_simple("contributor_gap_seconds", _gap_sql("v_project_members", "repo_id", "created_at", "user_id", "s % 86400"))
def contributor_gap_seconds(spark, sf_dir):
    return _gap_mean(rp.gap_seconds_of_day(Tables(spark, sf_dir).v_project_members, ["repo_id"], "created_at", "user_id"), "repo_id")


_ACTIVE = "d as (select project_id, cast(created_at as date) as date, count(*) as n from v_commits group by 1, 2)"


@_simple("activity_zero_filled", f"""with {_ACTIVE}, e as (select project_id, min(date) as f, max(date) as l from d group by 1), c as (select project_id, f, unnest(generate_series(f, l, interval 1 day))::date as date from e)
 select c.project_id, cast(datediff('day', c.f, c.date) + 1 as integer) as day, coalesce(d.n, 0) as n from c left join d using (project_id, date)""")
def activity_zero_filled(spark, sf_dir):
    return rp.active_days(Tables(spark, sf_dir).v_commits, "project_id", "created_at")


@_simple("active_day_gap_pdf", f"with {_ACTIVE}, g as (select cast(datediff('day', lag(date) over (partition by project_id order by date), date) as integer) as gap from d) select gap as value, count(*) as freq from g where gap is not null group by gap")
def active_day_gap_pdf(spark, sf_dir):
    return ds.pdf(rp.active_day_gaps(Tables(spark, sf_dir).v_commits, "project_id", "created_at"), "gap")


@_simple("file_day_cdf", "with d as (select cast(datediff('day', date '1992-01-01', cast(created_at as date)) as integer) as value, count(*) as freq from v_commits c join v_commit_files f on f.commit_id = c.id group by 1) select value, freq, sum(freq) over (order by value) as cum from d")
def file_day_cdf(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.v_commits.join(t.v_commit_files, F.col("commit_id") == F.col("id")).select(F.datediff("created_at", F.lit("1992-01-01").cast("date")).alias("d"))
    return ds.cumulative(ds.pdf(rows, "d"))


@_simple("issue_lifetime", """with l as (select issue_id, (epoch(max(created_at)) - epoch(min(created_at))) / 3600.0 as life, count(*) as events from v_issue_events group by 1), r as (select i.repo_id, cast(floor(life) as bigint) as y, count(*) over (partition by i.repo_id) as x from l join v_issues i on i.id = l.issue_id)
 select x, y, count(*) as freq from r group by x, y""")
def issue_lifetime(spark, sf_dir):
    t = Tables(spark, sf_dir)
    life = rp.life_times(t.v_issue_events, "issue_id", "created_at").join(t.v_issues.select(F.col("id").alias("issue_id"), "repo_id"), "issue_id")
    each = life.select(F.count("*").over(Window.partitionBy("repo_id")).alias("x"), F.floor("life").alias("y"))
    return ds.joint(each, "x", "y")


@_simple("bug_issue_lifetime", "with l as (select issue_id, cast(ceil(round((epoch(max(created_at)) - epoch(min(created_at))) / 3600.0, 6)) as bigint) as value from v_issue_events where issue_id % 2 = 0 group by 1) select value, count(*) as freq from l group by value")
def bug_issue_lifetime(spark, sf_dir):
    bugs = Tables(spark, sf_dir).v_issue_events.where("issue_id % 2 = 0")
    return ds.pdf(rp.life_times(bugs, "issue_id", "created_at").select(F.ceil(F.round("life", 6)).alias("h")), "h")


@_simple("size_factor", "select path, seq, round(factor, 9) as factor from v_size_log")
def size_factor(spark, sf_dir):
    return Tables(spark, sf_dir).v_size_log.select("path", "seq", F.round("factor", 9).alias("factor"))


@_simple("project_size_factor", "with s as (select commit_id, sum(additions) as size from v_commit_files group by 1) select p.commit_id, round(a.size / cast(b.size as double), 9) as factor from v_commit_parents p join s a on a.commit_id = p.commit_id join s b on b.commit_id = p.parent_id")
def project_size_factor(spark, sf_dir):
    t = Tables(spark, sf_dir)
    size = t.v_commit_files.groupBy("commit_id").agg(F.sum("additions").alias("size"))
    edges = t.v_commit_parents.join(size, "commit_id").join(size.select(F.col("commit_id").alias("parent_id"), F.col("size").alias("before")), "parent_id")
    return edges.select("commit_id", F.round(F.col("size") / F.col("before"), 9).alias("factor"))


@_simple("contrib_vs_watch", "with c as (select author_id as user_id, count(distinct project_id) as x from v_commits group by 1), w as (select user_id, count(distinct repo_id) as y from v_watchers group by 1) select x, y, count(*) as freq from c join w using (user_id) group by x, y")
def contrib_vs_watch(spark, sf_dir):
    return _contrib_watch(spark, sf_dir)


def _contrib_watch(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = rp.counts_by(t.v_commits.withColumnRenamed("author_id", "user_id"), "user_id", "project_id", "x")
    return ds.joint(c.join(rp.counts_by(t.v_watchers, "user_id", "repo_id", "y"), "user_id"), "x", "y")


@_simple("watched_not_contributed", "select user_id, count(*) as n from (select user_id, repo_id from v_watchers where (user_id, repo_id) not in (select author_id, project_id from v_commits)) t group by user_id")
def watched_not_contributed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    done = t.v_commits.select(F.col("author_id").alias("user_id"), F.col("project_id").alias("repo_id"))
    return rp.counts_by(t.v_watchers.join(done, ["user_id", "repo_id"], "left_anti"), "user_id")


@_simple("watch_vs_bugs", "with w as (select user_id, count(*) as x from v_watchers group by 1), b as (select introducer as user_id, count(*) as y from v_bugs group by 1) select x, y, count(*) as freq from w join b using (user_id) group by x, y")
def watch_vs_bugs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = rp.counts_by(t.v_bugs.withColumnRenamed("introducer", "user_id"), "user_id", name="y")
    return ds.joint(rp.counts_by(t.v_watchers, "user_id", name="x").join(b, "user_id"), "x", "y")


@_simple("commits_vs_issues_corr", """with c as (select author_id as user_id, count(*) as x from v_commits group by 1), i as (select actor_id as user_id, count(distinct issue_id) as y from v_issue_events group by 1),
 j as (select distinct coalesce(x, 0) as x, coalesce(y, 0) as y from c full outer join i using (user_id)) select round(corr(y, x), 6) as r, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as pairs from j where not (x = 0 and y = 0)""")
def commits_vs_issues_corr(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = rp.counts_by(t.v_commits.withColumnRenamed("author_id", "user_id"), "user_id", name="x")
    i = rp.counts_by(t.v_issue_events.withColumnRenamed("actor_id", "user_id"), "user_id", "issue_id", "y")
    f = fit.joint_correlation(ds.joint(rp.outer_counts(c, i, "user_id", "x", "y"), "x", "y"))
    return f.select(*(F.round(k, 6).alias(k) for k in ("r", "slope", "intercept")), "pairs")


_ROOTS = "with recursive r as (select id as node, id as root from v_projects where forked_from is null or forked_from not in (select id from v_projects) union all select p.id, r.root from v_projects p join r on p.forked_from = r.node)"


@register("fork_roots", oracle(f"{_ROOTS} select node, root from r"))
def fork_roots(spark, sf_dir):
    return rp.fork_roots(Tables(spark, sf_dir).v_projects)


@register("commits_per_root", oracle(f"{_ROOTS} select root, count(*) as commits, count(distinct node) as forks from r join v_commits c on c.project_id = r.node group by root"))
def commits_per_root(spark, sf_dir):
    t = Tables(spark, sf_dir)
    each = rp.counts_by(t.v_commits.withColumnRenamed("project_id", "node"), "node", name="c")
    return rp.fork_roots(t.v_projects).join(each, "node").groupBy("root").agg(F.sum("c").alias("commits"), F.count("*").alias("forks"))


@_simple("fork_descriptions", "select lower(trim(name)) as description, min(id) as id from v_projects where forked_from is not null group by 1")
def fork_descriptions(spark, sf_dir):
    return Tables(spark, sf_dir).v_projects.where("forked_from is not null").groupBy(F.lower(F.trim("name")).alias("description")).agg(F.min("id").alias("id"))


_PATCH = """select 1 as id, concat('@@ -10,4 +10,5 @@', chr(10), ' a', chr(10), '-b', chr(10), '+c', chr(10), '+d', chr(10), ' e', chr(10), '@@ -40,2 +41,1 @@', chr(10), '-x', chr(10), ' y') as patch"""


@register("diff_lines", """select * from (values (1, '-', 11), (1, '+', 11), (1, '+', 12), (1, '-', 40)) t(id, kind, line_no)""")
def diff_lines(spark, sf_dir):
    return rp.patch_lines(spark.sql(_PATCH), keys=["id"])


@_simple("blame_introducers", "select f.file_id, b.fixer, c.author_id as introducer, count(*) as lines from v_bugs b join v_commit_files f on f.commit_id = b.sha join v_commit_parents p on p.commit_id = b.sha join v_commits c on c.id = p.parent_id group by 1, 2, 3")
def blame_introducers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    deleted = t.v_bugs.join(t.v_commit_files, F.col("commit_id") == F.col("sha")).select("sha", "fixer", "file_id")
    last = t.v_commit_parents.join(t.v_commits, F.col("parent_id") == F.col("id")).select(F.col("commit_id").alias("sha"), F.col("author_id").alias("introducer"))
    return rp.blame(deleted, last, ["sha"]).groupBy("file_id", "fixer", "introducer").agg(F.count("*").alias("lines"))
