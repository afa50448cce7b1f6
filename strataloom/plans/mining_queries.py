"""Queries on communities, cascades, itemsets and signed triads of the repository graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.operators import circles as ci
from strataloom.operators import communities as cm
from strataloom.operators import inference as nf
from strataloom.operators import shapes as sh
from strataloom.operators import signs as sg
from strataloom.operators import walks as wk
from strataloom.operators.components import connected_components
from strataloom.plans.graph_queries import DEG, EVERY, _edges, _q
from strataloom.tables import Tables


@_q("neighbourhood_conductance", f"with {DEG}, t as (select x.a as p, x.b as q, y.b as r from v_edges x join v_edges y on x.b = y.a join v_edges z on z.a = x.a and z.b = y.b), c as (select node, count(*) as closed from (select p as node from t union all select q from t union all select r from t) u group by node), n as (select s.src as node, sum(g.deg) as around from s join g on g.node = s.dst group by 1), v as (select node, deg + 1 as size, cast(deg + around as bigint) as volume, cast(deg + around - 2 * (deg + coalesce(closed, 0)) as bigint) as cut, (select 2 * count(*) from v_edges) as total from g join n using (node) left join c using (node)) select node, size, cut, volume, round(case when least(volume, total - volume) > 0 then cut / cast(least(volume, total - volume) as double) else 0 end, 9) as conductance from v")
def neighbourhood_conductance(spark, sf_dir):
    return cm.neighbourhoods(_edges(spark, sf_dir)).withColumn("conductance", F.round("conductance", 9))


#: numbers of communities that are tried
COUNTS = (2, 4, 8)


@register("community_counts")
def community_counts(spark, sf_dir):
    """How well each number of overlapping communities explains the edges, and pairs that were held out."""
    scores = cm.cross_validated(_edges(spark, sf_dir), COUNTS)
    return spark.createDataFrame(scores, "k int, likelihood double, held_out double").select("k", F.round("likelihood", 4).alias("likelihood"), F.round("held_out", 4).alias("held_out"))


@register("overlapping_communities")
def overlapping_communities(spark, sf_dir):
    """Memberships over the whole follower graph, the number of communities by held-out pairs."""
    return cm.overlapping(_edges(spark, sf_dir), COUNTS).withColumn("weight", F.round("weight", 6))


#: days that a watcher may take after another
WINDOW = 3.0
_HITS = "h as (select repo_id as cascade, user_id as node, epoch_us(created_at) / 86400e6 as t from v_watchers)"


def _hits(spark, sf_dir):
    """Who watched what when, in days."""
    days = F.unix_micros(F.col("created_at").cast("timestamp")) / 86400e6
    return Tables(spark, sf_dir).v_watchers.select(F.col("repo_id").alias("cascade"), F.col("user_id").alias("node"), days.alias("t"))


@_q("inference_candidates", f"with {_HITS} select x.node as src, y.node as dst, count(*) as cascades, round(sum(x.t - y.t - ln(1e-64)), 6) as gain from h x join h y on x.cascade = y.cascade and x.t < y.t and y.t - x.t <= {WINDOW} group by 1, 2")
def inference_candidates(spark, sf_dir):
    return nf.candidate_links(nf.candidates(_hits(spark, sf_dir), WINDOW)).withColumn("gain", F.round("gain", 6))


@register("inferred_network")
def inferred_network(spark, sf_dir):
    """The five hundred links that explain best who watched a repository after whom."""
    found = nf.network(_hits(spark, sf_dir), 500, WINDOW)
    return found.withColumns({c: F.round(c, 6) for c in ("gain", "mean_gap", "median_gap")})


@_q("frequent_itemsets", "with b as (select distinct user_id as basket, repo_id as item from v_project_members), f1 as (select item from b group by item having count(*) >= 20), p as (select basket, item from b where item in (select item from f1)), l2 as (select x.item as a, y.item as b, count(*) as n from p x join p y on x.basket = y.basket and x.item < y.item group by 1, 2 having count(*) >= 20), l3 as (select l.a, l.b, z.item as c, count(*) as n from l2 l join p x on x.item = l.a join p y on y.item = l.b and y.basket = x.basket join p z on z.basket = x.basket and z.item > l.b group by 1, 2, 3 having count(*) >= 20), l4 as (select l.a, l.b, l.c, w.item as d, count(*) as n from l3 l join p x on x.item = l.a join p y on y.item = l.b and y.basket = x.basket join p z on z.item = l.c and z.basket = x.basket join p w on w.basket = x.basket and w.item > l.c group by 1, 2, 3, 4 having count(*) >= 20) select cast(item as varchar) as items, 1 as size, count(*) as support from p group by item union all select concat(a, '-', b), 2, n from l2 union all select concat(a, '-', b, '-', c), 3, n from l3 union all select concat(a, '-', b, '-', c, '-', d), 4, n from l4")
def frequent_itemsets(spark, sf_dir):
    """Projects that twenty developers or more work on together, four at most."""
    found = nf.frequent_itemsets(Tables(spark, sf_dir).v_project_members, "user_id", "repo_id", 20, 4)
    return found.select(F.array_join(F.transform("items", lambda i: i.cast("string")), "-").alias("items"), "size", "support")


#: first vote of each voter on each candidate: purchases and clicks are for, errors against
_VOTES = "e as (select actor_id as src, issue_id as dst, case when event = 'error' then -1 else 1 end as sign, created_at as ts, row_number() over (partition by actor_id, issue_id order by created_at, id) as k from v_issue_events where event in ('purchase', 'click', 'error') and actor_id <> issue_id), v as (select src, dst, sign, ts from e where k = 1), u as (select src as p, dst as q, 'f' as way, sign, ts from v union all select dst, src, 'b', sign, ts from v), t as (select v.src, v.dst, v.sign, v.ts, concat(x.way, case when x.sign > 0 then '+' else '-' end, y.way, case when y.sign > 0 then '+' else '-' end) as context, case when x.way = 'f' then x.sign else -x.sign end + case when y.way = 'f' then y.sign else -y.sign end as status, x.sign * y.sign as balance from v join u x on x.p = v.src and x.ts < v.ts join u y on y.p = x.q and y.q = v.dst and y.ts < v.ts)"


def _votes(spark, sf_dir):
    votes = Tables(spark, sf_dir).v_issue_events.where("event in ('purchase', 'click', 'error') and actor_id <> issue_id")
    first = votes.groupBy(F.col("actor_id").alias("src"), F.col("issue_id").alias("dst")).agg(F.min(F.struct("created_at", "id", "event")).alias("v"))
    return first.select("src", "dst", F.when(F.col("v.event") == "error", -1).otherwise(1).alias("sign"), F.col("v.created_at").alias("ts"))


@_q("status_theory", f"with {_VOTES}, g as (select src, avg(case when sign > 0 then 1.0 else 0.0 end) as p from v group by 1), r as (select dst, avg(case when sign > 0 then 1.0 else 0.0 end) as r from v group by 1) select context, status, balance, count(*) as n, count(*) filter (where sign > 0) as positive, round(sum(p), 6) as expected_out, round((count(*) filter (where sign > 0) - sum(p)) / nullif(sqrt(sum(p * (1 - p))), 0), 6) as surprise_out, round(sum(r), 6) as expected_in, round((count(*) filter (where sign > 0) - sum(r)) / nullif(sqrt(sum(r * (1 - r))), 0), 6) as surprise_in from t join g using (src) join r using (dst) group by 1, 2, 3")
def status_theory(spark, sf_dir):
    """Signs of votes by the triads that they close, against what voters give and candidates get."""
    return sg.status_theory(_votes(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("expected_out", "surprise_out", "expected_in", "surprise_in")})


@_q("signed_closures", f"with {_VOTES} select day(ts) as bucket, count(distinct (src, dst)) as closings, count(*) as triads, count(*) filter (where sign(status) = sign) as by_status, count(*) filter (where balance = sign) as by_balance from t group by 1")
def signed_closures(spark, sf_dir):
    """Day by day, how many closing votes have the sign of status and of balance."""
    return sg.closures_over_time(_votes(spark, sf_dir), F.day("ts").cast("bigint"))


#: a developer's first commit to a project makes a link from then on; links up to this day are known
_KNOWN_UNTIL = "1996-12-31"
_MEMBERS = f"m as (select user_id, repo_id + 1000000 as repo, count(*) as commits, min(created_at) as ts from (select author_id as user_id, project_id as repo_id, created_at from v_commits) c group by 1, 2), k as (select * from m where ts <= timestamp '{_KNOWN_UNTIL}'), a as (select user_id as src, repo as dst from k union all select repo, user_id from k)"


def _memberships(spark, sf_dir):
    """Known and later links of developers and projects; features of the known ones."""
    m = Tables(spark, sf_dir).v_commits.groupBy(F.col("author_id").alias("user"), (F.col("project_id") + 1_000_000).alias("repo")).agg(F.min("created_at").alias("ts"), F.count_if(F.col("created_at") <= F.lit(f"{_KNOWN_UNTIL} 00:00:00").cast("timestamp_ntz")).alias("commits"), F.max(F.when(F.col("created_at") <= F.lit(f"{_KNOWN_UNTIL} 00:00:00").cast("timestamp_ntz"), F.col("created_at"))).alias("last"))
    known = m.where("commits > 0")
    size = known.groupBy("repo").agg(F.count("*").alias("members"))
    ago = F.datediff(F.lit(_KNOWN_UNTIL).cast("date"), F.col("last").cast("date")) / 365.0
    links = known.join(size, "repo").select("user", "repo", F.log1p(F.col("commits") - 1).alias("often"), (-ago).alias("lately"), F.log("members").alias("crowd"))
    both = links.select(F.col("user").alias("src"), F.col("repo").alias("dst"), "often", "lately", "crowd").unionAll(links.select("repo", "user", "often", "lately", "crowd"))
    return both, known.select("user", "repo"), m.where("commits = 0").select("user", "repo")


def _candidates(known, later, users):
    """Each of ``users`` with every project it has no part in yet, and whether it gets one."""
    repos = known.select("repo").union(later.select("repo")).distinct()
    mine = users.crossJoin(repos).join(known, ["user", "repo"], "left_anti")  # a twentieth of the users, as stated, with all projects
    return mine.join(later.withColumn("linked", F.lit(True)), ["user", "repo"], "left").select(F.col("user").alias("source"), F.col("repo").alias("node"), F.coalesce("linked", F.lit(False)).alias("linked"))


@_q("restart_walks", f"with {_MEMBERS}, o as (select src, count(*) as n from a group by src), q as (select a.src, a.dst, 1.0 / o.n as q from a join o using (src)), s0 as (select distinct src as source, src as node, cast(1.0 as double) as p from a where src % 20 = 0 and src < 1000000), s1 as (select source, node, sum(p) as p from (select source, dst as node, 0.8 * p * q as p from s0 join q on src = node union all select source, node, 0.2 from s0) t group by 1, 2), s2 as (select source, node, sum(p) as p from (select source, dst as node, 0.8 * p * q as p from s1 join q on src = node union all select source, node, 0.2 from s0) t group by 1, 2), s3 as (select source, node, sum(p) as p from (select source, dst as node, 0.8 * p * q as p from s2 join q on src = node union all select source, node, 0.2 from s0) t group by 1, 2) select source, node, round(p, 9) as p from s3")
def restart_walks(spark, sf_dir):
    """Where three steps from every twentieth developer end among developers and projects, all arcs alike."""
    arcs, *_ = _memberships(spark, sf_dir)
    sources = arcs.where(f"src % {EVERY} = 0 and src < 1000000").select(F.col("src").alias("node")).distinct()
    return wk.Walks(arcs, [], steps=3).walk(sources).withColumn("p", F.round("p", 9))


@register("walk_predictions")
def walk_predictions(spark, sf_dir):
    """Which project each twentieth developer takes up next: strengths learned on half of them, chances for the others."""
    arcs, known, later = _memberships(spark, sf_dir)
    users = known.select("user").distinct().where(f"user % {EVERY} = 0")
    walks = wk.Walks(arcs, ["often", "lately", "crowd"], steps=3)
    weights, _ = walks.fit(_candidates(known, later, users.where(f"user % {2 * EVERY} = 0")), rounds=3)
    asked = _candidates(known, later, users.where(f"user % {2 * EVERY} <> 0"))
    reached = walks.walk(asked.select(F.col("source").alias("node")).distinct(), weights)
    return asked.join(reached, ["source", "node"], "left").fillna(0.0, ["p"]).select("source", F.col("node") - 1_000_000, "linked", "p").toDF("developer", "project", "linked", "p").withColumn("p", F.round("p", 6))


@register("fork_shapes")
def fork_shapes(spark, sf_dir):
    """How many families of forks have one shape, all below each root."""
    t = Tables(spark, sf_dir)
    arcs = t.v_projects.where("forked_from is not null and forked_from <> id").select(F.col("forked_from").alias("src"), F.col("id").alias("dst"))
    family = connected_components(arcs).select(F.col("component").alias("graph"), F.col("node").alias("src"))
    return sh.shape_counts(sh.shape_keys(arcs.join(family, "src").select("graph", "src", "dst")))


@register("cascade_shapes")
def cascade_shapes(spark, sf_dir):
    """Shapes of what follows within six hours: watchers of a repository, each linked to those soon after, by connected run."""
    found = nf.candidates(_hits(spark, sf_dir), 0.25)
    arcs = found.select(F.concat_ws("-", "cascade", "src").alias("src"), F.concat_ws("-", "cascade", "dst").alias("dst"))
    runs = connected_components(arcs).select(F.col("component").alias("graph"), F.col("node").alias("src"))
    return sh.shape_counts(sh.shape_keys(arcs.join(runs, "src").select("graph", "src", "dst")))


@register("acyclic_search")
def acyclic_search(spark, sf_dir):
    """An order of the followers after sources and sinks are peeled off and six rounds of swaps that gain."""
    arcs = Tables(spark, sf_dir).v_followers.select("src", "dst")
    return sh.swapped_order(arcs, sh.peeled_order(arcs), 6)


@register("ego_circles")
def ego_circles(spark, sf_dir):
    """Two circles among the friends of every twentieth user, by links and by shared company and location: size, linked pairs inside and weights; empty circles have a row."""
    users = Tables(spark, sf_dir).v_users.select(F.col("id").alias("node"), "company", "location")
    edges = _edges(spark, sf_dir)
    found = ci.Circles(edges, users, users.where(F.col("node") % EVERY == 0), 2).run(CIRCLE_ROUNDS)
    members = found.members()
    ties = found.ties.join(members.withColumnRenamed("node", "x"), ["ego", "x"]).join(members.withColumnRenamed("node", "y"), ["ego", "circle", "y"])
    inside = ties.groupBy("ego", "circle").agg((F.count("*") / 2).cast("bigint").alias("links"))
    every = found.fitted.select("ego", "theta", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("circle"))
    sizes = every.join(members.groupBy("ego", "circle").agg(F.count("*").alias("size")), ["ego", "circle"], "left").join(inside, ["ego", "circle"], "left").fillna(0, ["size", "links"])
    weights = F.transform(F.slice("theta", F.col("circle") * 3 + 1, F.lit(3)), lambda t: F.round(t, 6))
    return sizes.select("ego", "circle", "size", "links", weights[0].alias("base"), weights[1].alias("company"), weights[2].alias("location"))


#: rounds of moves that the circles get
CIRCLE_ROUNDS = 3
