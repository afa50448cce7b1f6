"""Queries on what holds along the paths of the commit history, and on changed files by root repository."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import history as hi
from strataloom.operators.repository import fork_roots
from strataloom.plans.graph_queries import _q
from strataloom.tables import Tables

_PATHS = """with recursive r as (select id, id as anc, 0 as d from v_commits union all select r.id, p.parent_id, r.d + 1 from r join v_commit_parents p on p.commit_id = r.anc),
 f as (select commit_id, file_id, sum(additions) as added, sum(deletions) as removed from v_commit_files group by 1, 2)"""


def _toured(spark, sf_dir):
    t = Tables(spark, sf_dir)
    toured = hi.tour(t.v_commits.select(F.col("id").alias("node")), t.v_commit_parents.select(F.col("commit_id").alias("node"), F.col("parent_id").alias("parent")))
    return toured, t.v_commit_files.select(F.col("commit_id").alias("node"), F.col("file_id").alias("term"), F.col("additions").alias("added"), F.col("deletions").alias("removed"))


@_q("commit_path_growth", f"{_PATHS} select r.id as commit_id, arg_max(r.anc, r.d) as root, max(r.d) as depth, count(f.file_id) as touched, count(distinct f.file_id) as files, cast(coalesce(sum(f.added), 0) as bigint) as lines, cast(coalesce(sum(f.added - f.removed), 0) as bigint) as size from r left join f on f.commit_id = r.anc group by r.id")
def commit_path_growth(spark, sf_dir):
    """Files touched, different files, lines added and lines left from the root to each commit."""
    grown = hi.path_growth(*_toured(spark, sf_dir))
    return grown.select(F.col("node").alias("commit_id"), "root", "depth", "touched", F.col("terms").alias("files"), F.col("added").alias("lines"), "size")


@_q("commit_file_history", f"{_PATHS} select o.commit_id, o.file_id, count(*) as nth, cast(sum(f.added - f.removed) as bigint) as size from f o join r on r.id = o.commit_id join f on f.commit_id = r.anc and f.file_id = o.file_id group by 1, 2")
def commit_file_history(spark, sf_dir):
    """Each change of a file: which one it is on the commit's path, and the file's lines after it."""
    return hi.term_history(*_toured(spark, sf_dir)).select(F.col("node").alias("commit_id"), F.col("term").alias("file_id"), "nth", "size")


@_q("root_commit_files", "with recursive r as (select id, id as root from v_projects where forked_from is null or forked_from not in (select id from v_projects) union all select p.id, r.root from r join v_projects p on p.forked_from = r.id) select distinct r.root, c.commit_id, f.filename from r join v_project_commits c on c.project_id = r.id left join v_commit_files f on f.commit_id = c.commit_id")
def root_commit_files(spark, sf_dir):
    """Commits and the files they change, once for each root repository; the file is null where none is known."""
    t = Tables(spark, sf_dir)
    commits = t.v_project_commits.join(fork_roots(t.v_projects).withColumnRenamed("node", "project_id"), "project_id").select("root", "commit_id").distinct()
    return commits.join(t.v_commit_files.select("commit_id", "filename").distinct(), "commit_id", "left").select("root", "commit_id", "filename")
