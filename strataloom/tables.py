"""Views that give the repository-mining schemas over the base tables, the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "embeddings")

#: name -> SELECT over base tables and earlier views
VIEWS = {
    "v_users": """select c_custkey as id, c_name as login, c_mktsegment as company, c_nationkey as location,
       concat('u', c_custkey % 500, '@host', c_nationkey % 3, '.org') as email from customer""",
    "v_projects": """select s_suppkey as id, s_name as name, s_nationkey as language,
       case when s_suppkey % 3 = 0 then null else cast(floor(s_suppkey / 3) as bigint) end as forked_from from supplier""",
    "v_commits": """select o_orderkey as id, o_custkey as author_id, o_custkey as committer_id,
       min(l_suppkey) as project_id, o_orderdate as created_at
       from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderdate""",
    "v_project_commits": "select distinct l_suppkey as project_id, l_orderkey as commit_id from lineitem",
    "v_commit_files": """select l_orderkey as commit_id, l_partkey as file_id, concat(p_name, '/', p_partkey, '.', lower(p_type)) as filename,
       cast(l_quantity as bigint) as additions, cast(round(l_tax * 100) as bigint) as deletions
       from lineitem join part on p_partkey = l_partkey""",
    "v_commit_parents": """select commit_id, parent_id from (
       select id as commit_id, lag(id) over (partition by author_id order by created_at, id) as parent_id from v_commits) t
       where parent_id is not null""",
    "v_project_members": """select project_id as repo_id, author_id as user_id, min(created_at) as created_at
       from v_commits group by project_id, author_id""",
    "v_issue_events": """select event_id as id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as issue_id,
       user_id as actor_id, event_type as event, ts as created_at from events""",
    "v_issues": "select distinct issue_id as id, issue_id % 20 as repo_id from v_issue_events",
    "v_watchers": """select issue_id as repo_id, actor_id as user_id, min(created_at) as created_at from v_issue_events
       where event = 'view' group by issue_id, actor_id""",
    "v_followers": """select distinct o_custkey as src, l_partkey % 1500 as dst from orders join lineitem on l_orderkey = o_orderkey""",
    "v_edges": "select distinct least(src, dst) as a, greatest(src, dst) as b from v_followers where src <> dst",
    "v_bipartite": "select project_id as repo_id, author_id as user_id, count(*) as weight from v_commits group by project_id, author_id",
    "v_size_log": """select path, new_size / old_size as factor, new_size, old_size, seq from (
       select l_partkey as path, l_extendedprice as new_size,
       lag(l_extendedprice) over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) as old_size,
       row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) as seq
       from lineitem) t where old_size is not null""",
    "v_messages": "select doc_id as id, case when doc_id % 3 = 0 then concat(text, ' fix #', doc_id) else text end as message from documents",
    "v_bugs": """select id as sha, author_id as introducer, (author_id + id) % 1500 as fixer from v_commits where id % 5 = 0""",
}


class Tables:
    """Base tables and views of one folder, as lazy DataFrames: ``Tables(spark, dir).v_commits``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in VIEWS:
                needs = {t: getattr(self, t) for t in _mentioned(VIEWS[name]) if t != name}
                sql = VIEWS[name]
                for t in sorted(needs, key=len, reverse=True):
                    sql = _swap(sql, t)
                self._known[name] = self._spark.sql(sql, **{f"df_{t}": d for t, d in needs.items()})
            else:
                self._known[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._known[name]

    def sql(self, sql: str) -> DataFrame:
        """Run SQL that names base tables and views."""
        needs = {t: getattr(self, t) for t in _mentioned(sql)}
        for t in sorted(needs, key=len, reverse=True):
            sql = _swap(sql, t)
        return self._spark.sql(sql, **{f"df_{t}": d for t, d in needs.items()})


def _words(sql: str) -> set[str]:
    import re

    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))


def _mentioned(sql: str) -> list[str]:
    return [t for t in (*VIEWS, *BASE) if _follows_from(sql, t)]


def _follows_from(sql: str, table: str) -> bool:
    import re

    return re.search(rf"(?i)\b(from|join)\s+{table}\b", sql) is not None


def _swap(sql: str, table: str) -> str:
    import re

    return re.sub(rf"(?i)\b(from|join)(\s+){table}\b", rf"\1\2{{df_{table}}}", sql)


def oracle(sql: str) -> str:
    """DuckDB SQL: the views that ``sql`` names, and those they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for t in VIEWS:
            if t not in needed and t in _words(text):
                need(VIEWS[t])
                needed.append(t)

    need(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{t} as ({VIEWS[t]})" for t in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
