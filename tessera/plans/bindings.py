"""Evidence-shaped views of the test tables. Each text is SQL that Spark and DuckDB both run; {t} names table t."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.store import ROWS, tasks

#: The moment that queries take as now, so that results don't hang on the clock.
NOW = "2024-01-31 00:00:00"

VIEWS = {
    "evidence": """
SELECT event_id, CAST((user_id * 100 + day(ts)) % 1500 AS BIGINT) AS candidate_id, CAST(user_id * 100 + day(ts) AS BIGINT) AS person_id,
  CASE event_type WHEN 'signup' THEN 'profile_observed' WHEN 'click' THEN 'project_created' WHEN 'view' THEN 'paper_published'
    WHEN 'purchase' THEN 'competition_result' ELSE 'social_graph_signal' END AS type,
  CASE event_id % 6 WHEN 0 THEN 'github' WHEN 1 THEN 'openalex' WHEN 2 THEN 'hacker-news' WHEN 3 THEN 'rss' WHEN 4 THEN 'x' ELSE 'people-data-labs' END AS source,
  concat('https://', CASE WHEN event_id % 2 = 0 THEN 'www.' ELSE '' END,
    CASE event_id % 7 WHEN 0 THEN 'a.example' WHEN 1 THEN 'b.example' WHEN 2 THEN 'c.example' WHEN 3 THEN 'localhost' WHEN 4 THEN 'd.local' ELSE 'e.example' END,
    '/p/', CAST(event_id % 400 AS VARCHAR(20))) AS source_url,
  concat('Result ', CAST(event_id % 40 AS VARCHAR(20)), ' of ', event_type) AS title,
  CASE WHEN event_id % 5 = 0 THEN 'verified-provider-subject' WHEN event_id % 5 = 1 THEN 'manual-roster-deep-dive' ELSE 'plain' END AS tag,
  ts AS discovered_at, ts - INTERVAL '1' DAY * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS occurred_at,
  CAST(0.3 AS DOUBLE) + CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 70 AS DOUBLE) / 100 AS confidence,
  value AS momentum,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 + event_id % 60 ELSE 0 END AS DOUBLE) AS rank,
  CAST(CASE WHEN event_type = 'view' THEN event_id % 90 ELSE 0 END AS DOUBLE) AS citations,
  CAST(CASE WHEN event_type = 'signup' THEN event_id % 120 ELSE 0 END AS DOUBLE) AS activity90d,
  CAST(CASE WHEN event_type = 'signup' THEN event_id % 9000 ELSE 0 END AS DOUBLE) AS followers,
  CAST(CASE WHEN event_type = 'click' THEN event_id % 100 ELSE 0 END AS DOUBLE) / 100 AS complexity,
  CAST(CASE WHEN event_type = 'click' THEN event_id % 50 ELSE 0 END AS DOUBLE) / 50 AS complexity_confidence,
  CAST(CASE WHEN event_type = 'error' THEN event_id % 30 ELSE 0 END AS DOUBLE) / 10 AS graph_weight,
  CAST(event_id % 101 AS DOUBLE) AS novelty,
  md5(CAST(event_id AS VARCHAR(20))) AS content_hash
FROM {events}""",
    "candidate": """
SELECT c_custkey AS candidate_id, c_name AS name, n_name AS location, c_mktsegment AS stage,
  CASE c_custkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'watching' WHEN 2 THEN 'saved' WHEN 3 THEN 'passed' ELSE 'archived' END AS status,
  abs(c_acctbal) / 100 AS score, CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence, CAST(c_custkey % 37 AS DOUBLE) - 5 AS momentum,
  CASE WHEN c_custkey % 3 = 0 THEN 'resolved' WHEN c_custkey % 3 = 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "edge": """
SELECT o_custkey AS source_id, l_suppkey AS target_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'follows' WHEN 1 THEN 'collaborates_with' WHEN 2 THEN 'coauthors_with' ELSE 'engages_with' END AS relation,
  concat('https://e.example/', CAST(o_orderkey % 500 AS VARCHAR(20))) AS source_url,
  CAST(0.05 AS DOUBLE) + CAST(l_quantity AS DOUBLE) / 60 AS weight, l_shipdate AS observed_at
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "feedback": """
SELECT o_orderkey AS feedback_id, o_custkey AS candidate_id, o_orderdate AS created_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'accept' WHEN '2-HIGH' THEN 'save' WHEN '3-MEDIUM' THEN 'watch' WHEN '4-NOT SPECIFIED' THEN 'contact' ELSE 'pass' END AS action,
  o_totalprice AS total
FROM {orders}""",
    "digest_item": """
SELECT DISTINCT date_trunc('week', o_orderdate) AS scheduled_for, o_custkey AS candidate_id,
  CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'ready' ELSE 'failed' END AS status
FROM {orders}""",
}


#: Tables that a view joins with each other, and by which column.
JOINED = {"edge": {"orders": "o_orderkey", "lineitem": "l_orderkey"}}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table if there is no view of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)}
    rows = sum(tables[t].count() for t in JOINED.get(name, ()))
    if rows > ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        for t, key in JOINED[name].items():  # a task of the join sorts no more than ROWS
            used = [c for c in tables[t].columns if re.search(rf"\b{c}\b", sql)]
            tables[t] = tables[t].select(*used).repartition(tasks(spark, rows), key)
    return spark.sql(sql, **tables)


def oracle(sql: str) -> str:
    """DuckDB SQL in which the views that `sql` names as {view} come first; other names in braces are tables."""
    used = [v for v in tables_of(sql) if v in VIEWS]
    texts = [f"v_{v} AS ({VIEWS[v].format(**{t: t for t in tables_of(VIEWS[v])})})" for v in used]
    body = sql.format(**{t: f"v_{t}" if t in VIEWS else t for t in tables_of(sql)}).strip()
    if not texts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(texts) + ", " + body[len("WITH RECURSIVE") :]
    return "WITH " + ", ".join(texts) + (", " + body[4:] if body.upper().startswith("WITH") else " " + body)
