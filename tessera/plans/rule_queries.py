"""Queries of rules over evidence and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.plans.bindings import NOW
from tessera.plans.registry import query


@query("f09_contact_routes", "customer", oracle="""WITH r AS (SELECT c_custkey // 4 AS candidate_id, CASE c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'website' WHEN 2 THEN 'github' ELSE 'x' END AS kind, CASE c_custkey % 4 WHEN 0 THEN concat('mailto:a@b', CAST(c_custkey AS VARCHAR), '.org') WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'http://10.0.0.1/' ELSE concat('https://w.example/', CAST(c_custkey AS VARCHAR)) END WHEN 2 THEN concat('https://github.com/u', CAST(c_custkey AS VARCHAR)) ELSE concat('https://x.com/u', CAST(c_custkey AS VARCHAR)) END AS url, CAST(80 + c_custkey % 20 AS DOUBLE) / 100 AS confidence, CASE WHEN c_custkey // 4 % 5 = 0 THEN 'High School' ELSE 'Work' END AS stage, c_custkey FROM customer)
SELECT candidate_id, url, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE kind WHEN 'email' THEN 1 WHEN 'website' THEN 2 WHEN 'github' THEN 4 ELSE 5 END, confidence DESC, url) AS place FROM r WHERE c_custkey % 7 <> 0 AND confidence >= 0.85 AND NOT (kind = 'email' AND stage = 'High School') AND url <> 'http://10.0.0.1/'""")
def f09(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "email").when(k % 4 == 1, "website").when(k % 4 == 2, "github").otherwise("x")
    url = F.when(k % 4 == 0, F.concat(F.lit("mailto:a@b"), k, F.lit(".org"))).when(k % 4 == 1, F.when(k % 3 == 0, "http://10.0.0.1/").otherwise(F.concat(F.lit("https://w.example/"), k))).when(k % 4 == 2, F.concat(F.lit("https://github.com/u"), k)).otherwise(F.concat(F.lit("https://x.com/u"), k))
    c = F.floor(k / 4)
    return R.contact_routes(customer.select(c.alias("candidate_id"), kind.alias("kind"), url.alias("url"), (k % 7 != 0).alias("verified"), ((80 + k % 20).cast("double") / 100).alias("confidence"), F.when(c % 5 == 0, "High School").otherwise("Work").alias("stage"))).select("candidate_id", "url", "place")


@query("f13_unsupported_agency", "events", oracle="SELECT event_id AS fact_id, 'found' AS root FROM events WHERE event_id % 3 = 0 AND event_type <> 'purchase'")
def f13(events: DataFrame) -> DataFrame:
    facts = events.select(F.col("event_id").alias("fact_id"), "event_id", F.when(F.col("event_id") % 3 == 0, "Founded a lab").otherwise("Wrote a paper").alias("fact"))
    own = events.select("event_id", F.when(F.col("event_type") == "purchase", "the founder of it").otherwise("nothing").alias("text"))
    return R.unsupported_agency(facts, own)


@query("x13_characteristics", "evidence", oracle="SELECT candidate_id, rule, n >= least AS matched, n FROM (SELECT candidate_id, 'buys' AS rule, 2 AS least, count(*) FILTER (WHERE type = 'competition_result') AS n FROM {evidence} GROUP BY 1 UNION ALL SELECT candidate_id, 'reads or clicks', 5, count(*) FILTER (WHERE type IN ('paper_published', 'project_created')) FROM {evidence} GROUP BY 1)")
def x13(evidence: DataFrame) -> DataFrame:
    return R.characteristics(evidence.withColumn("text", F.col("title")), [{"name": "buys", "terms": ["Purchase"], "least": 2}, {"name": "reads or clicks", "terms": ["view", "click"], "least": 5}])


@query("o05_release_brief", "candidate", "evidence", oracle=f"SELECT candidate_id, CASE WHEN newest > TIMESTAMP '2024-01-20 00:00:00' THEN TIMESTAMP '{NOW}' WHEN candidate_id % 3 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 24 HOUR WHEN candidate_id % 3 = 1 THEN TIMESTAMP '{NOW}' + INTERVAL 6 HOUR END AS retry_at FROM (SELECT candidate_id FROM {{candidate}}) LEFT JOIN (SELECT candidate_id, max(discovered_at) AS newest FROM {{evidence}} GROUP BY 1) USING (candidate_id)")
def o05(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    kind = F.when(F.col("candidate_id") % 3 == 0, "generation").when(F.col("candidate_id") % 3 == 1, "transient").otherwise("contract")
    f = candidate.select("candidate_id", kind.alias("kind"), F.lit("2024-01-20 00:00:00").cast("timestamp").alias("failed_at"))
    # A far date means never; it doesn't fit every client, so the report shows null.
    return R.release_brief(f, evidence, NOW).withColumn("retry_at", F.when(F.year("retry_at") < 9999, F.col("retry_at")))


@query("o06_due_sources", "orders", oracle="SELECT o_orderkey AS source_id, o_orderdate AS due_at FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1999-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def o06(orders: DataFrame) -> DataFrame:
    s = orders.select(F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("due_at"), (F.col("o_orderpriority") != "5-LOW").alias("enabled"), F.when(F.col("o_orderstatus") == "P", "paused").otherwise("active").alias("state"))
    return R.due_sources(s, "1999-01-01 00:00:00").select("source_id", "due_at")


@query("d09_equivalent_citations", "evidence", oracle="""WITH x AS (SELECT event_id, regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS work, regexp_replace(lower(regexp_extract(source_url, '^https?://([^/?#:]+)', 1)), '^www[.]', '') AS host FROM {evidence}),
g AS (SELECT work, host AS other_host, min(event_id) AS other FROM x GROUP BY work, host), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY work ORDER BY other) <= 2) SELECT event_id, min(other) AS other FROM x JOIN f USING (work) WHERE host <> other_host GROUP BY 1""")
def d09(evidence: DataFrame) -> DataFrame:
    return R.equivalent_citations(evidence)


@query("r03_backfill_runs", "events", oracle="SELECT event_id, run AS run_id FROM events JOIN (SELECT date_trunc('hour', ts) AS started, min(event_id) AS run FROM events WHERE event_id % 40 = 0 GROUP BY 1 HAVING count(*) = 1) r ON date_trunc('hour', ts) = r.started")
def r03(events: DataFrame) -> DataFrame:
    from tessera.operators.joins import unique_match

    hour = events.select("event_id", F.date_trunc("hour", "ts").alias("at"))
    return unique_match(hour, hour.filter("event_id % 40 = 0").select(F.col("at").alias("started"), F.col("event_id").alias("run_id")), "event_id", "at", "started", "run_id")


@query("u04_overlap", "orders", oracle="SELECT o_custkey, max(CAST(o_orderpriority = '1-URGENT' AS INT)) + max(CAST(o_orderpriority = '5-LOW' AS INT)) > 0 AS overlap FROM orders GROUP BY 1")
def u04(orders: DataFrame) -> DataFrame:
    own = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return own.select("o_custkey", (F.size(F.array_intersect("p", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))) > 0).alias("overlap"))


@query("w05_rank_digest_items", "digest_item", "candidate", oracle="SELECT scheduled_for, candidate_id, row_number() OVER (PARTITION BY scheduled_for ORDER BY score DESC, candidate_id) AS place FROM (SELECT DISTINCT scheduled_for, candidate_id, score FROM {digest_item} JOIN {candidate} USING (candidate_id))")
def w05(digest_item: DataFrame, candidate: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    x = digest_item.join(candidate.select("candidate_id", "score"), "candidate_id").select("scheduled_for", "candidate_id", "score").distinct()
    return x.select("scheduled_for", "candidate_id", F.row_number().over(Window.partitionBy("scheduled_for").orderBy(F.desc("score"), "candidate_id")).alias("place"))
