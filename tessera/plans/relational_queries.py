"""Queries of joins, windows, aggregations, top-k, sets, filters and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import publisher_host
from tessera.operators import aggregates as A
from tessera.operators import digest as D
from tessera.operators import filters as FI
from tessera.operators import joins as J
from tessera.operators import scoring as S
from tessera.operators import topk as O
from tessera.operators import windows as W
from tessera.plans.bindings import NOW
from tessera.plans.registry import query
from tessera.plans.scoring_queries import COUNTED, PUBLIC

EARLY = "2001-07-20 00:00:00"


# Joins


@query("j01_with_evidence", "candidate", "evidence", oracle="SELECT c.candidate_id, c.status, e.n, round(e.momentum, 6) AS momentum FROM {candidate} c JOIN (SELECT candidate_id, count(*) AS n, max(momentum) AS momentum FROM {evidence} GROUP BY 1) e USING (candidate_id)")
def j01(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    agg = evidence.groupBy("candidate_id").agg(F.count("*").alias("n"), F.round(F.max("momentum"), 6).alias("momentum"))
    return candidate.select("candidate_id", "status").join(agg, "candidate_id")


@query("j02_latest_event", "candidate", "evidence", oracle="SELECT c.candidate_id, coalesce(l.event_id, -1) AS event_id, l.type, l.discovered_at FROM {candidate} c LEFT JOIN (SELECT candidate_id, event_id, type, discovered_at FROM {evidence} QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY discovered_at DESC, event_id DESC) = 1) l USING (candidate_id)")
def j02(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    newest = J.latest(evidence, "candidate_id", ["discovered_at", "event_id"], ["event_id", "type", "discovered_at"])
    return candidate.select("candidate_id").join(newest, "candidate_id", "left").fillna(-1, ["event_id"])


@query("j03_having_any", "candidate", "evidence", oracle="SELECT candidate_id, status FROM {candidate} c WHERE EXISTS (SELECT 1 FROM {evidence} e WHERE e.candidate_id = c.candidate_id AND tag = 'manual-roster-deep-dive') AND resolution = 'resolved'")
def j03(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return J.having_any(candidate.filter("resolution = 'resolved'"), evidence.filter("tag = 'manual-roster-deep-dive'"), "candidate_id").select("candidate_id", "status")


@query("j04_exclude_recent", "candidate", "digest_item", oracle=f"SELECT candidate_id, status FROM {{candidate}} c WHERE NOT EXISTS (SELECT 1 FROM {{digest_item}} d WHERE d.candidate_id = c.candidate_id AND d.status <> 'failed' AND d.scheduled_for >= TIMESTAMP '{EARLY}' - INTERVAL 21 DAY)")
def j04(candidate: DataFrame, digest_item: DataFrame) -> DataFrame:
    return J.exclude_recent(candidate, digest_item, "candidate_id", F.lit(EARLY).cast("timestamp") - F.expr("INTERVAL 21 DAYS")).select("candidate_id", "status")


@query("j05_with_params", "candidate", oracle="SELECT candidate_id, score - p.mean AS above FROM {candidate}, (SELECT round(avg(score), 3) AS mean FROM {candidate}) p WHERE score > p.mean")
def j05(candidate: DataFrame) -> DataFrame:
    # One row of parameters.
    params = candidate.agg(F.round(F.avg("score"), 3).alias("mean"))
    return candidate.crossJoin(F.broadcast(params)).filter("score > mean").select("candidate_id", (F.col("score") - F.col("mean")).alias("above"))


@query("j06_with_priority", "candidate", "evidence", oracle="SELECT c.candidate_id, coalesce(e.deep, false) AS deep, e.best_rank FROM {candidate} c LEFT JOIN (SELECT candidate_id, bool_or(tag = 'manual-roster-deep-dive') AS deep, min(rank) FILTER (WHERE rank > 0) AS best_rank FROM {evidence} GROUP BY 1) e USING (candidate_id)")
def j06(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    agg = evidence.groupBy("candidate_id").agg(F.max(F.col("tag") == "manual-roster-deep-dive").alias("deep"), F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("best_rank"))
    return candidate.select("candidate_id").join(agg, "candidate_id", "left").fillna(False, ["deep"])


@query("j07_undirected", "edge", oracle="SELECT id, count(*) AS degree, round(sum(weight), 4) AS weight FROM (SELECT source_id AS id, weight FROM {edge} UNION ALL SELECT target_id, weight FROM {edge}) GROUP BY id")
def j07(edge: DataFrame) -> DataFrame:
    both = J.undirected(edge.select("source_id", "target_id", "weight"), "source_id", "target_id")
    return both.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 4).alias("weight"))


@query("j08_match_suffix", "evidence", "supplier", oracle="SELECT event_id, s_suppkey FROM {evidence} JOIN supplier ON concat('author:', CAST(event_id % 300 AS VARCHAR)) LIKE concat('%:', CAST(s_suppkey AS VARCHAR))")
def j08(evidence: DataFrame, supplier: DataFrame) -> DataFrame:
    key = F.regexp_extract(F.concat(F.lit("author:"), (F.col("event_id") % 300).cast("string")), ":([^:]+)$", 1)
    return evidence.withColumn("subject", key).join(supplier.withColumn("subject", F.col("s_suppkey").cast("string")), "subject").select("event_id", "s_suppkey")


@query("j09_match_prefix", "evidence", oracle="SELECT event_id, candidate_id FROM {evidence} WHERE starts_with(lower(title), concat('result ', CAST(candidate_id % 40 AS VARCHAR), ' of'))")
def j09(evidence: DataFrame) -> DataFrame:
    return evidence.filter(F.lower("title").startswith(F.concat(F.lit("result "), (F.col("candidate_id") % 40).cast("string"), F.lit(" of")))).select("event_id", "candidate_id")


@query("j10_unique_match", "events", "orders", oracle="SELECT event_id, run AS run_id FROM events JOIN (SELECT date_trunc('minute', ts) AS started, min(event_id) AS run FROM events WHERE event_type = 'signup' GROUP BY 1 HAVING count(*) = 1) r ON date_trunc('minute', ts) = r.started")
def j10(events: DataFrame, orders: DataFrame) -> DataFrame:
    minute = events.select("event_id", "event_type", F.date_trunc("minute", "ts").alias("at"))
    runs = minute.filter("event_type = 'signup'").select(F.col("at").alias("started"), F.col("event_id").alias("run_id"))
    return J.unique_match(minute, runs, "event_id", "at", "started", "run_id")


@query("j11_anchored_mismatches", "evidence", oracle="SELECT event_id, candidate_id FROM {evidence} e WHERE source = 'openalex' AND tag <> 'plain' AND candidate_id IN (SELECT candidate_id FROM {evidence} WHERE source = 'openalex' AND tag = 'plain')")
def j11(evidence: DataFrame) -> DataFrame:
    own = evidence.filter("source = 'openalex'")
    return J.having_any(own.filter("tag <> 'plain'"), own.filter("tag = 'plain'"), "candidate_id").select("event_id", "candidate_id")


@query("j12_block", "supplier", "customer", oracle="""WITH i AS (SELECT c_custkey AS identity_id, c_nationkey AS nation, CAST(c_custkey % 50 AS VARCHAR) AS name_key FROM customer),
o AS (SELECT s_suppkey AS observation_id, s_nationkey AS nation, CAST(s_suppkey AS VARCHAR) AS name_key FROM supplier)
SELECT observation_id, identity_id FROM o JOIN (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY identity_id) <= 10) i USING (name_key)
UNION SELECT observation_id, identity_id FROM o JOIN (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY nation ORDER BY identity_id) <= 3) i USING (nation)""")
def j12(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    o = supplier.select(F.col("s_suppkey").alias("observation_id"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").cast("string").alias("name_key"))
    i = customer.select(F.col("c_custkey").alias("identity_id"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).cast("string").alias("name_key"))
    return J.block(o, i, {"name_key": 10, "nation": 3})


@query("j13_share_any", "supplier", "part", oracle="""SELECT DISTINCT s_suppkey, p_partkey FROM (SELECT s_suppkey, unnest([s_suppkey % 90, s_suppkey % 70]) AS v FROM supplier) JOIN (SELECT p_partkey, unnest([p_partkey % 95, p_size + 40]) AS v FROM part) USING (v)""")
def j13(supplier: DataFrame, part: DataFrame) -> DataFrame:
    a = supplier.select("s_suppkey", F.array(F.col("s_suppkey") % 90, F.col("s_suppkey") % 70).alias("values"))
    b = part.select("p_partkey", F.array(F.col("p_partkey") % 95, (F.col("p_size") + 40).cast("long")).alias("values"))
    return J.share_any(a, b, "s_suppkey", "p_partkey", "values")


@query("j14_link_authorships", "evidence", oracle="SELECT a.event_id AS left_id, b.event_id AS right_id FROM {evidence} a JOIN {evidence} b ON a.type = 'paper_published' AND b.type = 'paper_published' AND a.source = 'openalex' AND b.source = 'rss' AND a.event_id // 6 = b.event_id // 6")
def j14(evidence: DataFrame) -> DataFrame:
    work = F.floor(F.col("event_id") / 6)
    papers = evidence.filter("type = 'paper_published'").select("event_id", "source", F.concat(F.lit("10.1234/w"), work).alias("doi"), (1 + work % 3).alias("place"))
    own = lambda source, name: papers.filter(F.col("source") == source).select(F.col("event_id").alias(name), "doi", "place")
    return J.link_authorships(own("openalex", "left_id"), own("rss", "right_id")).select("left_id", "right_id")


CALENDAR_SQL = """ends AS (SELECT profile_id, d + INTERVAL 1 HOUR * h + INTERVAL 1 MINUTE * m AS period_end FROM (
    SELECT n_nationkey AS profile_id, least(23, n_nationkey) AS h, CAST(floor(least(59, n_nationkey * 7) / 15) AS INT) * 15 AS m, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d FROM nation)
  WHERE dayofweek(d) IN (profile_id % 7, 4)),
calendar AS (SELECT * FROM (SELECT profile_id, lag(period_end) OVER (PARTITION BY profile_id ORDER BY period_end) AS period_start, period_end FROM ends) WHERE period_start IS NOT NULL)"""


def _calendar(nation: DataFrame) -> DataFrame:
    profiles = nation.select(F.col("n_nationkey").alias("profile_id"), F.array(F.col("n_nationkey") % 7, F.lit(4)).alias("days"), F.col("n_nationkey").alias("hour"), (F.col("n_nationkey") * 7).alias("minute"))
    return D.calendar(profiles, "2024-01-01", "2024-01-31")


@query("d05_digest_calendar", "nation", oracle=f"WITH {CALENDAR_SQL} SELECT profile_id, period_start, period_end FROM calendar")
def d05(nation: DataFrame) -> DataFrame:
    return _calendar(nation)


@query("j15_in_period", "evidence", "nation", oracle=f"WITH {CALENDAR_SQL} SELECT profile_id, period_end, count(*) AS n FROM {{evidence}} JOIN calendar ON discovered_at > period_start AND discovered_at <= period_end GROUP BY ALL")
def j15(evidence: DataFrame, nation: DataFrame) -> DataFrame:
    return J.in_period(evidence.select("event_id", "discovered_at"), _calendar(nation), "discovered_at").groupBy("profile_id", "period_end").agg(F.count("*").alias("n"))


# Windows


@query("w01_dedup_evidence", "evidence", oracle="SELECT source_url, event_id, round(confidence, 6) AS confidence FROM {evidence} QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY confidence DESC, event_id) = 1")
def w01(evidence: DataFrame) -> DataFrame:
    return W.dedup_evidence(evidence, "source_url").select("source_url", "event_id", F.round("confidence", 6).alias("confidence"))


@query("w02_distinct_on", "edge", oracle="SELECT target_id, source_id, source_url, round(weight, 6) AS weight FROM {edge} QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY weight DESC, source_id, source_url, relation, observed_at) = 1")
def w02(edge: DataFrame) -> DataFrame:
    one = W.first_of(edge, ["target_id"], [F.desc("weight"), F.asc("source_id"), F.asc("source_url"), F.asc("relation"), F.asc("observed_at")])
    return one.select("target_id", "source_id", "source_url", F.round("weight", 6).alias("weight"))


@query("w03_interleave", "evidence", oracle="SELECT event_id, source, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, event_id) AS turn FROM {evidence} ORDER BY turn, source LIMIT 20")
def w03(evidence: DataFrame) -> DataFrame:
    return W.interleave(evidence, "source", [F.desc("confidence"), F.asc("event_id")], 20).select("event_id", "source", "turn")


@query("w04_cap_per_group", "edge", oracle="SELECT source_id, target_id, relation, source_url FROM {edge} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, source_url, relation, observed_at) <= 5")
def w04(edge: DataFrame) -> DataFrame:
    return W.cap_per_group(edge, ["source_id"], [F.desc("weight"), F.asc("target_id"), F.asc("source_url"), F.asc("relation"), F.asc("observed_at")], 5).select("source_id", "target_id", "relation", "source_url")


@query("w06_first_last_seen", "evidence", oracle="SELECT candidate_id, min(discovered_at) AS first_seen, max(discovered_at) AS last_seen FROM {evidence} GROUP BY 1")
def w06(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("candidate_id").agg(F.min("discovered_at").alias("first_seen"), F.max("discovered_at").alias("last_seen"))


@query("w07_fixed_window", "events", oracle="""SELECT event_id, n <= 2 AS allowed, greatest(0, 2 - n) AS remaining, CASE WHEN n > 2 THEN s + 86400 - e ELSE 0 END AS retry_after FROM (
SELECT event_id, e, CAST(floor(e / 86400) AS BIGINT) * 86400 AS s, row_number() OVER (PARTITION BY user_id, floor(e / 86400) ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events))""")
def w07(events: DataFrame) -> DataFrame:
    return W.fixed_window_counter(events, "user_id", "ts", 2, 86400).select("event_id", "allowed", "remaining", "retry_after")


@query("w08_rotate_queue", "supplier", oracle="SELECT s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 + count(*) OVER (PARTITION BY s_nationkey) - 3 % count(*) OVER (PARTITION BY s_nationkey)) % count(*) OVER (PARTITION BY s_nationkey) AS place FROM supplier")
def w08(supplier: DataFrame) -> DataFrame:
    return W.rotate(supplier, "s_nationkey", [F.asc("s_suppkey")], 3).select("s_suppkey", "place")


@query("w09_active_version", "orders", oracle="SELECT o_orderkey AS criterion_id, row_number() OVER w AS version, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) THEN 'active' ELSE 'retired' END AS state FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w09(orders: DataFrame) -> DataFrame:
    c = orders.select(F.col("o_orderkey").alias("criterion_id"), F.col("o_orderdate").alias("created_at"), "o_custkey")
    return W.active_version(c, "o_custkey").select("criterion_id", "version", "state")


# Digests

DIGEST_SQL = f"""SELECT c.candidate_id, c.status, round(c.score * 0.62::DOUBLE + greatest(0, c.momentum) * 0.18::DOUBLE + c.confidence * 100 * 0.12::DOUBLE + least(100, coalesce(l.novelty, 0)) * 0.08::DOUBLE, 6) AS digest_rank_score, l.discovered_at
FROM {{candidate}} c LEFT JOIN (SELECT candidate_id, discovered_at, novelty FROM {{evidence}} QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY discovered_at DESC, event_id DESC) = 1) l USING (candidate_id)
WHERE c.status IN ('new', 'watching', 'saved') AND c.score >= 60 AND NOT EXISTS (SELECT 1 FROM {{digest_item}} d WHERE d.candidate_id = c.candidate_id AND d.status <> 'failed' AND d.scheduled_for >= TIMESTAMP '{EARLY}' - INTERVAL 21 DAY)
ORDER BY 3 DESC, l.discovered_at DESC NULLS LAST, c.candidate_id LIMIT 20"""


@query("d01_digest_rank", "candidate", "evidence", "digest_item", oracle=DIGEST_SQL)
def d01(candidate: DataFrame, evidence: DataFrame, digest_item: DataFrame) -> DataFrame:
    x = D.rank_for_digest(candidate, evidence, digest_item, EARLY)
    return x.select("candidate_id", "status", F.round("digest_rank_score", 6).alias("digest_rank_score"), "discovered_at")


@query("d02_diverse_pick", "candidate", oracle="""WITH r AS (SELECT candidate_id, stage, score, row_number() OVER (ORDER BY score DESC, candidate_id) AS place FROM {candidate} ORDER BY score DESC, candidate_id LIMIT 60),
t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY stage ORDER BY score DESC, candidate_id) <= 4 THEN 0 ELSE 1 END AS tier FROM r)
SELECT candidate_id, stage, tier FROM t ORDER BY tier, score DESC, candidate_id LIMIT 12""")
def d02(candidate: DataFrame) -> DataFrame:
    order = [F.desc("score"), F.asc("candidate_id")]
    return D.diverse_pick(candidate.orderBy(*order).limit(60), "stage", order, 12).select("candidate_id", "stage", "tier")


@query("d04_freeze_digest", "digest_item", oracle="""WITH old AS (SELECT scheduled_for, candidate_id, status FROM {digest_item} WHERE scheduled_for < TIMESTAMP '1999-01-01'), new AS (SELECT scheduled_for, candidate_id + 1000000 AS candidate_id, 'ready' AS status FROM {digest_item} WHERE scheduled_for > TIMESTAMP '1998-06-01')
SELECT * FROM old UNION ALL SELECT * FROM new WHERE scheduled_for NOT IN (SELECT scheduled_for FROM old)""")
def d04(digest_item: DataFrame) -> DataFrame:
    old = digest_item.filter("scheduled_for < TIMESTAMP '1999-01-01'")
    new = digest_item.filter("scheduled_for > TIMESTAMP '1998-06-01'").select("scheduled_for", (F.col("candidate_id") + 1000000).alias("candidate_id"), F.lit("ready").alias("status"))
    return D.freeze(old, new, "scheduled_for")


@query("d06_delivery_claims", "digest_item", oracle="""SELECT scheduled_for, status, count(*) AS n FROM {digest_item} WHERE scheduled_for <= TIMESTAMP '1998-03-02 06:00:00' AND (status = 'ready' OR (status = 'failed' AND epoch(TIMESTAMP '1998-03-02 06:00:00' - scheduled_for) / 60 <= 720)) GROUP BY ALL""")
def d06(digest_item: DataFrame) -> DataFrame:
    return D.claimable(digest_item, "1998-03-02 06:00:00").groupBy("scheduled_for", "status").agg(F.count("*").alias("n"))


@query("d07_recipients", "customer", oracle="SELECT email, name, (row_number() OVER (ORDER BY substr(md5(email), 1, 2), email) - 1) // 100 AS batch FROM (SELECT concat('c', CAST(c_custkey // 2 AS VARCHAR), '@mail.example') AS email, max(c_name) AS name FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1)")
def d07(customer: DataFrame) -> DataFrame:
    s = customer.select(F.when(F.col("c_custkey") % 11 == 0, "nobody").otherwise(F.concat(F.lit(" C"), F.floor(F.col("c_custkey") / 2).cast("string"), F.lit("@mail.example"))).alias("email"), F.col("c_name").alias("name"))
    return D.recipients(s)


@query("d08_diverse_evidence", "evidence", oracle=f"WITH p AS (SELECT event_id, candidate_id, {PUBLIC} AS host, 10 * confidence + ln(1 + momentum) + ln(1 + citations) + CASE WHEN rank > 0 THEN 4 / sqrt(rank) ELSE 0 END AS priority FROM {{evidence}}), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, host ORDER BY priority DESC, event_id) AS turn FROM p WHERE host IS NOT NULL) SELECT candidate_id, event_id, turn FROM r QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY turn, priority DESC, event_id) <= 4")
def d08(evidence: DataFrame) -> DataFrame:
    x = evidence.withColumn("priority", S.event_priority()).withColumn("host", publisher_host("source_url")).filter("host IS NOT NULL")
    from pyspark.sql.window import Window

    x = x.withColumn("turn", F.row_number().over(Window.partitionBy("candidate_id", "host").orderBy(F.desc("priority"), "event_id")))
    return W.cap_per_group(x, ["candidate_id"], [F.asc("turn"), F.desc("priority"), F.asc("event_id")], 4).select("candidate_id", "event_id", "turn")


# Aggregations


@query("a01_evidence_fingerprint", "evidence", oracle="SELECT candidate_id, md5(concat('v1|', string_agg(content_hash, '' ORDER BY discovered_at, event_id))) AS fingerprint, max(discovered_at) AS latest, count(*) AS n FROM {evidence} GROUP BY 1")
def a01(evidence: DataFrame) -> DataFrame:
    return A.evidence_fingerprint(evidence, "candidate_id", "v1")


@query("a03_dominant_publisher", "evidence", oracle=f"SELECT candidate_id, host, n FROM (SELECT candidate_id, {PUBLIC} AS host, count(*) AS n FROM {{evidence}} GROUP BY ALL) WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY n DESC, host) = 1")
def a03(evidence: DataFrame) -> DataFrame:
    return A.dominant_publisher(evidence, "candidate_id")


@query("a04_facet_counts", "candidate", "evidence", oracle="""WITH f AS (SELECT 'status' AS facet, candidate_id, status AS label FROM {candidate} UNION ALL SELECT 'stage', candidate_id, stage FROM {candidate} UNION ALL SELECT 'location', candidate_id, location FROM {candidate}
 UNION ALL SELECT DISTINCT 'event_type', candidate_id, type FROM {evidence} UNION ALL SELECT DISTINCT 'source', candidate_id, source FROM {evidence})
SELECT facet, value, n FROM (SELECT facet, lower(label) AS value, count(*) AS n FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 12""")
def a04(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return A.facet_counts(candidate, evidence)


@query("a05_dashboard_metrics", "candidate", "evidence", oracle=f"SELECT count(*) AS candidates, count(*) FILTER (WHERE score >= 80) AS strong, count(*) FILTER (WHERE resolution <> 'resolved') AS unresolved, (SELECT count(DISTINCT source) FROM {{evidence}}) AS sources, (SELECT count(*) FROM {{evidence}} WHERE discovered_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS fresh FROM {{candidate}}")
def a05(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return A.dashboard_metrics(candidate, evidence, NOW)


@query("a06_graph_support", "edge", oracle="SELECT target_id, count(DISTINCT source_id) AS sources, round(max(weight), 6) AS strongest, round(coalesce(sum(weight) FILTER (WHERE relation = 'coauthors_with'), 0), 4) AS coauthor, round(coalesce(sum(weight) FILTER (WHERE relation = 'collaborates_with'), 0), 4) AS collaboration, round(coalesce(sum(weight) FILTER (WHERE relation = 'engages_with'), 0), 4) AS engagement, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM {edge} GROUP BY 1")
def a06(edge: DataFrame) -> DataFrame:
    x = A.graph_support(edge, "target_id")
    return x.select("target_id", "sources", F.round("strongest", 6).alias("strongest"), *[F.round(c, 4).alias(c) for c in ("coauthor", "collaboration", "engagement")], F.array_join("relations", ",").alias("relations"))


@query("a07_coauthor_edges", "lineitem", oracle="SELECT a.l_suppkey AS a, b.l_suppkey AS b, round(least(1, 0.18::DOUBLE * count(*)), 6) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL")
def a07(lineitem: DataFrame) -> DataFrame:
    return A.coauthor_edges(lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("author")))


@query("a08_edge_upsert", "edge", oracle="SELECT source_id, target_id, relation, count(*) AS evidence_count, min(observed_at) AS first_seen, max(observed_at) AS last_seen, round(arg_max(weight, struct_pack(o := observed_at, w := weight)), 6) AS strength FROM {edge} GROUP BY ALL")
def a08(edge: DataFrame) -> DataFrame:
    return A.edge_upsert(edge)


@query("a09_target_support", "edge", oracle="SELECT target_id, round(sum(weight), 4) AS weight, count(DISTINCT source_id) AS sources FROM {edge} GROUP BY 1")
def a09(edge: DataFrame) -> DataFrame:
    return edge.groupBy("target_id").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count_distinct("source_id").alias("sources"))


@query("a11_run_event_priority", "evidence", oracle="SELECT candidate_id, round(max(10 * confidence + ln(1 + momentum) + ln(1 + citations) + CASE WHEN rank > 0 THEN 4 / sqrt(rank) ELSE 0 END), 6) AS priority FROM {evidence} GROUP BY 1")
def a11(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("candidate_id").agg(F.round(F.max(S.event_priority()), 6).alias("priority"))


@query("a12_research_trigger", "evidence", "candidate", oracle=f"SELECT c.candidate_id, greatest(c.candidate_id % 4, c.candidate_id % 3 + 1) AS revision, least(coalesce(e.first_change, TIMESTAMP '{NOW}'), TIMESTAMP '{NOW}') AS next_at, e.n FROM {{candidate}} c JOIN (SELECT candidate_id, count(*) AS n, min(discovered_at) AS first_change FROM {{evidence}} WHERE type <> 'profile_observed' GROUP BY 1) e USING (candidate_id)")
def a12(evidence: DataFrame, candidate: DataFrame) -> DataFrame:
    state = candidate.select("candidate_id", (F.col("candidate_id") % 4).alias("input_revision"), (F.col("candidate_id") % 3).alias("completed_revision"))
    return A.research_trigger(evidence.filter("type <> 'profile_observed'"), state, NOW)


@query("a13_event_type_mix", "evidence", oracle="SELECT candidate_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {t}" for t in ("competition_result", "paper_published", "profile_observed", "project_created", "social_graph_signal")) + " FROM {evidence} GROUP BY 1")
def a13(evidence: DataFrame) -> DataFrame:
    types = ["competition_result", "paper_published", "profile_observed", "project_created", "social_graph_signal"]
    return evidence.groupBy("candidate_id").pivot("type", types).count().fillna(0)


# Sorts and top-k


@query("o01_prioritize_events", "evidence", oracle="SELECT event_id, round(10 * confidence + ln(1 + momentum) + ln(1 + citations) + CASE WHEN rank > 0 THEN 4 / sqrt(rank) ELSE 0 END, 6) AS priority FROM {evidence} ORDER BY 10 * confidence + ln(1 + momentum) + ln(1 + citations) + CASE WHEN rank > 0 THEN 4 / sqrt(rank) ELSE 0 END DESC, event_id LIMIT 400")
def o01(evidence: DataFrame) -> DataFrame:
    return O.prioritize_events(evidence, 400).select("event_id", F.round("priority", 6).alias("priority"))


DUE = f"SELECT candidate_id, bool_or(tag = 'manual-roster-deep-dive') AS deep, count(DISTINCT CASE WHEN {COUNTED} AND type <> 'profile_observed' THEN {PUBLIC} END) AS publishers, max(discovered_at) AS latest FROM {{evidence}} GROUP BY 1"


@query("o02_due_brief_work", "candidate", "evidence", oracle=f"SELECT c.candidate_id, e.deep, e.publishers, TIMESTAMP '{NOW}' + INTERVAL 300 SECOND AS lease_until FROM {{candidate}} c JOIN ({DUE}) e USING (candidate_id) WHERE c.status <> 'archived' AND c.resolution = 'resolved' AND e.publishers >= 1 ORDER BY e.deep DESC, e.publishers >= 2 DESC, c.score DESC, e.latest DESC, c.candidate_id LIMIT 30")
def o02(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return O.due_brief_work(candidate, evidence, NOW).select("candidate_id", "deep", "publishers", "lease_until")


@query("o03_due_enrichment_work", "candidate", "evidence", oracle=f"SELECT c.candidate_id, e.deep, e.publishers FROM {{candidate}} c JOIN ({DUE}) e USING (candidate_id) WHERE c.status <> 'archived' ORDER BY e.deep DESC, (e.publishers < 2 AND c.score >= greatest(10, 0.65::DOUBLE * 60)) DESC, least(3, c.candidate_id % 5), c.score DESC, e.publishers, c.candidate_id LIMIT 20")
def o03(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return O.due_enrichment_work(candidate.withColumn("attempts", F.col("candidate_id") % 5), evidence, 60, 20).select("candidate_id", "deep", "publishers")


@query("o04_complete_enrichment", "candidate", oracle=f"SELECT candidate_id, candidate_id % 5 + 1 AS attempts, TIMESTAMP '{NOW}' + CASE WHEN candidate_id % 4 > candidate_id % 3 THEN INTERVAL 0 HOUR WHEN candidate_id % 5 + 1 < 3 THEN INTERVAL 4 HOUR WHEN candidate_id % 7 > 0 THEN INTERVAL 168 HOUR ELSE INTERVAL 720 HOUR END AS next_at FROM {{candidate}}")
def o04(candidate: DataFrame) -> DataFrame:
    x = candidate.select("candidate_id", (F.col("candidate_id") % 5).alias("attempts"), (F.col("candidate_id") % 4).alias("input_revision"), (F.col("candidate_id") % 3).alias("completed_revision"), (F.col("candidate_id") % 7).alias("found"))
    return O.complete_enrichment(x, NOW)


@query("o07_operator_queue_rank", "candidate", "evidence", oracle=f"""SELECT candidate_id, round(rank, 6) AS rank FROM (SELECT c.candidate_id, 0.67::DOUBLE * c.score + 0.16::DOUBLE * 100 * greatest(0, 1 - (epoch(TIMESTAMP '{NOW}') - floor(epoch(e.latest))) / 86400 / 60) + 0.10::DOUBLE * e.strongest * 100 + 0.07::DOUBLE * least(100, 35 * e.publishers) AS rank
FROM {{candidate}} c JOIN (SELECT candidate_id, max(discovered_at) AS latest, max(confidence) AS strongest, count(DISTINCT CASE WHEN {COUNTED} THEN {PUBLIC} END) AS publishers FROM {{evidence}} GROUP BY 1) e USING (candidate_id)) ORDER BY rank DESC, candidate_id LIMIT 24""")
def o07(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return O.operator_queue(candidate, evidence, NOW, 24).select("candidate_id", F.round("rank", 6).alias("rank"))


@query("o08_people_sorts", "candidate", oracle="SELECT candidate_id, row_number() OVER (ORDER BY confidence, score DESC, candidate_id) AS place FROM {candidate} ORDER BY confidence, score DESC, candidate_id LIMIT 50")
def o08(candidate: DataFrame) -> DataFrame:
    return O.people_sorted(candidate, "undiscovered", 50).select("candidate_id", "place")


@query("o09_review_shortlist", "candidate", oracle="""WITH f AS (SELECT candidate_id, 0 AS tier, candidate_id AS o FROM {candidate} WHERE status = 'new' UNION ALL SELECT candidate_id, 1, row_number() OVER (ORDER BY score DESC, candidate_id) FROM {candidate}),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY tier, o) = 1) SELECT candidate_id, tier FROM d ORDER BY tier, o LIMIT 400""")
def o09(candidate: DataFrame) -> DataFrame:
    return O.review_shortlist(candidate, candidate.filter("status = 'new'"), 400).select("candidate_id", "tier")


@query("o10_project_locators", "evidence", oracle="SELECT candidate_id, source_url FROM (SELECT candidate_id, source_url, max(2 * complexity + ln(1 + momentum) / 5) AS s FROM {evidence} WHERE type = 'project_created' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC, source_url) <= 3")
def o10(evidence: DataFrame) -> DataFrame:
    return O.project_locators(evidence).select("candidate_id", "source_url")


@query("o11_recent_events", "evidence", oracle="SELECT event_id, discovered_at FROM {evidence} ORDER BY discovered_at DESC, event_id DESC LIMIT 20")
def o11(evidence: DataFrame) -> DataFrame:
    return evidence.select("event_id", "discovered_at").orderBy(F.desc("discovered_at"), F.desc("event_id")).limit(20)


@query("o12_oldest_ready", "digest_item", oracle="SELECT candidate_id, min(scheduled_for) AS scheduled_for FROM {digest_item} WHERE status = 'ready' GROUP BY 1")
def o12(digest_item: DataFrame) -> DataFrame:
    return digest_item.filter("status = 'ready'").groupBy("candidate_id").agg(F.min("scheduled_for").alias("scheduled_for"))


# Sets


@query("u01_merge_batches", "evidence", oracle="SELECT source_url, event_id FROM {evidence} WHERE source_url NOT IN (SELECT source_url FROM {evidence} WHERE event_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY confidence DESC, event_id) = 1")
def u01(evidence: DataFrame) -> DataFrame:
    batches = [evidence.filter(f"event_id % 3 = {i}") for i in range(3)]
    both = batches[0].unionByName(batches[1]).unionByName(batches[2])
    fresh = both.join(evidence.filter("event_id % 50 = 0").select("source_url"), "source_url", "left_anti")
    return W.dedup_evidence(fresh, "source_url").select("source_url", "event_id")


@query("u02_extend_list", "orders", oracle="SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY p) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_orderkey + 100000000 END) AS p FROM orders GROUP BY ALL) GROUP BY 1")
def u02(orders: DataFrame) -> DataFrame:
    place = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 100000000)
    one = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min(place).alias("p"))
    return one.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ",").alias("priorities"))


@query("u03_novel", "lineitem", "orders", oracle="SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1 AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_suppkey = lineitem.l_suppkey AND k.l_partkey = lineitem.l_partkey AND k.l_linenumber > 1)")
def u03(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    new = lineitem.filter("l_linenumber = 1").select("l_suppkey", "l_partkey").distinct()
    return new.join(lineitem.filter("l_linenumber > 1"), ["l_suppkey", "l_partkey"], "left_anti")


@query("u05_created_vs_updated", "evidence", oracle="SELECT candidate_id, CASE WHEN min(event_id) % 2 = 0 THEN 'created' ELSE 'updated' END AS outcome FROM {evidence} GROUP BY 1")
def u05(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("candidate_id").agg(F.when(F.min("event_id") % 2 == 0, "created").otherwise("updated").alias("outcome"))


# Filters


@query("f01_list_candidates", "candidate", oracle="SELECT candidate_id, round(score, 6) AS score FROM {candidate} WHERE status IN ('new', 'saved') AND (score < 70 OR (score = 70 AND candidate_id < 500)) ORDER BY score DESC, candidate_id DESC LIMIT 100")
def f01(candidate: DataFrame) -> DataFrame:
    return FI.list_candidates(candidate, ["new", "saved"], (70.0, 500), 100).select("candidate_id", F.round("score", 6).alias("score"))


@query("f03_accepted_licensed", "evidence", oracle="SELECT event_id FROM {evidence} WHERE source <> 'people-data-labs' OR (confidence >= 0.8 AND tag IN ('verified-provider-subject', 'model-corroborated-identity'))")
def f03(evidence: DataFrame) -> DataFrame:
    return evidence.filter(S.accepted_licensed()).select("event_id")


@query("f04_post_filters", "candidate", "evidence", oracle="SELECT candidate_id FROM {candidate} c WHERE score >= 40 AND lower(status) IN ('new', 'watching') AND EXISTS (SELECT 1 FROM {evidence} e WHERE e.candidate_id = c.candidate_id AND type IN ('paper_published', 'competition_result')) AND EXISTS (SELECT 1 FROM {evidence} e WHERE e.candidate_id = c.candidate_id AND source = 'github')")
def f04(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return FI.post_filters(candidate, evidence, min_score=40, statuses=["New", "WATCHING"], types=["paper_published", "competition_result"], sources=["github"]).select("candidate_id")


@query("f05_facet_match", "candidate", oracle="SELECT candidate_id FROM {candidate} WHERE lower(stage) IN ('building', 'machinery')")
def f05(candidate: DataFrame) -> DataFrame:
    return candidate.filter(FI.facet_match(F.array("stage"), ["Building", "MACHINERY"])).select("candidate_id")


@query("f06_keyword_all_terms", "documents", oracle="SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")
def f06(documents: DataFrame) -> DataFrame:
    return documents.filter(FI.all_terms(F.col("text"), "The  TION")).select("doc_id")


@query("f07_review_queue_gate", "candidate", "evidence", oracle=f"SELECT c.candidate_id FROM {{candidate}} c JOIN (SELECT candidate_id, count(*) FILTER (WHERE {COUNTED}) AS facts, count(DISTINCT CASE WHEN {COUNTED} THEN {PUBLIC} END) AS publishers FROM {{evidence}} GROUP BY 1) e USING (candidate_id) WHERE status IN ('new', 'watching', 'saved') AND score >= 30 AND facts >= 2 AND publishers >= 2")
def f07(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return FI.review_queue_gate(candidate, evidence, 30).select("candidate_id")


@query("f08_referral_allowed", "candidate", oracle="SELECT candidate_id, resolution = 'resolved' AND confidence >= 0.72 AND NOT regexp_matches(lower(stage), 'school|minor|teen') AS allowed FROM {candidate}")
def f08(candidate: DataFrame) -> DataFrame:
    return candidate.select("candidate_id", FI.referral_allowed().alias("allowed"))


@query("f12_verified_facts", "labels", oracle="SELECT doc_id // 5 AS claim_id, doc_id FROM labels WHERE quality = 1 AND doc_id // 5 IN (SELECT doc_id // 5 FROM labels GROUP BY 1 HAVING count(*) >= 2 AND max(toxic) = 0)")
def f12(labels: DataFrame) -> DataFrame:
    return FI.verified_facts(labels.select(F.floor(F.col("doc_id") / 5).alias("claim_id"), "doc_id", (F.col("quality") == 1).alias("supported"), (F.col("toxic") == 1).alias("conflict"))).select("claim_id", "doc_id")


@query("f14_graph_seed_gate", "candidate", "evidence", oracle="SELECT candidate_id FROM {candidate} JOIN (SELECT candidate_id, count(DISTINCT source) AS sources FROM {evidence} GROUP BY 1) USING (candidate_id) WHERE status <> 'archived' AND score >= 35 AND greatest(confidence, momentum / 32) >= 0.3 AND resolution = 'resolved' ORDER BY score DESC, sources DESC, candidate_id LIMIT 25")
def f14(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return FI.graph_seed_gate(candidate, evidence, 25).select("candidate_id")


@query("f15_introduction_evidence", "evidence", oracle="SELECT event_id FROM {evidence} WHERE confidence >= 0.75 AND type = 'profile_observed' AND regexp_matches(lower(title), '(^| )(of|founder|engineer)( |$)')")
def f15(evidence: DataFrame) -> DataFrame:
    return evidence.filter(FI.introduces()).select("event_id")
