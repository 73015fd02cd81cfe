"""Queries of graphs, identities and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import fold_name, numbered_bigrams
from tessera.functions.store import new_folder
from tessera.operators import graph as G
from tessera.operators import identity as I
from tessera.operators import search as H
from tessera.plans.registry import query


@query("g01_collaboration_edges", "lineitem", oracle="SELECT l_orderkey AS repo, a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY commits DESC, b) AS place, round(least(0.82::DOUBLE, 0.42::DOUBLE + 0.2::DOUBLE * log10(commits + 1)), 6) AS weight FROM (SELECT l_partkey % 100 AS l_orderkey, 'u7' AS a, CASE WHEN l_suppkey % 10 = 0 THEN concat('u', CAST(l_suppkey AS VARCHAR), '-bot') ELSE concat('u', CAST(l_suppkey AS VARCHAR)) END AS b, CAST(sum(l_quantity) AS BIGINT) AS commits FROM lineitem GROUP BY ALL) WHERE b NOT LIKE '%bot' AND b <> 'u7') WHERE place <= 12")
def g01(lineitem: DataFrame) -> DataFrame:
    name = F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))
    c = lineitem.select((F.col("l_partkey") % 100).alias("repo"), F.lit("u7").alias("owner"), F.when(F.col("l_suppkey") % 10 == 0, F.concat(name, F.lit("-bot"))).otherwise(name).alias("contributor"), "l_quantity")
    return G.collaboration_edges(c.groupBy("repo", "owner", "contributor").agg(F.sum("l_quantity").cast("long").alias("commits")))


@query("g02_follow_edges", "edge", oracle="SELECT source_id, target_id, count(*) AS n, CASE WHEN source_id % 2 = 0 THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM {edge} WHERE relation = 'follows' GROUP BY ALL")
def g02(edge: DataFrame) -> DataFrame:
    f = edge.filter("relation = 'follows'").withColumn("provider", F.when(F.col("source_id") % 2 == 0, "x").otherwise("github"))
    return G.follow_edges(f).groupBy("source_id", "target_id", "weight").agg(F.count("*").alias("n"))


@query("g03_reply_edges", "conversations", oracle="SELECT a.conv_id AS thread, a.turn AS post, a.role AS a, b.role AS b, CASE WHEN length(a.text) >= 180 THEN 0.22::DOUBLE ELSE 0.16::DOUBLE END AS weight FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.role <> b.role")
def g03(conversations: DataFrame) -> DataFrame:
    return G.reply_edges(conversations.select(F.col("conv_id").alias("thread"), F.col("turn").alias("post"), (F.col("turn") - 1).alias("parent"), F.col("role").alias("author"), "text"))


@query("g05_identity_components", "supplier", oracle="""WITH RECURSIVE e AS (SELECT s.s_suppkey AS a, t.s_suppkey AS b FROM supplier s JOIN supplier t ON t.s_suppkey = s.s_suppkey + 7 AND t.s_nationkey % 2 = s.s_nationkey % 2), n AS (SELECT a AS id FROM e UNION SELECT b FROM e),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT id, id AS reached FROM n UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reached) SELECT id, min(reached) AS label FROM r GROUP BY id""")
def g05(supplier: DataFrame) -> DataFrame:
    side = supplier.select((F.col("s_suppkey") - 7).alias("a"), F.col("s_suppkey").alias("b"), (F.col("s_nationkey") % 2).alias("half"))
    return G.components(side.join(supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") % 2).alias("half")), ["a", "half"]).select("a", "b"))


@query("g06_support_dedup", "edge", oracle="SELECT source_id, target_id, relation, source_url, round(max(weight), 6) AS weight FROM {edge} GROUP BY ALL")
def g06(edge: DataFrame) -> DataFrame:
    return G.support_dedup(edge).select("source_id", "target_id", "relation", "source_url", F.round("weight", 6).alias("weight"))


@query("g07_graph_candidates", "edge", oracle="""WITH d AS (SELECT source_id, target_id, relation, source_url, max(weight) AS weight FROM {edge} GROUP BY ALL),
s AS (SELECT target_id, count(DISTINCT source_id) AS n, max(weight) AS m, sum(least(1, weight)) AS support, count(DISTINCT relation) AS r, coalesce(sum(weight) FILTER (WHERE relation = 'coauthors_with'), 0) AS co, coalesce(sum(weight) FILTER (WHERE relation = 'collaborates_with'), 0) AS col, coalesce(sum(weight) FILTER (WHERE relation = 'engages_with'), 0) AS eng FROM d GROUP BY 1)
SELECT target_id, n AS sources, round(support, 6) AS support, least(0.82::DOUBLE, round(0.58::DOUBLE + CASE WHEN n >= 2 THEN 0.07::DOUBLE + least(0.05::DOUBLE, (n - 2) * 0.02::DOUBLE) ELSE 0 END + CASE WHEN m >= 0.78 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN co >= 0.34 THEN 0.07::DOUBLE ELSE 0 END + CASE WHEN col >= 0.9 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN eng >= 0.72 THEN 0.04::DOUBLE ELSE 0 END + least(0.04::DOUBLE, (r - 1) * 0.02::DOUBLE), 3)) AS confidence
FROM s WHERE n >= 2 OR m >= 0.78 OR co >= 0.34 OR col >= 0.9 OR eng >= 0.72 ORDER BY 3 DESC, 4 DESC, 1 LIMIT 50""")
def g07(edge: DataFrame) -> DataFrame:
    x = G.graph_candidates(edge, "target_id")
    return x.select("target_id", "sources", F.round("support", 6).alias("support"), "confidence")


@query("g09_expand_frontier", "edge", oracle="""WITH e AS (SELECT source_id, target_id + 1000 * (source_id % 2) AS target_id, relation, source_url, weight, observed_at FROM {edge}),
one AS (SELECT target_id AS id, max(weight) AS m, count(DISTINCT source_id) AS n, sum(weight) AS w FROM (SELECT * FROM e WHERE source_id < 5 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, relation, source_url, observed_at) <= 6) GROUP BY 1),
a AS (SELECT * FROM one WHERE id >= 5 ORDER BY round(w, 6) DESC, id LIMIT 40),
two AS (SELECT target_id AS id, sum(weight) AS w FROM (SELECT e.* FROM e JOIN a ON e.source_id = a.id AND (a.m >= 0.6 OR a.n >= 2 OR a.w >= 0.9) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, relation, source_url, observed_at) <= 6) GROUP BY 1),
b AS (SELECT id FROM two WHERE id >= 5 AND id NOT IN (SELECT id FROM a) ORDER BY round(w, 6) DESC, id LIMIT 40)
SELECT DISTINCT c_custkey AS id, 0 AS depth FROM customer WHERE c_custkey < 5 UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b""")
def g09(edge: DataFrame) -> DataFrame:
    e = edge.withColumn("target_id", F.col("target_id") + 1000 * (F.col("source_id") % 2))
    seeds = edge.sparkSession.range(5)
    return G.expand_frontier(seeds, e, depth=2, nodes=40, per_seed=6)


@query("g10_neighbors", "edge", oracle="""WITH e AS (SELECT source_id AS a, target_id + 100000 AS b, max(weight) AS w FROM {edge} GROUP BY ALL), u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e),
one AS (SELECT b AS id, max(w) AS s FROM u WHERE a = 100003 GROUP BY 1), two AS (SELECT u.b AS id, max(least(one.s, u.w)) AS s FROM one JOIN u ON u.a = one.id WHERE u.b <> 100003 AND u.b NOT IN (SELECT id FROM one) GROUP BY 1)
SELECT * FROM (SELECT id, 1 AS depth, round(s, 6) AS strength FROM one UNION ALL SELECT id, 2, round(s, 6) FROM two) ORDER BY id LIMIT 100""")
def g10(edge: DataFrame) -> DataFrame:
    e = edge.select(F.col("source_id").alias("a"), (F.col("target_id") + 100000).alias("b"), "weight")
    return G.neighbors(e, 100003).select("id", "depth", F.round("strength", 6).alias("strength"))


@query("g11_connections", "edge", oracle="SELECT id, other, relation, round(w, 6) AS weight FROM (SELECT id, other, relation, max(weight) AS w FROM (SELECT source_id AS id, target_id + 100000 AS other, relation, weight FROM {edge} UNION ALL SELECT target_id + 100000, source_id, relation, weight FROM {edge}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, other, relation) <= 20")
def g11(edge: DataFrame) -> DataFrame:
    from tessera.operators.joins import undirected
    from tessera.operators.windows import cap_per_group

    e = edge.select(F.col("source_id").alias("id"), (F.col("target_id") + 100000).alias("other"), "relation", "weight")
    best = undirected(e, "id", "other").groupBy("id", "other", "relation").agg(F.max("weight").alias("weight"))
    return cap_per_group(best, ["id"], [F.desc("weight"), F.asc("other"), F.asc("relation")], 20).withColumn("weight", F.round("weight", 6))


@query("g12_upsert_nodes_edges", "edge", oracle="SELECT source_id, target_id, count(*) AS n, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM {edge} WHERE source_id <> target_id GROUP BY ALL")
def g12(edge: DataFrame) -> DataFrame:
    from tessera.functions.store import upsert

    daily = edge.filter("source_id <> target_id").groupBy("source_id", "target_id", (F.col("relation") == "follows").alias("late")).agg(F.count("*").alias("n"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    old, new = daily.filter("NOT late").drop("late"), daily.filter("late").drop("late")
    both = upsert(old, new, ["source_id", "target_id"], [], first="first_seen", last="last_seen")
    return both.drop("n").join(daily.groupBy("source_id", "target_id").agg(F.sum("n").alias("n")), ["source_id", "target_id"])


# Identities

OBS = "SELECT s_suppkey AS observation_id, s_name AS name, concat('https://www.', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS VARCHAR(20)), '.example/') AS website, concat('p', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) * 3 AS VARCHAR(20))) AS subject, s_suppkey % 2 = 0 AS verified, CAST(s_nationkey AS VARCHAR(20)) AS location, concat('University of N', CAST(s_nationkey % 7 AS VARCHAR(20))) AS org, s_suppkey % 13 AS candidate_id FROM supplier"
IDS = "SELECT c_custkey AS identity_id, replace(c_name, 'Customer', 'Supplier') AS name, concat('http://', CAST(CAST(floor(c_custkey / 15) AS BIGINT) AS VARCHAR(20)), '.example') AS website, concat('p', CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS VARCHAR(20))) AS subject, c_custkey % 3 <> 0 AS verified, CAST(c_nationkey AS VARCHAR(20)) AS location, concat('N', CAST(c_nationkey % 5 AS VARCHAR(20)), ' Labs') AS org, c_custkey % 11 AS candidate_id FROM customer"
FOLD = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
PAIRS_SQL = f"""o AS ({OBS}), i AS ({IDS}),
ok AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(website, '^https?://([^/?#:]+)', 1)), '^www[.]', ''), '/+$', '') AS site, {FOLD.format('name')} AS fold FROM o),
ik AS (SELECT *, lower(regexp_extract(website, '^https?://([^/?#:]+)', 1)) AS site, {FOLD.format('name')} AS fold FROM i),
pairs AS (SELECT observation_id, identity_id FROM ok JOIN ik USING (subject) UNION SELECT observation_id, identity_id FROM ok JOIN ik USING (site) UNION SELECT observation_id, identity_id FROM ok JOIN (SELECT * FROM ik QUALIFY row_number() OVER (PARTITION BY fold ORDER BY identity_id) <= 10) ik USING (fold))"""
BIG = "list_transform(range(1, length({0})), lambda k: substr({0}, CAST(k AS INT), 2))"
SCORED_SQL = f"""{PAIRS_SQL},
w AS (SELECT p.*, ok.subject = ik.subject AS exact, ok.verified AND ik.verified AS ver, ok.site = ik.site AS site, ok.location = ik.location AS place,
    right(ok.org, 2) = left(ik.org, 2) AS org, ok.fold AS a, ik.fold AS b FROM pairs p JOIN ok USING (observation_id) JOIN ik USING (identity_id)),
v AS (SELECT *, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * list_sum(list_transform(list_distinct({BIG.format('a')}), lambda g: least(len(list_filter({BIG.format('a')}, lambda e: e = g)), len(list_filter({BIG.format('b')}, lambda e: e = g))))) / (length(a) + length(b) - 2) END AS d FROM w),
scored AS (SELECT observation_id, identity_id, CASE WHEN exact THEN CASE WHEN ver THEN 1.0::DOUBLE ELSE 0.92::DOUBLE END ELSE least(1.0::DOUBLE, d * 0.38::DOUBLE + CASE WHEN site THEN 0.48::DOUBLE ELSE 0 END + CASE WHEN org THEN 0.24::DOUBLE ELSE 0 END + CASE WHEN place THEN 0.08::DOUBLE ELSE 0 END) END AS score,
    CASE WHEN exact THEN ver ELSE site AND d > 0.82 END AS durable,
    CASE WHEN exact THEN CASE WHEN ver THEN 'exact subject' ELSE 'unverified subject' END ELSE concat_ws(', ', CASE WHEN d = 1 THEN 'exact name' WHEN d > 0.82 THEN 'similar name' END, CASE WHEN site THEN 'website' END, CASE WHEN org THEN 'affiliation' END, CASE WHEN place THEN 'location' END) END AS reasons FROM v)"""


def _sides(supplier: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = supplier.sparkSession
    o = spark.sql(OBS.replace("FROM supplier", "FROM {supplier}"), supplier=supplier).withColumn("affiliations", F.array("org")).drop("org")
    i = spark.sql(IDS.replace("FROM customer", "FROM {customer}"), customer=customer).withColumn("affiliations", F.array("org")).drop("org")
    return o, i


def _scored(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    o, i = _sides(supplier, customer)
    return I.score_pairs(I.candidate_pairs(o, i), o, i)


ALIKE = "trim(regexp_replace(lower(concat(p_name, ' ', p_type)), '[^a-z0-9]+', ' ', 'g'))"


@query("c09_dice_names", "part", oracle=f"""WITH f AS (SELECT DISTINCT p_brand AS site, {ALIKE} AS n, concat(p_brand, ' ', {ALIKE}) AS id FROM part),
g AS (SELECT *, {BIG.format('n')} AS g FROM f)
SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.site = b.site AND a.id < b.id WHERE 2.0::DOUBLE * list_sum(list_transform(list_distinct(a.g), lambda x: least(len(list_filter(a.g, lambda y: y = x)), len(list_filter(b.g, lambda y: y = x))))) / (length(a.n) + length(b.n) - 2) > 0.82""")
def c09(part: DataFrame) -> DataFrame:
    """Names of a brand's parts that are alike; a name meets only those that share one of its rarest bigrams."""
    name = F.concat_ws(" ", "p_name", "p_type")
    f = part.select(F.col("p_brand").alias("site"), fold_name(name).alias("name")).distinct().select("site", "name", F.concat_ws(" ", "site", "name").alias("id"), numbered_bigrams(F.col("name")).alias("grams"))
    o = f.select(F.col("id").alias("observation_id"), F.col("site").alias("o_site"), F.col("name").alias("o_name"), F.col("grams").alias("o_grams"))
    i = f.select(F.col("id").alias("identity_id"), F.col("site").alias("i_site"), F.col("name").alias("i_name"), F.col("grams").alias("i_grams"))
    return I.similar_pairs(o, i).filter("observation_id < identity_id").select(F.col("observation_id").alias("a"), F.col("identity_id").alias("b"))


@query("i01_candidate_pairs", "supplier", "customer", oracle=f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def i01(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    return I.candidate_pairs(*_sides(supplier, customer))


@query("i02_score_pairs", "supplier", "customer", oracle=f"WITH {SCORED_SQL} SELECT observation_id, identity_id, round(score, 6) AS score, durable, reasons FROM scored")
def i02(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    return _scored(supplier, customer).withColumn("score", F.round("score", 6))


@query("i03_decide", "supplier", "customer", oracle=f"WITH {SCORED_SQL}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY score DESC, durable DESC, identity_id) = 1), d AS (SELECT o.observation_id, CASE WHEN score >= 0.92 AND durable THEN 'match' WHEN score >= 0.52 THEN 'review' ELSE 'create' END AS action, identity_id, score FROM o LEFT JOIN best USING (observation_id)) SELECT observation_id, action, CASE WHEN action <> 'create' THEN identity_id ELSE -1 END AS identity_id, round(CASE WHEN score IS NULL THEN 0.9 WHEN action = 'create' THEN greatest(0.55, 1 - score) ELSE score END, 6) AS confidence FROM d")
def i03(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    o, _ = _sides(supplier, customer)
    return I.decide(o, _scored(supplier, customer)).withColumn("confidence", F.round("confidence", 6)).fillna(-1, ["identity_id"])


@query("i04_reviewable_pairs", "supplier", "customer", oracle=f"WITH {SCORED_SQL} SELECT observation_id, identity_id FROM scored WHERE score >= 0.3 AND contains(reasons, 'name') QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY score DESC, identity_id) <= 2")
def i04(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    return I.reviewable_pairs(_scored(supplier, customer)).select("observation_id", "identity_id")


VERDICTS = "SELECT doc_id AS verdict_id, doc_id // 3 AS observation_id, CASE WHEN quality = 1 THEN 'match' WHEN doc_id % 2 = 0 THEN 'different' ELSE 'unclear' END AS verdict, toxic AS conflicts, CAST(60 + doc_id % 40 AS DOUBLE) / 100 AS confidence, doc_id % 3 AS strong_signals, doc_id % 4 AS signals FROM labels"
POLICY = f"SELECT *, CASE WHEN verdict = 'match' AND conflicts = 0 AND confidence >= 0.8 AND strong_signals >= 1 AND (signals >= 2 OR confidence >= 0.85) THEN 'match' WHEN verdict = 'different' THEN 'different' ELSE 'review' END AS decision FROM ({VERDICTS})"


def _verdicts(labels: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return labels.select(i.alias("verdict_id"), F.floor(i / 3).alias("observation_id"), F.when(F.col("quality") == 1, "match").when(i % 2 == 0, "different").otherwise("unclear").alias("verdict"), F.col("toxic").alias("conflicts"), ((60 + i % 40).cast("double") / 100).alias("confidence"), (i % 3).alias("strong_signals"), (i % 4).alias("signals"))


@query("i05_match_policy", "labels", oracle=f"SELECT verdict_id, decision FROM ({POLICY})")
def i05(labels: DataFrame) -> DataFrame:
    return I.match_policy(_verdicts(labels)).select("verdict_id", "decision")


@query("i06_combine_reviews", "labels", oracle=f"SELECT observation_id, CASE WHEN m = 1 AND r = 0 THEN 'match' WHEN m > 0 OR r > 0 THEN 'review' ELSE 'create' END AS action FROM (SELECT observation_id, count(*) FILTER (WHERE decision = 'match') AS m, count(*) FILTER (WHERE decision = 'review') AS r FROM ({POLICY}) GROUP BY 1)")
def i06(labels: DataFrame) -> DataFrame:
    v = I.match_policy(_verdicts(labels))
    return I.combine_reviews(v.select("observation_id").distinct().withColumn("action", F.lit("create")), v)


@query("i07_bind_in_batch", "supplier", "customer", oracle=f"WITH o AS ({OBS}) SELECT observation_id, CASE WHEN verified THEN min(observation_id) FILTER (WHERE verified) OVER (PARTITION BY subject) ELSE observation_id END AS bound_to FROM o")
def i07(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    return I.bind_in_batch(_sides(supplier, customer)[0])


@query("i08_upsert_identities", "supplier", "customer", oracle=f"WITH e AS (SELECT subject, min(candidate_id) AS c FROM ({IDS}) GROUP BY 1), n AS (SELECT subject, max(candidate_id) AS c FROM ({OBS}) GROUP BY 1) SELECT subject, coalesce(e.c, n.c) AS candidate_id, CASE WHEN e.c <> n.c THEN 'ambiguous' WHEN coalesce(e.c, n.c) IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status FROM e FULL JOIN n USING (subject)")
def i08(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    o, i = _sides(supplier, customer)
    return I.upsert_identities(i.groupBy("subject").agg(F.min("candidate_id").alias("candidate_id")), o.groupBy("subject").agg(F.max("candidate_id").alias("candidate_id")))


@query("i09_hypotheses", "supplier", "customer", oracle=f"WITH e AS (SELECT subject, min(candidate_id) AS bound FROM ({IDS}) GROUP BY 1) SELECT o.observation_id % 100 AS confidence_pct, o.subject, o.candidate_id, CASE WHEN e.bound <> o.candidate_id THEN 0.5::DOUBLE ELSE least(0.75::DOUBLE, o.observation_id % 100 / 100) END AS score FROM ({OBS}) o LEFT JOIN e USING (subject) WHERE NOT verified OR e.bound <> o.candidate_id".replace("o.observation_id % 100 AS confidence_pct, ", ""))
def i09(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    o, i = _sides(supplier, customer)
    return I.hypotheses(o.withColumn("confidence", F.col("observation_id") % 100 / 100), i.groupBy("subject").agg(F.min("candidate_id").alias("candidate_id")))


@query("i10_review_decision", "orders", oracle="SELECT identity_id, CASE WHEN a > 0 THEN 'resolved' WHEN p > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN a > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM (SELECT o_custkey AS identity_id, count(*) FILTER (WHERE o_orderstatus = 'P') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS p FROM orders GROUP BY 1)")
def i10(orders: DataFrame) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", "accepted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("rejected")
    return I.review_decision(orders.select(F.col("o_custkey").alias("identity_id"), state.alias("state"), F.col("o_orderkey").alias("candidate_id"), F.col("o_orderdate").alias("decided_at")))


@query("i12_match_author", "supplier", "customer", oracle="SELECT s_suppkey AS author_id, min(c_custkey) AS person_id FROM supplier JOIN customer ON right(s_name, 9) = right(c_name, 9) AND s_nationkey % 3 = c_nationkey % 3 GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1")
def i12(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    a = supplier.select(F.col("s_suppkey").alias("author_id"), F.substring("s_name", -9, 9).alias("name"), F.concat(F.lit("Institute "), F.col("s_nationkey") % 3, F.lit(" of Study")).alias("institution"))
    p = customer.select(F.col("c_custkey").alias("person_id"), F.substring("c_name", -9, 9).alias("name"), F.concat(F.lit("institute "), F.col("c_nationkey") % 3).alias("institution"))
    return I.match_author(a, p)


# Search


def _first(embeddings: DataFrame) -> list[float]:
    """The vector of the first row, which stands for a caller's query."""
    return list(embeddings.orderBy("vec_id").select("embedding").first()[0])


COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query("h01_vector_topk", "embeddings", oracle=f"SELECT vec_id, round({COS}, 5) AS similarity FROM embeddings e, {FIRST} WHERE {COS} >= 0.1 ORDER BY {COS} DESC, vec_id LIMIT 20")
def h01(embeddings: DataFrame) -> DataFrame:
    return H.vector_topk(embeddings, _first(embeddings), 0.1, 20).select("vec_id", F.round("similarity", 5).alias("similarity"))


def _text_index(documents: DataFrame) -> H.TextIndex:
    return H.TextIndex.build(documents, new_folder(documents.sparkSession, "text-index"))


LEX = """t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS tf0, len(list_filter(t, lambda x: x = 'von')) AS tf1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM n),
b AS (SELECT doc_id, ln(1 + (docs - df0 + 0.5::DOUBLE) / (df0 + 0.5::DOUBLE)) * tf0 * 2.2::DOUBLE / (tf0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) + ln(1 + (docs - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE)) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS x FROM n, s),
l AS (SELECT doc_id, x / (x + 1) AS text_rank FROM b WHERE x > 0)"""


@query("h03_lexical_rank", "documents", oracle=f"WITH {LEX} SELECT doc_id, round(text_rank, 6) AS text_rank FROM l")
def h03(documents: DataFrame) -> DataFrame:
    return H.lexical_rank(_text_index(documents), "The von").withColumn("text_rank", F.round("text_rank", 6))


@query("h02_hybrid_search", "documents", "embeddings", oracle=f"WITH {LEX}, v AS (SELECT vec_id AS doc_id, {COS} AS cosine FROM embeddings e, {FIRST}), f AS (SELECT doc_id, coalesce(cosine, 0) AS cosine, coalesce(text_rank, 0) AS text_rank, doc_id % 100 AS score FROM v FULL JOIN l USING (doc_id)) SELECT doc_id, round(0.65::DOUBLE * cosine + 0.35::DOUBLE * least(1, 4 * text_rank) + least(0.08::DOUBLE, 0.08::DOUBLE * score / 100), 5) AS fused FROM f WHERE cosine > 0 OR text_rank > 0 ORDER BY round(0.65::DOUBLE * cosine + 0.35::DOUBLE * least(1, 4 * text_rank) + least(0.08::DOUBLE, 0.08::DOUBLE * score / 100), 6) DESC, score DESC, doc_id LIMIT 20")
def h02(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    scores = documents.select("doc_id", (F.col("doc_id") % 100).cast("double").alias("score"))
    return H.hybrid_search(_text_index(documents), embeddings, scores, "The von", _first(embeddings)).select("doc_id", F.round("fused", 5).alias("fused"))


@query("h06_batch_search", "embeddings", oracle="SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(" + COS + ", 6) DESC, e.vec_id) AS place FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id QUALIFY place <= 10")
def h06(embeddings: DataFrame) -> DataFrame:
    return H.batch_search(_queries(embeddings), embeddings).select("query_id", "vec_id", "place")


def _queries(embeddings: DataFrame) -> DataFrame:
    return embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))


@query("h07_ann_index", "embeddings")
def h07(embeddings: DataFrame) -> DataFrame:
    index = H.VectorIndex.build(embeddings, new_folder(embeddings.sparkSession, "vectors"))
    return index.search(_queries(embeddings)).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "place")
