"""Queries of requests, merged persons, fact templates, identifiers and what SQL users call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.functions import session
from tessera.functions.store import new_folder
from tessera.operators import graph as G
from tessera.operators import requests as Q
from tessera.operators.search import TextIndex
from tessera.plans import graph_queries  # noqa: F401  (its SQL is used again)
from tessera.plans.registry import ORACLES, QUERIES, query
from tessera.plans.relational_queries import EARLY
from tessera.sources.landing import read_landing

ASKED = "SELECT conv_id * 1000 + turn AS query_id, concat(CASE turn % 5 WHEN 1 THEN 'early ' WHEN 2 THEN 'fast rising ' WHEN 3 THEN 'Low Profile c++ ' ELSE '' END, text) AS text, CASE WHEN turn % 4 > 0 THEN turn * 40 - 60 END AS asked_limit FROM {conversations} WHERE role = 'user'"


@query("h04_parse_queries", "conversations", oracle=f"""WITH a AS (SELECT query_id, coalesce(substr(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), ' +', ' ', 'g')), 1, 1000), '') AS s, CAST(greatest(1, least(100, coalesce(asked_limit, 20))) AS INT) AS asked_limit FROM ({ASKED})),
w AS (SELECT query_id, unnest(string_split_regex(lower(s), '[^a-z0-9+#.-]+')) AS w, generate_subscripts(string_split_regex(lower(s), '[^a-z0-9+#.-]+'), 1) AS i FROM a),
f AS (SELECT query_id, w, min(i) AS i FROM w WHERE length(w) >= 2 GROUP BY query_id, w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(i)) <= 20),
k AS (SELECT query_id, string_agg(w, ' ' ORDER BY i) AS keywords FROM f GROUP BY 1)
SELECT query_id, length(s) AS chars, coalesce(keywords, '') AS keywords, CASE WHEN regexp_matches(lower(s), 'under[- ]?discovered|early|unknown|low profile') THEN 'earlyness' WHEN regexp_matches(lower(s), 'fast|trajectory|momentum|rising') THEN 'trajectory' ELSE 'relevance' END AS sort_intent, asked_limit FROM a LEFT JOIN k USING (query_id)""")
def h04(conversations: DataFrame) -> DataFrame:
    asked = conversations.sparkSession.sql(ASKED.replace("VARCHAR", "STRING"), conversations=conversations)
    return Q.parse_queries(asked).select("query_id", F.length("semantic").alias("chars"), F.array_join("keywords", " ").alias("keywords"), "sort_intent", "asked_limit")


@query("h05_merge_filters", "customer", oracle="SELECT c_custkey AS query_id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'explicit' WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS stage, CASE WHEN c_custkey % 5 = 0 THEN 50.0::DOUBLE ELSE c_acctbal END AS min_score, c_nationkey AS location FROM customer")
def h05(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    parsed = customer.select(k.alias("query_id"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("stage"), F.col("c_acctbal").alias("min_score"), F.col("c_nationkey").alias("location"))
    explicit = customer.filter(k % 5 == 0).select(k.alias("query_id"), F.when(k % 2 == 0, "explicit").alias("stage"), F.lit(50.0).alias("min_score"))
    return Q.merge_filters(parsed, explicit)


PEOPLE = """SELECT CAST(floor(c_custkey / 5) AS BIGINT) AS component, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS headline, CASE WHEN c_custkey % 4 = 1 THEN 'Lives there.' ELSE '' END AS biography,
CASE WHEN c_custkey % 7 < 3 THEN concat('https://', CAST(c_custkey AS VARCHAR(20)), '.example') END AS website, CASE WHEN c_nationkey > 4 THEN CAST(c_nationkey AS VARCHAR(20)) END AS location, c_custkey, concat('https://e.example/', CAST(c_custkey AS VARCHAR(20))) AS source_url,
CASE WHEN c_custkey % 2 = 0 THEN concat('https://pic.example/', CAST(c_custkey AS VARCHAR(20))) END AS avatar_url, CASE WHEN c_custkey % 8 = 3 THEN 'student' END AS career_stage FROM {customer}"""


@query("g08_merge_component_person", "customer", oracle=f"""WITH p AS (SELECT *, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 3 END AS ids, c_custkey % 3 AS affs FROM ({PEOPLE})),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY component ORDER BY ids * 4 + CASE WHEN headline IS NULL THEN 0 ELSE 2 END + CASE WHEN biography = '' THEN 0 ELSE 2 END + CASE WHEN website IS NULL THEN 0 ELSE 2 END + CASE WHEN location IS NULL THEN 0 ELSE 1 END + affs DESC, name, source_url) = 1),
i AS (SELECT component, concat('github:g', CAST(c_custkey % 3 AS VARCHAR)) AS i FROM p UNION SELECT component, concat('x:x', CAST(c_custkey AS VARCHAR)) FROM p WHERE ids = 3 AND c_custkey % 2 = 0),
n AS (SELECT component, string_agg(i, ' ' ORDER BY i) AS identities FROM i GROUP BY 1)
SELECT component, name, headline, biography, website, location, avatar_url, career_stage, affs, identities, observations FROM b JOIN n USING (component) JOIN (SELECT component, count(*) AS observations FROM p GROUP BY 1) USING (component)""")
def g08(customer: DataFrame) -> DataFrame:
    p = customer.sparkSession.sql(PEOPLE, customer=customer)
    k = F.col("c_custkey").cast("string")
    identity = lambda provider, subject, ok: F.struct(F.lit(provider).alias("provider"), subject.alias("subject"), ok.alias("verified"))
    first = identity("github", F.concat(F.lit("G"), (F.col("c_custkey") % 3).cast("string")), F.lit(True))
    three = F.array(first, identity("x", F.concat(F.lit("x"), k), F.col("c_custkey") % 2 == 0), identity("email", k, F.lit(True)))
    affiliations = F.array_repeat(F.lit("A place"), (F.col("c_custkey") % 3).cast("int"))
    out = G.merge_component_person(p.withColumn("identities", F.when(F.col("c_custkey") % 6 == 0, F.array(first)).otherwise(three)).withColumn("affiliations", affiliations))
    shown = F.array_join(F.transform("identities", lambda i: F.concat_ws(":", i["provider"], i["subject"])), " ")
    return out.select("component", "name", "headline", "biography", "website", "location", "avatar_url", "career_stage", F.size("affiliations").cast("long").alias("affs"), shown.alias("identities"), "observations")


@query("c06_profile_urls", "customer", oracle="SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1, 5) THEN concat('https://www.linkedin.com/in/u-', CAST(c_custkey AS VARCHAR)) END AS url FROM customer")
def c06(customer: DataFrame) -> DataFrame:
    forms = ("https://linkedin.com/in/u-{}", "https://WWW.LinkedIn.com/in/u-{}/?trk=x", "http://linkedin.com/in/u-{}", "https://linkedin.com/company/u-{}", "https://linkedin.com.example/in/u-{}", "https://www.linkedin.com/in/u-{}#about")
    url = F.coalesce(*[F.when(F.col("c_custkey") % 6 == n, F.concat(F.lit(f.split("{}")[0]), F.col("c_custkey").cast("string"), F.lit(f.split("{}")[1]))) for n, f in enumerate(forms)])
    return customer.select("c_custkey", E.profile_url_ok(url).alias("url"))


@query("c07_author_keys", "lineitem", oracle="SELECT l_orderkey, l_linenumber, concat('10.5555/ab.', CAST(l_orderkey AS VARCHAR)) AS doi, l_linenumber AS place FROM lineitem WHERE l_orderkey % 10 <> 3")
def c07(lineitem: DataFrame) -> DataFrame:
    """Author keys made and read back; where the DOI is none, there is no key."""
    doi = F.concat(F.when(F.col("l_orderkey") % 10 == 3, "11.1/").otherwise("https://doi.org/10.5555/AB."), F.col("l_orderkey").cast("string"))
    back = lineitem.select("l_orderkey", "l_linenumber", E.parse_doi_author_key(E.doi_author_key(doi, "l_linenumber")).alias("k"))
    return back.filter("k IS NOT NULL").select("l_orderkey", "l_linenumber", "k.doi", "k.place")


@query("c20_near_facts", "part", oracle="""WITH p AS (SELECT p_partkey, concat(p_name, ' ', p_brand, ' ', p_type) AS f FROM part), w AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(f), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS w FROM p)
SELECT a.p_partkey, len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.72 AS near FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1""")
def c20(part: DataFrame) -> DataFrame:
    p = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("f"))
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("f").alias("g"))
    return p.join(after, "p_partkey").select("p_partkey", E.near_duplicate_fact("f", "g").alias("near"))


@query("c23_rough_names", "customer", "nation", oracle="SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE lower(n_name) NOT LIKE '% %' END AS agree FROM customer JOIN nation ON c_nationkey = n_nationkey")
def c23(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """A name against itself turned round, with a middle name, with another family name, and a single name against a longer one."""
    x = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    left = F.when(k == 3, F.col("n_name")).otherwise(F.concat(F.lit("Mara K"), key))
    right = F.when(k == 0, F.concat(F.lit("K"), key, F.lit(", mara"))).when(k == 1, F.concat(F.lit("Mara Jo K"), key)).when(k == 2, F.lit("Mara Other")).otherwise(F.concat(F.substring_index("n_name", " ", 1), F.lit(" Q")))
    return x.select("c_custkey", E.names_roughly_match(left, right).alias("agree"))


TH = "concat(CAST({0} AS VARCHAR), CASE WHEN {0} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {0} % 10 = 1 THEN 'st' WHEN {0} % 10 = 2 THEN 'nd' WHEN {0} % 10 = 3 THEN 'rd' ELSE 'th' END)"


@query("c24_fact_templates", "customer", oracle=f"""WITH x AS (SELECT c_custkey, c_name AS n, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS a, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 130 + 1 ELSE 0 END AS r, CASE WHEN c_custkey % 5 < 2 THEN 'gold' END AS g FROM customer)
SELECT c_custkey, CASE WHEN r = 0 AND g IS NULL AND a IS NULL THEN '' ELSE concat(n, CASE WHEN a IS NULL THEN ' competed at the finals.' ELSE concat(' represented ', a, ' at the finals.') END, ' ', n,
  CASE WHEN r > 0 AND g IS NOT NULL THEN concat(' placed ', {TH.format('r')}, ' overall and earned gold recognition.') WHEN r > 0 THEN concat(' placed ', {TH.format('r')}, ' overall in the official results.') WHEN g IS NOT NULL THEN ' earned gold recognition.' ELSE ' appears in the official the finals results.' END) END AS roster,
  CASE WHEN c_custkey % 4 < 2 THEN concat('The directory lists ', c_custkey, ' years of weaving for ', n, '.') END AS licensed FROM x""")
def c24(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    rank, award = F.when(k % 3 > 0, k % 130 + 1).otherwise(0), F.when(k % 5 < 2, "Gold")
    roster = E.roster_facts("c_name", F.lit("the finals"), F.when(k % 2 == 0, F.col("c_mktsegment")), rank, award)
    listed = F.concat(F.lit("About: nothing\n"), F.when(k % 4 < 2, F.concat(F.lit("Work history:  "), k.cast("string"), F.lit(" years of weaving; then more\n"))).otherwise(""), F.lit("Education:"))
    return customer.select("c_custkey", F.array_join(roster, " ").alias("roster"), E.licensed_fact("c_name", listed, "The directory").alias("licensed"))


@query("k01_fold_unicode", "conversations", oracle="SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS folded FROM conversations")
def k01(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", session.fold_unicode("text").alias("folded"))


@query("k04_links_in_sql", "pages", oracle="SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY 1")
def k04(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    session.register(spark, {"pages": pages})
    return spark.sql("SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM pages, LATERAL extract_links(html) GROUP BY page_id")


@query("k06_session_views", "embeddings", "candidate", oracle="""WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT e.vec_id, c.status, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings e, q, {candidate} c WHERE c.candidate_id = e.vec_id AND list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) >= 0.05""")
def k06(embeddings: DataFrame, candidate: DataFrame) -> DataFrame:
    spark = embeddings.sparkSession
    session.register(spark, {"embeddings": embeddings, "candidates": candidate})
    asked = "SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1"
    return spark.sql(f"SELECT s.vec_id, c.status, round(s.similarity, 5) AS similarity FROM ({asked}) q, LATERAL search_vectors(q.embedding, 0.05D) s JOIN candidates c ON c.candidate_id = s.vec_id")


def k06_hybrid(spark, sf_dir: str) -> DataFrame:
    """Hybrid search as SQL users call it."""
    documents, embeddings = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings"))
    scores = documents.select("doc_id", (F.col("doc_id") % 100).cast("double").alias("score"))
    session.register(spark, {"embeddings": embeddings, "scores": scores}, TextIndex.build(documents, new_folder(spark, "text-index")))
    return spark.sql("SELECT doc_id, round(fused, 5) AS fused FROM hybrid_search('The von', (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), 20)")


QUERIES["k06_hybrid_search_sql"] = k06_hybrid
ORACLES["k06_hybrid_search_sql"] = ORACLES["h02_hybrid_search"]


@query("k06_digest_rank_sql", "candidate", "evidence", "digest_item")
def k06_digest(candidate: DataFrame, evidence: DataFrame, digest_item: DataFrame) -> DataFrame:
    """The digest's ranking as SQL users call it."""
    session.register(candidate.sparkSession, {"candidates": candidate, "evidence": evidence, "digest_items": digest_item})
    return candidate.sparkSession.sql(f"SELECT candidate_id, status, round(digest_rank_score, 6) AS digest_rank_score, discovered_at FROM rank_for_digest(TIMESTAMP '{EARLY}', 60D, 20, 21)")


ORACLES["k06_digest_rank_sql"] = ORACLES["d01_digest_rank"]


def s02(spark, sf_dir: str) -> DataFrame:
    landed = read_landing(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp, event_type string")
    return landed.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


QUERIES["s02_read_landing"] = s02
ORACLES["s02_read_landing"] = "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1"
